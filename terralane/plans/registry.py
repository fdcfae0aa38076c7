"""Every query of the library by name, and its SQL where SQL can say it."""

from __future__ import annotations

from . import files, graphs, interfaces, more, rows, scalars, space, tracks

_PARTS = (tracks, scalars, space, graphs, files, more, rows, interfaces)


def queries() -> dict:
    return {name: run for part in _PARTS for name, (run, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
