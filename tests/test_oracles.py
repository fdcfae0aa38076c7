"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from terralane.plans import registry

DATA = Path("/root/testdata/sf0.001")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for table in DATA.glob("*.parquet"):
        connection.execute(f"create view {table.stem} as select * from '{table}'")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(
        (tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=repr
    )


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, str(DATA)).toPandas()
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
