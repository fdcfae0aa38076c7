"""Well-known binary of geometries, either byte order."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame

from terralane.functions.geometries import GEOMETRY

# Type codes of the format.
CODES = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3, "MULTIPOINT": 4, "MULTILINESTRING": 5, "MULTIPOLYGON": 6}
NAMES = {v: k for k, v in CODES.items()}


def parse(data: bytes) -> tuple[str, list]:
    """(type, parts); the rings of all polygons of a multi-polygon follow each other."""
    kind, parts, _ = _read(data, 0)
    return kind, parts


def _read(data: bytes, at: int) -> tuple[str, list, int]:
    order = "<" if data[at] else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    if code not in NAMES:
        raise ValueError(f"unknown geometry code {code}")
    at += 5

    def count():
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", data, at - 4)[0]

    def points(n):
        nonlocal at
        flat = struct.unpack_from(f"{order}{2 * n}d", data, at)
        at += 16 * n
        return list(zip(flat[::2], flat[1::2], strict=True))

    if code == 1:
        return NAMES[code], [points(1)], at
    if code == 2:
        return NAMES[code], [points(count())], at
    if code == 3:
        return NAMES[code], [points(count()) for _ in range(count())], at
    parts = []
    for _ in range(count()):
        _, inner, at = _read(data, at)
        parts += inner
    return NAMES[code], parts, at


def emit(kind: str, parts: list, holes_follow: bool = True) -> bytes:
    """Little-endian bytes; a multi-polygon's rings are grouped by their turn."""
    head = lambda k: struct.pack("<BI", 1, CODES[k])
    flat = lambda ps: struct.pack(f"<{2 * len(ps)}d", *(c for p in ps for c in p))
    counted = lambda ps: struct.pack("<I", len(ps)) + flat(ps)
    if kind == "POINT":
        return head(kind) + flat(parts[0])
    if kind == "LINESTRING":
        return head(kind) + counted(parts[0])
    if kind == "POLYGON":
        return head(kind) + struct.pack("<I", len(parts)) + b"".join(map(counted, parts))
    if kind == "MULTIPOLYGON":
        groups: list[list] = []
        for ring in parts:
            area = sum((b[0] - a[0]) * (b[1] + a[1]) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
            if area > 0 or not groups:
                groups.append([])
            groups[-1].append(ring)
        return head(kind) + struct.pack("<I", len(groups)) + b"".join(emit("POLYGON", g) for g in groups)
    single = kind.removeprefix("MULTI")
    return head(kind) + struct.pack("<I", len(parts)) + b"".join(emit(single, [p]) for p in parts)


def _with(layer: DataFrame, name: str, kind: str, source: str, make) -> DataFrame:
    """``layer`` with a column made of each value of another one."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([*layer.schema.fields]).add(name, _parse_datatype_string(kind))
    at = layer.columns.index(source)
    made = to_arrow_type(schema[name].dataType)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values = [None if v is None else make(v) for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, made)], [*batch.schema.names, name])

    return layer.mapInArrow(run, schema)


def to_wkb(layer: DataFrame, geom: str = "geom") -> DataFrame:
    """Add wkb; other columns stay, a null geometry gives null."""
    make = lambda g: emit(g["type"], [[(p["x"], p["y"]) for p in part] for part in g["parts"]])
    return _with(layer, "wkb", "binary", geom, make)


def from_wkb(layer: DataFrame, column: str = "wkb") -> DataFrame:
    """Add geom out of a binary column."""
    def make(data):
        kind, parts = parse(data)
        return {"type": kind, "parts": [[{"x": x, "y": y} for x, y in part] for part in parts]}

    return _with(layer, "geom", GEOMETRY, column, make)
