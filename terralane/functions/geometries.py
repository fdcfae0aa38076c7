"""Geometries as struct<type, parts>: parts is an array of rings or lines of points.

Points of a multi-point are parts of one point. For polygons a clockwise part starts a
polygon and the counter-clockwise parts after it are its holes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"
GEOMETRY = f"struct<type:string,parts:array<{POINTS}>>"
#: Square metres of a square degree, for areas in degrees.
SQUARE_DEGREE = 9101160000.085981


def _pairs(ring: Column, closed: bool = False) -> Column:
    n = F.size(ring)
    count = n if closed else n - 1
    steps = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, (i + 1) % n).alias("b")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def ring_area(ring: Column, geographic: bool = False) -> Column:
    """Signed trapezoid area, clockwise positive; degrees are turned into square metres."""
    area = _total(
        F.transform(
            _pairs(ring, closed=True),
            lambda p: (p["b"]["x"] - p["a"]["x"]) * (p["b"]["y"] + p["a"]["y"]) / 2,
        )
    )
    return area * SQUARE_DEGREE if geographic else area


def line_length(line: Column, geographic: bool = False) -> Column:
    from .geodesy import distance

    step = lambda p: distance(p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"], geographic)
    return _total(F.transform(_pairs(line), step))


def area(geom: Column, geographic: bool = False) -> Column:
    """Sum of the signed areas of all parts: holes count negative."""
    return _total(F.transform(geom["parts"], lambda r: ring_area(r, geographic)))


def perimeter(geom: Column, geographic: bool = False) -> Column:
    return _total(F.transform(geom["parts"], lambda r: line_length(r, geographic)))


def bounds(geom: Column) -> Column:
    """struct<xmin, ymin, xmax, ymax>."""
    points = F.flatten(geom["parts"])
    xs, ys = points["x"], points["y"]
    return F.struct(
        F.array_min(xs).alias("xmin"),
        F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"),
        F.array_max(ys).alias("ymax"),
    )


def explode_parts(layer: DataFrame, geom: str = "geom") -> DataFrame:
    """One row for each part, other columns repeated; part counts from 0."""
    parts = layer.select("*", F.posexplode(f"{geom}.parts").alias("part", "_points"))
    single = F.regexp_replace(F.col(f"{geom}.type"), "^MULTI", "")
    return parts.withColumn(
        geom, F.struct(single.alias("type"), F.array("_points").alias("parts"))
    ).drop("_points")


def explode_segments(layer: DataFrame, geom: str = "geom") -> DataFrame:
    """part, step, x1, y1, x2, y2 of all parts; no segment joins two parts."""
    parts = layer.select("*", F.posexplode(f"{geom}.parts").alias("part", "_points"))
    pairs = parts.select(*layer.columns, "part", F.posexplode(_pairs(F.col("_points"))).alias("step", "_p"))
    ends = {"x1": "_p.a.x", "y1": "_p.a.y", "x2": "_p.b.x", "y2": "_p.b.y"}
    return pairs.drop(geom).withColumns({k: F.col(v) for k, v in ends.items()}).drop("_p")


def group_rings(parts: Column) -> Column:
    """array of polygons, each an outer ring and its holes, by the turn of the rings."""
    def step(done, ring):
        last = F.get(done, F.size(done) - 1)
        opens = (ring_area(ring) > 0) | (F.size(done) == 0)
        kept = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(opens, F.concat(done, F.array(F.array(ring)))).otherwise(
            F.concat(kept, F.array(F.concat(last, F.array(ring))))
        )

    return F.aggregate(parts, F.array().cast(f"array<array<{POINTS}>>"), step)


def circle(x: Column, y: Column, radius: Column, arcs: int = 8, steps: int = 4) -> Column:
    """Ring of arcs * steps + 1 points around a point, clockwise from north."""
    import math

    n = arcs * steps
    return F.transform(
        F.sequence(F.lit(0), F.lit(n)),
        lambda i: F.struct(
            (x + radius * F.sin(i * (2 * math.pi / n))).alias("x"),
            (y + radius * F.cos(i * (2 * math.pi / n))).alias("y"),
        ),
    )


def _number(v: Column) -> Column:
    return F.regexp_replace(v.cast("string"), r"\.0$", "")


def to_wkt(geom: Column) -> Column:
    """Well-known text. A polygon's rings are all parts; a multi-polygon groups them."""
    kind = geom["type"]
    point = lambda p: F.concat_ws(" ", _number(p["x"]), _number(p["y"]))
    line = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, point), ", "), F.lit(")"))
    lines = F.transform(geom["parts"], line)
    bracket = lambda c: F.concat(F.lit("("), c, F.lit(")"))
    polygons = F.transform(
        group_rings(geom["parts"]), lambda p: bracket(F.array_join(F.transform(p, line), ", "))
    )
    body = (
        F.when(kind.isin("POINT", "LINESTRING"), F.get(lines, F.lit(0)))
        .when(kind == "MULTIPOLYGON", bracket(F.array_join(polygons, ", ")))
        .otherwise(bracket(F.array_join(lines, ", ")))
    )
    return F.concat(kind, F.lit(" "), body)


def from_wkt(text: Column) -> Column:
    """Geometry of a well-known text; null for an unknown tag or an empty one."""
    kind = F.upper(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1))
    known = kind.isin(
        "POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON"
    )
    body = F.regexp_extract(text, r"(?s)\((.*)\)", 0)
    flat = F.when(kind == "MULTIPOINT", F.regexp_replace(body, r"(-?[0-9.eE+-]+\s+-?[0-9.eE+-]+)", "($1)")).otherwise(body)
    groups = F.regexp_extract_all(flat, F.lit(r"\(([^()]+)\)"), F.lit(1))
    point = lambda t: F.struct(
        F.get(F.split(F.trim(t), r"\s+"), F.lit(0)).cast("double").alias("x"),
        F.get(F.split(F.trim(t), r"\s+"), F.lit(1)).cast("double").alias("y"),
    )
    parts = F.transform(groups, lambda g: F.transform(F.split(g, ","), point))
    return F.when(known & (F.size(groups) > 0), F.struct(kind.alias("type"), parts.alias("parts")))


def base_type(kind: Column) -> Column:
    """Base family of an ESRI-style type name."""
    table = {
        "PolyLine": "MULTILINESTRING",
        "PolyLineZ": "MULTILINESTRING",
        "Polygon": "MULTIPOLYGON",
        "PolygonZ": "MULTIPOLYGON",
        "Point": "POINT",
        "PointZ": "POINT",
    }
    out = F.upper(kind)
    for name, base in table.items():
        out = F.when(kind == name, base).otherwise(out)
    return out


def hull(points):
    """Convex hull of an (n, 2) array, counter-clockwise; empty for up to two points."""
    rows = sorted({(float(x), float(y)) for x, y in points})
    if len(rows) < 3:
        return []

    def half(ordered):
        out: list = []
        for p in ordered:
            while len(out) > 1 and (
                (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0
            ):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(rows) + half(rows[::-1])


def _chains(rows):
    """(key, lower, upper) of each key of (key, x, y) in order: the two chains of its hull.

    Only the chains are held, however many points a key has.
    """
    same = lambda a, b: a == b or (a != a and b != b)
    key, low, high, last, any_row = None, [], [], None, False
    for k, x, y in rows:
        if not any_row or not same(k, key):
            if any_row:
                yield key, low, high
            key, low, high, last, any_row = k, [], [], None, True
        if x is None or y is None or x != x or y != y or (x, y) == last:
            continue
        last = (x, y)
        while len(low) > 1 and (low[-1][0] - low[-2][0]) * (y - low[-2][1]) - (low[-1][1] - low[-2][1]) * (x - low[-2][0]) <= 0:
            low.pop()
        low.append(last)
        while len(high) > 1 and (high[-1][0] - high[-2][0]) * (y - high[-2][1]) - (high[-1][1] - high[-2][1]) * (x - high[-2][0]) >= 0:
            high.pop()
        high.append(last)
    if any_row:
        yield key, low, high


def hulls(points: DataFrame, key: str) -> DataFrame:
    """key, hull of the points (x, y) of each key.

    Partial hulls are made per partition first, so a group's points never meet in full. Both
    steps read points in order of key and place, and hold no more than one hull.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = points.schema[key].dataType.simpleString()
    flat, whole = f"`{key}` {kind}, x double, y double", f"`{key}` {kind}, hull {POINTS}"
    flat_schema, whole_schema = (to_arrow_schema(_parse_datatype_string(s)) for s in (flat, whole))

    def rows(batches):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def pieces(made, size, schema):
        import pyarrow as pa

        held, n = [], 0
        for row in made:
            held.append(row)
            n += size(row)
            if n >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    def partial(batches):
        made = ((k, x, y) for k, low, high in _chains(rows(batches)) for x, y in sorted({*low, *high}) or [(None, None)])
        yield from pieces(made, lambda _: 1, flat_schema)

    def final(batches):
        named = lambda ring: [{"x": x, "y": y} for x, y in ring]
        ring = lambda low, high: low[:-1] + high[:0:-1] if len({*low, *high}) > 2 else []
        made = ((k, named(ring(low, high))) for k, low, high in _chains(rows(batches)))
        yield from pieces(made, lambda r: len(r[1]) + 1, whole_schema)

    some = points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    some = some.sortWithinPartitions(key, "x", "y").mapInArrow(partial, flat)
    return some.repartition(key).sortWithinPartitions(key, "x", "y").mapInArrow(final, whole)
