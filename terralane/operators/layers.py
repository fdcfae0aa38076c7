"""Edits of vector layers: frames with fid, geom or coordinates, and attribute columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

MAX_NAME_BYTES = 11


def empty_layer(spark, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def add_column(layer: DataFrame, name: str, kind: DataType | str, value=None) -> DataFrame:
    """With a new typed column; a name that exists or is too long for a DBF raises."""
    if name in layer.columns:
        raise ValueError(f"column {name!r} exists")
    if len(name.encode()) > MAX_NAME_BYTES:
        raise ValueError(f"column name {name!r} is longer than {MAX_NAME_BYTES} bytes")
    return layer.withColumn(name, F.lit(value).cast(kind))


def delete_columns(layer: DataFrame, *names: str) -> DataFrame:
    return layer.drop(*names)


def append_rows(layer: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the other frame by column name; columns they lack are null."""
    return layer.unionByName(rows.select([c for c in rows.columns if c in layer.columns]), allowMissingColumns=True)


def delete_rows(layer: DataFrame, *fids: int) -> DataFrame:
    return layer.where(~F.col("fid").isin(*fids)) if fids else layer


def set_cell(layer: DataFrame, fid: int, name: str, value) -> DataFrame:
    kind = layer.schema[name].dataType
    return layer.withColumn(name, F.when(F.col("fid") == fid, F.lit(value).cast(kind)).otherwise(F.col(name)))


def number_cell(text: Column, decimals: int = 0) -> Column:
    """A blank counts as 0 for whole numbers and as null for others."""
    trimmed = F.trim(text)
    if decimals == 0:
        return F.when(trimmed == "", F.lit(0).cast("bigint")).otherwise(trimmed.try_cast("bigint"))
    return F.round(F.nullif(trimmed, F.lit("")).try_cast("double"), decimals)


def fields(layer: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in layer.schema.fields]


def feature(layer: DataFrame, index: int) -> DataFrame:
    """The row at a place in fid order; negative places count from the end.

    Places are found by sorted limits from the nearer end, not by numbering all rows.
    """
    order = F.col("fid").asc() if index >= 0 else F.col("fid").desc()
    back = F.col("fid").desc() if index >= 0 else F.col("fid").asc()
    n = index + 1 if index >= 0 else -index
    first = layer.orderBy(order).limit(n)
    if first.count() < n:
        raise IndexError(f"no feature at {index}")
    return first.orderBy(back).limit(1)


def by_family(layer: DataFrame, geom: str = "geom") -> dict[str, DataFrame]:
    """Up to three layers of points, lines and polygons; multi-points become points."""
    from terralane.functions.geometries import explode_parts

    kind = F.col(f"{geom}.type")
    points = explode_parts(layer.where(kind.isin("POINT", "MULTIPOINT")), geom).drop("part")
    return {
        "point": points,
        "line": layer.where(kind.isin("LINESTRING", "MULTILINESTRING")),
        "polygon": layer.where(kind.isin("POLYGON", "MULTIPOLYGON")),
    }


def field_set(layer: DataFrame, name: str = "extra") -> DataFrame:
    """key: the distinct keys of a map column."""
    return layer.select(F.explode(F.map_keys(name)).alias("key")).distinct()


def with_heights(vertices: DataFrame, start: Column, end: Column) -> DataFrame:
    """Add z to vertices (line_id, seq, x, y): from ``start`` to ``end`` along the line."""
    w = Window.partitionBy("line_id").orderBy("seq")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    measured = vertices.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    upto = F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_step").over(Window.partitionBy("line_id"))
    share = upto / F.nullif(total, F.lit(0.0))
    return measured.withColumn("z", start + F.coalesce(share, F.lit(0.0)) * (end - start)).drop("_step")


def weld(corners: DataFrame, places: int = 9) -> DataFrame:
    """Add vertex: one id for all corners (x, y, z) at one rounded place."""
    return corners.withColumn("vertex", F.xxhash64(*(F.round(c, places) for c in ("x", "y", "z"))))


def colour_edges(raster: DataFrame) -> DataFrame:
    """row, col of cells whose colour (r, g, b) differs from the right or lower neighbour."""
    key = F.struct("r", "g", "b")
    own = raster.select("row", "col", key.alias("own"))
    right = raster.select("row", (F.col("col") - 1).alias("col"), key.alias("right"))
    below = raster.select((F.col("row") - 1).alias("row"), "col", key.alias("below"))
    joined = own.join(right, ["row", "col"], "left").join(below, ["row", "col"], "left")
    differs = F.coalesce(F.col("own") != F.col("right"), F.lit(False)) | F.coalesce(F.col("own") != F.col("below"), F.lit(False))
    return joined.where(differs).select("row", "col")
