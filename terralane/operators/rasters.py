"""Rasters as sparse cell tables (band?, row, col, value) over a grid.

Row 0 is the north edge. A cell without data has no row in a table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralane.functions import geodesy

from .checkpoints import cut
from .trajectories import segments

#: Result of a division by zero in map algebra.
LARGEST = 1.7976931348623157e308


@dataclass(frozen=True)
class Grid:
    xmin: float
    ymax: float
    xstep: float
    ystep: float
    rows: int
    cols: int

    def col(self, x: Column) -> Column:
        return F.floor((x - self.xmin) / self.xstep)

    def row(self, y: Column) -> Column:
        return F.floor((self.ymax - y) / self.ystep)

    def holds(self, row: Column, col: Column) -> Column:
        return row.between(0, self.rows - 1) & col.between(0, self.cols - 1)

    def centre(self) -> tuple[Column, Column]:
        x = self.xmin + (F.col("col") + 0.5) * self.xstep
        y = self.ymax - (F.col("row") + 0.5) * self.ystep
        return x, y

    def cells(self, spark) -> DataFrame:
        return spark.range(self.rows * self.cols).select(
            F.floor(F.col("id") / self.cols).alias("row"), (F.col("id") % self.cols).alias("col")
        )

    def moved(self, change) -> Grid:
        """The grid whose corners ``change`` (x, y -> x, y) moved; no cell is resampled."""
        x0, y0 = change(self.xmin, self.ymax)
        x1, y1 = change(self.xmin + self.cols * self.xstep, self.ymax - self.rows * self.ystep)
        return Grid(x0, y0, (x1 - x0) / self.cols, (y0 - y1) / self.rows, self.rows, self.cols)


def with_cell(points: DataFrame, grid: Grid, x: str = "x", y: str = "y") -> DataFrame:
    """Add row and col; points outside the grid drop out."""
    placed = points.withColumns({"row": grid.row(F.col(y)), "col": grid.col(F.col(x))})
    return placed.where(grid.holds(F.col("row"), F.col("col")))


def line_cells(row1: Column, col1: Column, row2: Column, col2: Column) -> Column:
    """Cells of a digital line, both ends included: one step per cell of the longer axis."""
    rows, cols = row2 - row1, col2 - col1
    n = F.greatest(F.abs(rows), F.abs(cols))

    def at(i):
        share = i / F.greatest(n, F.lit(1))
        return F.struct(
            F.floor(row1 + share * rows + 0.5).alias("row"), F.floor(col1 + share * cols + 0.5).alias("col")
        )

    return F.transform(F.sequence(F.lit(0).cast("bigint"), n), at)


def _segment_cells(points: DataFrame, grid: Grid, geographic: bool) -> DataFrame:
    """A row for each cell that a segment touches, inside the grid."""
    s = segments(points, geographic)
    ends = (grid.row(F.col("y")), grid.col(F.col("x")), grid.row(F.col("y2")), grid.col(F.col("x2")))
    touched = s.withColumn("cell", F.explode(line_cells(*ends)))
    out = touched.withColumns({"row": F.col("cell.row"), "col": F.col("cell.col")}).drop("cell")
    return out.where(grid.holds(F.col("row"), F.col("col")))


def density(points: DataFrame, grid: Grid, by: str = "dot", geographic: bool = True) -> DataFrame:
    """``dot``: points in each cell; ``line``: tracks that touch it, each once."""
    if by == "dot":
        return with_cell(points, grid).groupBy("row", "col").agg(F.count("*").cast("double").alias("value"))
    once = _segment_cells(points, grid, geographic).select("row", "col", "traj_id").distinct()
    return once.groupBy("row", "col").agg(F.count("*").cast("double").alias("value"))


def speed(points: DataFrame, grid: Grid, geographic: bool = True) -> DataFrame:
    """Mean speed of the segments that touch a cell; standing time counts nothing."""
    cells = _segment_cells(points, grid, geographic).where("seconds > 0")
    return cells.groupBy("row", "col").agg(F.avg(F.col("length") / F.col("seconds")).alias("value"))


def heading(points: DataFrame, grid: Grid, geographic: bool = True) -> DataFrame:
    """Mean heading of segments from the points in a cell; beyond 337.5 counts from -22.5."""
    s = segments(points, geographic)
    angle = geodesy.direction(*(F.col(c) for c in ("x", "y", "x2", "y2")), geographic)
    turned = s.withColumn("angle", angle).where("angle >= 0")
    value = F.when(F.col("angle") > 337.5, F.col("angle") - 360).otherwise(F.col("angle"))
    return with_cell(turned, grid).groupBy("row", "col").agg(F.avg(value).alias("value"))


def property_mean(points: DataFrame, grid: Grid, value: Column) -> DataFrame:
    """Mean of any expression over the points of a cell; nulls don't count."""
    placed = with_cell(points.withColumn("_v", value), grid)
    return placed.groupBy("row", "col").agg(F.avg("_v").alias("value")).where("value is not null")


def ends_density(points: DataFrame, grid: Grid, which: str = "both") -> DataFrame:
    """Tracks that start (``origin``), end (``destination``) or do either in a cell."""
    key = F.struct("ts", "seq")
    ends = points.groupBy("traj_id").agg(
        F.min_by(F.struct("x", "y"), key).alias("o"), F.max_by(F.struct("x", "y"), key).alias("d")
    )
    chosen = {"origin": ["o"], "destination": ["d"], "both": ["o", "d"]}[which]
    places = ends.select(F.explode(F.array(*chosen)).alias("p")).select("p.x", "p.y")
    return with_cell(places, grid).groupBy("row", "col").agg(F.count("*").cast("double").alias("value"))


def algebra(a: DataFrame, b: DataFrame, sign: str) -> DataFrame:
    """Cellwise + - * / where both have a value; x / 0 is the largest double."""
    left, right = F.col("value"), F.col("other")
    how = {
        "+": left + right,
        "-": left - right,
        "*": left * right,
        "/": F.when(right == 0, F.lit(LARGEST)).otherwise(left / F.nullif(right, F.lit(0.0))),
    }[sign]
    joined = a.join(b.withColumnRenamed("value", "other"), ["row", "col"])
    return joined.select("row", "col", how.alias("value"))


def at(raster: DataFrame, cells: DataFrame) -> DataFrame:
    """Values at (row, col) pairs; 0 where the raster has none."""
    return cells.join(raster, ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def label_points(points: DataFrame, raster: DataFrame, grid: Grid, name: str = "label") -> DataFrame:
    """Add the raster's value at each point; null outside."""
    placed = points.withColumns({"row": grid.row(F.col("y")), "col": grid.col(F.col("x"))})
    return placed.join(raster.withColumnRenamed("value", name), ["row", "col"], "left").drop("row", "col")


def idw(
    points: DataFrame,
    grid: Grid,
    k: int | None = None,
    power: float = 2.0,
    search: float | None = None,
) -> DataFrame:
    """Inverse-distance means of the k nearest of all points (x, y, value), distances at least 1.

    ``k`` is a third of the points, two at least, unless given; ``search`` leaves out points
    further away. Ties go by x, y, value. Without points the result is empty.

    Points are counted in squares that would hold about one each if they lay evenly, and on
    levels of squares twice as wide. On the first level where the nine squares around a
    cell's centre hold k points, the k nearest lie no further than across these, so the cell
    meets only points within that bound, by an equi-join on wider squares. A cell keeps its
    k nearest already before rows are dealt out.
    """
    spark = points.sparkSession
    low = lambda c, level: F.floor(c / F.pow(F.lit(2.0), level)).cast("bigint")
    across = lambda x: (x - grid.xmin) / grid.xstep
    down = lambda y: (grid.ymax - y) / grid.ystep
    ends = [f(c(F.col(n))).alias(f"{f.__name__}_{n}") for n, c in (("x", across), ("y", down)) for f in (F.min, F.max)]
    known = points.agg(F.count("*").alias("n"), *ends).first()
    if k is None:
        k = max(known.n // 3, 2)
    if search is not None and search < 1:
        search = 1.0
    parts = 1 << max(0, min(20, math.ceil(math.log2(max(1, known.n) / (grid.rows * grid.cols)) / 2)))
    placed = points.select(
        "x",
        "y",
        "value",
        F.floor(across(F.col("x")) * parts).cast("bigint").alias("sx"),
        F.floor(down(F.col("y")) * parts).cast("bigint").alias("sy"),
    )
    counts = cut(placed.groupBy("sx", "sy").agg(F.count("*").alias("n")))
    far = [abs(known[e] or 0) for e in ("min_x", "max_x", "min_y", "max_y")]
    top = math.ceil(math.log2(2 * parts * (max(grid.rows, grid.cols, 1, *far) + 1)))
    centre = lambda c: F.floor((F.col(c) + 0.5) * parts).cast("bigint")
    cells = grid.cells(spark).withColumns({"bx": centre("col"), "by": centre("row")})

    def around(frame: DataFrame) -> DataFrame:
        """The nine squares around each cell's centre on its level."""
        step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
        return (
            frame.withColumn("i", step)
            .withColumn("j", step)
            .withColumns(
                {"qx": low(F.col("bx"), F.col("level")) + F.col("i"), "qy": low(F.col("by"), F.col("level")) + F.col("j")}
            )
            .drop("i", "j")
        )

    def enough(cells: DataFrame, first: int, last: int) -> DataFrame:
        """Cells with their first level of these that holds k points around them."""
        levels = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("level")
        squares = (
            counts.select("*", levels)
            .groupBy("level", low(F.col("sx"), F.col("level")).alias("qx"), low(F.col("sy"), F.col("level")).alias("qy"))
            .agg(F.sum("n").alias("n"))
        )
        held = around(cells.select("*", levels)).join(squares, ["level", "qx", "qy"])
        held = held.groupBy("row", "col", "bx", "by", "level").agg(F.sum("n").alias("n"))
        return held.where(F.col("n") >= min(k, known.n)).groupBy("row", "col", "bx", "by").agg(F.min("level").alias("level"))

    # Most cells have k points near; only the others look at all levels.
    near = min(3, top)
    found = cut(enough(cells, 0, near))
    if near < top:
        rest = cells.join(found.select("row", "col"), ["row", "col"], "left_anti")
        found = found.unionByName(enough(rest, near + 1, top))
    # How far the k nearest can be, and how many levels up nine squares reach so far.
    slant = math.hypot(grid.xstep, grid.ystep)
    more = math.ceil(math.log2(2 * slant / min(grid.xstep, grid.ystep)))
    bound = F.pow(F.lit(2.0), F.col("level") + 1) * (slant / parts)
    targets = cut(around(found.withColumn("bound", bound).withColumn("level", F.col("level") + more)))
    used = [r[0] for r in targets.select("level").distinct().collect()]
    sources = placed.select(
        "x", "y", "value", "sx", "sy", F.explode(F.array(*map(F.lit, used)).cast("array<int>")).alias("level")
    ).withColumns({"qx": low(F.col("sx"), F.col("level")), "qy": low(F.col("sy"), F.col("level"))})
    cx, cy = grid.centre()
    away = geodesy.planar_distance(cx, cy, F.col("x"), F.col("y"))
    reach = F.col("bound") if search is None else F.least("bound", F.lit(float(search)))
    pairs = (
        targets.join(sources, ["level", "qx", "qy"])
        .select("row", "col", "x", "y", "value", away.alias("away"), reach.alias("reach"))
        .where("away <= reach")
        .withColumn("d", F.greatest("away", F.lit(1.0)))
    )
    order = Window.partitionBy("row", "col").orderBy("d", "x", "y", "value")
    nearest = pairs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    weight = F.pow("d", F.lit(-power))
    return nearest.groupBy("row", "col").agg((F.sum(F.col("value") * weight) / F.sum(weight)).alias("value"))
