"""Joins by place: grid cells as equi-join keys, exact tests after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralane.functions import geodesy

from .nearest import nearest_arcs, nearest_places

METRES_PER_DEGREE = 111000.0


def cell(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    return F.floor(x / size), F.floor(y / size)


def point_index(points: DataFrame, size: float, id_col: str = "id") -> DataFrame:
    """cell_x, cell_y, id of points."""
    cx, cy = cell(F.col("x"), F.col("y"), size)
    return points.select(cx.alias("cell_x"), cy.alias("cell_y"), F.col(id_col).alias("id"))


def remove_item(index: DataFrame, gone: int) -> DataFrame:
    """An index without one item; the ids after it move down, as places in a list do."""
    left = index.where(F.col("id") != gone)
    return left.withColumn("id", F.col("id") - (F.col("id") > gone).cast("int"))


def box_index(boxes: DataFrame, size: float, id_col: str = "id") -> DataFrame:
    """cell_x, cell_y, id for every cell that a box (xmin, ymin, xmax, ymax) overlaps."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    return boxes.select(F.col(id_col).alias("id"), span("xmin", "xmax").alias("cell_x"), "ymin", "ymax").select(
        "cell_x", span("ymin", "ymax").alias("cell_y"), "id"
    )


def _around(df: DataFrame, size: float, reach: int) -> DataFrame:
    cx, cy = cell(F.col("x"), F.col("y"), size)
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    return (
        df.withColumn("_i", F.explode(steps))
        .withColumn("_j", F.explode(steps))
        .withColumns({"cell_x": cx + F.col("_i"), "cell_y": cy + F.col("_j")})
        .drop("_i", "_j")
    )


#: Ids of one cell or place that travel together; pairs of such lists are made into rows last.
LIST_IDS = 1024


def _lists(df: DataFrame, key: list[str], size: int) -> DataFrame:
    """key, ids: the ids of each key in lists of ``size`` at most, so no key's rows meet in full."""
    order = Window.partitionBy(*key).orderBy("id")
    part = F.floor((F.row_number().over(order) - 1) / size).alias("_part")
    return df.select(*key, "id", part).groupBy(*key, "_part").agg(F.collect_list("id").alias("ids")).drop("_part")


def _unpacked(lists: DataFrame, *others: str) -> DataFrame:
    one = lists.select("query_ids", F.explode("ids").alias("id"), *others)
    return one.select(F.explode("query_ids").alias("query_id"), "id", *others)


def _all_pairs(lists: DataFrame) -> DataFrame:
    """query_id, id of every pair of two lists (query_ids, ids).

    Pairs of lists are dealt out evenly first, whatever cell they are from.
    """
    # A given number of tasks is kept where few bytes become many rows.
    tasks = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lists.select("query_ids", "ids").repartition(tasks, F.get("query_ids", F.lit(0)), F.get("ids", F.lit(0)))
    return _unpacked(dealt)


def candidates_in_range(queries: DataFrame, points: DataFrame, radius: float, size: float) -> DataFrame:
    """query_id, id of all points in the square of cells around each query: no exact test.

    The result itself grows with queries times points; only lists of ids are joined.
    """
    reach = int(radius / size) + 1
    cells = ["cell_x", "cell_y"]
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    asked = _lists(point_index(queries, size), cells, LIST_IDS).withColumnRenamed("ids", "query_ids")
    around = asked.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).select(
        (F.col("cell_x") + F.col("_i")).alias("cell_x"), (F.col("cell_y") + F.col("_j")).alias("cell_y"), "query_ids"
    )
    return _all_pairs(around.join(_lists(point_index(points, size), cells, LIST_IDS), cells))


def within_distance(
    queries: DataFrame, points: DataFrame, radius: float, geographic: bool = False
) -> DataFrame:
    """query_id, id, distance of all pairs at most ``radius`` apart.

    Cells are as wide as the radius, so each query looks into nine. For degrees the cell
    is wide enough at 60 degrees of latitude; nearer the poles pass planar coordinates.
    """
    size = radius * 2 / METRES_PER_DEGREE if geographic else radius
    asked = _lists(queries, ["x", "y"], LIST_IDS).withColumnRenamed("ids", "query_ids")
    around = _around(asked, size, 1)
    cx, cy = cell(F.col("x"), F.col("y"), size)
    placed = _lists(points, ["x", "y"], LIST_IDS).select(
        "ids", F.col("x").alias("px"), F.col("y").alias("py"), cx.alias("cell_x"), cy.alias("cell_y")
    )
    d = geodesy.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py"), geographic)
    # The lists are small and their pairs many: a given number of tasks is kept.
    tasks, cells = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["cell_x", "cell_y"]
    pairs = around.repartition(tasks, *cells).join(placed.repartition(tasks, *cells), cells).withColumn("distance", d).where(F.col("distance") <= radius)
    # A pair of places is measured once, then made into the pairs of its ids.
    return _unpacked(pairs, "distance")


def nearest_k(
    queries: DataFrame, points: DataFrame, k: int, radius: float, geographic: bool = False
) -> DataFrame:
    """query_id, id, distance, rank: the k nearest within the radius, ties by id.

    Planar points are searched in tiles, so no more than k of them leave a task; for degrees
    all pairs within the radius are ranked.
    """
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    if geographic:
        pairs = within_distance(queries, points, radius, geographic)
    else:
        pairs = nearest_places(queries, points, radius, k)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def snap_to_arcs(
    points: DataFrame, arcs: DataFrame, tolerance: float, geographic: bool = False
) -> DataFrame:
    """point_id, arc_id, distance, x, y: the nearest arc in tolerance, ties to the least id.

    ``arcs`` has id, x1, y1, x2, y2. Planar arcs are searched in tiles; for degrees an arc lies
    in all cells of its box and all pairs of near cells are measured.
    """
    order = Window.partitionBy("point_id").orderBy("distance", "arc_id")
    if not geographic:
        found = nearest_arcs(points.select("id", "x", "y"), arcs, tolerance, 1).select(
            F.col("id").alias("point_id"), F.col("arc").alias("arc_id"), "distance", F.col("foot_x").alias("x"), F.col("foot_y").alias("y")
        )
        return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    size = tolerance / METRES_PER_DEGREE * 2
    boxes = arcs.select(
        "id",
        F.least("x1", "x2").alias("xmin"),
        F.least("y1", "y2").alias("ymin"),
        F.greatest("x1", "x2").alias("xmax"),
        F.greatest("y1", "y2").alias("ymax"),
    )
    index = box_index(boxes, size)
    near = _around(points.select(F.col("id").alias("point_id"), "x", "y"), size, 1)
    pairs = near.join(index, ["cell_x", "cell_y"]).select("point_id", "x", "y", F.col("id").alias("arc_id")).distinct()
    ends = arcs.select(F.col("id").alias("arc_id"), "x1", "y1", "x2", "y2")
    full = pairs.join(ends, "arc_id")
    line = [F.col(c) for c in ("x1", "y1", "x2", "y2", "x", "y")]
    measured = full.withColumns(
        {
            "distance": geodesy.point_segment_distance(*line, geographic=geographic),
            "foot": geodesy.nearest_on_segment(*line),
        }
    ).where(F.col("distance") <= tolerance)
    return (
        measured.withColumn("_n", F.row_number().over(order))
        .where("_n = 1")
        .select("point_id", "arc_id", "distance", "foot.x", "foot.y")
    )


def ring_edges(polygons: DataFrame) -> DataFrame:
    """region, x1, y1, x2, y2 of all rings; a ring closes itself."""
    rings = polygons.select("region", F.explode("rings").alias("ring"))
    shifted = F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    pairs = rings.select("region", F.explode(F.arrays_zip("ring", shifted.alias("next"))).alias("e"))
    return pairs.select(
        "region",
        F.col("e.ring.x").alias("x1"),
        F.col("e.ring.y").alias("y1"),
        F.col("e.next.x").alias("x2"),
        F.col("e.next.y").alias("y2"),
    )


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float, id_col: str = "seq") -> DataFrame:
    """region, id of the points inside each polygon, holes left out.

    Points and polygons meet on the cells of the polygons' boxes; a point then counts
    the edges that cross its ray to the right (even-odd).
    """
    edges = ring_edges(polygons)
    boxes = edges.groupBy("region").agg(
        F.min("x1").alias("xmin"), F.min("y1").alias("ymin"), F.max("x1").alias("xmax"), F.max("y1").alias("ymax")
    )
    index = box_index(boxes, size, "region").withColumnRenamed("id", "region")
    cx, cy = cell(F.col("x"), F.col("y"), size)
    placed = points.select(F.col(id_col).alias("id"), "x", "y", cx.alias("cell_x"), cy.alias("cell_y"))
    pairs = placed.join(index, ["cell_x", "cell_y"]).join(boxes, "region").where(
        "x >= xmin and x <= xmax and y >= ymin and y <= ymax"
    )
    packed = edges.groupBy("region").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    crossing = lambda e: ((e["y1"] > F.col("y")) != (e["y2"] > F.col("y"))) & (
        F.col("x")
        < (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) * (F.col("y") - e["y1"]) + e["x1"]
    )
    hits = F.size(F.filter("edges", crossing))
    return pairs.join(packed, "region").where(hits % 2 == 1).select("region", "id")


def polygon_distance(points: DataFrame, polygons: DataFrame, id_col: str = "seq", geographic: bool = False) -> DataFrame:
    """region, id, distance: -1 inside, else to the nearest edge, for every pair asked for.

    Meant for a stated, small set of polygons: each point meets every polygon.
    """
    packed = ring_edges(polygons).groupBy("region").agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges")
    )
    x, y = F.col("x"), F.col("y")
    crossing = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (
        x < (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) * (y - e["y1"]) + e["x1"]
    )
    near = F.array_min(
        F.transform(
            "edges",
            lambda e: geodesy.point_segment_distance(e["x1"], e["y1"], e["x2"], e["y2"], x, y, geographic),
        )
    )
    pairs = points.select(F.col(id_col).alias("id"), "x", "y").join(F.broadcast(packed))
    inside = F.size(F.filter("edges", crossing)) % 2 == 1
    return pairs.select("region", "id", F.when(inside, -1.0).otherwise(near).alias("distance"))
