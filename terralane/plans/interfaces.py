"""Queries that plug in what a user brings: judges, costs, projections, modes, indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralane.functions import geometries, projections
from terralane.operators import clustering, folds, layers as L, meshes, networks, spatial_joins
from terralane.operators import trajectories as T
from terralane.sources import geotiff, layers as files

from .fixtures import GNSS, NATIONS, PLANAR, SEGMENTS, gnss, nations, planar, table
from .more import scratch
from .space import _cluster_sql, _lines, _vectors
from .tracks import _OVERSPEED

R = F.round
C = F.col


def q09_ping_pong_speed(spark, sf):
    """Ping-pong removal by speed is removal of points reached too fast."""
    return folds.drop_overspeed(gnss(spark, sf), 8.0).select("traj_id", "seq")


def s09_shapefile_modes(spark, sf):
    """One layer opened in each mode: shapes alike, attributes but in the last."""
    layer = _lines(spark, sf).select(
        "fid", "geom", F.create_map(F.lit("k"), C("fid").cast("string")).alias("attributes"), F.floor(C("fid") / 100).alias("file")
    )
    path = scratch(spark, "shapes")
    folder = f"{path}/files"
    files.write_shapefile(layer, f"{path}/rows", "file")

    def write(batches):
        import pandas as pd
        import pyarrow.fs

        # Through Arrow's file systems: the folder may be in any store that Arrow knows.
        for batch in batches:
            for part, extension, content in zip(batch["part"], batch["extension"], batch["content"], strict=True):
                store, base = pyarrow.fs.FileSystem.from_uri(folder)
                store.create_dir(base)
                with store.open_output_stream(f"{base}/{part}.{extension}") as f:
                    f.write(bytes(content))
            yield pd.DataFrame({"n": [len(batch)]})

    spark.read.parquet(f"{path}/rows").mapInPandas(write, "n bigint").agg(F.sum("n")).collect()
    out = None
    for mode in files.MODES:
        one = files.read_shapefile(spark, folder, mode=mode).agg(
            F.count("*").alias("n"), F.sum(F.size("geom.parts")).alias("parts"), F.count("attributes").alias("with_attributes")
        ).select(F.lit(mode).alias("mode"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def p09_clone(spark, sf):
    """A layer and its copy, which loses the odd features: the layer keeps them."""
    layer = nations(spark, sf).withColumnRenamed("id", "fid")
    copy = L.delete_rows(layer.select("*"), *range(1, 25, 2))
    return layer.agg(F.count("*").alias("own")).join(copy.agg(F.count("*").alias("copy")))


def p23_append_part(spark, sf):
    """A part with heights behind the parts of each line."""
    new = F.array(*(F.struct(F.lit(v).alias("x"), F.lit(v + 1).alias("y"), F.lit(v + 2).alias("z")) for v in (0.0, 1.0)))
    flat = F.transform("geom.parts", lambda p: F.transform(p, lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), F.lit(0.0).alias("z"))))
    lines = _lines(spark, sf).select("fid", F.concat(flat, F.array(new)).alias("parts"))
    return lines.select("fid", F.size("parts").cast("bigint").alias("parts"), F.element_at(F.element_at("parts", -1), -1)["z"].alias("last"))


def j04_remove_item(spark, sf):
    return spatial_joins.remove_item(spatial_joins.point_index(planar(spark, sf), 500.0, "seq"), 7)


def o03_least(spark, sf):
    """The ten shortest segments: a heap in each task, and one over theirs."""
    s = T.segments(gnss(spark, sf)).select("traj_id", "seq", "length")
    return s.orderBy("length", "traj_id", "seq").limit(10).select("traj_id", "seq", R("length", 3).alias("length"))


def x04_judged_links(spark, sf):
    links = networks.link_nearest(nations(spark, sf), 2, 12.0, C("community") == C("community_b"))
    return links.select("src", "dst", R("weight", 6).alias("weight"))


def x05_cluster_cost(spark, sf):
    """A cost of one's own beside a weighted distance."""
    cost = F.when(C("label") == C("label_b"), 0.0).otherwise(60.0)
    return clustering.density_clusters(_vectors(spark, sf), 80.0, 3, cost, weight=0.5)


class Sheared:
    """A projection of one's own: anything with forward and inverse over columns will do."""

    def forward(self, x, y):
        return F.struct((x * 2 + y).alias("x"), (y - 1).alias("y"))

    def inverse(self, x, y):
        return F.struct(((x - y - 1) / 2).alias("x"), (y + 1).alias("y"))


def x06_projection(spark, sf):
    p = projections.map_points(gnss(spark, sf).select("seq", "x", "y"), Sheared().forward)
    back = projections.map_points(p.select("*", C("x").alias("u"), C("y").alias("v")), Sheared().inverse)
    return back.select("seq", R("u", 6).alias("u"), R("v", 6).alias("v"), R("x", 6).alias("x"), R("y", 6).alias("y"))


def x07_indexes(spark, sf):
    """The same boxes and points in both kinds of index."""
    p = planar(spark, sf)
    boxes = p.select("seq", C("x").alias("xmin"), C("y").alias("ymin"), C("x").alias("xmax"), C("y").alias("ymax"))
    a, b = spatial_joins.point_index(p, 700.0, "seq"), spatial_joins.box_index(boxes, 700.0, "seq")
    return a.join(b, ["cell_x", "cell_y", "id"]).select("cell_x", "cell_y", "id")


def r06_tags(spark, sf):
    """GeoTIFF tags of one small image for each nation, read back from its bytes."""
    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                found = geotiff.parse(geotiff.encode(np.full((1, 3, 4), r.x), r.x, r.y, 0.5, 0.25))
                rows.append((r.id, *found["tie"], *found["scale"], int(found["bands"].shape[2]), float(found["bands"].sum())))
            yield pd.DataFrame(rows, columns=["id", "xmin", "ymax", "xstep", "ystep", "cols", "total"])

    n = nations(spark, sf).select("id", "x", "y")
    return n.mapInPandas(run, "id bigint, xmin double, ymax double, xstep double, ystep double, cols bigint, total double")


def m18_scene(spark, sf):
    """A scene is its meshes' tables under one more key."""
    sizes = [r[0] for r in table(spark, sf, "region").select("r_regionkey").orderBy("r_regionkey").collect()]
    out = None
    for key in sizes:
        v, f = meshes.grid_mesh(spark, 1 + key, 2)
        one = v.agg(F.count("*").alias("vertices")).join(f.agg(F.count("*").alias("faces"))).select(F.lit(key).cast("bigint").alias("mesh"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def f22_models(spark, sf):
    """Lines through text and back: parts, points and length stay."""
    lines = _lines(spark, sf)
    back = lines.select("fid", geometries.from_wkt(geometries.to_wkt(C("geom"))).alias("geom"))
    return back.select("fid", F.size("geom.parts").cast("bigint").alias("parts"), F.aggregate(F.transform("geom.parts", lambda p: F.size(p)), F.lit(0), lambda a, n: a + n).cast("bigint").alias("points"))


_V = f"WITH {PLANAR}, v AS (SELECT traj_id AS fid, seq % 2 AS p FROM planar)"
QUERIES = {
    "q09_ping_pong_speed": (q09_ping_pong_speed, _OVERSPEED),
    "s09_shapefile_modes": (
        s09_shapefile_modes,
        f"{_V}, k AS (SELECT count(DISTINCT fid) AS n, count(DISTINCT (fid, p)) AS parts FROM v) "
        "SELECT mode, n, parts, CASE WHEN mode = 'shp_only' THEN 0 ELSE n END AS with_attributes FROM k, (VALUES ('common'), ('read_only'), ('shp_only')) t(mode)",
    ),
    "p09_clone": (p09_clone, "SELECT count(*) AS own, count(*) FILTER (n_nationkey % 2 = 0 OR n_nationkey >= 25) AS copy FROM nation"),
    "p23_append_part": (p23_append_part, f"{_V} SELECT fid, count(DISTINCT p) + 1 AS parts, 3.0::DOUBLE AS last FROM v GROUP BY 1"),
    "j04_remove_item": (
        j04_remove_item,
        f"WITH {PLANAR} SELECT CAST(floor(x / 500) AS BIGINT) AS cell_x, CAST(floor(y / 500) AS BIGINT) AS cell_y, CASE WHEN seq > 7 THEN seq - 1 ELSE seq END AS id FROM planar WHERE seq <> 7",
    ),
    "o03_least": (o03_least, f"WITH {SEGMENTS} SELECT traj_id, seq, round(length, 3) AS length FROM segments ORDER BY segments.length, traj_id, seq LIMIT 10"),
    "x04_judged_links": (
        x04_judged_links,
        f"""WITH {NATIONS}, d AS (SELECT a.id AS src, b.id AS dst, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS w
  FROM nodes a JOIN nodes b ON a.id <> b.id AND a.community = b.community),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w, dst) AS k FROM d WHERE w <= 12)
SELECT src, dst, round(w, 6) AS weight FROM r WHERE k <= 2""",
    ),
    "x05_cluster_cost": (
        x05_cluster_cost,
        _cluster_sql("sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) * 0.5 + CASE WHEN a.label = b.label THEN 0 ELSE 60 END <= 80"),
    ),
    "x06_projection": (
        x06_projection,
        f"WITH {GNSS} SELECT seq, round(x * 2 + y, 6) AS u, round(y - 1, 6) AS v, round(x, 6) AS x, round(y, 6) AS y FROM gnss",
    ),
    "x07_indexes": (
        x07_indexes,
        f"WITH {PLANAR} SELECT CAST(floor(x / 700) AS BIGINT) AS cell_x, CAST(floor(y / 700) AS BIGINT) AS cell_y, seq AS id FROM planar",
    ),
    "r06_tags": (r06_tags, f"WITH {NATIONS} SELECT id, x AS xmin, y AS ymax, 0.5::DOUBLE AS xstep, 0.25::DOUBLE AS ystep, CAST(4 AS BIGINT) AS cols, 12 * x AS total FROM nodes"),
    "m18_scene": (m18_scene, "SELECT CAST(r_regionkey AS BIGINT) AS mesh, CAST((r_regionkey + 2) * 3 AS BIGINT) AS vertices, CAST((r_regionkey + 1) * 4 AS BIGINT) AS faces FROM region"),
    "f22_models": (f22_models, f"{_V} SELECT fid, count(DISTINCT p) AS parts, count(*) AS points FROM v GROUP BY 1"),
}
