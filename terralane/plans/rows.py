"""The remaining inventory rows: accessors, single functions and interfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralane import config
from terralane.functions import geodesy as G
from terralane.functions import geometries, projections, scalars
from terralane.operators import clustering, folds, meshes, networks, rasters
from terralane.operators import trajectories as T
from terralane.sources import layers as files, points as P

from .fixtures import GNSS, NATIONS, PLANAR, SEGMENTS, TRADE, gnss, nations, planar, table, trade
from .more import _parts_layer, scratch
from .space import CLUSTERS, GRID, _vectors

R = F.round
C = F.col
LINE = (116.02, 39.1, 116.07, 39.3)
_DX, _DY = "(116.07::DOUBLE - 116.02::DOUBLE)", "(39.3::DOUBLE - 39.1::DOUBLE)"
_T = f"(((x - 116.02::DOUBLE) * {_DX} + (y - 39.1::DOUBLE) * {_DY}) / ({_DX} * {_DX} + {_DY} * {_DY}))"


def _line():
    return [F.lit(v) for v in LINE]


def s02_folder_scan(spark, sf):
    """A folder of point texts, dealt over files, as one scan."""
    g = gnss(spark, sf)
    path = scratch(spark, "folder")
    g.select(F.concat_ws(",", "traj_id", "x", "y", scalars.from_epoch(F.floor("ts"))).alias("value")).repartition(5).write.text(path)
    return P.with_two_points(P.read_points(spark, path)).groupBy(C("traj_id").cast("bigint").alias("traj_id")).agg(F.count("*").alias("n"))


def s07_header(spark, sf):
    """Nations as a text whose first line names the columns."""
    n = nations(spark, sf).select(F.concat_ws(",", "id", "x", "y", F.lit("2024-01-01 00:00:00")).alias("value"))
    path = scratch(spark, "header")
    n.repartitionByRange(1, "value").mapInPandas(_with_header, "value string").write.text(path)
    return P.read_points(spark, path, header=True).select(C("traj_id").cast("bigint").alias("traj_id"), "x", "y")


def _with_header(frames):
    import pandas as pd

    yield pd.DataFrame({"value": ["ID,X,Y,T"]})
    yield from frames


def s21_settings(spark, sf):
    """Settings put for each region, read back beside the defaults."""
    names = {r.r_name: str(r.r_regionkey) for r in table(spark, sf, "region").collect()}
    for name, value in names.items():
        config.put(spark, f"region.{name}", value)
    keys = [*(f"region.{n}" for n in sorted(names)), "split.metres", "split.seconds", "region.none"]
    return spark.createDataFrame([(k, config.get(spark, k)) for k in keys], "key string, value string")


def k04_track_set(spark, sf):
    g = gnss(spark, sf).select(
        C("traj_id").cast("string").alias("traj_id"), C("seq").cast("int").alias("seq"), "ts", "x", "y",
        F.lit(-1.0).alias("speed"), F.lit(-1.0).alias("direction"), F.create_map(F.lit("kind"), C("kind")).alias("extra"),
    )
    path = scratch(spark, "tracks")
    P.write_track_set(g, path, files=P.files_for(g, 8))
    back = P.read_track_set(spark, f"{path}/*/*.txt")
    return back.groupBy(C("traj_id").cast("bigint").alias("traj_id"), C("extra")["kind"].alias("kind")).agg(F.count("*").alias("n"), R(F.sum("x"), 4).alias("x"))


def _counts(spark, sf) -> tuple[int, int]:
    """Regions and nations: the sizes of generated meshes."""
    return table(spark, sf, "region").count(), table(spark, sf, "nation").count()


def k10_obj(spark, sf):
    return files.obj_lines(*meshes.grid_mesh(spark, *_counts(spark, sf))).groupBy("kind").agg(F.count("*").alias("n"))


def k11_geojson(spark, sf):
    n = nations(spark, sf).select(
        F.struct(F.lit("POINT").alias("type"), F.array(F.array(F.struct("x", "y"))).alias("parts")).alias("geom"),
        F.create_map(F.lit("id"), C("id").cast("string")).alias("properties"),
    )
    return files.to_geojson(n)


def p11_collections(spark, sf):
    g = gnss(spark, sf).select("traj_id", "seq")
    return T.union_all(g.where("traj_id <> 3"), g.where("traj_id = 5").withColumn("traj_id", F.lit(9_999).cast("bigint"))).groupBy("traj_id").agg(F.count("*").alias("n"))


def q16_side(spark, sf):
    return gnss(spark, sf).select("seq", G.side_of_line(*_line(), C("x"), C("y")).alias("side"))


def q17_nearly_equal(spark, sf):
    s = T.segments(gnss(spark, sf))
    return s.select("seq", G.nearly_equal(C("x"), C("y"), C("x2"), C("y2"), 0.05).alias("near"))


def a11_degrees(spark, sf):
    d = networks.degrees(nations(spark, sf), trade(spark, sf))
    return d.groupBy("degree").agg(F.count("*").alias("n"))


def a15_mesh(spark, sf):
    return meshes.summary(*meshes.cone(spark, _counts(spark, sf)[1])).select("n_vertices", "n_edges", "n_faces", "euler")


def o02_time_order(spark, sf):
    g = gnss(spark, sf).withColumn("place", F.row_number().over(T.track_order()).cast("bigint"))
    return g.select("traj_id", "seq", "place")


def f07_nearest(spark, sf):
    p = G.nearest_on_segment(*_line(), C("x"), C("y"))
    return gnss(spark, sf).select("seq", R(p["x"], 7).alias("nx"), R(p["y"], 7).alias("ny"))


def f08_foot_or_null(spark, sf):
    p = G.foot_or_null(*_line(), C("x"), C("y"))
    return gnss(spark, sf).select("seq", R(p["x"], 7).alias("fx")).where("fx is not null")


def f09_foot_class(spark, sf):
    return gnss(spark, sf).select("seq", G.foot_class(*_line(), C("x"), C("y")).alias("place"))


def f10_foot(spark, sf):
    p = G.foot_on_line(*_line(), C("x"), C("y"))
    return gnss(spark, sf).select("seq", R(p["x"], 7).alias("fx"), R(p["y"], 7).alias("fy"))


def f36_registry(spark, sf):
    """Each registered projection by its name, with its defaults, there and back on all nations."""
    p = nations(spark, sf).select((C("x") / 10).alias("x"), (C("y") + 20).alias("y"), (C("x") / 10).alias("x0"), (C("y") + 20).alias("y0"))
    out = None
    for name in sorted(projections.REGISTRY):
        made = projections.projection(name)
        back = projections.map_points(projections.map_points(p, made.forward), made.inverse)
        near = F.count_if((F.abs(C("x") - C("x0")) < 1e-6) & (F.abs(C("y") - C("y0")) < 1e-6))
        one = back.agg(near.alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def f38_project_tracks(spark, sf):
    m = projections.projection("Mercator")
    return projections.map_points(gnss(spark, sf), m.forward).select("traj_id", "seq", R("x", 2).alias("x"))


def f40_offset_round_trip(spark, sf):
    g = projections.map_points(gnss(spark, sf), projections.OFFSETS["gcj02", "forward"])
    b = projections.map_points(projections.map_points(g, projections.OFFSETS["bd09", "forward"]), projections.OFFSETS["bd09", "inverse"])
    back = projections.map_points(b, projections.OFFSETS["gcj02", "inverse"])
    was = gnss(spark, sf).select("seq", C("x").alias("x0"), C("y").alias("y0"))
    near = lambda a, b: F.abs(C(a) - C(b)) < 5e-5
    return back.join(was, "seq").select("seq", (near("x", "x0") & near("y", "y0")).alias("back"))


def r01_grid(spark, sf):
    x, y = GRID.centre()
    return GRID.cells(spark).select("row", "col", R(x, 6).alias("x"), R(y, 6).alias("y"))


def n02_access(spark, sf):
    n, a = nations(spark, sf), trade(spark, sf)
    return n.agg(F.count("*").alias("nodes"), F.max("id").alias("last")).join(a.agg(F.count("*").alias("arcs")))


def n03_properties(spark, sf):
    a = trade(spark, sf).withColumn("props", F.create_map(F.lit("n"), C("n").cast("string")))
    return a.select("src", "dst", C("props")["n"].cast("bigint").alias("n"))


def n21_routes(spark, sf):
    """Whole ways from one source to every node."""
    nodes = nations(spark, sf)
    pairs = nodes.select(F.lit(0).cast("bigint").alias("source"), C("id").alias("target"))
    found = networks.astar(nodes, networks.both_ways(trade(spark, sf)), pairs, exact=True)
    hops = F.when(C("exists"), F.size("path") - 1).cast("bigint")
    return found.select(C("target").alias("node"), "exists", hops.alias("hops"), F.array_join(C("path").cast("array<string>"), ">").alias("path"))


def n22_heights(spark, sf):
    z = nations(spark, sf).select("id", "x", "y", (C("id") % 7).cast("double").alias("z"))
    a = trade(spark, sf).select("src", "dst")
    p, q = (z.select(C("id").alias(k), *(C(c).alias(f"{c}{i}") for c in "xyz")) for k, i in (("src", 1), ("dst", 2)))
    d = G.distance_3d(*(C(f"{c}{i}") for i in (1, 2) for c in "xyz"))
    return a.join(p, "src").join(q, "dst").select("src", "dst", R(d, 6).alias("length"))


def c05_items(spark, sf):
    c = clustering.density_clusters(_vectors(spark, sf), 120.0, 3)
    return c.groupBy("cluster").agg(F.count("*").alias("n"))


def m01_half_edges(spark, sf):
    h = meshes.half_edges(meshes.grid_mesh(spark, *_counts(spark, sf))[1])
    return h.agg(F.count("*").alias("half_edges"), F.sum(C("opposite").isNull().cast("bigint")).alias("open"))


def m11_collapse(spark, sf):
    """A sphere for each region, collapsed to fewer faces: it stays closed."""
    out = None
    for key in sorted(r[0] for r in table(spark, sf, "region").select("r_regionkey").collect()):
        keep = 40 + 4 * key
        m = meshes.summary(*meshes.simplify(*meshes.sphere(spark, 6, 10 + key), keep_faces=keep, cost="length"))
        one = m.select(
            F.lit(key).cast("bigint").alias("region"), "euler", C("border_edges").cast("bigint").alias("border_edges"), (C("n_faces") <= keep).alias("fits")
        )
        out = one if out is None else out.unionByName(one)
    return out


def m15_primitives(spark, sf):
    out, (few, many) = None, _counts(spark, sf)
    made = {"cone": meshes.cone(spark, many), "sphere": meshes.sphere(spark, few, many), "grid": meshes.grid_mesh(spark, few, many)}
    for name, (v, f) in made.items():
        one = v.agg(F.count("*").alias("vertices")).join(f.agg(F.count("*").alias("faces"))).select(F.lit(name).alias("name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def x03_cell_expression(spark, sf):
    r = rasters.property_mean(gnss(spark, sf), GRID, F.when(C("kind") == "click", 1.0).otherwise(0.0))
    return r.select("row", "col", R("value", 6).alias("value"))


def x02_custom_filter(spark, sf):
    return T.creator_filter(planar(spark, sf), "flight", geographic=False).select("traj_id", "seq")


_CELL = "CAST(floor((39.5::DOUBLE - y) / 0.0125::DOUBLE) AS BIGINT) AS row, CAST(floor((x - 116.0::DOUBLE) / 0.0025::DOUBLE) AS BIGINT) AS col"
_BASE = f"WITH {NATIONS}, {TRADE}"
_COUNTS = "WITH k AS (SELECT (SELECT count(*) FROM region) AS r, (SELECT count(*) FROM nation) AS n)"

QUERIES = {
    "s02_folder_scan": (s02_folder_scan, "SELECT user_id AS traj_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 2"),
    "s07_header": (s07_header, f"WITH {NATIONS} SELECT id AS traj_id, x, y FROM nodes"),
    "s21_settings": (s21_settings, "SELECT 'region.' || r_name AS key, CAST(r_regionkey AS VARCHAR) AS value FROM region UNION ALL VALUES ('split.metres', '5000'), ('split.seconds', '300'), ('region.none', '')"),
    "k04_track_set": (k04_track_set, f"WITH {GNSS} SELECT traj_id, kind, count(*) AS n, round(sum(x), 4) AS x FROM gnss GROUP BY 1, 2"),
    "k10_obj": (k10_obj, f"{_COUNTS} SELECT 'v' AS kind, (r + 1) * (n + 1) AS n FROM k UNION ALL SELECT 'f', 2 * r * n FROM k"),
    "k11_geojson": (k11_geojson, None),
    "p11_collections": (p11_collections, "WITH e AS (SELECT user_id AS traj_id FROM events) SELECT traj_id, count(*) AS n FROM (SELECT traj_id FROM e WHERE traj_id <> 3 UNION ALL SELECT 9999 FROM e WHERE traj_id = 5) GROUP BY 1"),
    "q16_side": (q16_side, f"WITH {GNSS} SELECT seq, CAST(sign({_DX} * (y - 39.1::DOUBLE) - {_DY} * (x - 116.02::DOUBLE)) AS INTEGER) AS side FROM gnss"),
    "q17_nearly_equal": (q17_nearly_equal, f"WITH {SEGMENTS} SELECT seq, abs(x - x2) <= 0.05::DOUBLE AND abs(y - y2) <= 0.05::DOUBLE AS near FROM segments"),
    "a11_degrees": (a11_degrees, f"{_BASE}, d AS (SELECT id, (SELECT count(*) FROM arcs WHERE src = id OR dst = id) AS degree FROM nodes) SELECT degree, count(*) AS n FROM d GROUP BY 1"),
    "a15_mesh": (a15_mesh, f"{_COUNTS} SELECT n + 2 AS n_vertices, 3 * n AS n_edges, 2 * n AS n_faces, CAST(2 AS BIGINT) AS euler FROM k"),
    "o02_time_order": (o02_time_order, f"WITH {GNSS} SELECT traj_id, seq, row_number() OVER (PARTITION BY traj_id ORDER BY ts, seq) AS place FROM gnss"),
    "f07_nearest": (f07_nearest, f"WITH {GNSS} SELECT seq, round(116.02::DOUBLE + greatest(0, least(1, {_T})) * {_DX}, 7) AS nx, round(39.1::DOUBLE + greatest(0, least(1, {_T})) * {_DY}, 7) AS ny FROM gnss"),
    "f08_foot_or_null": (f08_foot_or_null, f"WITH {GNSS} SELECT seq, round(116.02::DOUBLE + {_T} * {_DX}, 7) AS fx FROM gnss WHERE {_T} BETWEEN 0 AND 1"),
    "f09_foot_class": (f09_foot_class, f"WITH {GNSS} SELECT seq, CASE WHEN {_T} < 0 THEN -1 WHEN {_T} > 1 THEN 1 ELSE 0 END AS place FROM gnss"),
    "f10_foot": (f10_foot, f"WITH {GNSS} SELECT seq, round(116.02::DOUBLE + {_T} * {_DX}, 7) AS fx, round(39.1::DOUBLE + {_T} * {_DY}, 7) AS fy FROM gnss"),
    "f36_registry": (f36_registry, "SELECT name, count(*) AS n FROM nation, (VALUES ('Gauss_Kruger'), ('Lambert_Conformal_Conic'), ('Mercator'), ('Transverse_Mercator')) t(name) GROUP BY 1"),
    "f38_project_tracks": (f38_project_tracks, f"WITH {GNSS} SELECT traj_id, seq, round(6378137.0::DOUBLE * radians(x), 2) AS x FROM gnss"),
    "f40_offset_round_trip": (f40_offset_round_trip, "SELECT event_id AS seq, true AS back FROM events"),
    "r01_grid": (r01_grid, "SELECT r AS row, c AS col, round(116.0::DOUBLE + (c + 0.5) * 0.0025::DOUBLE, 6) AS x, round(39.5::DOUBLE - (r + 0.5) * 0.0125::DOUBLE, 6) AS y FROM range(0, 40) t(r), range(0, 40) u(c)"),
    "n02_access": (n02_access, f"{_BASE} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT max(id) FROM nodes) AS last, (SELECT count(*) FROM arcs) AS arcs"),
    "n03_properties": (n03_properties, f"{_BASE} SELECT src, dst, n FROM arcs"),
    "n21_routes": (
        n21_routes,
        f"""WITH RECURSIVE {NATIONS}, {TRADE}, walk AS (
  SELECT CAST(0 AS BIGINT) AS node, 0.0::DOUBLE AS distance, CAST(0 AS BIGINT) AS hops, '0' AS path
  UNION
  SELECT node, distance, hops, path FROM (
    SELECT h.dst AS node, w.distance + h.weight AS distance, w.hops + 1 AS hops, w.path || '>' || h.dst AS path,
           row_number() OVER (PARTITION BY h.dst ORDER BY w.distance + h.weight, w.hops) AS k
    FROM walk w JOIN half h ON h.src = w.node WHERE w.hops < 12
  ) WHERE k = 1
), best AS (SELECT node, arg_min(hops, distance) AS hops, arg_min(path, distance) AS path FROM walk GROUP BY 1)
SELECT id AS node, hops IS NOT NULL AS exists, hops, coalesce(path, '') AS path FROM nodes LEFT JOIN best ON node = id""",
    ),
    "n22_heights": (n22_heights, f"{_BASE} SELECT src, dst, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.id % 7 - b.id % 7, 2)), 6) AS length FROM arcs JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst"),
    "c05_items": (c05_items, f"SELECT cluster, count(*) AS n FROM ({CLUSTERS}) GROUP BY 1"),
    "m01_half_edges": (m01_half_edges, f"{_COUNTS} SELECT 6 * r * n AS half_edges, 2 * (r + n) AS open FROM k"),
    "m11_collapse": (m11_collapse, "SELECT CAST(r_regionkey AS BIGINT) AS region, CAST(2 AS BIGINT) AS euler, CAST(0 AS BIGINT) AS border_edges, true AS fits FROM region"),
    "m15_primitives": (m15_primitives, f"{_COUNTS} SELECT 'cone' AS name, n + 2 AS vertices, 2 * n AS faces FROM k UNION ALL SELECT 'sphere', (r - 1) * n + 2, 2 * n * (r - 1) FROM k UNION ALL SELECT 'grid', (r + 1) * (n + 1), 2 * r * n FROM k"),
    "x02_custom_filter": (x02_custom_filter, f"WITH {PLANAR}, s AS (SELECT traj_id, seq, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS d FROM planar WINDOW w AS (PARTITION BY traj_id ORDER BY ts, seq)) SELECT traj_id, seq FROM s WHERE d IS NULL OR d > 0.0001"),
    "x03_cell_expression": (x03_cell_expression, f"WITH {GNSS}, c AS (SELECT kind, {_CELL} FROM gnss) SELECT row, col, round(avg(CASE WHEN kind = 'click' THEN 1.0 ELSE 0.0 END), 6) AS value FROM c WHERE row BETWEEN 0 AND 39 AND col BETWEEN 0 AND 39 GROUP BY 1, 2"),
}
