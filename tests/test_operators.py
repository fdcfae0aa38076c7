"""Operators without SQL, against plain Python and known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralane.functions import geodesy, geometries, projections, scalars
from terralane.operators import clustering, folds, map_matching, meshes, networks, rasters, trajectories


def track(spark, rows):
    return spark.createDataFrame(
        [(1, i, float(t), float(x), float(y)) for i, (t, x, y) in enumerate(rows)],
        "traj_id long, seq long, ts double, x double, y double",
    )


def kept(df):
    return sorted(r.seq for r in df.select("seq").collect())


def test_overspeed_compares_with_the_last_kept(spark):
    t = track(spark, [(0, 0, 0), (1, 1000, 0), (2, 40, 0), (2, 41, 0), (3, 50, 0)])
    assert kept(folds.drop_overspeed(t, 33.0, geographic=False)) == [0, 2, 4]


def test_same_place(spark):
    t = track(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 5, 0), (4, 10, 0)])
    assert kept(folds.drop_same_place(t, geographic=False)) == [0, 2, 3, 4]
    assert kept(folds.drop_same_place(t, geographic=False, parity=True)) == [0, 2, 4]


def test_ping_pong(spark):
    t = track(spark, [(0, 0, 0), (1, 5, 0), (2, 0, 0), (3, 5, 0), (4, 0, 0), (5, 9, 0)])
    assert kept(folds.drop_ping_pong(t)) == [0, 4, 5]


def test_stays(spark):
    rows = [(i * 600, i % 2, 0) for i in range(6)] + [(4000 + i * 60, 1000 * (i + 1), 0) for i in range(4)]
    parts = folds.stays_and_moves(track(spark, rows), 10.0, 1800.0, geographic=False).orderBy("part").collect()
    assert [(p.kind, p.start_ts, p.end_ts) for p in parts] == [("stay", 0.0, 3000.0), ("move", 3000.0, 4180.0)]


def test_empty_track_tables(spark):
    t = track(spark, []).limit(0)
    assert trajectories.summaries(t).count() == 0
    assert trajectories.resample_time(t, 10.0).count() == 0
    assert folds.drop_overspeed(t).count() == 0
    assert rasters.density(t, rasters.Grid(0, 1, 1, 1, 1, 1)).count() == 0


@pytest.mark.parametrize("name", sorted(projections.REGISTRY))
def test_projections_come_back(spark, name):
    p = projections.projection(name)
    df = spark.createDataFrame([(2.5, 31.0), (-1.2, 60.3), (0.0, 5.0)], "x double, y double")
    out = projections.map_points(projections.map_points(df, p.forward), p.inverse).collect()
    for a, b in zip(df.collect(), out, strict=True):
        assert abs(a.x - b.x) < 1e-7 and abs(a.y - b.y) < 1e-7


def test_gauss_kruger_on_the_meridian(spark):
    df = spark.createDataFrame([(117.0, 45.0)], "x double, y double")
    r = projections.map_points(df, projections.GaussKruger(117.0).forward).first()
    assert abs(r.x - 500000) < 1e-6 and abs(r.y - 4984944.378) < 0.01


HASHES = {
    "bkdr": lambda s: fold(s, 0, lambda h, c: h * 131 + c),
    "sdbm": lambda s: fold(s, 0, lambda h, c: c + (h << 6) + (h << 16) - h),
    "djb": lambda s: fold(s, 5381, lambda h, c: h + (h << 5) + c),
    "js": lambda s: fold(s, 1315423911, lambda h, c: h ^ ((h << 5) + c + (h >> 2))),
}


def fold(s, h, step):
    for c in map(ord, s):
        h = step(h, c) & 0xFFFFFFFF
        h -= (h & 0x80000000) << 1
    return h & 0x7FFFFFFF


def test_hashes(spark):
    df = spark.createDataFrame([("Customer#000000001",), ("",), ("aé",)], "s string")
    for name, plain in HASHES.items():
        got = [r[0] for r in df.select(scalars.string_hash(F.col("s"), name, 1009)).collect()]
        assert got == [plain(r.s) % 1009 for r in df.collect()]
    for name in ("rs", "pjw", "elf", "ap", "chars", "md5"):
        assert all(0 <= r[0] < 7 for r in df.select(scalars.string_hash(F.col("s"), name, 7)).collect())


def test_segments(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    one = spark.range(1)
    cross = one.select(geodesy.segment_intersection(*lit(0, 0, 2, 2, 0, 2, 2, 0)).alias("p")).first().p
    assert (cross.x, cross.y) == (1.0, 1.0)
    d = one.select(geodesy.segment_distance(*lit(0, 0, 1, 0, 0, 2, 1, 2))).first()[0]
    assert d == 2.0
    ends = one.select(geodesy.segments_cross(*lit(0, 0, 1, 0, 1, 0, 2, 5), at_ends=False)).first()[0]
    assert ends is False


def test_wkt_of_a_holed_multi_polygon(spark):
    text = "MULTIPOLYGON (((0 0, 0 4, 4 4, 4 0, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1)), ((9 9, 9 10, 10 10, 9 9)))"
    df = spark.createDataFrame([(text,), ("NOTHING (1 2)",)], "t string")
    r = df.select(geometries.to_wkt(geometries.from_wkt(F.col("t"))).alias("w"), geometries.area(geometries.from_wkt(F.col("t"))).alias("a")).collect()
    assert r[0].w == text and r[0].a == 15.5 and r[1].w is None


def test_hull(spark):
    rng = np.random.default_rng(1)
    pts = [(float(x), float(y)) for x, y in rng.random((200, 2))] + [(-1.0, -1.0), (2.0, -1.0), (2.0, 2.0), (-1.0, 2.0)]
    df = spark.createDataFrame([(1, *p) for p in pts] + [(2, 0.0, 0.0)], "k int, x double, y double")
    r = {x.k: [(p.x, p.y) for p in x.hull] for x in geometries.hulls(df, "k").collect()}
    assert r[1] == [(-1.0, -1.0), (2.0, -1.0), (2.0, 2.0), (-1.0, 2.0)] and r[2] == []


def test_communities_of_two_cliques(spark):
    arcs = [(a, b, 1.0) for g in (range(5), range(10, 15)) for a in g for b in g if a < b] + [(4, 10, 1.0)]
    half = networks.both_ways(spark.createDataFrame(arcs, "src long, dst long, weight double"))
    for how in (networks.louvain, lambda h: networks.girvan_newman(h, 2)):
        found = {r.id: r.community for r in how(half).collect()}
        assert {found[i] for i in range(5)} == {0} and {found[i] for i in range(10, 15)} == {10}


def test_betweenness_of_a_path(spark):
    arcs = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], "src long, dst long, weight double")
    nodes = spark.range(4).select("id")
    paths = networks.shortest_paths(networks.both_ways(arcs), nodes)
    assert {r.id: r.visits for r in networks.betweenness(nodes, paths).collect()} == {0: 0, 1: 4, 2: 4, 3: 0}


def test_delaunay_has_empty_circles(spark):
    rng = np.random.default_rng(3)
    pts = rng.random((25, 2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, x double, y double")
    triangles = [(r.a, r.b, r.c) for r in networks.delaunay(df).collect()]
    for t in triangles:
        (ax, ay), (bx, by), (cx, cy) = pts[list(t)]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        ux = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
        uy = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
        r = math.hypot(ax - ux, ay - uy)
        assert all(math.hypot(x - ux, y - uy) > r - 1e-9 for i, (x, y) in enumerate(pts) if i not in t)
    hull = len(geometries.hull(pts))
    assert len(triangles) == 2 * 25 - 2 - hull


def test_k_means(spark):
    rows = [(i, float(i % 2 * 100 + i % 3), float(i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    found = {r.id: r.cluster for r in clustering.k_means(df, 2).collect()}
    assert len({(i % 2, c) for i, c in found.items()}) == 2


def test_mesh_measures(spark):
    v, f = meshes.sphere(spark, 24, 48)
    s = meshes.summary(v, f).first()
    assert s.euler == 2 and s.border_edges == 0 and abs(abs(s.volume) - 4.18879) < 0.06
    holed = f.where("v0 <> 1104 and v1 <> 1104 and v2 <> 1104")
    patch = meshes.fill_holes(holed).count()
    assert patch == 46
    assert meshes.face_components(f).select("component").distinct().count() == 1
    small_v, small_f = meshes.simplify(*meshes.sphere(spark, 8, 12), keep_faces=60)
    after = meshes.summary(small_v, small_f).first()
    assert after.euler == 2 and after.n_faces <= 60
    cone = meshes.summary(*meshes.cone(spark)).first()
    assert cone.euler == 2 and cone.border_edges == 0


def test_matching_follows_the_street(spark):
    arcs = spark.createDataFrame(
        [(i, i, i + 1, i * 100.0, 0.0, (i + 1) * 100.0, 0.0) for i in range(20)] + [(99, 50, 51, 0.0, 30.0, 2000.0, 30.0)],
        "id long, src long, dst long, x1 double, y1 double, x2 double, y2 double",
    )
    t = track(spark, [(i * 10, 50 + i * 120, 8) for i in range(12)])
    got = map_matching.match(t, arcs, 50.0).orderBy("seq").collect()
    assert [r.arc_id for r in got] == [int((50 + i * 120) // 100) for i in range(12)]


def test_stream_twins(spark, tmp_path):
    from terralane.streaming import tracks

    rows = [(1, i, float(t), float(t), 0.0) for i, t in enumerate((0, 10, 500, 510, 2000))]
    df = spark.createDataFrame(rows, "traj_id long, seq long, ts double, x double, y double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = tracks.stream_gap_split(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 300.0, 1e9)
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    got = sorted((r.seq, r.part) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)]
