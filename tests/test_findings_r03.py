"""Cases that the findings of the third round name."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terralane.functions import geodesy, geometries, overlay
from terralane.operators import map_matching, nearest, networks, spatial_joins, trajectories
from terralane.plans.fixtures import REGIONS
from terralane.sources import points


def test_crossings_round_as_sql_does(spark):
    x1, y1, x2, y2 = (116.051, 39.05303, 116.003, 39.00203)
    line = [F.lit(v) for v in (x1, y1, x2, y2, 116.05, 39.0, 116.05, 39.5)]
    got = spark.range(1).select(geodesy.segment_intersection(*line)["y"].alias("y")).first().y
    assert round(got * 1e6) == 39051968


def test_equally_far_points_tie(spark):
    # Both outside points lie as far from the slanted edge; the later one is the cut.
    points = [(116.099, 39.00602), (116.054, 39.27602), (116.05, 39.1), (116.05, 39.11)]
    rows = [(1, i, float(i), x, y) for i, (x, y) in enumerate(points)]
    table = spark.createDataFrame(rows, "traj_id bigint, seq bigint, ts double, x double, y double")
    got = trajectories.in_out_split(table, REGIONS["triangle"]).orderBy("seq").collect()
    assert [r.kind for r in got] == ["out", "out", "in", "in"]


def _brute(places, arcs, k, reach, feet):
    out = []
    for i, (x, y) in enumerate(places):
        near = []
        for j, (x1, y1, x2, y2) in enumerate(arcs):
            dx, dy = x2 - x1, y2 - y1
            t = ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy) if dx or dy else None
            if feet and (t is None or not 0 <= t <= 1):
                continue
            s = min(1.0, max(0.0, t or 0.0))
            d = math.sqrt((x - x1 - s * dx) ** 2 + (y - y1 - s * dy) ** 2)
            if d <= reach:
                near.append((d, j))
        out += [(i, j, round(d, 9)) for d, j in sorted(near)[:k]]
    return out


@pytest.mark.parametrize(("k", "reach", "feet"), [(1, 300.0, False), (3, 300.0, True), (4, 40.0, False)])
def test_nearest_in_tiles_equal_all_pairs(spark, monkeypatch, k, reach, feet):
    monkeypatch.setattr(nearest, "BLOCK_POINTS", 40)
    random = np.random.default_rng(k)
    points = random.integers(0, 1000, (300, 2)).astype(float)
    points[200:] = points[:100]
    start = random.integers(-100, 1100, (150, 2))
    arcs = np.concatenate([start, start + random.integers(-200, 200, (150, 2))], 1).astype(float)
    # Equal arcs and arcs without length.
    arcs[100:130], arcs[140:, 2:] = arcs[:30], arcs[140:, :2]
    p = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(points)] + [(999, None, 1.0)], "id bigint, x double, y double")
    a = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(arcs)], "id bigint, x1 double, y1 double, x2 double, y2 double")
    got = nearest.nearest_arcs(p, a, reach, k, feet).collect()
    assert sorted((r.id, r.arc, round(r.distance, 9)) for r in got) == sorted(_brute(points, arcs, k, reach, feet))


def test_leaves_of_the_search_stay_small(monkeypatch):
    """Work grows with the points, not with points times arcs."""
    measured = []
    real = nearest._measured

    def counted(*a):
        out = real(*a)
        measured.append(out[2].size)
        return out

    monkeypatch.setattr(nearest, "_measured", counted)
    random = np.random.default_rng(5)
    points, arcs = random.random((4000, 2)) * 1000, np.tile(random.random((4000, 2)) * 1000, 2)
    nearest.nearest_in_tile(points, arcs, 5, 1000.0, False)
    assert sum(measured) < 16_000_000 / 10


def test_few_nearest_are_found_at_the_full_radius(spark):
    p = spark.createDataFrame([(i, float(i * i), 0.0) for i in range(40)], "id bigint, x double, y double")
    got = spatial_joins.nearest_k(p, p, 3, 200.0).collect()
    want = []
    for q in range(40):
        near = sorted((abs(q * q - i * i), i) for i in range(40) if abs(q * q - i * i) <= 200)[:3]
        want += [(q, i, float(d), n) for n, (d, i) in enumerate(near, 1)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_trips_share_no_broadcast(spark, monkeypatch):
    """What grows with the trips is merged, also where it is small enough to be sent to the driver."""
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0)], "id bigint, x double, y double")
    arcs = spark.createDataFrame([(7, 1, 2, 0.0, 0.0, 10.0, 0.0)], "id bigint, src bigint, dst bigint, x1 double, y1 double, x2 double, y2 double")
    trips = spark.createDataFrame([(1, 1.0, 1.0, 9.0, 1.0), (2, 1.0, 1.0, 50.0, 50.0)], "id bigint, x1 double, y1 double, x2 double, y2 double")
    r = networks.route(nodes, arcs, trips, 3.0)
    got = {row.id: (row["exists"], row.impedance) for row in r.collect()}
    assert got == {1: (True, 14.0), 2: (False, None)}
    joins = [line for line in r._jdf.queryExecution().optimizedPlan().toString().splitlines() if "LeftOuter" in line]
    assert len(joins) == 2 and all("strategy=merge" in j for j in joins)


def test_track_sets_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(points, "FILE_POINTS", 10)
    assert points.files_for(spark.range(95)) == 10 and points.files_for(spark.range(5), 8) == 8


def test_searches_go_on_where_they_stopped(spark):
    """Steps of growing length use one search of the network; the chain stays the same."""
    arcs = spark.createDataFrame([(i, i, i + 1, i * 100.0, 0.0, i * 100.0 + 100, 0.0) for i in range(20)], "id bigint, src bigint, dst bigint, x1 double, y1 double, x2 double, y2 double")
    xs = [50.0, 250.0, 650.0, 1450.0, 250.0]
    track = spark.createDataFrame([(1, i, float(i), x, 1.0) for i, x in enumerate(xs)], "traj_id bigint, seq bigint, ts double, x double, y double")
    got = map_matching.match(track, arcs, 30.0).orderBy("seq").collect()
    assert [r.arc_id for r in got] == [0, 2, 6, 14, 2]


def test_hull_chains_hold_no_points(spark):
    rows = [(1, float(x), float(y)) for x in range(60) for y in range(60)]
    sizes = [len(low) + len(high) for _, low, high in geometries._chains(sorted(rows))]
    assert sizes == [6]
    table = spark.createDataFrame([*rows, (2, 1.0, 1.0), (3, 0.0, 0.0), (3, 1.0, 1.0), (3, 2.0, 2.0), (None, 1.0, None)], "k bigint, x double, y double")
    got = {r.k: len(r.hull) for r in geometries.hulls(table.repartition(5), "k").collect()}
    assert got == {1: 4, 2: 0, 3: 0, None: 0}


def test_geometries_become_values_in_small_pieces():
    line = [{"x": 0.0, "y": 0.0}] * 5000
    batch = pa.RecordBatch.from_pydict({"id": list(range(50)), "line": [line] * 50})
    pieces = list(overlay._pieces(batch))
    assert sum(p.num_rows for p in pieces) == 50 and max(p.num_rows for p in pieces) <= 3


def test_tables_of_parts_stay_small(spark, monkeypatch, tmp_path):
    """Parts that one file number would hold are written in tables of at most ten thousand rows."""
    from terralane.plans import more

    path = f"file://{tmp_path}"
    spark.range(0, 100_000, 4).selectExpr("id as p_partkey", "if(id = 8, null, cast(id % 50 as int)) as p_size", "id + 0.25D as p_retailprice", "'b' as p_brand").coalesce(1).write.parquet(f"{path}/part.parquet")
    plan = more.s10_dbf(spark, path)
    assert "FlatMapGroups" not in plan._jdf.queryExecution().optimizedPlan().toString()
    got = plan.selectExpr("count(*) as n", "sum(k) as k", "count(s) as s").first()
    assert tuple(got) == (25_000, 4 * sum(range(25_000)), 24_999)


def test_distances_to_edges_equal_the_columns(spark):
    random = np.random.default_rng(3)
    rows = [tuple(map(float, r)) for r in random.integers(0, 6, (400, 8))]
    names = ["ax", "ay", "bx", "by", "cx", "cy", "dx", "dy"]
    want = spark.createDataFrame(rows, names).select(geodesy.segment_distance(*map(F.col, names)).alias("d")).collect()
    got = overlay.distance_to_edge(*np.array(rows).T)
    assert [r.d for r in want] == list(got)


def test_pairs_are_made_of_lists(spark, monkeypatch):
    """Hot cells and places are split into lists; pairs are those of all rows."""
    monkeypatch.setattr(spatial_joins, "LIST_IDS", 7)
    p = spark.createDataFrame([(i, float(i % 5), float(i % 3)) for i in range(90)], "id bigint, x double, y double")
    q = p.where("id % 9 = 0")
    sizes = spatial_joins._lists(p, ["x", "y"], 4).selectExpr("max(size(ids)) as most", "sum(size(ids)) as n").first()
    assert tuple(sizes) == (4, 90)
    got = sorted(tuple(r) for r in spatial_joins.within_distance(q, p, 1.0).collect())
    rows, asked = ([(r.id, r.x, r.y) for r in t.collect()] for t in (p, q))
    want = [(a, b, math.hypot(x - u, y - v)) for a, x, y in asked for b, u, v in rows if math.hypot(x - u, y - v) <= 1]
    assert got == sorted(want)
    got = sorted(tuple(r) for r in spatial_joins.candidates_in_range(q, p, 1.0, 2.0).collect())
    near = lambda a, b: abs(a // 2 - b // 2) <= 1
    assert got == sorted((a, b) for a, x, y in asked for b, u, v in rows if near(x, u) and near(y, v))
