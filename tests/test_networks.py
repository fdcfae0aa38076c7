"""Networks beyond a few nodes: right answers or an error, never less than the whole."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from terralane.operators import networks, rasters
from terralane.sources import points as sources


def chain(spark, n):
    nodes = spark.range(n).select("id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    arcs = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    return nodes, networks.both_ways(arcs)


@pytest.mark.parametrize("settings", [{"exact": True}, {}, {"greedy": 10}])
def test_ways_on_a_long_chain(spark, settings):
    nodes, half = chain(spark, 6000)
    pairs = spark.createDataFrame([(5990, 5995), (4995, 5005), (0, 10), (7, 7), (3, 9999)], "source long, target long")
    got = {(r.source, r.target): (r.exists, r.distance, r.path) for r in networks.astar(nodes, half, pairs, **settings).collect()}
    for s, t in [(5990, 5995), (4995, 5005), (0, 10), (7, 7)]:
        assert got[s, t] == (True, float(t - s), list(range(s, t + 1)))
    assert got[3, 9999] == (False, None, [])


def lattice(spark, side, seed=3):
    draw = random.Random(seed)
    arcs = []
    for i in range(side * side):
        if i % side < side - 1:
            arcs.append((i, i + 1, draw.uniform(1, 9)))
        if i < side * (side - 1):
            arcs.append((i, i + side, draw.uniform(1, 9)))
    nodes = spark.createDataFrame([(i, float(i % side), float(i // side)) for i in range(side * side)], "id long, x double, y double")
    return nodes, networks.both_ways(spark.createDataFrame(arcs, "src long, dst long, weight double")), arcs


def test_ways_beyond_the_bound_are_relaxed_by_joins(spark, monkeypatch):
    nodes, half, arcs = lattice(spark, 6)
    pairs = spark.createDataFrame([(0, 35), (5, 30), (7, 7), (2, 99), (0, 1)], "source long, target long")
    near = {}
    for a, b, w in arcs:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))

    def cheapest(s, t):
        done, queue = {}, [(0.0, s)]
        while queue:
            g, n = heapq.heappop(queue)
            if n not in done:
                done[n] = g
                for m, w in near.get(n, ()):
                    heapq.heappush(queue, (g + w, m))
        return done.get(t)

    shared = {(r.source, r.target): r for r in networks.astar(nodes, half, pairs, exact=True).collect()}
    monkeypatch.setattr(networks, "SHARED_NODES", 10)
    joined = {(r.source, r.target): r for r in networks.astar(nodes, half, pairs, exact=True).collect()}
    for key in shared:
        a, b = shared[key], joined[key]
        assert (a.exists, a.path) == (b.exists, b.path) and a.exists == (key != (2, 99))
        if a.exists:
            assert math.isclose(a.distance, cheapest(*key)) and math.isclose(b.distance, a.distance)
    with pytest.raises(ValueError):
        networks.astar(nodes, half, pairs)


def modularity(half, home):
    total = sum(w for _, _, w in half)
    inner = sum(w for a, b, w in half if home[a] == home[b])
    degree = {}
    for a, _, w in half:
        degree[home[a]] = degree.get(home[a], 0) + w
    return inner / total - sum((d / total) ** 2 for d in degree.values())


def test_louvain_in_rounds(spark, monkeypatch):
    draw = random.Random(1)
    arcs = []
    for c in range(12):
        members = range(c * 10, c * 10 + 10)
        arcs += [(a, b, 1.0) for a in members for b in members if a < b and draw.random() < 0.7]
        arcs.append((c * 10, (c * 10 + 10) % 120, 0.5))
    half = networks.both_ways(spark.createDataFrame(arcs, "src long, dst long, weight double"))
    rows = [tuple(r) for r in half.collect()]
    whole = {r.id: r.community for r in networks.louvain(half).collect()}
    monkeypatch.setattr(networks, "ONE_TASK_NODES", 20)
    rounds = {r.id: r.community for r in networks.louvain(half).collect()}
    assert set(rounds) == set(whole) == {a for a, _, _ in rows}
    assert all(c == min(i for i in rounds if rounds[i] == c) for c in rounds.values())
    assert modularity(rows, rounds) > 0.95 * modularity(rows, whole) > 0.5


def test_one_task_operators_raise_beyond_their_bound(spark, monkeypatch):
    nodes, half, _ = lattice(spark, 5)
    for name in ("GIRVAN_NEWMAN_NODES", "DELAUNAY_POINTS", "ONE_TASK_NODES"):
        monkeypatch.setattr(networks, name, 20)
    for call in (
        lambda: networks.girvan_newman(half),
        lambda: networks.delaunay(nodes),
        lambda: networks.spatial_communities(nodes, half.where("src < dst"), 2.0),
    ):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize(("k", "search"), [(3, None), (None, None), (7, 12.0)])
def test_idw_takes_all_points(spark, k, search):
    draw = random.Random(6)
    # A dense corner, a few points far outside, and nothing in between.
    spots = [(draw.uniform(0, 3), draw.uniform(0, 3), draw.uniform(0, 9)) for _ in range(40)]
    spots += [(300.0, -200.0, 5.0), (-900.0, 40.0, 7.0), (1.0, 1.0, 2.0), (1.0, 1.0, 2.0)]
    grid = rasters.Grid(0.0, 20.0, 1.0, 2.0, 10, 20)
    df = spark.createDataFrame(spots, "x double, y double, value double")
    got = {(r.row, r.col): r.value for r in rasters.idw(df, grid, k=k, search=search).collect()}
    n = k or max(len(spots) // 3, 2)
    for row in range(10):
        for col in range(20):
            cx, cy = col + 0.5, 20 - (row + 0.5) * 2
            near = sorted((max(1.0, math.hypot(cx - x, cy - y)), x, y, v) for x, y, v in spots)
            near = [p for p in near if search is None or p[0] <= search][:n]
            if not near:
                assert (row, col) not in got
                continue
            want = sum(p[3] / p[0] ** 2 for p in near) / sum(1 / p[0] ** 2 for p in near)
            assert math.isclose(got[row, col], want, rel_tol=1e-9)
    assert rasters.idw(df.limit(0), grid, k=k).count() == 0


def test_track_sets_in_several_files(spark, tmp_path):
    rows = [(f"t{i % 9}", i, float(i), i * 0.5, -float(i), 1.0, 2.0, {"k": str(i)}) for i in range(90)]
    df = spark.createDataFrame(rows, "traj_id string, seq int, ts double, x double, y double, speed double, direction double, extra map<string,string>")
    sources.write_track_set(df.repartition(5), str(tmp_path / "t"), files=3)
    back = sources.read_track_set(spark, str(tmp_path / "t" / "*" / "*.txt")).collect()
    assert sorted((r.traj_id, r.ts, r.x, r.extra["k"]) for r in back) == sorted((r[0], r[2], r[3], r[7]["k"]) for r in rows)
    by_track = {}
    for r in sorted(back, key=lambda r: (r.traj_id, r.seq)):
        by_track.setdefault(r.traj_id, []).append(r.ts)
    assert all(times == sorted(times) for times in by_track.values())
