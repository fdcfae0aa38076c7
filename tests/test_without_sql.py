"""Queries without SQL against plain Python over the same tables."""

import json
import math
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from test_operators import HASHES

from terralane.plans import fixtures, graphs, registry, scalars

DATA = Path("/root/testdata/sf0.001")
NAMES = sorted(set(registry.queries()) - set(registry.oracle_sql()))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for table in DATA.glob("*.parquet"):
        connection.execute(f"create view {table.stem} as select * from '{table}'")
    return connection


def planar(duck):
    return duck.execute(f"WITH {fixtures.PLANAR} SELECT * FROM planar ORDER BY traj_id, ts, seq").df()


def segments(duck):
    return duck.execute(f"WITH {fixtures.SEGMENTS} SELECT * FROM segments").df()


def trade(duck):
    nodes = duck.execute(f"WITH {fixtures.NATIONS} SELECT * FROM nodes ORDER BY id").df()
    return nodes, duck.execute(f"WITH {fixtures.TRADE} SELECT src, dst, weight FROM half").df()


def point_segment(p, a, b):
    d = b - a
    t = np.clip(((p - a) * d).sum(-1) / np.maximum((d * d).sum(-1), 1e-300), 0, 1)
    return np.linalg.norm(p - a - t[..., None] * d, axis=-1)


def crosses(a, b, c, d):
    turn = lambda p, q, r: np.sign((q - p)[..., 0] * (r - p)[..., 1] - (q - p)[..., 1] * (r - p)[..., 0])
    return (turn(a, b, c) * turn(a, b, d) <= 0) & (turn(c, d, a) * turn(c, d, b) <= 0)


def distance(a, b, c, d):
    apart = np.minimum.reduce([point_segment(a, c, d), point_segment(b, c, d), point_segment(c, a, b), point_segment(d, a, b)])
    return np.where(crosses(a, b, c, d), 0.0, apart)


def inside(rings, x, y):
    hit = np.zeros(np.shape(x), bool)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if y1 != y2:
                hit ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return hit


def a18_random_walks(g, duck):
    assert g.visits.sum() == 25 * 7 and set(g.node) <= set(range(25))


def c03_k_means(g, duck):
    v = duck.execute("SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE) * 10000, 0) AS x, round(CAST(embedding[2] AS DOUBLE) * 10000, 0) AS y FROM embeddings ORDER BY id").df()
    p = v[["x", "y"]].to_numpy()
    centres, last = p[:6].copy(), None
    for _ in range(25):
        own = np.linalg.norm(p[:, None] - centres[None], axis=2).argmin(1)
        if last is not None and (own == last).all():
            break
        last = own
        centres = np.array([p[own == k].mean(0) if (own == k).any() else centres[k] for k in range(6)])
    assert (g.sort_values("id").cluster.to_numpy() == last).mean() > 0.99


def q15_cross(g, duck):
    s = segments(duck).set_index("seq")
    want = (s[["x", "x2"]].min(axis=1) <= 116.05) & (s[["x", "x2"]].max(axis=1) >= 116.05)
    assert (g.set_index("seq")["cross"] == want.reindex(g.seq)).all() and want.any() and not want.all()


def f11_segment_segment(g, duck):
    s = segments(duck).set_index("seq").loc[g.seq]
    a, b = s[["x", "y"]].to_numpy(), s[["x2", "y2"]].to_numpy()
    c, d = (np.array(scalars._LINE[i : i + 2]) for i in (0, 2))
    assert np.allclose(g.d, distance(a, b, c, d), atol=2e-7) and (g["cross"] == (g.d == 0)).all()
    hit = g[g.hx.notna()]
    assert len(hit) and hit["cross"].all() and hit.hx.between(min(c[0], d[0]) - 1e-5, max(c[0], d[0]) + 1e-5).all()


def f12_geometry_distance(g, duck):
    p = planar(duck)
    p["p"] = p.seq % 2
    p = p.sort_values(["traj_id", "p", "seq"])
    nxt = p.groupby(["traj_id", "p"]).shift(-1)
    s = p.assign(x2=nxt.x, y2=nxt.y).dropna(subset=["x2"])
    for r in g.itertuples():
        own = s[s.traj_id == r.fid]
        a, b = own[["x", "y"]].to_numpy()[:, None], own[["x2", "y2"]].to_numpy()[:, None]
        edges = [(u, v) for ring in fixtures.REGIONS[r.region] for u, v in zip(ring, ring[1:] + ring[:1], strict=True)]
        at = lambda k: np.array([[(e[k][0] - 116) * 1e5, (e[k][1] - 39) * 1e5] for e in edges])[None]
        assert abs(distance(a, b, at(0), at(1)).min() - r.distance) < 2e-3


def f16_hulls(g, duck):
    p, got = planar(duck), g.set_index("traj_id")
    for key, own in p.groupby("traj_id"):
        pts = sorted({(x, y) for x, y in own[["x", "y"]].to_numpy()})
        ring = []
        for side in (pts, pts[::-1]):
            half = []
            for q in side:
                while len(half) > 1 and (half[-1][0] - half[-2][0]) * (q[1] - half[-2][1]) <= (half[-1][1] - half[-2][1]) * (q[0] - half[-2][0]):
                    half.pop()
                half.append(q)
            ring += half[:-1]
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2
        assert abs(got.loc[key].area - area) < 1 and got.loc[key].n == len(ring)


def f18_buffers(g, duck):
    assert sorted(g.id) == sorted(planar(duck).traj_id.unique()) and (g.n >= 8).all()


def _near_the_globe(g, duck):
    """Short ways on the projected plane are as long as on the ground."""
    s = segments(duck)
    at = g.set_index("seq")
    gnss = duck.execute(f"WITH {fixtures.GNSS} SELECT seq, x, y FROM gnss").df().set_index("seq").loc[at.index]
    lon, lat = np.radians(gnss.x.to_numpy()), np.radians(gnss.y.to_numpy())
    i, j = np.arange(len(at) - 1), np.arange(1, len(at))
    h = np.sin((lat[i] - lat[j]) / 2) ** 2 + np.cos(lat[i]) * np.cos(lat[j]) * np.sin((lon[i] - lon[j]) / 2) ** 2
    ground = 2 * 6371000 * np.arcsin(np.sqrt(h))
    plane = np.hypot(*(at[c].to_numpy()[i] - at[c].to_numpy()[j] for c in "xy"))
    far = ground > 100
    assert len(s) and np.abs(plane[far] / ground[far] - 1).max() < 0.03


def f54_hashes(g, duck):
    names = duck.execute("SELECT c_custkey, c_name FROM customer").df().set_index("c_custkey").c_name
    for r in g.itertuples():
        for name, plain in HASHES.items():
            assert getattr(r, name) == plain(names[r.c_custkey]) % 97
        assert all(0 <= getattr(r, name) < 97 for name in ("rs", "pjw", "elf", "ap"))


def j09_delaunay(g, duck):
    nodes, _ = trade(duck)
    pts = nodes[["x", "y"]].to_numpy()
    for t in g[["a", "b", "c"]].to_numpy():
        (ax, ay), (bx, by), (cx, cy) = pts[t]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        ux = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
        uy = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
        assert (np.hypot(pts[:, 0] - ux, pts[:, 1] - uy) > math.hypot(ax - ux, ay - uy) - 1e-6).all()


def j14_match(g, duck):
    p = planar(duck).set_index("seq").loc[g.seq]
    off = np.minimum.reduce([np.abs((p[c].to_numpy() + 500) % 1000 - 500) for c in "xy"])
    assert len(g) and (off <= 300).all() and not g.duplicated(["traj_id", "seq"]).any()


def k11_geojson(g, duck):
    nodes, _ = trade(duck)
    found = [json.loads(v) for v in g.value]
    assert {(f["properties"]["id"], *f["geometry"]["coordinates"]) for f in found} == {(str(r.id), r.x, r.y) for r in nodes.itertuples()}
    assert {(f["type"], f["geometry"]["type"]) for f in found} == {("Feature", "Point")}


def m06_curvature(g, duck):
    # A unit sphere has curvature one everywhere; its two poles have triangles of their own kind.
    assert (abs(g.gaussian - 1) < 0.05).sum() == len(g) - 2 and (abs(g.gaussian - 1) < 0.3).all()


def m09_quadric(g, duck):
    corners = g[["v0", "v1", "v2"]].to_numpy()
    assert 0 < len(g) <= 400 and all(len(set(t)) == 3 for t in corners) and g.id.is_unique
    edges = Counter(tuple(sorted(e)) for t in corners for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])))
    assert max(edges.values()) <= 2


def m10_error(g, duck):
    assert len(g) == 1 and 0 < g["mean"][0] <= g.hausdorff[0] < 3


def m12_morse(g, duck):
    assert g.id.is_unique and len(set(g.kind)) > 1 and "regular" in set(g.kind)


def m13_fill(g, duck):
    corners = g[["v0", "v1", "v2"]].to_numpy()
    edges = Counter(tuple(sorted(e)) for t in corners for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])))
    # A disc: as many border edges as corners, and two triangles fewer.
    border = sum(n == 1 for n in edges.values())
    assert border == len(set(corners.ravel())) == len(g) + 2 and max(edges.values()) <= 2


def shortest(duck):
    return duck.execute(f"{graphs.PATHS} SELECT * FROM paths").df()


def n07_greedy(g, duck):
    best = shortest(duck).set_index(["source", "node"]).distance
    # Ways of more than ten times the straight one are left out, so not every pair has one.
    for r in g[g.exists].itertuples():
        assert r.distance >= best[r.source, r.target] - 1e-9
    assert g.exists.sum() > 15 and g.distance[~g.exists].isna().all()


def n08_route(g, duck):
    nodes, half = trade(duck)
    place = nodes.set_index("id")[["x", "y"]]
    a, b = place.loc[half.src].to_numpy()[None], place.loc[half.dst].to_numpy()[None]
    keys = g.id.to_numpy()
    ends = [np.stack([(keys * m) % 24 + 0.3 for m in pair], 1)[:, None] for pair in ((7, 5), (11, 13))]
    reach = [point_segment(p, a, b).min(1) for p in ends]
    assert not g.exists[(reach[0] > 3) | (reach[1] > 3)].any() and g.exists.any()
    assert g.impedance[g.exists].notna().all() and g.impedance[~g.exists].isna().all()
    straight = np.linalg.norm(ends[0] - ends[1], axis=2)[:, 0]
    assert (g.impedance[g.exists] >= straight[g.exists.to_numpy()] - 1e-4).all()


def n14_betweenness(g, duck):
    paths = shortest(duck)
    assert g.visits.sum() == (paths.hops[paths.hops > 0] - 1).sum() and len(g) == 25


def _partition(g, duck):
    nodes, half = trade(duck)
    assert sorted(g.id) == list(nodes.id) and set(g.community) <= set(g.id)
    home = dict(zip(g.id, g.community, strict=True))
    total, inner, degree = half.weight.sum(), 0.0, defaultdict(float)
    for r in half.itertuples():
        inner += r.weight * (home[r.src] == home[r.dst])
        degree[home[r.src]] += r.weight
    return inner / total - sum((d / total) ** 2 for d in degree.values())


def n15_girvan_newman(g, duck):
    assert _partition(g, duck) >= -0.01


def n16_louvain(g, duck):
    assert _partition(g, duck) > 0.01


def n17_spatial_communities(g, duck):
    _partition(g, duck)
    nodes, _ = trade(duck)
    assert g.community.nunique() < len(nodes)


def q10_ping_pong(g, duck):
    p = planar(duck)
    want = set()
    for _, own in p.groupby("traj_id"):
        place = [(math.floor(x / 20000), math.floor(y / 20000)) for x, y in own[["x", "y"]].to_numpy()]
        seq, i = own.seq.tolist(), 0
        while i < len(seq):
            # The longest run from here in which two places take turns.
            end = next((k - 1 for k in range(i + 2, len(seq)) if not place[k] == place[k - 2] != place[k - 1]), len(seq) - 1)
            collapsed = end - i >= 3
            want |= {seq[i], seq[end]} if collapsed else {seq[i]}
            i = end + 1 if collapsed else i + 1
    assert set(g.seq) == want


def q12_ais_filter(g, duck):
    p = planar(duck)
    p["ts"] = np.floor(p.ts / 50000) * 50000.0
    for c in "xy":
        p[c] = np.floor(p[c] / 5000 + 0.5)
    p = p.sort_values(["traj_id", "ts", "seq"])
    before = p.groupby("traj_id").shift(1)
    gone = (p.ts == before.ts) & (np.hypot(p.x - before.x, p.y - before.y) < 10)
    assert set(g.seq) == set(p.seq[~gone]) and gone.any()


def s19_reservoir(g, duck):
    assert len(g) == g.seq.nunique() == 100 and set(g.seq) <= set(planar(duck).seq)


def u03_clip(g, duck):
    x, y = np.meshgrid(116.03 + (np.arange(800) + 0.5) * 0.04 / 800, 39.05 + (np.arange(800) + 0.5) * 0.2 / 800)
    for r in g.itertuples():
        # The hole is a ring of its own here, and the clipped outline may keep it.
        outer = inside(fixtures.REGIONS[r.region][:1], x, y).mean() * 0.04 * 0.2
        whole = inside(fixtures.REGIONS[r.region], x, y).mean() * 0.04 * 0.2
        assert min(abs(r.area - outer), abs(r.area - whole)) < 0.004 * outer


def w03_concurrent(g, duck):
    p = duck.execute(f"WITH {fixtures.GNSS} SELECT * FROM gnss").df().merge(g, on=["traj_id", "seq"]).sort_values(["traj_id", "part", "ts", "seq"])
    assert len(p) == len(g) and p.groupby(["traj_id", "part"]).size().min() >= 5
    step = p.groupby(["traj_id", "part"]).ts.diff().dropna()
    assert (step > 0).all() and (step <= 90000).all()


def w05_stays(g, duck):
    stays = g[g.kind == "stay"]
    assert len(stays) and (stays.end_ts - stays.start_ts > 20000).all() and set(g.kind) == {"stay", "move"}
    p = duck.execute(f"WITH {fixtures.GNSS} SELECT * FROM gnss").df()
    for r in stays.itertuples():
        own = p[(p.traj_id == r.traj_id) & p.ts.between(r.start_ts, r.end_ts)]
        assert len(own) == r.n and own.x.between(r.xmin, r.xmax).all() and own.y.between(r.ymin, r.ymax).all()
    for _, own in g.sort_values(["traj_id", "part"]).groupby("traj_id"):
        assert list(own.part) == list(range(len(own)))
        assert (own.start_ts.to_numpy()[1:] == own.end_ts.to_numpy()[:-1]).all() or len(own) == 1 or (own.kind == "stay").sum() > 1


def w07_stay_attributes(g, duck):
    assert set(g.kind) == {"stay", "move"} and (g.points >= 2 * g.n).all()


CHECKS = {name: globals()[name] for name in NAMES if name in globals()}
CHECKS |= {name: _near_the_globe for name in ("f32_gauss_kruger", "f34_transverse_mercator", "f35_lambert")}


@pytest.mark.parametrize("name", NAMES)
def test_query_without_sql(spark, duck, name):
    CHECKS[name](registry.queries()[name](spark, str(DATA)).toPandas(), duck)
