"""Queries over meshes, map matching and sources written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralane.operators import map_matching, meshes, rasters
from terralane.sources import points as P

from .fixtures import GNSS, gnss, planar
from .space import ARCS, GRID, _arcs

R = F.round
C = F.col


def _hills(spark):
    return meshes.grid_mesh(spark, 20, 30, F.sin(C("x") / 3) * F.cos(C("y") / 4) * 2)


def m05_measures(spark, sf):
    m = meshes.measured(*_hills(spark))
    return m.select("id", R("area", 7).alias("area"), R("nz", 7).alias("nz"), R("a0", 7).alias("a0"))


_GRID_MESH = """v AS (SELECT i AS id, CAST(i % 31 AS DOUBLE) AS x, CAST(i // 31 AS DOUBLE) AS y,
  sin((i % 31) / 3.0::DOUBLE) * cos((i // 31) / 4.0::DOUBLE) * 2 AS z FROM range(0, 651) t(i)),
c AS (SELECT i, (i // 30) * 31 + i % 30 AS k FROM range(0, 600) t(i)),
f AS (SELECT i * 2 AS id, k AS v0, k + 1 AS v1, k + 32 AS v2 FROM c UNION ALL SELECT i * 2 + 1, k, k + 32, k + 31 FROM c),
p AS (SELECT f.id, f.v0, f.v1, f.v2, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, d.x AS x2, d.y AS y2, d.z AS z2
  FROM f JOIN v a ON a.id = v0 JOIN v b ON b.id = v1 JOIN v d ON d.id = v2),
n AS (SELECT *, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS nx, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS ny,
  (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS nz FROM p)"""


def m07_summary(spark, sf):
    s = meshes.summary(*_hills(spark))
    return s.select(
        "n_vertices", "n_edges", "n_faces", C("border_edges").cast("bigint").alias("border_edges"), "euler",
        R("area", 5).alias("area"), R("volume", 5).alias("volume"), R("mean_edge", 7).alias("mean_edge"),
    )


def m02_one_ring(spark, sf):
    return meshes.one_ring(_hills(spark)[1])


def m03_border(spark, sf):
    return meshes.border(_hills(spark)[1])


def m04_normals(spark, sf):
    n = meshes.vertex_normals(*_hills(spark))
    return n.select("id", *(R(c, 7).alias(c) for c in ("nx", "ny", "nz")))


def m06_curvature(spark, sf):
    c = meshes.curvature(*meshes.sphere(spark))
    return c.select("id", R("gaussian", 3).alias("gaussian"))


def m08_loop(spark, sf):
    v, f = meshes.subdivide_loop(*_hills(spark))
    return meshes.summary(v, f).select("n_vertices", "n_edges", "n_faces", "euler")


def m08_sqrt3(spark, sf):
    v, f = meshes.subdivide_sqrt3(*_hills(spark))
    return meshes.summary(v, f).select("n_vertices", "n_edges", "n_faces", "euler")


def m09_cluster(spark, sf):
    v, f = meshes.cluster_vertices(*_hills(spark), size=3.0)
    return v.select(R("x", 6).alias("x"), R("y", 6).alias("y"), R("z", 6).alias("z"))


def m09_quadric(spark, sf):
    return meshes.simplify(*_hills(spark), keep_faces=400)[1]


def m12_morse(spark, sf):
    return meshes.morse(*_hills(spark))


def m13_fill(spark, sf):
    _, f = meshes.sphere(spark)
    return meshes.fill_holes(f.where("id > 8"))


def j13_candidates(spark, sf):
    arcs = _arcs(spark, sf).withColumns({"src": C("id") * 2, "dst": C("id") * 2 + 1})
    c = map_matching.candidates(planar(spark, sf), arcs, 600.0, 3)
    return c.select("seq", "arc_id", R("distance", 4).alias("distance"))


_CANDIDATES = f"""WITH {GNSS}, q AS (
  SELECT seq, round((x - 116) * 100000, 3) AS x, round((y - 39) * 100000, 3) AS y FROM gnss
), {ARCS}, m AS (
  SELECT seq, a.id AS arc_id, x, y, x1, y1, x2, y2,
         ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif(power(x2 - x1, 2) + power(y2 - y1, 2), 0) AS t FROM q, ARC a
), d AS (SELECT *, sqrt(power(x - x1 - t * (x2 - x1), 2) + power(y - y1 - t * (y2 - y1), 2)) AS d FROM m WHERE t BETWEEN 0 AND 1),
n AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY d, arc_id) AS k FROM d WHERE d <= 600)
SELECT seq, arc_id, round(d, 4) AS distance FROM n WHERE k <= 3"""


def j14_match(spark, sf):
    """Tracks along a lattice of streets."""
    lines = spark.range(11).select((C("id") * 1000.0).alias("at"))
    step = spark.range(10).select((C("id") * 1000.0).alias("low"))
    grid = lines.join(step)
    node = lambda x, y: (x / 1000 * 1000 + y / 1000).cast("bigint")
    across = grid.select(C("low").alias("x1"), C("at").alias("y1"), (C("low") + 1000).alias("x2"), C("at").alias("y2"))
    up = grid.select(C("at").alias("x1"), C("low").alias("y1"), C("at").alias("x2"), (C("low") + 1000).alias("y2"))
    arcs = across.union(up).select(
        F.abs(F.xxhash64("x1", "y1", "x2", "y2")).alias("id"), node(C("x1"), C("y1")).alias("src"), node(C("x2"), C("y2")).alias("dst"), "x1", "y1", "x2", "y2"
    )
    return map_matching.match(planar(spark, sf), arcs, 300.0).select("traj_id", "seq", "arc_id")


def s19_reservoir(spark, sf):
    return P.reservoir(gnss(spark, sf), 100, "seq").select("seq")


def s03_track_set(spark, sf):
    """Tracks written as lines of the text format, and counted by kind."""
    g = gnss(spark, sf).select(
        C("traj_id").cast("string").alias("traj_id"), C("seq").cast("int").alias("seq"), "ts", "x", "y",
        F.lit(-1.0).alias("speed"), F.lit(-1.0).alias("direction"), F.create_map(F.lit("kind"), C("kind")).alias("extra"),
    )
    lines = P.track_set_lines(g)
    return lines.groupBy(C("place.kind").cast("bigint").alias("kind")).agg(F.count("*").alias("n"))


QUERIES = {
    "s03_track_set": (
        s03_track_set,
        f"WITH {GNSS} SELECT CAST(k AS BIGINT) AS kind, CASE k WHEN 0 THEN 3 WHEN 3 THEN count(*) ELSE count(DISTINCT traj_id) END AS n "
        "FROM gnss, (VALUES (0), (1), (2), (3)) t(k) GROUP BY k",
    ),
    "s19_reservoir": (s19_reservoir, None),
    "j13_candidates": (j13_candidates, _CANDIDATES),
    "j14_match": (j14_match, None),
    "m02_one_ring": (
        m02_one_ring,
        f"WITH {_GRID_MESH}, e AS (SELECT v0 AS a, v1 AS b FROM f UNION SELECT v1, v2 FROM f UNION SELECT v2, v0 FROM f) "
        "SELECT a AS id, b AS neighbour FROM e UNION SELECT b, a FROM e",
    ),
    "m03_border": (
        m03_border,
        f"WITH {_GRID_MESH}, e AS (SELECT v0 AS src, v1 AS dst FROM f UNION SELECT v1, v2 FROM f UNION SELECT v2, v0 FROM f) "
        "SELECT src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.src = e.dst AND o.dst = e.src)",
    ),
    "m04_normals": (
        m04_normals,
        f"""WITH {_GRID_MESH}, o AS (SELECT v0 AS id, nx, ny, nz FROM n UNION ALL SELECT v1, nx, ny, nz FROM n UNION ALL SELECT v2, nx, ny, nz FROM n),
s AS (SELECT id, sum(nx) AS x, sum(ny) AS y, sum(nz) AS z FROM o GROUP BY 1)
SELECT id, round(x / sqrt(x * x + y * y + z * z), 7) AS nx, round(y / sqrt(x * x + y * y + z * z), 7) AS ny,
       round(z / sqrt(x * x + y * y + z * z), 7) AS nz FROM s""",
    ),
    "m05_measures": (
        m05_measures,
        f"""WITH {_GRID_MESH} SELECT id, round(sqrt(nx * nx + ny * ny + nz * nz) / 2, 7) AS area, round(nz / sqrt(nx * nx + ny * ny + nz * nz), 7) AS nz,
round(acos(((x1 - x0) * (x2 - x0) + (y1 - y0) * (y2 - y0) + (z1 - z0) * (z2 - z0)) /
  (sqrt(power(x1 - x0, 2) + power(y1 - y0, 2) + power(z1 - z0, 2)) * sqrt(power(x2 - x0, 2) + power(y2 - y0, 2) + power(z2 - z0, 2)))), 7) AS a0 FROM n""",
    ),
    "m06_curvature": (m06_curvature, None),
    "m07_summary": (
        m07_summary,
        f"""WITH {_GRID_MESH}, h AS (SELECT v0 AS a, v1 AS b FROM f UNION ALL SELECT v1, v2 FROM f UNION ALL SELECT v2, v0 FROM f),
e AS (SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS k FROM h GROUP BY 1, 2),
l AS (SELECT k, sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2) + power(p.z - q.z, 2)) AS len FROM e JOIN v p ON p.id = a JOIN v q ON q.id = b)
SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM l) AS n_edges, (SELECT count(*) FROM f) AS n_faces,
  (SELECT count(*) FROM l WHERE k = 1) AS border_edges, (SELECT count(*) FROM v) - (SELECT count(*) FROM l) + (SELECT count(*) FROM f) AS euler,
  (SELECT round(sum(sqrt(nx * nx + ny * ny + nz * nz)) / 2, 5) FROM n) AS area,
  (SELECT round(sum(x0 * (y1 * z2 - z1 * y2) + y0 * (z1 * x2 - x1 * z2) + z0 * (x1 * y2 - y1 * x2)) / 6, 5) FROM n) AS volume,
  (SELECT round(avg(len), 7) FROM l) AS mean_edge""",
    ),
    "m08_loop": (
        m08_loop,
        # One level of any face: vertices and edges add up, each edge is halved, each face quartered.
        "SELECT CAST(651 + 1850 AS BIGINT) AS n_vertices, CAST(2 * 1850 + 3 * 1200 AS BIGINT) AS n_edges, CAST(4800 AS BIGINT) AS n_faces, CAST(1 AS BIGINT) AS euler",
    ),
    "m08_sqrt3": (
        m08_sqrt3,
        "SELECT CAST(651 + 1200 AS BIGINT) AS n_vertices, CAST(1750 + 100 + 3600 AS BIGINT) AS n_edges, CAST(2 * 1750 + 100 AS BIGINT) AS n_faces, CAST(1 AS BIGINT) AS euler",
    ),
    "m09_cluster": (
        m09_cluster,
        f"WITH {_GRID_MESH} SELECT round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM v GROUP BY floor(x / 3), floor(y / 3), floor(z / 3)",
    ),
    "m09_quadric": (m09_quadric, None),
    "m12_morse": (m12_morse, None),
    "m13_fill": (m13_fill, None),
}
