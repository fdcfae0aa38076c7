"""Queries over cells, polygons, rasters and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralane.functions import geometries as M
from terralane.operators import clustering, rasters, spatial_joins
from terralane.operators.rasters import Grid

from .fixtures import GNSS, PLANAR, REGIONS, SEGMENTS, gnss, planar, plane, region_edges_sql, regions, table
from .tracks import _inside

R = F.round
C = F.col

GRID = Grid(116.0, 39.5, 0.0025, 0.0125, 40, 40)
CELL = "CAST(floor((39.5::DOUBLE - y) / 0.0125::DOUBLE) AS BIGINT) AS row, CAST(floor((x - 116.0::DOUBLE) / 0.0025::DOUBLE) AS BIGINT) AS col"
HELD = "row BETWEEN 0 AND 39 AND col BETWEEN 0 AND 39"
PLANAR_GRID = Grid(0.0, 50000.0, 500.0, 2500.0, 20, 20)


def _cells(df, digits=6):
    return df.select("row", "col", R("value", digits).alias("value"))


def a05_density_dot(spark, sf):
    return _cells(rasters.density(gnss(spark, sf), GRID))


def a05_density_line(spark, sf):
    return _cells(rasters.density(gnss(spark, sf), GRID, "line"))


def a06_heading(spark, sf):
    return _cells(rasters.heading(planar(spark, sf), PLANAR_GRID, geographic=False), 3)


def a07_speed(spark, sf):
    return _cells(rasters.speed(planar(spark, sf), PLANAR_GRID, geographic=False), 4)


def a08_property(spark, sf):
    return _cells(rasters.property_mean(gnss(spark, sf), GRID, C("seq") % 100), 5)


def a10_ends(spark, sf):
    return _cells(rasters.ends_density(gnss(spark, sf), GRID))


def _ends_sql() -> str:
    return f"""WITH {GNSS}, o AS (
  SELECT first(x ORDER BY ts, seq) AS x, first(y ORDER BY ts, seq) AS y FROM gnss GROUP BY traj_id
  UNION ALL SELECT last(x ORDER BY ts, seq), last(y ORDER BY ts, seq) FROM gnss GROUP BY traj_id
), c AS (SELECT {CELL} FROM o)
SELECT row, col, CAST(count(*) AS DOUBLE) AS value FROM c WHERE {HELD} GROUP BY 1, 2"""


_LINE_CELLS = f"""WITH {SEGMENTS}, ends AS (
  SELECT traj_id, length, seconds,
         floor((39.5::DOUBLE - y) / 0.0125::DOUBLE) AS r1, floor((x - 116.0::DOUBLE) / 0.0025::DOUBLE) AS c1,
         floor((39.5::DOUBLE - y2) / 0.0125::DOUBLE) AS r2, floor((x2 - 116.0::DOUBLE) / 0.0025::DOUBLE) AS c2 FROM segments
), steps AS (
  SELECT *, greatest(abs(r2 - r1), abs(c2 - c1)) AS n, unnest(range(0, CAST(greatest(abs(r2 - r1), abs(c2 - c1)) AS BIGINT) + 1)) AS i FROM ends
), cells AS (
  SELECT traj_id, CAST(floor(r1 + i / greatest(n, 1) * (r2 - r1) + 0.5) AS BIGINT) AS row,
         CAST(floor(c1 + i / greatest(n, 1) * (c2 - c1) + 0.5) AS BIGINT) AS col FROM steps
)"""


_PLANAR_SEGMENTS = f"""WITH {PLANAR}, led AS (
  SELECT *, lead(ts) OVER w AS ts2, lead(x) OVER w AS x2, lead(y) OVER w AS y2
  FROM planar WINDOW w AS (PARTITION BY traj_id ORDER BY ts, seq)
), segments AS (SELECT *, {plane("x", "y", "x2", "y2")} AS length, ts2 - ts AS seconds FROM led WHERE ts2 IS NOT NULL)"""
_PLANAR_HELD = "row BETWEEN 0 AND 19 AND col BETWEEN 0 AND 19"
_HEADING = f"""{_PLANAR_SEGMENTS}, a AS (
  SELECT CAST(floor((50000 - y) / 2500) AS BIGINT) AS row, CAST(floor(x / 500) AS BIGINT) AS col,
         CASE WHEN x = x2 AND y2 > y THEN 360 ELSE (degrees(atan2(x2 - x, y2 - y)) + 360) % 360 END AS a
  FROM segments WHERE NOT (x = x2 AND y = y2)
) SELECT row, col, round(avg(CASE WHEN a > 337.5 THEN a - 360 ELSE a END), 3) AS value FROM a WHERE {_PLANAR_HELD} GROUP BY 1, 2"""
_SPEED = f"""{_PLANAR_SEGMENTS}, ends AS (
  SELECT length, seconds, floor((50000 - y) / 2500) AS r1, floor(x / 500) AS c1, floor((50000 - y2) / 2500) AS r2, floor(x2 / 500) AS c2
  FROM segments WHERE seconds > 0
), steps AS (
  SELECT *, greatest(abs(r2 - r1), abs(c2 - c1)) AS n, unnest(range(0, CAST(greatest(abs(r2 - r1), abs(c2 - c1)) AS BIGINT) + 1)) AS i FROM ends
), cells AS (
  SELECT length / seconds AS v, CAST(floor(r1 + i / greatest(n, 1) * (r2 - r1) + 0.5) AS BIGINT) AS row,
         CAST(floor(c1 + i / greatest(n, 1) * (c2 - c1) + 0.5) AS BIGINT) AS col FROM steps
) SELECT row, col, round(avg(v), 4) AS value FROM cells WHERE {_PLANAR_HELD} GROUP BY 1, 2"""


def r03_map_algebra(spark, sf):
    g = gnss(spark, sf)
    a, b = rasters.density(g, GRID), rasters.ends_density(g, GRID)
    signs = {"plus": "+", "minus": "-", "times": "*", "over": "/"}
    out = None
    for name, sign in signs.items():
        one = rasters.algebra(a, b, sign).select("row", "col", F.lit(name).alias("op"), R("value", 6).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def r02_at(spark, sf):
    return rasters.at(rasters.density(gnss(spark, sf), GRID), GRID.cells(spark))


def r04_idw(spark, sf):
    p = planar(spark, sf).select("x", "y", (C("seq") % 50).cast("double").alias("value"))
    return _cells(rasters.idw(p, Grid(0.0, 50000.0, 500.0, 500.0, 100, 20), k=5), 5)


_IDW = f"""WITH {PLANAR}, cells AS (
  SELECT r AS row, c AS col, (c + 0.5) * 500 AS cx, 50000 - (r + 0.5) * 500 AS cy FROM range(0, 100) t(r), range(0, 20) u(c)
), pairs AS (
  SELECT row, col, x, y, CAST(seq % 50 AS DOUBLE) AS value, greatest(1, sqrt(power(cx - x, 2) + power(cy - y, 2))) AS d
  FROM cells, planar
), n AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY d, x, y, value) AS k FROM pairs)
SELECT row, col, round(sum(value / (d * d)) / sum(1 / (d * d)), 5) AS value FROM n WHERE k <= 5 GROUP BY 1, 2"""


def p16_labelled(spark, sf):
    g = gnss(spark, sf)
    return rasters.label_points(g, rasters.density(g, GRID), GRID).select("seq", "label")


def j01_points_in_polygons(spark, sf):
    return spatial_joins.points_in_polygons(gnss(spark, sf), regions(spark), 0.05)


def j01_polygon_distance(spark, sf):
    d = spatial_joins.polygon_distance(gnss(spark, sf), regions(spark))
    return d.select("region", "id", R("distance", 7).alias("distance"))


def _points_in_sql() -> str:
    parts = [
        f"SELECT '{r}' AS region, seq AS id FROM gnss WHERE {_inside('x', 'y', r)}" for r in REGIONS
    ]
    return f"WITH {GNSS}, {region_edges_sql()} " + " UNION ALL ".join(parts)


_DISTANCE = f"""WITH {GNSS}, {region_edges_sql()}, p AS (
  SELECT region, seq AS id, x, y, x1, y1, x2, y2,
         greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2)))) AS t
  FROM gnss, region_edges
)
SELECT region, id, round(CASE WHEN sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) / nullif(y2 - y1, 0) * (y - y1) + x1
       THEN 1 ELSE 0 END) % 2 = 1 THEN -1
       ELSE min(sqrt(power(x - x1 - t * (x2 - x1), 2) + power(y - y1 - t * (y2 - y1), 2))) END, 7) AS distance
FROM p GROUP BY 1, 2"""


def _queries_and_points(spark, sf):
    p = planar(spark, sf).select(C("seq").alias("id"), "x", "y")
    return p.where("id % 50 = 0"), p


def j02_grid_index(spark, sf):
    return spatial_joins.point_index(planar(spark, sf), 500.0, "seq")


def j03_range_candidates(spark, sf):
    q, p = _queries_and_points(spark, sf)
    return spatial_joins.candidates_in_range(q, p, 600.0, 500.0)


def j03_within_distance(spark, sf):
    q, p = _queries_and_points(spark, sf)
    d = spatial_joins.within_distance(q, p, 400.0)
    return d.select("query_id", "id", R("distance", 4).alias("distance"))


def o04_nearest(spark, sf):
    q, p = _queries_and_points(spark, sf)
    n = spatial_joins.nearest_k(q, p, 5, 1500.0)
    return n.select("query_id", "id", R("distance", 4).alias("distance"), C("rank").cast("bigint").alias("rank"))


_Q = f"WITH {PLANAR}, p AS (SELECT seq AS id, x, y FROM planar), q AS (SELECT * FROM p WHERE id % 50 = 0)"


def _arcs(spark, sf):
    p = table(spark, sf, "part").select(
        C("p_partkey").alias("id"),
        ((C("p_partkey") * 37) % 10000).cast("double").alias("x1"),
        ((C("p_partkey") * 91) % 50000).cast("double").alias("y1"),
    )
    return p.withColumns(
        {"x2": C("x1") + ((C("id") * 13) % 700 - 350), "y2": C("y1") + ((C("id") * 29) % 700 - 350)}
    )


ARCS = """ARC AS (
  SELECT p_partkey AS id, CAST(p_partkey * 37 % 10000 AS DOUBLE) AS x1, CAST(p_partkey * 91 % 50000 AS DOUBLE) AS y1,
         CAST(p_partkey * 37 % 10000 + (p_partkey * 13 % 700 - 350) AS DOUBLE) AS x2,
         CAST(p_partkey * 91 % 50000 + (p_partkey * 29 % 700 - 350) AS DOUBLE) AS y2 FROM part
)"""


def j07_snap(spark, sf):
    q, _ = _queries_and_points(spark, sf)
    s = spatial_joins.snap_to_arcs(q, _arcs(spark, sf), 500.0)
    return s.select("point_id", "arc_id", R("distance", 4).alias("distance"))


_SNAP = f"""{_Q}, {ARCS}, m AS (
  SELECT q.id AS point_id, a.id AS arc_id, x, y, x1, y1, x2, y2,
         greatest(0, least(1, coalesce(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif(power(x2 - x1, 2) + power(y2 - y1, 2), 0), 0))) AS t
  FROM q, ARC a
), d AS (SELECT *, sqrt(power(x - x1 - t * (x2 - x1), 2) + power(y - y1 - t * (y2 - y1), 2)) AS d FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, arc_id) AS k FROM d WHERE d <= 500)
SELECT point_id, arc_id, round(d, 4) AS distance FROM n WHERE k = 1"""


def a14_areas(spark, sf):
    r = regions(spark).select("region", F.struct(F.lit("POLYGON").alias("type"), C("rings").alias("parts")).alias("geom"))
    b = M.bounds(C("geom"))
    closed = F.transform(C("geom.parts"), lambda p: F.concat(p, F.slice(p, 1, 1)))
    outline = F.struct(F.lit("POLYGON").alias("type"), closed.alias("parts"))
    return r.select(
        "region",
        R(M.area(C("geom")), 6).alias("area"),
        R(M.area(C("geom"), geographic=True), 0).alias("square_metres"),
        R(M.perimeter(outline), 6).alias("perimeter"),
        R(b["xmin"], 4).alias("xmin"),
        R(b["ymax"], 4).alias("ymax"),
    )


_AREA = f"""WITH {region_edges_sql()} SELECT region, round(sum((x2 - x1) * (y2 + y1) / 2), 6) AS area,
round(sum((x2 - x1) * (y2 + y1) / 2) * 9101160000.085981::DOUBLE, 0) AS square_metres,
round(sum(sqrt(power(x2 - x1, 2) + power(y2 - y1, 2))), 6) AS perimeter, round(min(x1), 4) AS xmin, round(max(y1), 4) AS ymax
FROM region_edges GROUP BY 1"""


def _lines(spark, sf):
    v = planar(spark, sf)
    parts = v.groupBy("traj_id", (C("seq") % 2).alias("p")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("seq", "x", "y"))),
            lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")),
        ).alias("line")
    )
    return parts.groupBy(C("traj_id").alias("fid")).agg(
        F.struct(
            F.lit("MULTILINESTRING").alias("type"),
            F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda s: s["line"]).alias("parts"),
        ).alias("geom")
    )


def p06_single_parts(spark, sf):
    parts = M.explode_parts(_lines(spark, sf))
    return parts.select(
        "fid",
        C("part").cast("bigint").alias("part"),
        C("geom.type").alias("type"),
        F.size(F.get("geom.parts", F.lit(0))).cast("bigint").alias("n"),
    )


_PARTS = f"WITH {PLANAR}, v AS (SELECT traj_id AS fid, seq % 2 AS p, seq, x, y FROM planar)"


def p07_segments_of_parts(spark, sf):
    s = M.explode_segments(_lines(spark, sf))
    return s.select("fid", C("part").cast("bigint").alias("part"), C("step").cast("bigint").alias("step"), "x1", "y1", "x2", "y2")


def f21_wkt(spark, sf):
    lines = _lines(spark, sf)
    back = lines.select("fid", M.from_wkt(M.to_wkt(C("geom"))).alias("geom"))
    return back.select(
        "fid",
        C("geom.type").alias("type"),
        F.size("geom.parts").cast("bigint").alias("parts"),
        R(M.perimeter(C("geom")), 2).alias("length"),
    )


def f16_hulls(spark, sf):
    h = M.hulls(planar(spark, sf), "traj_id")
    ring = F.reverse("hull")
    return h.select("traj_id", F.size("hull").cast("bigint").alias("n"), R(M.ring_area(ring), 1).alias("area"))


def f17_circles(spark, sf):
    g = planar(spark, sf).select("seq", M.circle(C("x"), C("y"), F.lit(100.0)).alias("ring"))
    return g.select(
        "seq", F.size("ring").cast("bigint").alias("n"), R(M.line_length(C("ring")), 3).alias("length")
    )


def f23_line_cells(spark, sf):
    a = _arcs(spark, sf)
    cell = lambda c: F.floor(C(c) / 100)
    cells = rasters.line_cells(cell("y1"), cell("x1"), cell("y2"), cell("x2"))
    return a.select("id", F.explode(cells).alias("c")).select("id", "c.row", "c.col")


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    x, y = (F.round(F.get("embedding", F.lit(i)).cast("double") * 10000, 0) for i in (0, 1))
    return e.select(C("vec_id").alias("id"), x.alias("x"), y.alias("y"), "label")


def c01_density_clusters(spark, sf):
    return clustering.density_clusters(_vectors(spark, sf), 120.0, 3)


def c02_density_clusters_cost(spark, sf):
    cost = F.abs(C("label") - C("label_b")) * 20.0
    return clustering.density_clusters(_vectors(spark, sf), 220.0, 3, cost)


_VECTORS = """v AS (SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE) * 10000, 0) AS x,
  round(CAST(embedding[2] AS DOUBLE) * 10000, 0) AS y, label FROM embeddings)"""


def _cluster_sql(condition: str) -> str:
    return f"""WITH RECURSIVE {_VECTORS}, e AS (
  SELECT a.id AS s, b.id AS d FROM v a JOIN v b ON {condition}
), reach AS (
  SELECT id AS s, id AS d FROM v UNION SELECT r.s, e.d FROM reach r JOIN e ON r.d = e.s
), c AS (SELECT s AS id, min(d) AS cluster FROM reach GROUP BY 1)
SELECT id, cluster FROM c WHERE cluster IN (SELECT cluster FROM c GROUP BY 1 HAVING count(*) >= 3)"""


CLUSTERS = _cluster_sql("sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 120")


def c03_k_means(spark, sf):
    k = clustering.k_means(_vectors(spark, sf), 6, rounds=25)
    return k.select("id", "cluster")


QUERIES = {
    "a05_density_dot": (
        a05_density_dot,
        f"WITH {GNSS}, c AS (SELECT {CELL} FROM gnss) SELECT row, col, CAST(count(*) AS DOUBLE) AS value FROM c WHERE {HELD} GROUP BY 1, 2",
    ),
    "a05_density_line": (
        a05_density_line,
        f"{_LINE_CELLS} SELECT row, col, CAST(count(DISTINCT traj_id) AS DOUBLE) AS value FROM cells WHERE {HELD} GROUP BY 1, 2",
    ),
    "a06_heading": (a06_heading, _HEADING),
    "a07_speed": (a07_speed, _SPEED),
    "a08_property": (
        a08_property,
        f"WITH {GNSS}, c AS (SELECT seq, {CELL} FROM gnss) SELECT row, col, round(avg(seq % 100), 5) AS value FROM c WHERE {HELD} GROUP BY 1, 2",
    ),
    "a10_ends": (a10_ends, _ends_sql()),
    "r02_at": (
        r02_at,
        f"WITH {GNSS}, c AS (SELECT {CELL} FROM gnss), n AS (SELECT row, col, CAST(count(*) AS DOUBLE) AS value FROM c GROUP BY 1, 2) "
        "SELECT r AS row, c AS col, coalesce(value, 0) AS value FROM range(0, 40) t(r) CROSS JOIN range(0, 40) u(c) LEFT JOIN n ON n.row = r AND n.col = c",
    ),
    "r03_map_algebra": (
        r03_map_algebra,
        f"""WITH {GNSS}, c AS (SELECT {CELL} FROM gnss), a AS (SELECT row, col, CAST(count(*) AS DOUBLE) AS v FROM c WHERE {HELD} GROUP BY 1, 2),
o AS (SELECT first(x ORDER BY ts, seq) AS x, first(y ORDER BY ts, seq) AS y FROM gnss GROUP BY traj_id
  UNION ALL SELECT last(x ORDER BY ts, seq), last(y ORDER BY ts, seq) FROM gnss GROUP BY traj_id),
oc AS (SELECT {CELL} FROM o), b AS (SELECT row, col, CAST(count(*) AS DOUBLE) AS w FROM oc WHERE {HELD} GROUP BY 1, 2),
j AS (SELECT * FROM a JOIN b USING (row, col))
SELECT row, col, 'plus' AS op, v + w AS value FROM j UNION ALL SELECT row, col, 'minus', v - w FROM j
UNION ALL SELECT row, col, 'times', v * w FROM j UNION ALL SELECT row, col, 'over', round(v / w, 6) FROM j""",
    ),
    "r04_idw": (r04_idw, _IDW),
    "p16_labelled": (
        p16_labelled,
        f"WITH {GNSS}, c AS (SELECT seq, {CELL} FROM gnss), n AS (SELECT row, col, CAST(count(*) AS DOUBLE) AS label FROM c WHERE {HELD} GROUP BY 1, 2) "
        "SELECT seq, label FROM c LEFT JOIN n USING (row, col)",
    ),
    "j01_points_in_polygons": (j01_points_in_polygons, _points_in_sql()),
    "j01_polygon_distance": (j01_polygon_distance, _DISTANCE),
    "j02_grid_index": (
        j02_grid_index,
        f"WITH {PLANAR} SELECT CAST(floor(x / 500) AS BIGINT) AS cell_x, CAST(floor(y / 500) AS BIGINT) AS cell_y, seq AS id FROM planar",
    ),
    "j03_range_candidates": (
        j03_range_candidates,
        f"{_Q} SELECT q.id AS query_id, p.id FROM q JOIN p ON abs(floor(q.x / 500) - floor(p.x / 500)) <= 2 AND abs(floor(q.y / 500) - floor(p.y / 500)) <= 2",
    ),
    "j03_within_distance": (
        j03_within_distance,
        f"{_Q} SELECT q.id AS query_id, p.id, round(sqrt(power(q.x - p.x, 2) + power(q.y - p.y, 2)), 4) AS distance FROM q, p "
        "WHERE sqrt(power(q.x - p.x, 2) + power(q.y - p.y, 2)) <= 400",
    ),
    "o04_nearest": (
        o04_nearest,
        f"{_Q}, d AS (SELECT q.id AS query_id, p.id, sqrt(power(q.x - p.x, 2) + power(q.y - p.y, 2)) AS d FROM q, p), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM d WHERE d <= 1500) "
        "SELECT query_id, id, round(d, 4) AS distance, rank FROM r WHERE rank <= 5",
    ),
    "j07_snap": (j07_snap, _SNAP),
    "a14_areas": (a14_areas, _AREA),
    "p06_single_parts": (
        p06_single_parts,
        f"{_PARTS}, n AS (SELECT fid, p, count(*) AS n FROM v GROUP BY 1, 2) "
        "SELECT fid, row_number() OVER (PARTITION BY fid ORDER BY p) - 1 AS part, 'LINESTRING' AS type, n FROM n",
    ),
    "p07_segments_of_parts": (
        p07_segments_of_parts,
        f"""{_PARTS}, r AS (SELECT *, dense_rank() OVER (PARTITION BY fid ORDER BY p) - 1 AS part,
  row_number() OVER (PARTITION BY fid, p ORDER BY seq) - 1 AS step, lead(x) OVER w AS x2, lead(y) OVER w AS y2
  FROM v WINDOW w AS (PARTITION BY fid, p ORDER BY seq))
SELECT fid, part, step, x AS x1, y AS y1, x2, y2 FROM r WHERE x2 IS NOT NULL""",
    ),
    "f21_wkt": (
        f21_wkt,
        f"""{_PARTS}, r AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM v WINDOW w AS (PARTITION BY fid, p ORDER BY seq))
SELECT fid, 'MULTILINESTRING' AS type, count(DISTINCT p) AS parts,
  round(coalesce(sum(sqrt(power(x2 - x, 2) + power(y2 - y, 2))), 0), 2) AS length FROM r GROUP BY 1""",
    ),
    "f16_hulls": (f16_hulls, None),
    "f17_circles": (
        f17_circles,
        f"WITH {PLANAR} SELECT seq, CAST(33 AS BIGINT) AS n, round(32 * 2 * 100 * sin(pi() / 32), 3) AS length FROM planar",
    ),
    "f23_line_cells": (
        f23_line_cells,
        f"""WITH {ARCS}, e AS (SELECT id, floor(y1 / 100) AS r1, floor(x1 / 100) AS c1, floor(y2 / 100) AS r2, floor(x2 / 100) AS c2 FROM ARC),
s AS (SELECT *, greatest(abs(r2 - r1), abs(c2 - c1)) AS n, unnest(range(0, CAST(greatest(abs(r2 - r1), abs(c2 - c1)) AS BIGINT) + 1)) AS i FROM e)
SELECT id, CAST(floor(r1 + i / greatest(n, 1) * (r2 - r1) + 0.5) AS BIGINT) AS row, CAST(floor(c1 + i / greatest(n, 1) * (c2 - c1) + 0.5) AS BIGINT) AS col FROM s""",
    ),
    "c01_density_clusters": (
        c01_density_clusters,
        CLUSTERS,
    ),
    "c02_density_clusters_cost": (
        c02_density_clusters_cost,
        _cluster_sql("sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) + abs(a.label - b.label) * 20 <= 220"),
    ),
    "c03_k_means": (c03_k_means, None),
}
