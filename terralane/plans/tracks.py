"""Queries over tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralane.operators import folds
from terralane.operators import trajectories as T

from .fixtures import GNSS, PLANAR, REGIONS, SEGMENTS, gnss, great_circle, planar, region_edges_sql, table

R = F.round


def _inside(x: str, y: str, region: str) -> str:
    return (
        f"(SELECT count(*) % 2 = 1 FROM region_edges e WHERE e.region = '{region}' AND (e.y1 > {y}) <> (e.y2 > {y}) "
        f"AND {x} < ({y} - e.y1) * ((e.x2 - e.x1) / (e.y2 - e.y1)) + e.x1)"
    )


ENDS = (
    SEGMENTS
    + """,
lengths AS (SELECT traj_id, sum(length) AS length FROM segments GROUP BY 1),
ends AS (
  SELECT traj_id, min(ts) AS start_ts, max(ts) AS end_ts,
         first(x ORDER BY ts, seq) AS start_x, first(y ORDER BY ts, seq) AS start_y,
         last(x ORDER BY ts, seq) AS end_x, last(y ORDER BY ts, seq) AS end_y
  FROM gnss GROUP BY 1
)"""
)

AT = 1704931200.0


def s01_point_scan(spark, sf):
    """Summary of every track: the flagship."""
    return T.summaries(gnss(spark, sf)).select(
        "traj_id", "n_segments", R("length", 1).alias("length"), R("max_speed", 2).alias("max_speed")
    )


def w01_segments(spark, sf):
    return T.segments(gnss(spark, sf)).select(
        "traj_id", "seq", R("length", 1).alias("length"), R("seconds", 3).alias("seconds")
    )


def w02_gap_split(spark, sf):
    parts = T.gap_split(gnss(spark, sf), max_seconds=20000.0, max_distance=40000.0)
    return parts.select("traj_id", "seq", "part")


def a02_length(spark, sf):
    s = T.segments(gnss(spark, sf)).groupBy("traj_id").agg(R(F.sum("length"), 1).alias("length"))
    return s


def q01_length_filter(spark, sf):
    return T.length_filter(gnss(spark, sf), 400_000.0, 500_000.0).select("traj_id", "seq")


def q02_duration_filter(spark, sf):
    return T.duration_filter(gnss(spark, sf), shorter=2_470_000.0, longer=2_400_000.0).select("traj_id", "seq")


def _region(mode, region):
    return lambda spark, sf: T.region_filter(gnss(spark, sf), REGIONS[region], mode).select("traj_id", "seq")


def _region_sql(condition: str) -> str:
    return (
        f"WITH {ENDS}, {region_edges_sql()}, flagged AS (SELECT traj_id, {_inside('start_x', 'start_y', 'triangle')} "
        f"AS o, {_inside('end_x', 'end_y', 'triangle')} AS d FROM ends) "
        f"SELECT traj_id, seq FROM gnss WHERE traj_id IN (SELECT traj_id FROM flagged WHERE {condition})"
    )


def q13_box_filter(spark, sf):
    return T.box_filter(gnss(spark, sf), 116.02, 39.05, 116.05, 39.2).select("traj_id", "seq")


def p12_trips(spark, sf):
    o = T.origins_destinations(gnss(spark, sf))
    return o.select(
        "traj_id",
        *(R(c, 6).alias(c) for c in ("start_x", "start_y", "end_x", "end_y")),
        R("length", 1).alias("length"),
        R("seconds", 3).alias("seconds"),
        R("speed", 5).alias("speed"),
    )


def p13_resample_time(spark, sf):
    return T.resample_time(gnss(spark, sf), 7200.0).select(
        "traj_id", R("ts", 3).alias("ts"), R("x", 7).alias("x"), R("y", 7).alias("y")
    )


def p14_resample_distance(spark, sf):
    r = T.resample_distance(planar(spark, sf), 5000.0, geographic=False)
    return r.select("traj_id", "k", R("x", 3).alias("x"), R("y", 3).alias("y"))


def p15_snapshot(spark, sf):
    s = T.snapshot(gnss(spark, sf), AT)
    return s.select("traj_id", R("x", 7).alias("x"), R("y", 7).alias("y"), R("speed", 5).alias("speed"))


def p17_smooth_heights(spark, sf):
    return _smooth(spark, sf, False)


def p17_smooth_heights_average(spark, sf):
    return _smooth(spark, sf, True)


def _smooth(spark, sf, average):
    v = planar(spark, sf).select(
        F.col("traj_id").alias("line_id"), "seq", "x", "y", (F.col("seq") % 97).cast("double").alias("z")
    )
    return T.smooth_heights(v, average).select("line_id", "seq", R("z", 6).alias("z"))


def _smooth_sql(average: bool) -> str:
    z = "z1 * (1 - p) + z3 * p"
    z = f"({z} + z) / 2" if average else z
    return f"""WITH {PLANAR}, v AS (
  SELECT traj_id AS line_id, seq, x, y, CAST(seq % 97 AS DOUBLE) AS z FROM planar
), n AS (
  SELECT *, lag(x) OVER w AS x1, lag(y) OVER w AS y1, lag(z) OVER w AS z1,
         lead(x) OVER w AS x3, lead(y) OVER w AS y3, lead(z) OVER w AS z3
  FROM v WINDOW w AS (PARTITION BY line_id ORDER BY seq)
), d AS (
  SELECT *, sqrt(power(x - x1, 2) + power(y - y1, 2)) AS d1, sqrt(power(x3 - x, 2) + power(y3 - y, 2)) AS d2 FROM n
), q AS (SELECT *, d1 / nullif(d1 + d2, 0) AS p FROM d)
SELECT line_id, seq, round(coalesce({z}, z), 6) AS z FROM q"""


def a01_bounds(spark, sf):
    g = gnss(spark, sf)
    return g.groupBy("traj_id").agg(
        *(R(f(c), 6).alias(f"{c}{n}") for c in "xy" for f, n in ((F.min, "min"), (F.max, "max")))
    )


def a03_statistics(spark, sf):
    s = T.statistics(gnss(spark, sf))
    return s.select(
        "n_segments",
        R("avg_seconds", 3).alias("avg_seconds"),
        R("avg_length", 2).alias("avg_length"),
        R("avg_speed", 3).alias("avg_speed"),
        R("first_ts", 3).alias("first_ts"),
        R("last_ts", 3).alias("last_ts"),
        *(R(c, 2).alias(c) for c in s.columns if c.startswith("seconds_q")),
    )


def a03_length_quantiles(spark, sf):
    return T.length_quantiles(gnss(spark, sf)).select("q", R("length", 1).alias("length"))


def a04_interval_histogram(spark, sf):
    return T.histogram(gnss(spark, sf), "seconds")


def a04_length_histogram(spark, sf):
    return T.histogram(gnss(spark, sf), "length")


def _bucket_sql(what: str, bounds) -> str:
    arms, low = [], None
    for high in bounds:
        label = f"<={high}" if low is None else f"{low}-{high}"
        arms.append(f"WHEN {what} <= {high} THEN '{label}'")
        low = high
    return f"CASE {' '.join(arms)} ELSE '>{low}' END"


def o01_longest_first(spark, sf):
    ranked = a02_length(spark, sf).orderBy(F.desc("length"), "traj_id").limit(20)
    return ranked


def u01_union_all(spark, sf):
    g = gnss(spark, sf).select("traj_id", "seq")
    return T.union_all(g.where("traj_id < 40"), g.where("traj_id > 20"))


def u02_distinct_union(spark, sf):
    g = gnss(spark, sf).select("traj_id", "seq")
    return T.union_all(g.where("traj_id < 40"), g.where("traj_id > 20")).distinct()


def k05_track_lines(spark, sf):
    lines = T.as_lines(planar(spark, sf), geographic=False)
    return lines.select("traj_id", F.size("line").cast("bigint").alias("n"), R("length", 2).alias("length"))


def q07_overspeed(spark, sf):
    return folds.drop_overspeed(gnss(spark, sf), 8.0).select("traj_id", "seq")


def q08_same_place(spark, sf):
    p = planar(spark, sf).withColumns({c: F.floor(F.col(c) / 20000) * 20000.0 for c in "xy"})
    return folds.drop_same_place(p, geographic=False).select("traj_id", "seq")


def q10_ping_pong(spark, sf):
    p = planar(spark, sf).withColumns({c: F.floor(F.col(c) / 20000) * 20000.0 for c in "xy"})
    return folds.drop_ping_pong(p).select("traj_id", "seq")


def q11_turns(spark, sf):
    return folds.drop_frequent_turns(planar(spark, sf), 100.0, 86400.0, 3).select("traj_id", "seq")


def w03_concurrent(spark, sf):
    return folds.split_concurrent(gnss(spark, sf), max_speed=5.0, max_distance=60000.0, max_seconds=90000.0).select(
        "traj_id", "seq", "part"
    )


def w05_stays(spark, sf):
    return folds.stays_and_moves(gnss(spark, sf), tolerance=20000.0, min_seconds=20000.0)


_OVERSPEED = f"""WITH RECURSIVE {GNSS}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY ts, seq) AS i FROM gnss
), kept AS (
  SELECT traj_id, i, seq, ts AS kts, x AS kx, y AS ky, TRUE AS ok FROM numbered WHERE i = 1
  UNION ALL
  SELECT traj_id, i, seq, CASE WHEN good THEN ts ELSE kts END, CASE WHEN good THEN x ELSE kx END,
         CASE WHEN good THEN y ELSE ky END, good
  FROM (
    SELECT n.*, k.kts, k.kx, k.ky,
           n.ts - k.kts > 0 AND {great_circle('k.kx', 'k.ky', 'n.x', 'n.y')} / (n.ts - k.kts) <= 8.0 AS good
    FROM kept k JOIN numbered n ON n.traj_id = k.traj_id AND n.i = k.i + 1
  )
)
SELECT traj_id, seq FROM kept WHERE ok"""

QUERIES = {
    "s01_point_scan": (
        s01_point_scan,
        f"WITH {SEGMENTS} SELECT traj_id, count(*) AS n_segments, round(sum(length), 1) AS length, "
        "round(max(length / nullif(seconds, 0)), 2) AS max_speed FROM segments GROUP BY 1",
    ),
    "w01_segments": (
        w01_segments,
        f"WITH {SEGMENTS} SELECT traj_id, seq, round(length, 1) AS length, round(seconds, 3) AS seconds FROM segments",
    ),
    "w02_gap_split": (
        w02_gap_split,
        f"""WITH {GNSS}, prev AS (
  SELECT *, lag(ts) OVER w AS pts, lag(x) OVER w AS px, lag(y) OVER w AS py
  FROM gnss WINDOW w AS (PARTITION BY traj_id ORDER BY ts, seq)
), parts AS (
  SELECT traj_id, seq, CAST(sum(CASE WHEN ts - pts >= 20000 OR {great_circle('px', 'py', 'x', 'y')} >= 40000
         THEN 1 ELSE 0 END) OVER (PARTITION BY traj_id ORDER BY ts, seq) AS BIGINT) AS part FROM prev
), sized AS (SELECT *, count(*) OVER (PARTITION BY traj_id, part) AS n FROM parts)
SELECT traj_id, seq, part FROM sized WHERE n >= 2""",
    ),
    "a02_length": (
        a02_length,
        f"WITH {SEGMENTS} SELECT traj_id, round(sum(length), 1) AS length FROM segments GROUP BY 1",
    ),
    "q01_length_filter": (
        q01_length_filter,
        f"WITH {SEGMENTS} SELECT traj_id, seq FROM gnss WHERE traj_id IN (SELECT traj_id FROM segments GROUP BY 1 "
        "HAVING sum(length) BETWEEN 400000 AND 500000)",
    ),
    "q02_duration_filter": (
        q02_duration_filter,
        f"WITH {GNSS} SELECT traj_id, seq FROM gnss WHERE traj_id IN (SELECT traj_id FROM gnss GROUP BY 1 "
        "HAVING max(ts) - min(ts) < 2470000 AND max(ts) - min(ts) >= 2400000)",
    ),
    "q03_origin_region": (_region("origin", "triangle"), _region_sql("o AND NOT d")),
    "q04_destination_region": (_region("destination", "triangle"), _region_sql("d AND NOT o")),
    "q05_od_region": (_region("od", "triangle"), _region_sql("o <> d")),
    "q06_intersect_region": (
        _region("intersect", "square"),
        f"WITH {GNSS}, {region_edges_sql()} SELECT traj_id, seq FROM gnss WHERE traj_id IN "
        f"(SELECT traj_id FROM gnss g WHERE {_inside('g.x', 'g.y', 'square')})",
    ),
    "q07_overspeed": (q07_overspeed, _OVERSPEED),
    "q08_same_place": (
        q08_same_place,
        f"""WITH {PLANAR}, p AS (SELECT traj_id, seq, ts, floor(x / 20000) AS x, floor(y / 20000) AS y FROM planar),
w AS (SELECT traj_id, seq, lag(x) OVER w = x AND lag(y) OVER w = y AND lead(x) OVER w = x AND lead(y) OVER w = y AS still
  FROM p WINDOW w AS (PARTITION BY traj_id ORDER BY ts, seq))
SELECT traj_id, seq FROM w WHERE NOT coalesce(still, false)""",
    ),
    "q10_ping_pong": (q10_ping_pong, None),
    "q11_turns": (
        q11_turns,
        f"""WITH {PLANAR}, h AS (
  SELECT *, atan2(lead(y) OVER w - y, lead(x) OVER w - x) AS h FROM planar WINDOW w AS (PARTITION BY traj_id ORDER BY ts, seq)
), c AS (SELECT *, h - lag(h) OVER (PARTITION BY traj_id ORDER BY ts, seq) + pi() AS c FROM h),
t AS (SELECT *, CASE WHEN degrees(abs(c - 2 * pi() * floor(c / (2 * pi())) - pi())) > 100 THEN 1 ELSE 0 END AS sharp FROM c),
n AS (SELECT *, sum(sharp) OVER (PARTITION BY traj_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 86400.0 FOLLOWING)
  - coalesce(sum(sharp) OVER (PARTITION BY traj_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM t)
SELECT traj_id, seq FROM n WHERE NOT (sharp = 1 AND n >= 3)""",
    ),
    "q13_box_filter": (
        q13_box_filter,
        f"WITH {GNSS} SELECT traj_id, seq FROM gnss WHERE x BETWEEN 116.02 AND 116.05 AND y BETWEEN 39.05 AND 39.2",
    ),
    "p12_trips": (
        p12_trips,
        f"WITH {ENDS} SELECT traj_id, round(start_x, 6) AS start_x, round(start_y, 6) AS start_y, "
        "round(end_x, 6) AS end_x, round(end_y, 6) AS end_y, round(length, 1) AS length, "
        "round(end_ts - start_ts, 3) AS seconds, round(length / (end_ts - start_ts), 5) AS speed "
        "FROM ends JOIN lengths USING (traj_id)",
    ),
    "p13_resample_time": (
        p13_resample_time,
        f"""WITH {SEGMENTS}, b AS (SELECT *, min(ts) OVER (PARTITION BY traj_id) AS t0 FROM segments),
ticks AS (
  SELECT *, t0 + unnest(range(CAST(ceil((ts - t0) / 7200) AS BIGINT), CAST(ceil((ts2 - t0) / 7200) AS BIGINT))) * 7200 AS t
  FROM b WHERE seconds > 0
)
SELECT traj_id, round(t, 3) AS ts, round(x + (t - ts) / seconds * (x2 - x), 7) AS x,
       round(y + (t - ts) / seconds * (y2 - y), 7) AS y FROM ticks
UNION ALL
SELECT traj_id, round(max(ts), 3), round(last(x ORDER BY ts, seq), 7), round(last(y ORDER BY ts, seq), 7)
FROM gnss GROUP BY 1""",
    ),
    "p14_resample_distance": (
        p14_resample_distance,
        f"""WITH {PLANAR}, led AS (
  SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM planar WINDOW w AS (PARTITION BY traj_id ORDER BY ts, seq)
), s AS (
  SELECT *, sqrt(power(x2 - x, 2) + power(y2 - y, 2)) AS len FROM led WHERE x2 IS NOT NULL
), c AS (
  SELECT *, coalesce(sum(len) OVER (PARTITION BY traj_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM s
), k AS (
  SELECT *, unnest(range(CAST(ceil(done / 5000) AS BIGINT), CAST(ceil((done + len) / 5000) AS BIGINT))) AS k FROM c WHERE len > 0
)
SELECT traj_id, k, round(x + (k * 5000 - done) / len * (x2 - x), 3) AS x, round(y + (k * 5000 - done) / len * (y2 - y), 3) AS y FROM k""",
    ),
    "p15_snapshot": (
        p15_snapshot,
        f"WITH {SEGMENTS} SELECT traj_id, round(x + ({AT} - ts) / seconds * (x2 - x), 7) AS x, "
        f"round(y + ({AT} - ts) / seconds * (y2 - y), 7) AS y, round(length / seconds, 5) AS speed "
        f"FROM segments WHERE ts <= {AT} AND ts2 > {AT} AND length > 0",
    ),
    "p17_smooth_heights": (p17_smooth_heights, _smooth_sql(False)),
    "p17_smooth_heights_average": (p17_smooth_heights_average, _smooth_sql(True)),
    "a01_bounds": (
        a01_bounds,
        f"WITH {GNSS} SELECT traj_id, round(min(x), 6) AS xmin, round(max(x), 6) AS xmax, round(min(y), 6) AS ymin, "
        "round(max(y), 6) AS ymax FROM gnss GROUP BY 1",
    ),
    "a03_statistics": (
        a03_statistics,
        f"WITH {SEGMENTS} SELECT count(*) AS n_segments, round(avg(seconds), 3) AS avg_seconds, "
        "round(avg(length), 2) AS avg_length, round(avg(CASE WHEN seconds > 0 THEN round(length / seconds, 3) ELSE 0 END), 3) "
        "AS avg_speed, round(min(ts), 3) AS first_ts, round(max(ts2), 3) AS last_ts, "
        + ", ".join(
            f"round(quantile_cont(floor(seconds), {q}), 2) AS seconds_q{int(q * 1000)}" for q in T.QUANTILES
        )
        + " FROM segments",
    ),
    "a03_length_quantiles": (
        a03_length_quantiles,
        f"WITH {SEGMENTS}, o AS (SELECT length, row_number() OVER (ORDER BY length) - 1 AS i, count(*) OVER () AS n "
        "FROM segments), q(q) AS (VALUES "
        + ", ".join(f"({q}::DOUBLE)" for q in T.QUANTILES)
        + ") SELECT q, round(length, 1) AS length FROM o, q WHERE i = floor(n * q)",
    ),
    "a04_interval_histogram": (
        a04_interval_histogram,
        f"WITH {SEGMENTS} SELECT {_bucket_sql('seconds', T.INTERVAL_BOUNDS)} AS bucket, count(*) AS n FROM segments GROUP BY 1",
    ),
    "a04_length_histogram": (
        a04_length_histogram,
        f"WITH {SEGMENTS} SELECT {_bucket_sql('length', T.DISTANCE_BOUNDS)} AS bucket, count(*) AS n FROM segments GROUP BY 1",
    ),
    "o01_longest_first": (
        o01_longest_first,
        f"WITH {SEGMENTS} SELECT traj_id, round(sum(length), 1) AS length FROM segments GROUP BY 1 "
        "ORDER BY length DESC, traj_id LIMIT 20",
    ),
    "u01_union_all": (
        u01_union_all,
        f"WITH {GNSS} SELECT traj_id, seq FROM gnss WHERE traj_id < 40 UNION ALL SELECT traj_id, seq FROM gnss WHERE traj_id > 20",
    ),
    "u02_distinct_union": (
        u02_distinct_union,
        f"WITH {GNSS} SELECT traj_id, seq FROM gnss WHERE traj_id < 40 UNION SELECT traj_id, seq FROM gnss WHERE traj_id > 20",
    ),
    "k05_track_lines": (
        k05_track_lines,
        f"""WITH {PLANAR}, led AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM planar
  WINDOW w AS (PARTITION BY traj_id ORDER BY ts, seq))
SELECT traj_id, count(*) AS n, round(coalesce(sum(sqrt(power(x2 - x, 2) + power(y2 - y, 2))), 0), 2) AS length
FROM led GROUP BY 1""",
    ),
    "w03_concurrent": (w03_concurrent, None),
    "w05_stays": (w05_stays, None),
}
