"""Queries that apply the scalar functions to whole tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from terralane.functions import geodesy as G
from terralane.functions import projections as P
from terralane.functions import scalars as S

from .fixtures import GNSS, SEGMENTS, gnss, great_circle, table
from terralane.operators import trajectories as T

R = F.round
C = F.col


def _ends(spark, sf):
    return T.segments(gnss(spark, sf)), (C("x"), C("y"), C("x2"), C("y2"))


def f01_planar(spark, sf):
    s, e = _ends(spark, sf)
    return s.select("seq", R(G.planar_distance(*e), 7).alias("d"))


def f03_direction(spark, sf):
    s, e = _ends(spark, sf)
    return s.select("seq", R(G.direction_angle(*e), 5).alias("a"))


def f04_horizontal(spark, sf):
    s, e = _ends(spark, sf)
    return s.select("seq", R(G.horizontal_angle(*e), 5).alias("a"))


def f05_direction_geographic(spark, sf):
    s, e = _ends(spark, sf)
    return s.select("seq", R(G.direction_angle_geographic(*e), 3).alias("a"))


_LINE = (116.02, 39.1, 116.07, 39.3)


def f06_point_segment(spark, sf):
    line = [F.lit(v) for v in _LINE]
    near = G.nearest_on_segment(*line, C("x"), C("y"))
    return gnss(spark, sf).select(
        "seq",
        R(G.point_segment_distance(*line, C("x"), C("y")), 7).alias("d"),
        R(near["x"], 7).alias("nx"),
        R(near["y"], 7).alias("ny"),
        G.foot_class(*line, C("x"), C("y")).alias("side"),
        G.foot_or_null(*line, C("x"), C("y")).isNull().alias("off"),
    )


def f11_segment_segment(spark, sf):
    s, e = _ends(spark, sf)
    line = [F.lit(v) for v in _LINE]
    hit = G.segment_intersection(*e, *line)
    return s.select(
        "seq",
        G.segments_cross(*e, *line).alias("cross"),
        R(G.segment_distance(*e, *line), 7).alias("d"),
        R(hit["x"], 5).alias("hx"),
    )


def f13_distance_3d(spark, sf):
    s, e = _ends(spark, sf)
    z = [(C(c) % 100).cast("double") for c in ("seq", "seq2")]
    return s.select("seq", R(G.distance_3d(e[0], e[1], z[0], e[2], e[3], z[1]), 6).alias("d"))


def f14_colour(spark, sf):
    k = C("p_partkey")
    a, b = [k % 256, (k * 7) % 256, (k * 13) % 256, F.lit(255)], [(k * 3) % 256, k % 200, F.lit(9), F.lit(255)]
    d = G.colour_distance([c.cast("double") for c in a], [c.cast("double") for c in b])
    return table(spark, sf, "part").select(k.alias("id"), R(d, 6).alias("d"))


def f16_side(spark, sf):
    line = [F.lit(v) for v in _LINE]
    return gnss(spark, sf).select(
        "seq",
        G.side_of_line(*line, C("x"), C("y")).alias("side"),
        G.nearly_equal(C("x"), C("y"), F.lit(116.05), F.lit(39.1), 0.01).alias("near"),
    )


def f30_gcj02(spark, sf):
    return _offset(spark, sf, P.gcj02_forward)


def f30_gcj02_inverse(spark, sf):
    return _offset(spark, sf, P.gcj02_inverse)


def f31_bd09(spark, sf):
    return _offset(spark, sf, P.bd09_forward)


def f31_bd09_inverse(spark, sf):
    return _offset(spark, sf, P.bd09_inverse)


def _offset(spark, sf, change):
    return P.map_points(gnss(spark, sf), change).select("seq", R("x", 7).alias("x"), R("y", 7).alias("y"))


_PI = "pi()"


def _waves_sql(v: str, terms) -> str:
    return "(" + " + ".join(f"{a} * sin({v} * {_PI} * {f!r})" for a, f in terms) + ") * 2 / 3"


def _gcj_sql(sign: str) -> str:
    common = [(20, 6), (20, 2)]
    lat = (
        "(-100.0 + 2 * u + 3 * v + 0.2 * v * v + 0.1 * u * v + 0.2 * sqrt(abs(u)) + "
        + _waves_sql("u", common)
        + " + "
        + _waves_sql("v", [(20, 1), (40, 1 / 3), (160, 1 / 12), (320, 1 / 30)])
        + ")"
    )
    lon = (
        "(300.0 + u + 2 * v + 0.1 * u * u + 0.1 * u * v + 0.1 * sqrt(abs(u)) + "
        + _waves_sql("u", common)
        + " + "
        + _waves_sql("u", [(20, 1), (40, 1 / 3), (150, 1 / 12), (300, 1 / 30)])
        + ")"
    )
    return f"""WITH {GNSS}, o AS (
  SELECT seq, x, y, x - 105.0 AS u, y - 35.0 AS v, 1 - 0.00669342162296594323::DOUBLE * power(sin(radians(y)), 2) AS w FROM gnss
)
SELECT seq, round(x {sign} {lon} * 180 / (6378245.0 / sqrt(w) * cos(radians(y)) * pi()), 7) AS x,
       round(y {sign} {lat} * 180 / (6378245.0 * (1 - 0.00669342162296594323::DOUBLE) / (w * sqrt(w)) * pi()), 7) AS y
FROM o"""


_BD = "(3.141592653589793::DOUBLE * 3000.0 / 180.0)"
_PROJECTIONS = {
    "f32_gauss_kruger": P.GaussKruger(central_meridian=117.0),
    "f33_mercator": P.Mercator(),
    "f34_transverse_mercator": P.TransverseMercator(central_meridian=117.0),
    "f35_lambert": P.LambertConformal(central_meridian=105.0, latitude_of_origin=30.0),
}


def _projected(projection):
    def run(spark, sf):
        p = P.map_points(gnss(spark, sf), projection.forward)
        return p.select("seq", R("x", 3).alias("x"), R("y", 3).alias("y"))

    return run


def _round_trip(projection):
    def run(spark, sf):
        p = P.map_points(P.map_points(gnss(spark, sf), projection.forward), projection.inverse)
        return p.select("seq", R("x", 6).alias("x"), R("y", 6).alias("y"))

    return run


ROUND_TRIP = f"WITH {GNSS} SELECT seq, round(x, 6) AS x, round(y, 6) AS y FROM gnss"


def _mercator_sql() -> str:
    e = P.Ellipsoid()
    root = math.sqrt(e.e2)
    return (
        f"WITH {GNSS} SELECT seq, round({e.axis}::DOUBLE * radians(x), 3) AS x, "
        f"round({e.axis}::DOUBLE * ln(tan(pi() / 4 + radians(y) / 2) * power((1 - {root!r}::DOUBLE * sin(radians(y))) / "
        f"(1 + {root!r}::DOUBLE * sin(radians(y))), {root / 2!r}::DOUBLE)), 3) AS y FROM gnss"
    )


def f50_epoch(spark, sf):
    text = F.date_format(C("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf, "orders").select(
        "o_orderkey", S.to_epoch(text).alias("epoch"), S.from_epoch(S.to_epoch(text), "yyyy/MM/dd").alias("day")
    )


def f51_sigmoid(spark, sf):
    x = (C("value") - 250) / 10
    return table(spark, sf, "events").select(
        "event_id", R(S.sigmoid(x), 9).alias("s"), R(S.relu(x), 6).alias("r")
    )


def f52_json(spark, sf):
    e = table(spark, sf, "events")
    parsed = F.from_json("props", "k bigint")
    return e.select("event_id", parsed["k"].alias("k"), F.size(F.json_object_keys("props")).cast("bigint").alias("n"))


def f53_hashes(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", *(S.string_hash(C("c_name"), h, 97).alias(h) for h in ("chars", "md5")))


def f54_hashes(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", *(S.string_hash(C("c_name"), h, 97).alias(h) for h in S.HASHES))


def f56_vectors(spark, sf):
    a, b = S.vector(C("x"), C("y")), S.vector(C("x2"), C("y2"))
    s, _ = _ends(spark, sf)
    return s.select(
        "seq",
        R(S.dot(a, b), 5).alias("dot"),
        R(S.cross2(a, b), 5).alias("cross"),
        R(F.get(S.normalised(a), F.lit(0)), 7).alias("unit"),
        R(F.get(S.combine(a, b, "-"), F.lit(1)), 7).alias("minus"),
    )


def f57_vectors_3d(spark, sf):
    z = (C("seq") % 10).cast("double")
    a, b = S.vector(C("x"), C("y"), z), S.vector(C("x2"), C("y2"), F.lit(1.0))
    s, _ = _ends(spark, sf)
    c = S.cross3(a, b)
    return s.select("seq", *(R(F.get(c, F.lit(i)), 5).alias(f"c{i}") for i in range(3)), R(S.norm(a), 6).alias("n"))


def f58_matrices(spark, sf):
    q = (C("event_id") % 7).cast("double")
    m = F.array(q, F.lit(2.0), F.lit(1.0), C("value") / 100)
    n = S.matrix_product(m, m, 2)
    return table(spark, sf, "events").select(
        "event_id", R(S.determinant(m, 2), 6).alias("det"), R(F.get(n, F.lit(0)), 6).alias("m00"), R(F.get(n, F.lit(3)), 3).alias("m11")
    )


_FOOT = "((x - 116.02) * 0.05 + (y - 39.1) * 0.2) / (0.05 * 0.05 + 0.2 * 0.2)"
_DX, _DY = "(116.07::DOUBLE - 116.02::DOUBLE)", "(39.3::DOUBLE - 39.1::DOUBLE)"
_T = f"(((x - 116.02::DOUBLE) * {_DX} + (y - 39.1::DOUBLE) * {_DY}) / ({_DX} * {_DX} + {_DY} * {_DY}))"

QUERIES = {
    "f01_planar": (
        f01_planar,
        f"WITH {SEGMENTS} SELECT seq, round(sqrt(power(x2 - x, 2) + power(y2 - y, 2)), 7) AS d FROM segments",
    ),
    "f02_great_circle": (
        lambda spark, sf: gnss(spark, sf).select("seq", R(G.great_circle(C("x"), C("y"), F.lit(116.4), F.lit(39.9)), 2).alias("d")),
        f"WITH {GNSS} SELECT seq, round({great_circle('x', 'y', '116.4::DOUBLE', '39.9::DOUBLE')}, 2) AS d FROM gnss",
    ),
    "f03_direction": (
        f03_direction,
        f"""WITH {SEGMENTS} SELECT seq, round(CASE WHEN x = x2 AND y = y2 THEN -1 WHEN y = y2 THEN CASE WHEN x < x2 THEN 90 ELSE 270 END
WHEN x = x2 AND y2 > y THEN 360 WHEN (degrees(atan2(x2 - x, y2 - y)) < 0) THEN degrees(atan2(x2 - x, y2 - y)) + 360
ELSE degrees(atan2(x2 - x, y2 - y)) END, 5) AS a FROM segments""",
    ),
    "f04_horizontal": (
        f04_horizontal,
        f"""WITH {SEGMENTS} SELECT seq, round(CASE WHEN x = x2 AND y = y2 THEN -1 WHEN degrees(atan2(y2 - y, x2 - x)) < 0
THEN degrees(atan2(y2 - y, x2 - x)) + 360 ELSE degrees(atan2(y2 - y, x2 - x)) END, 5) AS a FROM segments""",
    ),
    "f05_direction_geographic": (
        f05_direction_geographic,
        f"""WITH {SEGMENTS}, l AS (SELECT seq, x, y, x2, y2, sign(y2 - y) * {great_circle('x', 'y', 'x', 'y2')} AS dy,
sign(x2 - x) * {great_circle('x', 'y2', 'x2', 'y2')} AS dx FROM segments)
SELECT seq, round(CASE WHEN x = x2 AND y = y2 THEN -1 WHEN degrees(atan2(dx, dy)) < 0 THEN degrees(atan2(dx, dy)) + 360
ELSE degrees(atan2(dx, dy)) END, 3) AS a FROM l""",
    ),
    "f06_point_segment": (
        f06_point_segment,
        f"""WITH {GNSS}, t AS (SELECT seq, x, y, {_T} AS t FROM gnss), n AS (
  SELECT *, 116.02::DOUBLE + greatest(0, least(1, t)) * {_DX} AS nx, 39.1::DOUBLE + greatest(0, least(1, t)) * {_DY} AS ny FROM t
)
SELECT seq, round(sqrt(power(x - nx, 2) + power(y - ny, 2)), 7) AS d, round(nx, 7) AS nx, round(ny, 7) AS ny,
       CASE WHEN t < 0 THEN -1 WHEN t > 1 THEN 1 ELSE 0 END AS side, (t < 0 OR t > 1) AS off FROM n""",
    ),
    "f11_segment_segment": (f11_segment_segment, None),
    "f13_distance_3d": (
        f13_distance_3d,
        f"""WITH {GNSS}, led AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(seq) OVER w AS seq2 FROM gnss
WINDOW w AS (PARTITION BY traj_id ORDER BY ts, seq))
SELECT seq, round(sqrt(power(x - x2, 2) + power(y - y2, 2) + power(seq % 100 - seq2 % 100, 2)), 6) AS d FROM led WHERE seq2 IS NOT NULL""",
    ),
    "f14_colour": (
        f14_colour,
        "SELECT p_partkey AS id, round(sqrt(power(p_partkey % 256 - p_partkey * 3 % 256, 2) + "
        "power(p_partkey * 7 % 256 - p_partkey % 200, 2) + power(p_partkey * 13 % 256 - 9, 2)), 6) AS d FROM part",
    ),
    "f16_side": (
        f16_side,
        f"WITH {GNSS} SELECT seq, CAST(sign({_DX} * (y - 39.1::DOUBLE) - {_DY} * (x - 116.02::DOUBLE)) AS INTEGER) AS side, "
        "abs(x - 116.05::DOUBLE) <= 0.01::DOUBLE AND abs(y - 39.1::DOUBLE) <= 0.01::DOUBLE AS near FROM gnss",
    ),
    "f19_midpoint": (
        lambda spark, sf: (lambda s, e: s.select("seq", R(G.midpoint(*e)["x"], 7).alias("mx"), R(G.midpoint(*e)["y"], 7).alias("my")))(*_ends(spark, sf)),
        f"WITH {SEGMENTS} SELECT seq, round((x + x2) / 2, 7) AS mx, round((y + y2) / 2, 7) AS my FROM segments",
    ),
    "f30_gcj02": (f30_gcj02, _gcj_sql("+")),
    "f30_gcj02_inverse": (f30_gcj02_inverse, _gcj_sql("-")),
    "f31_bd09": (
        f31_bd09,
        f"WITH {GNSS}, z AS (SELECT seq, sqrt(x * x + y * y) + 0.00002 * sin(y * {_BD}) AS z, atan2(y, x) + 0.000003 * cos(x * {_BD}) AS t FROM gnss) "
        "SELECT seq, round(z * cos(t) + 0.0065, 7) AS x, round(z * sin(t) + 0.006, 7) AS y FROM z",
    ),
    "f31_bd09_inverse": (
        f31_bd09_inverse,
        f"WITH {GNSS}, m AS (SELECT seq, x - 0.0065 AS x, y - 0.006 AS y FROM gnss), z AS (SELECT seq, sqrt(x * x + y * y) - 0.00002 * sin(y * {_BD}) AS z, "
        f"atan2(y, x) - 0.000003 * cos(x * {_BD}) AS t FROM m) SELECT seq, round(z * cos(t), 7) AS x, round(z * sin(t), 7) AS y FROM z",
    ),
    **{name: (_projected(p), _mercator_sql() if name == "f33_mercator" else None) for name, p in _PROJECTIONS.items()},
    **{f"{name}_round_trip": (_round_trip(p), ROUND_TRIP) for name, p in _PROJECTIONS.items()},
    "f50_epoch": (
        f50_epoch,
        "SELECT o_orderkey, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS epoch, strftime(o_orderdate, '%Y/%m/%d') AS day FROM orders",
    ),
    "f51_sigmoid": (
        f51_sigmoid,
        "SELECT event_id, round(CASE WHEN (value - 250) / 10 < -20 THEN 0 ELSE 1 / (1 + exp(-(value - 250) / 10)) END, 9) AS s, "
        "round(greatest((value - 250) / 10, 0), 6) AS r FROM events",
    ),
    "f52_json": (
        f52_json,
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(len(json_keys(props)) AS BIGINT) AS n FROM events",
    ),
    "f53_hashes": (
        f53_hashes,
        "SELECT c_custkey, CAST(list_sum([ascii(c) FOR c IN string_split(c_name, '')]) % 97 AS BIGINT) AS chars, "
        "CAST(list_sum([CAST('0x' || substr(md5(c_name), 2 * i + 1, 2) AS BIGINT) FOR i IN range(0, 16)]) % 97 AS BIGINT) AS md5 FROM customer",
    ),
    "f54_hashes": (f54_hashes, None),
    "f56_vectors": (
        f56_vectors,
        f"WITH {SEGMENTS} SELECT seq, round(x * x2 + y * y2, 5) AS dot, round(x * y2 - y * x2, 5) AS cross, "
        "round(x / sqrt(x * x + y * y), 7) AS unit, round(y - y2, 7) AS minus FROM segments",
    ),
    "f57_vectors_3d": (
        f57_vectors_3d,
        f"WITH {SEGMENTS}, v AS (SELECT *, CAST(seq % 10 AS DOUBLE) AS z FROM segments) SELECT seq, round(y * 1 - z * y2, 5) AS c0, "
        "round(z * x2 - x * 1, 5) AS c1, round(x * y2 - y * x2, 5) AS c2, round(sqrt(x * x + y * y + z * z), 6) AS n FROM v",
    ),
    "f58_matrices": (
        f58_matrices,
        "SELECT event_id, round((event_id % 7) * (value / 100) - 2, 6) AS det, round(CAST((event_id % 7) * (event_id % 7) + 2 AS DOUBLE), 6) AS m00, "
        "round(2 + (value / 100) * (value / 100), 3) AS m11 FROM events",
    ),
}
