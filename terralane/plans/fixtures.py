"""Adapters from the test tables to tracks, networks and layers, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gnss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geographic track points: traj_id, seq, ts, x, y, kind."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.col("user_id").alias("traj_id"),
        F.col("event_id").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"),
        (116.0 + k / 1000).alias("x"),
        (39.0 + F.col("value") / 1000).alias("y"),
        F.col("event_type").alias("kind"),
    )


GNSS = """
gnss AS (
  SELECT user_id AS traj_id, event_id AS seq, epoch_us(ts) / 1e6 AS ts,
         116.0::DOUBLE + CAST(json_extract_string(props, '$.k') AS DOUBLE) / 1000 AS x,
         39.0::DOUBLE + value / 1000 AS y, event_type AS kind
  FROM events
)"""


def planar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same points in metres."""
    return gnss(spark, sf_dir).select(
        "traj_id",
        "seq",
        "ts",
        F.round((F.col("x") - 116) * 100000, 3).alias("x"),
        F.round((F.col("y") - 39) * 100000, 3).alias("y"),
        "kind",
    )


PLANAR = (
    GNSS
    + """,
planar AS (
  SELECT traj_id, seq, ts, round((x - 116) * 100000, 3) AS x, round((y - 39) * 100000, 3) AS y, kind
  FROM gnss
)"""
)


def great_circle(a: str, b: str, c: str, d: str) -> str:
    """DuckDB text of the cut haversine distance."""
    return (
        f"floor(2 * asin(sqrt(power(sin((radians({b}) - radians({d})) / 2), 2) + cos(radians({b})) * "
        f"cos(radians({d})) * power(sin((radians({a}) - radians({c})) / 2), 2))) * 6378137.0 * 10000) / 10000"
    )


def plane(a: str, b: str, c: str, d: str) -> str:
    return f"sqrt(power({c} - ({a}), 2) + power({d} - ({b}), 2))"


SEGMENTS = (
    GNSS
    + f""",
led AS (
  SELECT *, lead(ts) OVER w AS ts2, lead(x) OVER w AS x2, lead(y) OVER w AS y2
  FROM gnss WINDOW w AS (PARTITION BY traj_id ORDER BY ts, seq)
),
segments AS (
  SELECT *, {great_circle('x', 'y', 'x2', 'y2')} AS length, ts2 - ts AS seconds
  FROM led WHERE ts2 IS NOT NULL
)"""
)


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network nodes: id, x, y."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("bigint")
    return n.select(
        key.alias("id"),
        ((key * 37) % 25).cast("double").alias("x"),
        ((key * 11) % 25).cast("double").alias("y"),
        (key % 5).alias("community"),
    )


NATIONS = """
nodes AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey * 37 % 25 AS DOUBLE) AS x,
         CAST(n_nationkey * 11 % 25 AS DOUBLE) AS y, CAST(n_nationkey % 5 AS BIGINT) AS community
  FROM nation
)"""


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network arcs: src < dst, n lines traded either way, weight (one over n, scaled)."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    counted = (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .join(customer, orders.o_custkey == customer.c_custkey)
        .join(supplier, line.l_suppkey == supplier.s_suppkey)
        .groupBy(
            F.least("c_nationkey", "s_nationkey").cast("bigint").alias("src"),
            F.greatest("c_nationkey", "s_nationkey").cast("bigint").alias("dst"),
        )
        .agg(F.count("*").alias("n"))
        .where("src < dst")
    )
    return counted.select("src", "dst", "n", (1000.0 / F.col("n")).alias("weight"))


TRADE = """
arcs AS (
  SELECT CAST(least(c_nationkey, s_nationkey) AS BIGINT) AS src, CAST(greatest(c_nationkey, s_nationkey) AS BIGINT) AS dst, count(*) AS n,
         1000.0::DOUBLE / count(*) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey
  GROUP BY 1, 2
),
half AS (SELECT src, dst, weight FROM arcs UNION ALL SELECT dst, src, weight FROM arcs)"""

#: Regions as rings of lon/lat corners; a hole goes the other way.
REGIONS = {
    "square": [[(116.02, 39.01), (116.02, 39.08), (116.06, 39.08), (116.06, 39.01)]],
    "triangle": [[(116.00, 39.00), (116.05, 39.30), (116.10, 39.00)]],
    "holed": [
        [(116.01, 39.1), (116.01, 39.4), (116.09, 39.4), (116.09, 39.1)],
        [(116.03, 39.2), (116.07, 39.2), (116.07, 39.3), (116.03, 39.3)],
    ],
}


def regions(spark: SparkSession) -> DataFrame:
    """region, rings (array of arrays of points)."""
    rows = [(name, [[(x, y) for x, y in r] for r in rings]) for name, rings in REGIONS.items()]
    return spark.createDataFrame(rows, "region string, rings array<array<struct<x:double,y:double>>>")


def region_edges_sql() -> str:
    rows = []
    for name, rings in REGIONS.items():
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
                rows.append(f"('{name}', {x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)")
    return "region_edges(region, x1, y1, x2, y2) AS (VALUES " + ", ".join(rows) + ")"
