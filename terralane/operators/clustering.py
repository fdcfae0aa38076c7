"""Density clustering and k-means over planar items (id, x, y, properties)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoints import cut
from .networks import components
from .spatial_joins import within_distance

K_MEANS_ROUNDS = 100


def density_clusters(
    items: DataFrame, reach: float, min_items: int = 2, cost: Column | None = None, weight: float = 1.0
) -> DataFrame:
    """id, cluster of items chained by steps of cost at most ``reach``.

    The cost is distance * weight, plus ``cost`` (an expression over both sides' columns,
    suffix ``_b`` for the far one, not negative) if given. Smaller groups than
    ``min_items`` drop out; the cluster is the least id in it.
    """
    radius = reach / weight
    near = within_distance(items, items, radius).where("query_id < id")
    arcs = near.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "distance")
    if cost is not None:
        a = items.select(*(F.col(c).alias("src" if c == "id" else c) for c in items.columns))
        b = items.select(*(F.col(c).alias("dst" if c == "id" else f"{c}_b") for c in items.columns))
        arcs = arcs.join(a, "src").join(b, "dst").where(F.col("distance") * weight + cost <= reach)
    labels = components(items.select("id"), arcs.select("src", "dst"))
    large = labels.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= min_items)
    return labels.join(large, "component").select("id", F.col("component").alias("cluster"))


def k_means(items: DataFrame, k: int, rounds: int = K_MEANS_ROUNDS) -> DataFrame:
    """id, cluster, cx, cy; the k items of least id seed, until no item changes cluster.

    The centres (k rows, k a parameter) are the only thing sent to tasks or the driver.
    An emptied cluster keeps its centre.
    """
    seeds = items.orderBy("id").limit(k).collect()
    centres = [(i, float(r.x), float(r.y)) for i, r in enumerate(seeds)]
    spark, last = items.sparkSession, None
    for _ in range(rounds):
        placed = (
            items.select("id", "x", "y")
            .withColumn("_c", F.array(*(F.struct(F.lit(c).alias("cluster"), F.lit(x).alias("cx"), F.lit(y).alias("cy")) for c, x, y in centres)))
            .withColumn(
                "_b",
                F.array_min(
                    F.transform(
                        "_c",
                        lambda c: F.struct(
                            (F.pow(F.col("x") - c["cx"], 2) + F.pow(F.col("y") - c["cy"], 2)).alias("d"),
                            c["cluster"].alias("cluster"),
                        ),
                    )
                ),
            )
            .select("id", "x", "y", F.col("_b.cluster").alias("cluster"))
        )
        sums = {
            r.cluster: (r.x, r.y)
            for r in placed.groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).collect()
        }
        new = [(c, *sums.get(c, (x, y))) for c, x, y in centres]
        if new == centres or new == last:
            break
        last, centres = centres, new
    middle = F.broadcast(spark.createDataFrame(centres, "cluster int, cx double, cy double"))
    return cut(placed).join(middle, "cluster").select("id", "cluster", "cx", "cy")
