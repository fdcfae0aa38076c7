"""Settings of the library: Spark configuration under one prefix, with defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

PREFIX = "spark.terralane."
# Defaults that change results.
DEFAULTS = {
    "split.seconds": "300",
    "split.metres": "5000",
    "filter.max_speed": "33.333333",
    "grid.scale": "500",
    "read.block_bytes": "33554432",
    "geotiff.tile": "128",
    "hash.name": "chars",
    "shapefile.encoding": "gbk",
}


def get(spark: SparkSession, key: str) -> str:
    """The session's value, else the default, else an empty text."""
    return spark.conf.get(PREFIX + key, DEFAULTS.get(key, ""))


def put(spark: SparkSession, key: str, value: str) -> None:
    spark.conf.set(PREFIX + key, value)
