"""Queries work on whole tables, not on the first ids."""

import pytest

from terralane.plans import registry

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    ("name", "column", "table", "key"),
    [
        ("j14_match", "traj_id", "events", "user_id"),
        ("f12_geometry_distance", "fid", "events", "user_id"),
        ("n08_route", "id", "part", "p_partkey"),
    ],
)
def test_every_id_has_a_result(spark, name, column, table, key):
    found = registry.queries()[name](spark, DATA).select(column).distinct()
    every = spark.read.parquet(f"{DATA}/{table}.parquet").select(key).distinct()
    assert every.exceptAll(found).count() == 0 and every.count() > 100
