"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


class UnionFind:
    """Union-find over any hashable keys; the least key is the root."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (parent := up.get(root, root)) != root:
            root = parent
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        up = self.up
        up[b] = a
        up.setdefault(a, a)
        return True


#: Nodes that one union-find holds; a partition with more is contracted in portions.
HELD_NODES = 500_000


def contract(edges: DataFrame) -> DataFrame:
    """Replace edges by the stars of their components, by portions of a partition."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def stars(sets, schema):
            nodes = [x for x in sets.up if sets.find(x) != x]
            for i in range(0, len(nodes), 100_000):
                piece = nodes[i : i + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(piece, schema.field(0).type),
                        pa.array([sets.find(x) for x in piece], schema.field(1).type),
                    ],
                    ["a", "b"],
                )

        sets, schema = UnionFind(), None
        for batch in batches:
            schema = batch.schema
            for a, b in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True
            ):
                sets.union(a, b)
            if len(sets.up) >= HELD_NODES:
                yield from stars(sets, schema)
                sets = UnionFind()
        if sets.up:
            yield from stars(sets, schema)

    return edges.select("a", "b").mapInArrow(run, edges.select("a", "b").schema)


def _stars_done(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s"),
    ).first()
    return row.n, row.s


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that can be reached, for nodes with an edge.

    ``edges`` has columns a and b. Each partition is first contracted by union-find;
    the rest alternates large-star and small-star rounds, whose number grows with the
    logarithm of the graph's size. Every round is a written table, and so are the least
    neighbours in it: a node with very many edges is summed by partial aggregates, and as
    the sum doesn't share the join's exchange, its join partition can be split.
    Self-loops and repeated edges are allowed; nulls are ignored; no edges give no rows.
    """
    clean = edges.where(F.col("a") != F.col("b")).select("a", "b")
    now = materialize(contract(clean).distinct(), "components")
    state = _stars_done(now)
    while state[0]:
        both = now.select("a", "b").unionByName(
            now.select(F.col("b").alias("a"), F.col("a").alias("b"))
        )
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")), "components-least")
        large = materialize(
            both.join(least.hint("merge"), "a")
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct(),
            "components-large",
        )
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "components-least")
        small = (
            large.join(least.hint("merge"), "a")
            .select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
            .select(F.col("e.a").alias("a"), F.col("e.m").alias("b"))
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
        now = materialize(small, "components")
        before, state = state, _stars_done(now)
        if before == state:
            break
    heads = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        heads.select("node", F.col("node").alias("component"))
    )
