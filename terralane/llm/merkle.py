"""WARC fixity audit with Merkle trees over ordered record ranges.

A record is its WARC bytes: a header with url and length, then the payload. Records are
ordered by id. A leaf is the hash of a record; a node on level L covers the ids that share
all but their last 4 L bits and hashes its parts in order, each with its place and its
length in bytes, so the offsets of all parts are fixed by it as well. It has ``FANOUT``
parts at most, however the ids lie; the root has those of the highest level. An audit
compares the roots of two replicas and goes down only where nodes differ, adding up the
lengths on the way, so it reads few rows of the lower levels of equal parts and knows the
offset of every difference in either replica. As a node hashes lengths, not offsets from
the start, a lost record changes only the nodes above it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Parts of a node: a step of this many bits.
BITS = 4
FANOUT = 1 << BITS
#: Levels below the root that 64-bit ids need at most.
MOST_LEVELS = 64 // BITS - 1


def record_bytes(url: Column, payload: Column) -> Column:
    """A WARC response record; null fields are empty."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def leaves(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """named, place (the id), hash, bytes.

    Rows of one id are one leaf, whose hash is that of their number and the sums of their
    hashes' parts, in any order. Rows with a null id come after all others (``named`` is
    false), placed by their hash. Other columns are ignored.
    """
    data = record_bytes(F.col("url"), F.col("html"))
    one = records.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.sha2(data.cast("binary"), 256).alias("hash"),
        F.octet_length(data).cast("bigint").alias("bytes"),
    )
    by_hash = F.conv(F.substring("hash", 1, 15), 16, 10).cast("bigint")
    placed = one.select(F.col("id").isNotNull().alias("named"), F.coalesce("id", by_hash).alias("place"), "hash", "bytes")
    part = lambda i: F.conv(F.substring("hash", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")
    many = placed.groupBy("named", "place").agg(
        F.count("*").alias("n"),
        F.min("hash").alias("first"),
        *(F.sum(part(i)).alias(f"part_{i}") for i in range(4)),
        F.sum("bytes").alias("bytes"),
    )
    together = F.concat_ws(":", *(F.col(c).cast("string") for c in ("n", *(f"part_{i}" for i in range(4)))))
    return many.select(
        "named",
        "place",
        F.when(F.col("n") == 1, F.col("first")).otherwise(F.sha2(together.cast("binary"), 256)).alias("hash"),
        "bytes",
    )


def levels_for(*replicas: DataFrame, id_col: str = "page_id") -> int:
    """Levels below the root that hold all ids of the replicas; trees to be compared need the same."""
    widest = 1
    for records in replicas:
        ids = F.col(id_col).cast("bigint")
        found = records.agg(F.min(ids).alias("low"), F.max(ids).alias("high"), F.count_if(ids.isNull()).alias("nameless")).first()
        for i in (found.low, found.high):
            widest = max(widest, 0 if i is None else i.bit_length())
        if found.nameless:
            widest = max(widest, 60)
    return min(MOST_LEVELS, -(-widest // BITS))


def tree(records: DataFrame, levels: int, id_col: str = "page_id") -> DataFrame:
    """level, named, place, up, hash, bytes: all nodes; level 0 are the leaves, the root is levels + 1.

    ``up`` is the place of the node above. No records give no nodes. ``levels`` must hold
    all ids (``levels_for``), else the root has more parts.
    """
    def above(level: int) -> Column:
        return F.shiftright("place", BITS) if level < levels else F.lit(0).cast("bigint")

    with_up = lambda df, level: df.withColumn("up", above(level))
    now = materialize(with_up(leaves(records, id_col), 0), "merkle-leaves")
    out = [now.select(F.lit(0).alias("level"), "*")]
    for level in range(1, levels + 2):
        # The root holds named and nameless records alike.
        named = F.col("named") if level <= levels else F.lit(True)
        parts = F.array_sort(F.collect_list(F.struct((~F.col("named")).alias("late"), "place", "bytes", "hash")))
        spelled = F.transform("parts", lambda c: F.concat_ws(":", c["late"].cast("int"), c["place"], c["bytes"], c["hash"]))
        nodes = (
            now.groupBy(named.alias("side"), F.col("up").alias("place"))
            .agg(parts.alias("parts"), F.sum("bytes").alias("bytes"))
            .select(
                F.col("side").alias("named"),
                "place",
                F.sha2(F.array_join(spelled, ",").cast("binary"), 256).alias("hash"),
                "bytes",
            )
        )
        now = with_up(nodes, level)
        if level % 3 == 0:
            now = materialize(now, "merkle-level")
        out.append(now.select(F.lit(level).alias("level"), "*"))
    return materialize(reduce(DataFrame.unionByName, out), "merkle-tree")


def audit(first: DataFrame, second: DataFrame, levels: int) -> DataFrame:
    """place, status, first_hash, second_hash, first_offset, second_offset of the leaves that differ.

    ``first`` and ``second`` are trees of ``levels``. ``status`` is changed, missing (not in
    the second tree) or extra (only there); offsets count bytes before the leaf in the
    replica's order and are null where it has none. A record with a null id has a null
    place. Equal trees, or two empty ones, give no rows after one comparison of roots.
    """
    suspects = None
    for level in range(levels + 1, -1, -1):
        sides = []
        for side, nodes in (("first", first), ("second", second)):
            of = nodes.where(F.col("level") == level).drop("level")
            offset = F.lit(0).cast("bigint")
            if suspects is not None:
                on = ["up"] if level == levels else ["named", "up"]
                of = of.join(suspects.select(*on, F.col(f"{side}_offset").alias("base")), on)
                before = Window.partitionBy(*on).orderBy(F.col("named").desc(), "place").rowsBetween(Window.unboundedPreceding, -1)
                offset = F.col("base") + F.coalesce(F.sum("bytes").over(before), F.lit(0))
            sides.append(of.select("named", "place", F.col("hash").alias(f"{side}_hash"), offset.alias(f"{side}_offset")))
        differ = materialize(
            sides[0]
            .join(sides[1], ["named", "place"], "full")
            .where(~F.col("first_hash").eqNullSafe(F.col("second_hash"))),
            "merkle-differ",
        )
        if differ.isEmpty():
            break
        suspects = differ.withColumnRenamed("place", "up")
    return differ.select(
        F.when(F.col("named"), F.col("place")).alias("place"),
        F.when(F.col("second_hash").isNull(), "missing")
        .when(F.col("first_hash").isNull(), "extra")
        .otherwise("changed")
        .alias("status"),
        "first_hash",
        "second_hash",
        "first_offset",
        "second_offset",
    )
