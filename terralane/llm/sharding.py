"""Sharding by minimax contiguous partition of ordered atomic groups.

Rows with equal texts form a group; groups are ordered by a 64-bit hash of the text.
The smallest capacity with which a greedy pass fills at most the wanted number of
shards is found by binary search, and the order is cut there.

The driver never sees the groups. It starts with their sizes summed over 65,536 hash
ranges and refines only the ranges in which a cut could fall, 16 hash bits at a time,
until these are single groups. The rest of a range's groups stay summed.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 8
LAW = "bytes"
_LEVELS = (48, 32, 16, 0)


class Segments:
    """Ordered hash ranges: (first hash, level, total, groups in it)."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        self.rows = sorted(rows)
        self.ends = [0, *accumulate(r[2] for r in self.rows)]
        self.total = self.ends[-1]

    def reach(self, start: int, capacity: int) -> int:
        """The last boundary to which a shard from boundary ``start`` can go."""
        return bisect_right(self.ends, self.ends[start] + capacity) - 1

    def fits(self, capacity: int, shards: int) -> bool:
        at = 0
        for _ in range(shards):
            at = self.reach(at, capacity)
        return at == len(self.rows)

    def smallest_capacity(self, shards: int) -> int:
        low = max(-(-self.total // shards), max((r[2] for r in self.rows), default=0))
        high = max(self.total, low)
        while low < high:
            middle = (low + high) // 2
            if self.fits(middle, shards):
                high = middle
            else:
                low = middle + 1
        return low

    def doubtful(self, shards: int, largest: int) -> list[tuple[int, int]]:
        """(first hash, level) of divisible ranges in which some cut may fall."""
        low = max(-(-self.total // shards), largest)
        high = self.smallest_capacity(shards)
        early = late = 0
        found = set()
        for _ in range(shards - 1):
            # At least this far: the least capacity, and no range is entered in part.
            early = bisect_right(self.ends, early + low) - 1
            early = self.ends[max(early, 0)]
            # At most this far: the greatest capacity, with ranges as if they were fluid.
            late = min(self.total, late + high)
            i, j = bisect_right(self.ends, early) - 1, bisect_left(self.ends, late)
            for r in self.rows[i : j + 1]:
                if r[3] > 1 and r[1] > 0:
                    found.add((r[0], r[1]))
        return sorted(found)

    def cuts(self, shards: int, capacity: int) -> list[int]:
        """Boundaries between shards: none over capacity, and each near its equal share."""
        n = len(self.rows)
        least, at = [n], n
        for _ in range(shards - 1):
            at = bisect_left(self.ends, self.ends[at] - capacity)
            least.append(at)
        least.reverse()
        out, at = [], 0
        for s in range(shards - 1):
            share = self.ends[at] + (self.total - self.ends[at]) / (shards - s)
            k = bisect_left(self.ends, share)
            if k > 0 and share - self.ends[k - 1] <= self.ends[min(k, n)] - share:
                k -= 1
            k = max(k, min(at + 1, n), least[s])
            at = min(k, self.reach(at, capacity))
            out.append(at)
        return out


def _summed(groups: DataFrame, level: int) -> list[tuple[int, int, int, int]]:
    first = F.shiftleft(F.shiftright("h", level), level)
    rows = (
        groups.groupBy(first.alias("first"))
        .agg(F.sum("total").alias("total"), F.count("*").alias("n"))
        .collect()
    )
    return [(r["first"], level, r["total"], r["n"]) for r in rows]


def plan_cuts(groups: DataFrame, shards: int) -> list[int]:
    """The first hash of every shard but the first, from groups (h, total)."""
    segments = Segments(_summed(groups, _LEVELS[0]))
    largest = groups.agg(F.max("total")).first()[0] or 0
    for level in _LEVELS[1:]:
        doubtful = segments.doubtful(shards, largest)
        if not doubtful:
            break
        chosen = {first for first, _ in doubtful}
        above = level + 16
        within = F.shiftleft(F.shiftright("h", above), above)
        finer = _summed(groups.where(within.isin(*chosen)), level)
        segments = Segments([r for r in segments.rows if r[0] not in chosen] + finer)
    capacity = segments.smallest_capacity(shards)
    ends = [*(r[0] for r in segments.rows), None]
    return [ends[c] for c in segments.cuts(shards, capacity)]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    ``size`` is the text's UTF-8 bytes plus 1; a null text counts as empty. Rows of
    equal text share a shard, so a shard may be larger than an equal share only where
    one text's copies are. ``slot`` counts from 0 within a shard without gaps, in order
    of hash and id. ``grown_shard`` is null, as the law is ``bytes``. Repeated rows get
    slots of their own; null ids are allowed; no rows give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ),
        "shard-rows",
    )
    groups = materialize(rows.groupBy("h").agg(F.sum("size").alias("total")), "shard-groups")
    starts = [c for c in plan_cuts(groups, shards) if c is not None]
    number = F.lit(0)
    for c in starts:
        number = number + (F.col("h") >= c).cast("int")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        rows.withColumn("shard", number.cast("int"))
        .repartitionByRange(partitions, "h", "doc_id")
        .sortWithinPartitions("h", "doc_id")
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        seen, part = [0] * shards, TaskContext.get().partitionId()
        for batch in batches:
            rank = []
            for s in batch.column(4).to_pylist():
                rank.append(seen[s])
                seen[s] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in (0, 1, 2, 4)),
                    pa.array([part] * len(rank), pa.int32()),
                    pa.array(rank, pa.int64()),
                ],
                ["doc_id", "size", "text_crc32", "shard", "part", "rank"],
            )

    ranked = materialize(
        placed.mapInArrow(
            count,
            f"doc_id {id_type}, size bigint, text_crc32 bigint, shard int, part int, rank bigint",
        ),
        "shard-ranks",
    )
    # A count for each shard that a partition holds: at most partitions + shards rows.
    counts = ranked.groupBy("shard", "part").agg(F.count("*").alias("n")).collect()
    before, offsets = [0] * shards, []
    for r in sorted(counts):
        offsets.append((r.shard, r.part, before[r.shard]))
        before[r.shard] += r.n
    table = docs.sparkSession.createDataFrame(offsets, "shard int, part int, before bigint")
    return ranked.join(F.broadcast(table), ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("before") + F.col("rank")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
