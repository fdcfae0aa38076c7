"""Packing by concatenation: two-pass prefix sums, then fixed windows.

Pass one encodes every document once and stores its ids with the task that wrote them
and the ids before it in that task. The totals per task (one number each) are summed
on the driver into global offsets. Pass two reads the stored ids and cuts them where
the global stream crosses a multiple of the window; a window that two tasks share
shows up as boundary records with one sequence id. Nothing is shuffled or sorted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_tables import (
    default_pattern,
    default_ranks,
    default_vocabulary,
    rank_encoder,
    special_tokens,
)
from .common import materialize

WINDOW = 2048
END_ID = 1


def encode_documents(
    docs: DataFrame, vocabulary: str, ranks: str, pattern: str, end_id: int
) -> DataFrame:
    """doc_id, part, before, n_tokens, ids (packed, two or four bytes each)."""
    source = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    specials = special_tokens(vocabulary)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode = rank_encoder(ranks, pattern, specials).encode_to_numpy
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            starts, counts, packed = [], [], []
            for text in batch.column(1):
                ids = np.append(encode(text.as_py(), allowed_special="all"), end_id)
                starts.append(before)
                counts.append(len(ids))
                before += len(ids)
                packed.append(ids.astype("<u2" if ids.max() < 65536 else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([part] * len(counts), pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(packed, pa.binary()),
                ],
                ["doc_id", "part", "before", "n_tokens", "ids"],
            )

    return source.mapInArrow(
        run, f"doc_id {id_type}, part int, before bigint, n_tokens bigint, ids binary"
    )


def pack(
    docs: DataFrame,
    window: int = WINDOW,
    end_id: int = END_ID,
    vocabulary: str | None = None,
    ranks: str | None = None,
    pattern: str | None = None,
    keep_ids: bool = True,
) -> DataFrame:
    """Cut the concatenated documents into windows; one row per piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    with ``keep_ids``, ids (array of int). A document is its ids and then ``end_id``,
    so a null or empty text is one piece of one id. Every id lies in exactly one
    piece; all windows are full but the last. Repeated rows are packed as often as
    they occur; no rows give no pieces; other columns are ignored.
    """
    vocabulary = vocabulary or default_vocabulary()
    stored = materialize(
        encode_documents(
            docs, vocabulary, ranks or default_ranks(), pattern or default_pattern(), end_id
        ),
        "packing-ids",
    )
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    ends = [0, *accumulate(r.n for r in totals)]
    # One number for each task that wrote ids: sent to each executor once, not with each task.
    offsets_of = stored.sparkSession.sparkContext.broadcast(
        {r.part: before for r, before in zip(totals, ends, strict=False)}
    )
    id_type = stored.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, "
        "doc_tokens bigint, sequence_id bigint, offset bigint"
    ) + (", ids array<int>" if keep_ids else "")

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        offsets = offsets_of.value
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            pieces, owner = [], []
            for i, (part, before, n, packed) in enumerate(
                zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True)
            ):
                ids = np.frombuffer(packed, "<u2" if len(packed) == 2 * n else "<u4").astype("<u4")
                place, start = offsets[part] + before, 0
                while start < n:
                    sequence, offset = divmod(place + start, window)
                    piece = ids[start : start + window - offset]
                    values = (start, len(piece), zlib.crc32(piece), n, sequence, offset)
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
                    owner.append(i)
                    if keep_ids:
                        pieces.append(piece.astype(np.int32))
                    start += len(piece)
            columns = [batch.column(0).take(pa.array(owner, pa.int64()))]
            columns += [pa.array(c, pa.int64()) for c in rows]
            names = "doc_id start length ids_crc32 doc_tokens sequence_id offset".split()
            if keep_ids:
                columns.append(pa.array(pieces, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return stored.mapInArrow(cut, schema)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Whole windows out of pieces that carry ids: sequence_id, length, ids (padded).

    A group holds at most ``window`` ids, so its size is bounded. No pieces give no
    sequences.
    """
    joined = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.flatten(
            F.transform(
                F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"]
            )
        ).alias("ids"),
    )
    padding = F.array_repeat(F.lit(pad_id), (F.lit(window) - F.col("length")).cast("int"))
    return joined.withColumn("ids", F.concat("ids", padding))
