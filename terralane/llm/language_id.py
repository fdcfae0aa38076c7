"""Language identification by compression.

A language's model is a raw-content zstandard dictionary: the start of some of its
labelled documents. Texts and dictionaries are reduced to lower-case words, as
punctuation and capitals tell nothing of a language here. A text is cut into blocks,
each block is compressed with every dictionary, and the language with the fewest
bytes over all blocks wins. Blocks are short so that the dictionary, not the text's
own past, explains them; the whole text counts. A very short text is compressed four
times over: once alone it doesn't shrink, and zstandard then stores it raw at the same
size for every dictionary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UNDETERMINED = "und"
#: Bounds of the labelled sample: documents of a language, code points of each.
SAMPLE_DOCS = 64
SAMPLE_CHARS = 2048
BLOCK_BYTES = 2048
SHORT_BYTES = 256
_gaps = re.compile(r"[\W\d_]+").sub


def reduced(text: str) -> str:
    """Lower-case words with single spaces between."""
    return _gaps(" ", text).lower()


#: A winner must save this part of the runner-up's bytes, else it is rejected.
MARGIN = 0.002


def learn(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    sample_docs: int = SAMPLE_DOCS,
    sample_chars: int = SAMPLE_CHARS,
) -> dict[str, bytes]:
    """One dictionary per label, from a bounded sample of labelled rows.

    Takes the ``sample_docs`` documents of each language that come first in a hash
    order of their ids and ``sample_chars`` code points of each, so the driver gets a
    few hundred kB a language at any size. Rows with a null label, null or blank text
    are left out; without labelled rows the result is empty.
    """
    rows = labelled.where(
        F.col(lang_col).isNotNull() & (F.length(F.trim(F.col(text_col))) > 0)
    ).select(
        F.col(lang_col).alias("lang"),
        F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")).alias("rank"),
        F.substring(F.col(text_col), 1, sample_chars).alias("piece"),
    )
    first = Window.partitionBy("lang").orderBy("rank", "piece")
    picked = (
        rows.withColumn("n", F.row_number().over(first))
        .where(F.col("n") <= sample_docs)
        .collect()
    )
    models: dict[str, list[tuple[int, str]]] = {}
    for r in picked:
        models.setdefault(r.lang, []).append((r.n, r.piece))
    # The last bytes of a dictionary are the cheapest to refer to.
    return {
        lang: "\n".join(reduced(p) for _, p in sorted(pieces, reverse=True)).encode("utf-8", "replace")
        for lang, pieces in sorted(models.items())
    }


@lru_cache(maxsize=1)
def _compressors(models: tuple[tuple[str, bytes], ...]):
    import zstandard

    settings = zstandard.ZstdCompressionParameters(
        window_log=18,
        chain_log=17,
        hash_log=17,
        search_log=4,
        min_match=4,
        target_length=16,
        strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=0,
    )
    out = []
    for _, content in models:
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=settings)
        out.append(
            zstandard.ZstdCompressor(dict_data=known, compression_params=settings).compress
        )
    return out


def sizes(text: str, models: tuple[tuple[str, bytes], ...], block: int) -> list[int]:
    """Bytes that the whole text takes with each model."""
    data = reduced(text).encode("utf-8", "replace")
    if len(data) < SHORT_BYTES:
        data = b" ".join([data] * 4)
    blocks = [data[i : i + block] for i in range(0, len(data), block)]
    return [sum(len(squeeze(b)) for b in blocks) for squeeze in _compressors(models)]


def identify(
    docs: DataFrame,
    models: dict[str, bytes],
    text_col: str = "text",
    margin: float = MARGIN,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add lang_pred, score, margin and rejected to every row of ``docs``.

    ``lang_pred`` is ``und`` with score 0 for a null text, a text without a letter or
    where no language was learned; else the label with the fewest bytes, ties to the
    first in order. ``score`` is that label's share when sizes are turned into
    weights. ``rejected`` holds for ``und`` and where the winner saves less than
    ``margin`` of the runner-up's bytes. Columns of these names are replaced; a text
    is never cut short; one narrow pass.
    """
    models_tuple = tuple(sorted(models.items()))
    labels = [m[0] for m in models_tuple]
    added = ("lang_pred", "score", "margin", "rejected")
    kept = docs.drop(*added)
    schema = StructType(list(kept.schema.fields))
    for name, kind in zip(added, ("string", "double", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    at = kept.columns.index(text_col)

    def judge(text):
        import math

        if text is None or not labels or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, 0.0, True
        n = sizes(text, models_tuple, block_bytes)
        best = min(range(len(n)), key=n.__getitem__)
        rest = sorted(n)[1:]
        gap = (rest[0] - n[best]) / rest[0] if rest else 1.0
        score = 1 / sum(math.exp(max(-700.0, (n[best] - x) / n[best] * 50)) for x in n)
        return labels[best], score, gap, gap < margin

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column(at)]
            extra = [
                pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *extra], [*batch.schema.names, *added]
            )

    return kept.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """True for the quarter of the ids that never teaches."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2
