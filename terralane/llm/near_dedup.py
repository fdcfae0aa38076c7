"""Near-duplicate grouping: SuperMinHash signatures, banding, exact links, union-find.

1. Every document gets its shingle set, a digest of the set and a SuperMinHash
   signature cut into bands. Documents with equal sets form a class; its least id
   stands for it from then on, so copies are never paired.
2. Representatives that share a band are drawn into one neighbourhood (stars to the
   least member of each bucket, then components). Nothing is confirmed yet: this only
   bounds where links can be. A pair of similarity 0.8 shares no band with a
   probability of (1 - 0.8**6)**48, which is 5e-7. Chains of half-alike texts can make a
   neighbourhood large: one of more than a block is drawn anew, from pairs of a bucket
   whose signatures agree in ``NEAR`` of their values. At 0.8 a signature does so but for
   five standard deviations, 3e-7.
3. Inside a neighbourhood full sets are intersected, block against block; a large
   neighbourhood is dealt out as many block pairs, so no task gets more than two
   blocks. A block pair returns the forest of its links, never all pairs.
4. Components over those links give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import UnionFind, connected_components
from .shingles import U, in_portions, mix, shingle_hashes

SHINGLE_WORDS = 5
PERCENT = 80
BANDS = 48
ROWS = 6
BLOCK_DOCS = 256
#: Least estimate (percent) of two signatures in one neighbourhood that is drawn anew.
NEAR = 68
#: Rows of one block of a bucket there; larger buckets are dealt out as block pairs.
BUCKET_ROWS = 512
_PORTION = 32_768


def superminhash(elements: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """Signatures (one row of ``m`` values per set) of sets given as runs of hashes.

    In step j each element draws a fraction and swaps position j of its own
    permutation with a random later one; the slot it lands on keeps the least of
    j + fraction. A set is finished once every slot holds less than j + 1, as all
    later values are larger: long sets stop after a step or two.
    """
    n = len(bounds) - 1
    signatures = np.full((n, m), np.iinfo(np.uint64).max, U)
    flat = signatures.reshape(-1)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(n), sizes)
    low = 0
    while low < len(elements):
        # A portion is whole sets, or one part of a long set, which then meets the others in its slots.
        high = min(len(elements), low + _PORTION)
        if high < len(elements):
            cut = bounds[owner[high]]
            high = int(cut) if cut > low else int(min(bounds[owner[high] + 1], low + 8 * _PORTION))
        e, o = elements[low:high], owner[low:high]
        places = np.broadcast_to(np.arange(m, dtype=np.uint16), (len(e), m)).copy()
        rows = np.arange(len(e))
        for j in range(m):
            drawn = mix(e + U((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            k = j + ((drawn >> U(32)) * U(m - j) >> U(32)).astype(np.int64)
            slot = places[rows, k]
            places[rows, k] = places[rows, j]
            value = U(j << 48) | (mix(drawn ^ U(0xA0761D6478BD642F)) >> U(16))
            np.minimum.at(flat, o * m + slot, value)
            present = np.unique(o)
            open_sets = present[signatures[present].max(axis=1) >= U((j + 1) << 48)]
            if not len(open_sets):
                break
            if len(open_sets) < len(present):
                left = np.isin(o, open_sets)
                e, o, rows = e[left], o[left], rows[left]
        low = high
    return signatures


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cells = signatures.reshape(len(signatures), bands, rows)
    keys = np.broadcast_to(np.arange(bands, dtype=U), cells.shape[:2])
    for r in range(rows):
        keys = mix(keys * U(0xD6E8FEB86659FD93) + cells[:, :, r])
    return keys.view(np.int64)


def sketch(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (a digest of the set), bands, signature (a byte a value).

    Bands are empty where there is no set.
    """
    source = docs.select("doc_id", "text")
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for first, texts in in_portions(batch.column(1)):
                h, bounds = shingle_hashes(texts, k)
                sizes = np.diff(bounds)
                sums = [np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ U(c)))]) for c in (1, 2)]
                signatures = superminhash(h, bounds, bands * rows)
                keys = band_keys(signatures, bands, rows)
                low = (mix(signatures) & U(255)).astype(np.uint8)
                filled = sizes > 0
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(filled * bands)]), pa.int32()),
                    pa.array(keys[filled].reshape(-1), pa.int64()),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array(sizes, pa.int64()),
                        *(pa.array((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64)) for s in sums),
                        lists,
                        pa.array([v.tobytes() for v in low], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands", "signature"],
                )

    return source.mapInArrow(
        run,
        f"doc_id {id_type}, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, signature binary",
    )


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections among a few hundred sets, exactly."""
    sizes = np.array([len(s) for s in sets])
    tokens, codes, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = df[codes] > 1
    owner, codes = owner[shared], codes[shared]
    kept = np.flatnonzero(df > 1)
    dense = np.zeros(len(tokens), np.int64)
    dense[kept] = np.arange(len(kept))
    codes = dense[codes]
    order = np.argsort(codes, kind="stable")
    owner, codes = owner[order], codes[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    step = 4096
    for low in range(0, len(kept), step):
        i, j = np.searchsorted(codes, (low, low + step))
        block = np.zeros((len(sets), min(step, len(kept) - low)), np.float32)
        block[owner[i:j], codes[i:j] - low] = 1
        out += block @ block.T
    return out.astype(np.int64)


def link_forest(ids: list, sets: list[np.ndarray], side: list[int], percent: int) -> list[tuple]:
    """A spanning forest of the links among the sets; between sides only, if there are two."""
    if len(sets) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    common = _overlaps(sets)
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    sides = np.array(side)
    if sides.min() != sides.max():
        linked &= sides[:, None] != sides[None, :]
    found, forest = UnionFind(), []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        if found.union(int(i), int(j)):
            forest.append((ids[i], ids[j]))
    return forest


def near_pairs(rows: DataFrame, near: int = NEAR, block: int = BUCKET_ROWS) -> DataFrame:
    """A forest (a, b) of the rows (bucket, doc_id, signature) that are alike in a bucket.

    A bucket of more than ``block`` rows is dealt out as block pairs. Two rows of a bucket
    whose signatures are ``near`` percent alike, by bias-corrected share of equal bytes, are
    in one tree, or their trees are joined by other block pairs.
    """
    id_type = rows.schema["doc_id"].dataType.simpleString()
    large = materialize(
        rows.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n_blocks")).where("n_blocks > 1"),
        "near-large-buckets",
    )
    n_blocks = F.coalesce("n_blocks", F.lit(1))
    dealt = (
        rows.join(large, "bucket", "left")
        .withColumn("own", F.pmod(F.xxhash64("doc_id"), n_blocks.cast("bigint")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        .select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "doc_id", "signature")
        .repartition("bucket", "low", "high")
        .sortWithinPartitions("bucket", "low", "high")
    )

    def forest(ids: list, signatures: list[bytes]) -> list[tuple]:
        if len(ids) < 2:
            return []
        values = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(ids), -1)
        chance = 1 / 256
        least = values.shape[1] * (near / 100 * (1 - chance) + chance)
        left, found = np.arange(len(ids)), []
        # What is reached is never compared again, so a group of copies takes one pass.
        while len(left):
            reached, left = [left[0]], left[1:]
            while reached and len(left):
                i = reached.pop()
                alike = (values[left] == values[i]).sum(1) >= least
                found += [(ids[i], ids[j]) for j in left[alike]]
                reached += list(left[alike])
                left = left[~alike]
        return found

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, ids, signatures, kind = None, [], [], None
        for batch in batches:
            kind, found = batch.schema.field(3).type, []
            for *place, doc, signature in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if place != key:
                    found += forest(ids, signatures)
                    key, ids, signatures = place, [], []
                ids.append(doc)
                signatures.append(signature)
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i in (0, 1)], ["a", "b"])
        if ids:
            found = forest(ids, signatures)
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(run, f"a {id_type}, b {id_type}")


def _confirm(members: DataFrame, k: int, percent: int, block: int) -> DataFrame:
    """Links (a, b) out of doc_id, component, n_blocks, text."""
    id_type = members.schema["doc_id"].dataType.simpleString()

    def to_sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for first, texts in in_portions(batch.column(3)):
                h, bounds = shingle_hashes(texts, k)
                packed = [h[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(first, len(texts)) for i in range(3)),
                        pa.array(packed, pa.binary()),
                    ],
                    ["doc_id", "component", "n_blocks", "packed"],
                )

    sets = members.select("doc_id", "component", "n_blocks", "text").mapInArrow(
        to_sets, f"doc_id {id_type}, component {id_type}, n_blocks int, packed binary"
    )
    own = F.pmod(F.xxhash64("doc_id"), F.col("n_blocks").cast("bigint")).cast("int")
    pairs = (
        sets.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .select(
            "component",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            "own",
            "doc_id",
            "packed",
        )
    )
    dealt = pairs.repartition("component", "low", "high").sortWithinPartitions(
        "component", "low", "high"
    )

    def link(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = None
        key, ids, sets, side = None, [], [], []
        for batch in batches:
            kind, found = batch.schema.field(4).type, []
            for c, low, high, own, doc, packed in zip(
                *(batch.column(i).to_pylist() for i in range(6)), strict=True
            ):
                if (c, low, high) != key:
                    found += link_forest(ids, sets, side, percent)
                    key, ids, sets, side = (c, low, high), [], [], []
                ids.append(doc)
                sets.append(np.frombuffer(packed, U))
                side.append(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], kind) for i in (0, 1)], ["a", "b"]
            )
        if ids:
            found = link_forest(ids, sets, side, percent)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], kind) for i in (0, 1)], ["a", "b"]
            )

    return dealt.mapInArrow(link, f"a {id_type}, b {id_type}")


def _blocks(groups: DataFrame, block: int) -> DataFrame:
    """node, component, n_blocks: in how many blocks the members of a component are dealt out."""
    counts = groups.groupBy("component").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n_blocks"))
    # Written first: only the large ones, and a component of many rows can be split in the join.
    large = materialize(counts.where("n_blocks > 1"), "near-blocks")
    return groups.join(large, "component", "left").select(
        "node", "component", F.coalesce("n_blocks", F.lit(1)).alias("n_blocks")
    )


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Two documents are linked if 100 * shared shingles >= ``percent`` * all shingles of
    both; links are confirmed on full sets. ``component_id`` is the least doc_id that
    links reach, ``kept`` marks it. Null, empty and blank texts have no set, are linked
    with nothing and kept. A row with a null id belongs to no group: its component_id
    is null and it is kept. Repeated rows share one id and so one component; other
    columns are ignored; no rows give no rows.
    """
    sketches = materialize(sketch(docs, shingle_words, bands, rows), "near-sketch")
    filled = sketches.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    digest = ["set_a", "set_b", "n_shingles"]
    # Written first, so that both sides of the join are dealt anew and a class that many
    # documents share can be split.
    classes = materialize(
        filled.groupBy(*digest).agg(F.min("doc_id").alias("head")), "near-classes"
    )
    members = materialize(
        filled.join(classes.hint("merge"), digest).select(
            "doc_id",
            "n_shingles",
            "head",
            F.when(F.col("doc_id") == F.col("head"), F.col("bands")).alias("bands"),
        ),
        "near-members",
    )
    buckets = members.where(F.col("bands").isNotNull()).select(
        "doc_id", F.explode("bands").alias("bucket")
    )
    heads = (
        buckets.groupBy("bucket")
        .agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("most"))
        .where(F.col("b") != F.col("most"))
        .select("bucket", "b")
    )
    stars = buckets.join(heads, "bucket").select(F.col("doc_id").alias("a"), "b")
    around = materialize(connected_components(stars), "near-neighbourhoods")
    placed = _blocks(around, block_docs)
    small = placed.where("n_blocks = 1").select("node", "component")
    wide = placed.where("n_blocks > 1").select(F.col("node").alias("doc_id"))
    # Only what is in a wide neighbourhood meets again, with its signature.
    again = sketches.select("doc_id", "bands", "signature").join(wide, "doc_id", "left_semi")
    shared = again.select("doc_id", "signature", F.explode("bands").alias("bucket")).join(heads.select("bucket"), "bucket", "left_semi")
    drawn = connected_components(near_pairs(shared))
    placed = _blocks(small.unionByName(drawn), block_docs).withColumnRenamed("node", "doc_id")
    placed = materialize(placed, "near-placed")
    # The neighbourhoods grow with the corpus, so they are never broadcast.
    texts = docs.select("doc_id", "text").join(placed.hint("merge"), "doc_id")
    links = _confirm(texts, shingle_words, percent, block_docs)
    groups = connected_components(links).withColumnRenamed("node", "head")
    grouped = members.select("doc_id", "head").distinct().join(groups, "head", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("component", "head")).alias("component_id")
    )
    return (
        sketches.select("doc_id", "n_shingles")
        .join(grouped, "doc_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component_id", "doc_id").alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
