"""Copies of images: no two features of a bucket are left uncompared."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralane.llm import image_descriptors as images


@pytest.mark.parametrize("block", [7, 1000])
def test_bucket_pairs_equal_brute_force(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.integers(-(2**62), 2**62, (5, 4))
    rows = []
    for i in range(150):
        flips = [sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 9), replace=False)) for _ in range(4)]
        bits = [int(c) ^ f for c, f in zip(centres[i % 5], flips, strict=True)]
        rows.append((i // 2, 0 if i < 120 else i % 4, i, *bits))
    of = {i: i if i % 7 else 0 for i in range(75)}
    df = spark.createDataFrame([(r[0], of[r[0]], *r[1:]) for r in rows], "image_id bigint, class bigint, key bigint, corner int, " + ", ".join(f"{c} bigint" for c in images.BITS))
    got = sorted(tuple(r) for r in images.bucket_pairs(df, block).collect())
    want = sorted(
        (a[0], b[0], a[2])
        for a in rows
        for b in rows
        if a[0] < b[0] and of[a[0]] != of[b[0]] and a[1] == b[1] and sum((x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) + 2**64).bit_count() for x, y in zip(a[3:], b[3:], strict=True)) <= images.MAX_DISTANCE
    )
    assert want and got == want
    stars = [tuple(r) for r in images.bucket_pairs(df, block, stars=True).collect()]
    # One partner for each feature and block pair.
    assert stars and set(stars) <= set(want) and len(stars) < len(want) / (2 if block > 150 else 1)


def test_tables_grow_with_the_corpus():
    assert images.table_plan(0) == images.table_plan(1 << 24) == (images.KEY_BITS, images.TABLES)
    for n in (1 << 26, 1 << 34, 1 << 40):
        bits, tables = images.table_plan(n)
        assert n / 2**bits <= images.BUCKET_ROWS < n / 2 ** (bits - 1)
        # A match meets as often as in the tables of a small corpus.
        assert tables * 0.9**bits >= images.TABLES * 0.9**images.KEY_BITS
        assert len({tuple(images._chosen_bits(t, bits)) for t in range(tables)}) == tables


def _drawn(rng, n):
    """Features of an image: one mark that all images share, the others at random."""
    made = np.zeros(n, images.FEATURE)
    made["x"], made["y"] = rng.uniform(0, 400, (2, n))
    made["scale"], made["bits"] = 1, rng.integers(0, 2**64, (n, 4), dtype=np.uint64)
    made["bits"][0] = 0x5A5A
    return made


def _copied(rng, of):
    """A copy moved by some pixels, a few bits of each feature flipped."""
    made = of.copy()
    made["x"] += 7
    for row in made["bits"]:
        for bit in rng.choice(256, 12, replace=False).tolist():
            row[bit // 64] ^= np.uint64(1 << bit % 64)
    return made


def _tables(spark, found):
    rows = [(i, f"{i:04}", len(f), bytearray(f.tobytes())) for i, f in found.items()]
    stored = spark.createDataFrame(rows, "image_id bigint, digest string, n_features int, features binary")
    return stored, stored.select("image_id", "digest", "n_features")


def test_table_keys_are_the_chosen_bits():
    made = _drawn(np.random.default_rng(4), 300)
    every = np.unpackbits(made["bits"].copy().view(np.uint8), axis=1, bitorder="little")
    for table, bits in ((0, 20), (3, 27), (9, 60)):
        want = every[:, images._chosen_bits(table, bits)].astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
        assert np.array_equal(images.table_keys(made, table, bits), want)


def test_matches_by_chance_are_no_rows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    found = {i: _drawn(rng, 60) for i in range(120)}
    found |= {1000 + i: _copied(rng, found[i]) for i in range(0, 120, 10)}
    written, write = [], images.materialize

    def counted(df, name, *args):
        out = write(df, name, *args)
        written.append((out.count(), name))
        return out

    monkeypatch.setattr(images, "materialize", counted)
    got = {r.image_id: r.component for r in images.image_groups(*_tables(spark, found), 2, images.MIN_INLIERS).collect()}
    assert got == {i: i % 1000 for k in range(0, 120, 10) for i in (k, 1000 + k)}
    # Every two of the 132 images meet once, by their mark: 8,646 pairs.
    assert max(written)[0] <= len(found), max(written)


@pytest.mark.parametrize("most", [0, 32])
def test_groups_in_blocks_and_by_key_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(images, "MOST_BLOCKS", most)
    monkeypatch.setattr(images, "BLOCK_FEATURES", 500)
    # Votes are counted as they come, so some pairs have theirs from two counts.
    monkeypatch.setattr(images, "_VOTES", 100)
    rng = np.random.default_rng(7)
    found = {}
    for base in range(0, 500, 100):
        found[base] = _drawn(rng, 40 + base // 10)
        # A chain: each is the copy of the one before, the ends are too far apart for a link.
        for k in range(1, 12):
            found[base + k] = _copied(rng, found[base + k - 1 if base < 300 else base])
    got = {r.image_id: r.component for r in images.image_groups(*_tables(spark, found), 2, images.MIN_INLIERS).collect()}
    least = {i: i for i in found}
    for a in found:
        for b in found:
            if a < b and images.consensus(found[a], found[b]) >= images.needed_inliers(found[a], found[b]):
                least = {i: min(least[a], least[b]) if c in (least[a], least[b]) else c for i, c in least.items()}
    assert got == least == {i: i // 100 * 100 for i in found}
    assert images.consensus(found[0], found[11]) < images.MIN_INLIERS


def test_classes_of_many_edited_copies_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for base in range(3):
        picture = images._picture(list(rng.normal(size=32)))
        for k in range(16):
            edited = (0.7 + 0.02 * k) * picture[k % 3 : 96 - k % 4, k % 2 : 96 - k % 5] + 2 * k
            rows.append((base * 100 + k, bytearray(images.encode_pgm(edited))))
    df = spark.createDataFrame(rows, "image_id bigint, media binary")
    got = {r.image_id: r.class_id for r in images.image_copies(df).collect()}
    found = dict(zip([r[0] for r in rows], images.describe([images.decode(bytes(r[1])) for r in rows]), strict=True))
    links = {i: {j for j in found if i != j and images.consensus(found[min(i, j)], found[max(i, j)]) >= images.MIN_INLIERS} for i in found}
    assert all(links[i] == {j for j in found if j // 100 == i // 100} - {i} for i in found)
    assert got == {i: i // 100 * 100 for i in found}


def test_repeated_ids_and_clashing_columns(spark):
    rng = np.random.default_rng(1)
    a, b = (images.encode_pgm(images._picture(list(rng.normal(size=16)))) for _ in range(2))
    rows = [(1, a), (1, a), (1, b), (2, b), (3, b""), (4, None), (4, None), (None, a), (5, b"junk")]
    df = spark.createDataFrame([(i, bytearray(m) if m is not None else None) for i, m in rows], "image_id bigint, media binary")
    df = df.withColumns({c: F.lit("clash") for c in ("digest", "features", "class_id", "class", "key", "corner")})
    got = sorted(((r.image_id, r.class_id) for r in images.image_copies(df).select("image_id", "class_id").collect()), key=repr)
    assert got == sorted([(1, 1), (1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (4, 3), (None, None), (5, 5)], key=repr)


def test_strong_crops_and_small_scales_are_copies(spark):
    def shrunk(picture, k):
        side = len(picture) // k * k
        return picture[:side, :side].reshape(side // k, k, side // k, k).mean((1, 3))

    def coarse(seed, side=384):
        noise = np.random.default_rng(seed).normal(size=(1, side, side)).astype(np.float32)
        smooth = images._blur(images._blur(images._blur(noise, 4), 4), 4)[0]
        return 128 + 70 * np.tanh(smooth / smooth.std())

    rng = np.random.default_rng(2)
    big, other = (images._picture(list(rng.normal(size=16)), 256) for _ in range(2))
    wide, far = coarse(1), coarse(2)
    # Class 0: crops of a large image to an eighth and a sixteenth; class 10: copies under half the size.
    made = {0: big, 1: big[100:191, 60:151], 2: big[100:164, 60:124], 3: other, 10: wide, 11: shrunk(wide, 3), 12: far}
    rows = [(i, bytearray(images.encode_pgm(p))) for i, p in made.items()]
    df = spark.createDataFrame(rows, "image_id bigint, media binary")
    got = {r.image_id: r.class_id for r in images.image_copies(df).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 10: 10, 11: 10, 12: 12}
    assert {r.image_id: r.n_features > 500 for r in images.features(df).where("image_id = 0").collect()} == {0: True}
