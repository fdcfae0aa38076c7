"""Fingerprints, near-duplicate groups and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralane.llm import components, fingerprint, near_dedup
from terralane.llm.shingles import shingle_hashes


def words(draw, n):
    return [f"w{draw.randint(0, 9999)}" for _ in range(n)]


def corpus():
    draw = random.Random(5)
    out = []
    for base in range(12):
        text = words(draw, draw.choice([3, 40, 120, 200]))
        for _ in range(draw.randint(1, 14)):
            copy = list(text)
            for _ in range(draw.randint(0, 6)):
                copy[draw.randrange(len(copy))] = f"x{draw.randint(0, 99999)}"
            out.append(" ".join(copy))
        out += [" ".join(text)] * draw.randint(0, 3)
    passage = " ".join(words(draw, 60))
    out += [" ".join(words(draw, 30)) + " " + passage for _ in range(15)]
    out += ["", None, " \t\n ", "one", "ONE", "two words", "İstanbul ıx", "a\u00a0b c", "z " * 30_000]
    draw.shuffle(out)
    return out


def sets(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def brute(texts, k, percent=80):
    s, up = sets(texts, k), list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(s))], [len(x) for x in s]


@pytest.mark.parametrize(("k", "block"), [(4, 256), (5, 8), (5, 1)])
def test_groups_equal_brute_force(spark, k, block):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = near_dedup.near_duplicates(df.repartition(6), shingle_words=k, block_docs=block).toPandas().set_index("doc_id").sort_index()
    groups, sizes = brute(texts, k)
    assert list(got.component_id) == groups and list(got.n_shingles) == sizes
    assert list(got.kept) == [g == i for i, g in enumerate(groups)]


def test_a_template_family_makes_no_square_work(spark, monkeypatch):
    draw = random.Random(9)
    frame = words(draw, 60)
    texts = [" ".join(frame + words(draw, 28)) for _ in range(5000)]
    for i in range(0, 60, 3):
        texts[i + 1] = texts[i] + " more"
    texts += [texts[2]] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    seen, confirm = [], near_dedup._confirm

    def counted(members, *settings):
        seen.append(members.count())
        return confirm(members, *settings)

    monkeypatch.setattr(near_dedup, "_confirm", counted)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    # All of the family half agree and chain in bands; only pairs stay to be confirmed.
    s = sets(texts[:200], 5)
    assert 0.4 < len(s[0] & s[2]) / len(s[0] | s[2]) < 0.6
    want = {i: i for i in range(len(texts))} | {i + 1: i for i in range(0, 60, 3)} | {5000 + k: 2 for k in range(5)}
    assert got == want and sum(seen) < 500


def test_groups_with_null_ids_repeats_and_no_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, near_dedup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)], key=repr)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_superminhash_estimates_similarity():
    draw = random.Random(2)
    base = [" ".join(words(draw, 400))]
    errors = []
    for cut in (0.05, 0.1, 0.3):
        w = base[0].split()
        for i in draw.sample(range(len(w)), int(cut * len(w))):
            w[i] = f"y{i}"
        texts = [base[0], " ".join(w)]
        h, bounds = shingle_hashes([t.encode() for t in texts], 4)
        s = near_dedup.superminhash(h, bounds, 512)
        a, b = sets(texts, 4)
        errors.append(abs((s[0] == s[1]).mean() - len(a & b) / len(a | b)))
    assert max(errors) < 0.08


def test_superminhash_of_a_long_set_equals_that_of_its_parts():
    h = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 400_000, dtype=np.uint64))
    whole = near_dedup.superminhash(h, np.array([0, len(h)]), 64)
    parts = near_dedup.superminhash(h, np.array([0, 1000, len(h)]), 64).min(0)
    assert (whole[0] == parts).all()


def test_components_of_chains_and_stars(spark):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5), (2000, 1999)]
    draw.shuffle(edges)
    df = spark.createDataFrame([(b, a) for a, b in edges], "a long, b long").repartition(7)
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1300)}, 1999: 1999, 2000: 1999}
    assert components.connected_components(df.limit(0)).count() == 0


def test_fingerprints(spark):
    texts = corpus()
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in fingerprint.edited_neighbours(df).collect()}
    assert len(got) == len(rows)
    by_text = {}
    for i, t in enumerate(texts):
        own, after = t or "", texts[(i + 1) % len(texts)] or ""
        q = len(own) // 4
        edited = own[: len(own) - q] + after[:q]
        r = got[i * 3]
        import hashlib

        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(own, r.fingerprint) == r.fingerprint
        assert (r.fingerprint == '') == (not own.split())
        lower = [x.lower() for x in (own, edited, after)]
        a, b, c = sets(lower, 5)
        for x, y, estimate in ((a, b, r.near_edited), (a, c, r.near_next)):
            true = len(x & y) / len(x | y) if x | y else 1.0
            assert 0 <= estimate <= 1, (x, y)
            assert abs(true - estimate) < (0.16 if len(x | y) > 30 else 0.45)


def test_fingerprint_edges(spark):
    one = spark.createDataFrame([(7, "only one here")], "doc_id long, text string")
    (r,) = fingerprint.edited_neighbours(one).collect()
    assert r.near_next == 1.0
    clash = one.withColumns({c: F.lit("clash") for c in ("fingerprint", "n_chars", "edited_fingerprint", "near_next")})
    (again,) = fingerprint.edited_neighbours(clash).select("fingerprint", "n_chars").collect()
    assert (again.fingerprint, again.n_chars) == (r.fingerprint, 13)
    odd = spark.createDataFrame([(None, "p q"), (1, None), (1, None), (2, "a b c d e f g")], "doc_id long, text string")
    assert fingerprint.edited_neighbours(odd).count() == 4
    assert fingerprint.edited_neighbours(odd.limit(0)).count() == 0
    plan = fingerprint.edited_neighbours(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
