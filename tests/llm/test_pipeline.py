"""The pipeline on the small table, stage by stage, against plain Python."""

import corpus_pipeline
from pyspark.sql import functions as F
from test_language_pii_pages import accepted_by_hand, plain_spans
from test_near import brute

from terralane.llm import pii


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        steps.append((name, before.toPandas(), docs.toPandas()))
    (_, raw, spoken), (_, a, unique), (_, b, clean), (_, c, pieces) = steps
    assert all(list(x.columns) == list(raw.columns) for x in (spoken, unique, clean))
    assert len(spoken) >= 0.98 * len(raw) and set(spoken.doc_id) <= set(raw.doc_id)
    a = a.sort_values("doc_id").reset_index(drop=True)
    groups, _ = brute(list(a.text), 5)
    assert sorted(unique.doc_id) == [a.doc_id[i] for i, g in enumerate(groups) if g == i]
    assert sorted(clean.doc_id) == sorted(b.doc_id)
    text = dict(zip(b.doc_id, b.text, strict=True))
    found = pii.extract(spark.createDataFrame(b)).collect()
    accepted, _, _ = accepted_by_hand(found, list(b.text))
    ids = {r.doc_id: [(m.start, m.end, "id") for m in r.candidates if m.body.lower() in accepted] for r in found}
    for r in clean.itertuples():
        spans = sorted([(s, e, k) for k, v in plain_spans(text[r.doc_id]).items() for s, e in v] + ids[r.doc_id])
        want, at = "", 0
        for s, e, k in spans:
            if e > at:
                want, at = want + text[r.doc_id][at : max(s, at)] + f"[{k.upper()}]", e
        want += text[r.doc_id][at:]
        assert r.text == want
        assert r.n_chars == len(r.text)
    assert set(pieces.doc_id) == set(clean.doc_id) and pieces.groupby("doc_id").length.sum().equals(pieces.groupby("doc_id").doc_tokens.first())


def test_near_copies_keep_clashing_columns(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, "q", "z"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n string").withColumns({"kept": F.lit(1), "n": F.lit(2)})
    got = corpus_pipeline.near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((*r, 1, 2)) for r in [rows[0], rows[3], rows[4]])


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "sequence_id" in out.columns
