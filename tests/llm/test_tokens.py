"""BPE automaton and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
from terralane.llm import bpe_automaton, packing  # noqa: E402
from terralane.llm.bpe_tables import default_pattern, default_vocabulary  # noqa: E402

ALPHABET = [
    "a", "b", "é", "ñ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u200b", "\u3000", "1", "²", "½", "٣", "_", "-", "'s", "'ll",
    "<|endoftext|>", "😀", "the", "ing", "!!", "ß", "\x00", "\ufeff", "漢字", "'S",
]


def texts():
    draw = random.Random(1)
    out = ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 25))) for _ in range(300)]
    return [*out, "", None, "a" * 20_000, "ab" * 5_000, " " * 3_000, "!" * 3_000, out[0]]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(default_vocabulary())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)


def test_encode_decode(spark, docs, library):
    got = {r.doc_id: r for r in bpe_automaton.encode_decode(docs).collect()}
    for i, text in enumerate(texts()):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(got[i].decoded.encode()).hexdigest()


def test_automaton_on_a_small_merge_list():
    vocab = {b"a": 0, b"b": 1, b"aa": 2, b"ab": 3, b"aab": 4}
    merges = [(0, 0, 2), (0, 1, 3), (2, 1, 4)]
    a = bpe_automaton.TokenAutomaton(vocab, merges)

    def plain(word):
        ids = [vocab[bytes([c])] for c in word]
        for u, v, uv in merges:
            out, i = [], 0
            while i < len(ids):
                if ids[i : i + 2] == [u, v]:
                    out.append(uv)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    for n in range(1, 1 << 10):
        word = bytes(97 + int(c) for c in bin(n)[3:])
        assert a.encode_word(word) == plain(word)
        assert a.decode(a.encode_word(word)) == word
    with pytest.raises(ValueError):
        a.encode_word(b"c")


def test_automaton_words_are_cached_in_a_bound(monkeypatch, library):
    monkeypatch.setattr(bpe_automaton, "WORD_ENTRIES", 10)
    monkeypatch.setattr(bpe_automaton, "MEMO_ENTRIES", 10)
    coder = bpe_automaton.TextCodec(default_vocabulary(), default_pattern())
    text = " ".join(f"word{i} other{i * 7}" for i in range(200))
    assert np.frombuffer(coder.encode_packed(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("window", [7, 2048])
def test_pack(spark, docs, library, window):
    pieces = packing.pack(docs, window=window).toPandas()
    stream = {}
    for i, text in enumerate(texts()):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        mine = pieces[pieces.doc_id == i].sort_values("start")
        assert [x for part in mine.ids for x in part] == ids
        assert (mine.doc_tokens == len(ids)).all() and mine.length.sum() == len(ids)
        for r in mine.itertuples():
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.length > 0
            for k in range(r.length):
                assert stream.setdefault((r.sequence_id, r.offset + k), r.doc_id) == i
    total = pieces.length.sum()
    assert sorted(stream) == [divmod(k, window) for k in range(total)]


def test_pack_sequences_and_empty(spark, docs):
    pieces = packing.pack(docs, window=64)
    rows = packing.sequences(pieces, window=64).orderBy("sequence_id").collect()
    assert all(len(r.ids) == 64 for r in rows) and all(r.length == 64 for r in rows[:-1])
    assert packing.pack(docs.limit(0)).count() == 0
    assert bpe_automaton.encode_decode(docs.limit(0)).count() == 0
