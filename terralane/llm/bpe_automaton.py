"""BPE encoding and decoding with an automaton over tokens.

The automaton accepts exactly the token sequences which BPE yields. It starts as one
state with a loop for every byte. Each merge ``u v -> uv``, taken in rank order,
inserts one gadget: the arcs labelled ``u`` are led to a copy of their old target without
the arc ``v``; and every state that has an arc ``u`` gets an arc ``uv`` to where ``v`` led.
So the whole is deterministic: all arcs with one label end in one state, and a state is
known by the token that led there.

The gadgets are kept as flat tables, not spelled out (50,000 states times as many
labels): the parts of each label, the time of each gadget and the arcs taken away. A state
lacks the arc ``t`` if a gadget took it, or a left part of it before the label was made,
from the state or from that of a right part before that was made.

For words the automaton is composed with the spelling of its labels: the state after some
bytes is that of the one accepted path that spells them. These transitions are a table by
state and byte, which is filled where texts first go; a word is one look-up a byte, and
its tokens are read off backwards. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_tables import default_pattern, default_vocabulary, load_vocabulary

#: Transitions and arcs, and whole words, that a worker remembers; beyond it starts anew.
MEMO_ENTRIES = 1_000_000
WORD_ENTRIES, WORD_BYTES = 300_000, 64 << 20
#: Longer words are run without remembering their transitions.
LONG_WORD = 256
_TOKEN_BITS = 24


class TokenAutomaton:
    """Deterministic automaton of a merge list, and its use on pre-split words."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[int, int, int]]):
        size = max(max(vocab.values(), default=0), max((m[2] for m in merges), default=0)) + 1
        self.label = [b""] * size
        for token, i in vocab.items():
            self.label[i] = token
        self.left, self.right, self.made = [-1] * size, [-1] * size, [0] * size
        self.taken: dict[int, int] = {}
        for time, (u, v, uv) in enumerate(merges, 1):
            self._gadget(time, u, v, uv)
        self._spell(vocab)
        self._forget()

    def _gadget(self, time: int, u: int, v: int, uv: int) -> None:
        # Without an arc from u to v the merge never happens.
        if self.has_arc(u, v):
            self.taken[u << _TOKEN_BITS | v] = time
            self.left[uv], self.right[uv], self.made[uv] = u, v, time

    def _spell(self, vocab: dict[bytes, int]) -> None:
        """Labels that can occur, read from their ends: next node by node and byte, label of a node."""
        self.back: dict[int, int] = {}
        self.ends = [-1]
        for token, i in vocab.items():
            if len(token) == 1 or self.left[i] >= 0:
                node = 0
                for byte in reversed(token):
                    node = self.back.setdefault(node << 8 | byte, len(self.ends))
                    if node == len(self.ends):
                        self.ends.append(-1)
                self.ends[node] = i

    def _forget(self) -> None:
        self.next: dict[int, int] = {}
        self.token = [-1]
        self.arcs: dict[int, bool] = {}

    def has_arc(self, state: int, token: int) -> bool:
        """Whether ``token`` may follow the token ``state``."""
        taken, left, right, made = self.taken, self.left, self.right, self.made
        before = len(taken) + len(made) + 1 << 32
        r, r_made = state, before
        while r >= 0:
            t, t_made = token, before
            while t >= 0:
                time = taken.get(r << _TOKEN_BITS | t)
                if time is not None and time < r_made and time <= t_made:
                    return False
                t, t_made = left[t], made[t]
            r, r_made = right[r], made[r]
        return True

    def _step(self, word: bytes, last: list[int], end: int) -> int:
        """The last token of the path that spells ``word[:end]``; ``last`` has those before."""
        back, ends, arcs, node = self.back, self.ends, self.arcs, 0
        for at in range(end - 1, -1, -1):
            node = back.get(node << 8 | word[at])
            if node is None:
                break
            token = ends[node]
            if token >= 0:
                if not at:
                    return token
                arc = last[at] << _TOKEN_BITS | token
                known = arcs.get(arc)
                if known is None:
                    known = arcs[arc] = self.has_arc(last[at], token)
                if known:
                    return token
        raise ValueError("a byte of the word is not in the vocabulary")

    def encode_word(self, word: bytes) -> list[int]:
        """The one accepted path that spells ``word``: a look-up for each byte.

        Every prefix of an accepted path is accepted and a byte string has one accepted
        path, so each byte leads to one state and nothing is taken back.
        """
        last = [-1]
        if len(self.next) + len(self.arcs) >= MEMO_ENTRIES:
            self._forget()
        if len(word) > LONG_WORD:
            for end in range(1, len(word) + 1):
                last.append(self._step(word, last, end))
        else:
            following, token, state = self.next, self.token, 0
            for end, byte in enumerate(word, 1):
                key = state << 8 | byte
                state = following.get(key, -1)
                if state < 0:
                    found = self._step(word, last, end)
                    state = following[key] = len(token)
                    token.append(found)
                last.append(token[state])
        path, at = [], len(word)
        while at:
            path.append(last[at])
            at -= len(self.label[last[at]])
        return path[::-1]

    def decode(self, ids) -> bytes:
        """Emit the labels of the arcs, in order."""
        return b"".join(map(self.label.__getitem__, ids))


class TextCodec:
    """Whole texts: special strings, the pre-split pattern, then the automaton."""

    def __init__(self, vocabulary: str, pattern: str):
        import regex

        vocab, merges, self.specials = load_vocabulary(vocabulary)
        self.automaton = TokenAutomaton(vocab, merges)
        labels = self.automaton.label
        for text, i in self.specials.items():
            if i >= len(labels):
                labels.extend([b""] * (i + 1 - len(labels)))
            labels[i] = text.encode()
        self.find = regex.compile(pattern).findall
        self.cut = (
            regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")").split
            if self.specials
            else None
        )
        self.words: dict[str, bytes] = {}
        self.held = 0

    def _new_word(self, word: str) -> bytes:
        ids = self.automaton.encode_word(word.encode("utf-8", "surrogatepass"))
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        self.held += len(word) + len(packed)
        if len(self.words) >= WORD_ENTRIES or self.held >= WORD_BYTES:
            self.words.clear()
            self.held = len(word) + len(packed)
        self.words[word] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        known, new = self.words.get, self._new_word
        return b"".join([known(w) or new(w) for w in self.find(text)])

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(s in text for s in self.specials):
            return self._plain(text)
        return b"".join(
            self.specials[part].to_bytes(4, "little") if part in self.specials else self._plain(part)
            for part in self.cut(text)
            if part
        )

    def decode_packed(self, packed: bytes) -> str:
        import numpy as np

        ids = np.frombuffer(packed, "<u4").tolist()
        return self.automaton.decode(ids).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def codec(vocabulary: str, pattern: str) -> TextCodec:
    return TextCodec(vocabulary, pattern)


def encode_decode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    pattern: str | None = None,
    keep_payload: bool = True,
) -> DataFrame:
    """Encode each text and decode the ids again.

    Returns ``id_col``, n_tokens, ids_sha256, decoded_sha256 and, with
    ``keep_payload``, ids (array of int) and decoded (string). A null text counts as
    empty: no ids, an empty decoded text. Repeated rows give repeated results; other
    columns of ``docs`` are ignored. One narrow pass, no shuffle; memory is one Arrow
    batch and two bounded caches per worker.
    """
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    id_type = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if keep_payload:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        coder = codec(vocabulary, pattern)
        for batch in batches:
            counts, id_hashes, text_hashes, ids, texts = [], [], [], [], []
            for text in batch.column(1):
                packed = coder.encode_packed(text.as_py())
                back = coder.decode_packed(packed)
                counts.append(len(packed) // 4)
                id_hashes.append(hashlib.sha256(packed).hexdigest())
                text_hashes.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                if keep_payload:
                    ids.append(np.frombuffer(packed, "<i4"))
                    texts.append(back)
            columns = [
                batch.column(0),
                pa.array(counts, pa.int64()),
                pa.array(id_hashes, pa.string()),
                pa.array(text_hashes, pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_payload:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = source.mapInArrow(run, schema)
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out
