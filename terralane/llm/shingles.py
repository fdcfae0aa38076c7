"""Word shingles of whole texts as 64-bit hashes, many documents at a time.

Words are runs of bytes that are neither a space nor 0x09-0x0D, with A-Z in lower case.
A document's shingles are its distinct runs of ``k`` words; with fewer words the whole
sequence is the only one; without words there is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=U)
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of the text it is in), in order."""
    data = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    forward, back = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * forward[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * back[starts])
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    return hashes, np.searchsorted(begins, starts, "right") - 1


def shingle_hashes(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, distinct within a text and sorted; start of each text's run)."""
    words, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(counts)])
    parts, owners = [], []

    def chained(at: np.ndarray, length: int) -> np.ndarray:
        h = np.full(len(at), length, U)
        for j in range(length):
            h = mix(h * U(0xD6E8FEB86659FD93) + words[at + j])
        return h

    at = np.flatnonzero(owner[k - 1 :] == owner[: len(owner) - k + 1]) if len(owner) >= k else []
    if len(at):
        parts.append(chained(at, k))
        owners.append(owner[at])
    for length in range(1, k):
        of = np.flatnonzero(counts == length)
        if len(of):
            parts.append(chained(first[of], length))
            owners.append(of)
    if not parts:
        return np.zeros(0, U), np.zeros(len(texts) + 1, np.int64)
    h, o = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(o, minlength=len(texts)))])


def in_portions(column, limit: int = 400_000) -> Iterator[tuple[int, list[bytes]]]:
    """(position of the first, texts as UTF-8) in portions of about ``limit`` bytes."""
    portion, size, first = [], 0, 0
    for i, value in enumerate(column):
        text = (value.as_py() or "").encode("utf-8", "surrogatepass")
        portion.append(text)
        size += len(text)
        if size >= limit:
            yield first, portion
            portion, size, first = [], 0, i + 1
    if portion:
        yield first, portion
