"""Vocabulary of a byte-level BPE tokenizer file, per Python worker."""

from __future__ import annotations

import base64
import json
from functools import lru_cache


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[str, int]:
    """Printable stand-in -> byte, as byte-level tokenizer files spell bytes.

    Bytes that print in Latin-1 stand for themselves; the others take the code
    points from 256 on, in order.
    """
    table, spare = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            table[chr(byte)] = byte
        else:
            table[chr(spare)] = byte
            spare += 1
    return table


def special_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """Special strings and their ids; read once, on the driver."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return tuple(sorted((t["content"], t["id"]) for t in spec.get("added_tokens", [])))


@lru_cache(maxsize=1)
def load_vocabulary(path: str):
    """(bytes -> id, merges as id triples in rank order, special text -> id)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    spelled = spec["model"]["vocab"]
    vocab = {
        bytes(alphabet[c] for c in token): i
        for token, i in spelled.items()
        if token not in specials
    }
    merges = []
    for m in spec["model"]["merges"]:
        left, right = m.split(" ") if isinstance(m, str) else m
        merges.append((spelled[left], spelled[right], spelled[left + right]))
    return vocab, merges, specials


@lru_cache(maxsize=1)
def rank_encoder(ranks_path: str, pattern: str, specials: tuple[tuple[str, int], ...]):
    """A tiktoken encoder over the same vocabulary, given as ranks."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding(
        "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(specials)
    )
