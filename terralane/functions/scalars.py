"""Dates, small mathematics, vectors and string hashes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_epoch(text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Whole seconds since 1970 of a UTC date text; null if it does not fit."""
    return F.unix_seconds(F.try_to_timestamp(text, F.lit(pattern)))


def from_epoch(seconds: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.timestamp_seconds(seconds), pattern)


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)); 0 below -20."""
    return F.when(x < -20, 0.0).otherwise(1 / (1 + F.exp(-x)))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def vector(*parts: Column) -> Column:
    return F.array(*parts)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """The vector of length 1; null for one without length."""
    return F.transform(a, lambda p: p / F.nullif(norm(a), F.lit(0.0)))


def cross2(a: Column, b: Column) -> Column:
    return F.get(a, F.lit(0)) * F.get(b, F.lit(1)) - F.get(a, F.lit(1)) * F.get(b, F.lit(0))


def cross3(a: Column, b: Column) -> Column:
    p, q = ([F.get(v, F.lit(i)) for i in range(3)] for v in (a, b))
    return F.array(*(p[(i + 1) % 3] * q[(i + 2) % 3] - p[(i + 2) % 3] * q[(i + 1) % 3] for i in range(3)))


def combine(a: Column, b: Column, sign: str) -> Column:
    """Elementwise +, -, * or / of two vectors; x / 0 is null."""
    how = {
        "+": lambda p, q: p + q,
        "-": lambda p, q: p - q,
        "*": lambda p, q: p * q,
        "/": lambda p, q: p / F.nullif(q, F.lit(0.0)),
    }[sign]
    return F.zip_with(a, b, how)


def matrix_product(a: Column, b: Column, n: int) -> Column:
    """Product of two row-major n x n matrices given as arrays."""
    cell = lambda m, i, j: F.get(m, F.lit(i * n + j))
    return F.array(
        *(sum((cell(a, i, k) * cell(b, k, j) for k in range(n)), F.lit(0.0)) for i in range(n) for j in range(n))
    )


def determinant(m: Column, n: int) -> Column:
    """By expansion along the first row."""
    def minor(rows, cols):
        if len(rows) == 1:
            return F.get(m, F.lit(rows[0] * n + cols[0]))
        terms = [
            F.get(m, F.lit(rows[0] * n + c)) * minor(rows[1:], [k for k in cols if k != c]) * (-1) ** i
            for i, c in enumerate(cols)
        ]
        return sum(terms[1:], terms[0])

    return minor(list(range(n)), list(range(n)))


def code_points(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))


def _wrap(h: Column) -> Column:
    """Signed 32 bits."""
    return F.shiftright(F.shiftleft(h, 32), 32)


def _shift_right(h: Column, n: int) -> Column:
    return F.shiftright(h, n)


def _fold(text: Column, seed: int, step) -> Column:
    return F.aggregate(code_points(text), F.lit(seed).cast("bigint"), lambda h, c: _wrap(step(h, c)))


def _rs(text: Column) -> Column:
    start = F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(63689).cast("bigint").alias("a"))
    step = lambda s, c: F.struct(
        _wrap(s["h"] * s["a"] + c).alias("h"), _wrap(s["a"] * 378551).alias("a")
    )
    return F.aggregate(code_points(text), start, step, lambda s: s["h"])


def _four_bits(text: Column, clear) -> Column:
    def step(h, c):
        moved = _wrap(F.shiftleft(h, 4) + c)
        high = _wrap(moved.bitwiseAND(F.lit(0xF0000000)))
        return F.when(high != 0, clear(moved, high)).otherwise(moved)

    return _fold(text, 0, step)


def _ap(text: Column) -> Column:
    """Even characters mix by <<7 and >>3, odd ones by ~(<<11 ^ >>5); the first half only."""
    points = code_points(text)
    half = F.slice(points, 1, F.greatest(F.ceil(F.size(points) / 2).cast("int"), F.lit(0)))
    marked = F.transform(half, lambda c, i: F.struct(c.alias("c"), (i % 2).alias("odd")))

    def step(h, p):
        even = F.shiftleft(h, 7).bitwiseXOR(p["c"]).bitwiseXOR(F.shiftright(h, 3))
        odd = F.bitwise_not(F.shiftleft(h, 11).bitwiseXOR(p["c"]).bitwiseXOR(F.shiftright(h, 5)))
        return _wrap(h.bitwiseXOR(F.when(p["odd"] == 0, even).otherwise(odd)))

    return F.aggregate(marked, F.lit(0).cast("bigint"), step)


HASHES = {
    "bkdr": lambda t: _fold(t, 0, lambda h, c: h * 131 + c),
    "sdbm": lambda t: _fold(t, 0, lambda h, c: c + F.shiftleft(h, 6) + F.shiftleft(h, 16) - h),
    "djb": lambda t: _fold(t, 5381, lambda h, c: h + F.shiftleft(h, 5) + c),
    "js": lambda t: _fold(
        t, 1315423911, lambda h, c: h.bitwiseXOR(F.shiftleft(h, 5) + c + F.shiftright(h, 2))
    ),
    "rs": _rs,
    "pjw": lambda t: _four_bits(
        t, lambda h, g: h.bitwiseXOR(_shift_right(g, 24)).bitwiseAND(F.lit(0x0FFFFFFF))
    ),
    "elf": lambda t: _four_bits(
        t, lambda h, g: h.bitwiseXOR(_shift_right(g, 24)).bitwiseAND(F.bitwise_not(g))
    ),
    "ap": _ap,
}


def string_hash(text: Column, name: str, buckets: int) -> Column:
    """Bucket of a string by one of the classic 32-bit hashes, 0 to buckets - 1."""
    if name == "chars":
        total = F.aggregate(code_points(text), F.lit(0).cast("bigint"), lambda s, c: s + c)
        return total % buckets
    if name == "md5":
        digest = F.md5(text.cast("binary"))
        total = F.aggregate(
            F.sequence(F.lit(0), F.lit(15)),
            F.lit(0).cast("bigint"),
            lambda s, i: s + F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"),
        )
        return total % buckets
    return HASHES[name](text).bitwiseAND(F.lit(0x7FFFFFFF)) % buckets
