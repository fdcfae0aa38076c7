"""Document fingerprints: one-permutation MinHash with optimal densification.

Everything here is a SQL expression over one row; no Python runs on the executors. A
text's word shingles are hashed once. The high bits of a hash name its bin and each
bin keeps its least hash. An empty bin copies another one: it tries bins in an order
that a universal hash fixes for it, the same in all documents, until one is filled.
Of each bin the low four bits of a hash of value and bin are stored, sixteen bins to a
long; without the bin in it, a short text's one value would agree by chance everywhere
at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
BINS = 256
BITS = 4
PER_LONG = 64 // BITS
#: Tries spelled out for an empty bin, before all filled bins are ranked for it.
TRIES = 12
_SHIFT = 63 - 8
_TOP = (1 << _SHIFT) - 1


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _order(bins: int) -> list[list[int]]:
    """For each try, the bin that every empty bin turns to."""
    state, tables = 0x2545F4914F6CDD1D, []
    for _ in range(TRIES):
        row = []
        for j in range(bins):
            state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            row.append((state >> 33) % (bins - 1))
            row[j] += row[j] >= j
        tables.append(row)
    return tables


def shingle_hashes(text: Column, k: int = SHINGLE_WORDS) -> Column:
    """Non-negative 63-bit hashes of the text's word shingles, with repeats.

    Words are runs between white space in lower case. With fewer than ``k`` words the
    whole sequence is one shingle; without words the array is empty.
    """
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def of(words):
        runs = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0))),
            lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))),
        )
        return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(runs, lambda h: F.shiftrightunsigned(h, 1))
        )

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of)


def bin_minima(hashes: Column) -> Column:
    """The least hash of each bin, in bin order; an empty bin holds its top value.

    The top values are sorted in with the hashes, so every bin has a first entry.
    """
    tops = F.array(*(F.lit((b << _SHIFT) | _TOP) for b in range(BINS)))
    return _let(
        F.sort_array(F.concat(hashes, tops)),
        lambda s: F.filter(
            s,
            lambda x, i: (i == 0)
            | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(s, i - 1), _SHIFT)),
        ),
    )


def densified(minima: Column) -> Column:
    """Every bin filled; for a text without shingles nothing can be, so all stay empty."""
    tables = [F.array(*map(F.lit, row)) for row in _order(BINS)]
    empty = lambda x: x.bitwiseAND(_TOP) == _TOP

    def fill(m):
        filled = F.filter(m, lambda x: ~empty(x))

        def ranked(j):
            # Beyond the spelled tries: the filled bin that a hash ranks first for this one.
            best = F.array_min(
                F.transform(
                    filled,
                    lambda x: F.struct(
                        F.xxhash64(j, F.shiftright(x, _SHIFT)).alias("r"), x.alias("x")
                    ),
                )
            )
            return best["x"]

        def one(x, j):
            tries = [F.get(m, F.get(t, j)) for t in tables]
            return F.when(~empty(x), x).otherwise(
                F.coalesce(*(F.when(~empty(t), t) for t in tries), ranked(j))
            )

        return F.transform(m, one)

    return _let(minima, fill)


def packed(bins: Column) -> Column:
    """Low bits of all bins as an array of longs; null for a text without shingles."""
    def word(i):
        parts = [
            F.shiftleft(
                F.xxhash64(F.get(bins, F.lit(i * PER_LONG + j)), F.lit(i * PER_LONG + j)).bitwiseAND(
                    (1 << BITS) - 1
                ),
                BITS * j,
            )
            for j in range(PER_LONG)
        ]
        return reduce(lambda a, b: a.bitwiseOR(b), parts)

    return F.array(*(word(i) for i in range(BINS // PER_LONG)))


def fingerprint(text: Column, k: int = SHINGLE_WORDS) -> Column:
    """array<bigint> of a text; empty for a null text or one without words."""
    def of(h):
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(
            _let(densified(bin_minima(h)), packed)
        )

    return _let(shingle_hashes(F.coalesce(text, F.lit("")), k), of)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1, without the chance agreement of low bits.

    Two fingerprints without shingles are alike (1); one such and another are not (0).
    """
    ones = 0x1111111111111111

    def differing(x):
        some = reduce(lambda p, q: p.bitwiseOR(q), [F.shiftrightunsigned(x, i) for i in range(BITS)])
        return F.bit_count(some.bitwiseAND(F.lit(ones)))

    apart = F.aggregate(
        F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x
    )
    chance = 1 / (1 << BITS)
    raw = ((1 - apart / BINS) - chance) / (1 - chance)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    )


def as_text(fp: Column) -> Column:
    """Sixteen hex digits a long; empty for a text without shingles."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def with_next(docs: DataFrame, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """Add next_<column> from the row that follows in id order; the last takes the first's.

    Ids are cut into ranges of about equal counts. The first id of a range also goes to
    the range before (of the first range: to the last), so that every range can look
    ahead by itself and no order is global. The driver sees one id per range. Rows of
    one id are ordered by ``columns``; null ids come first. A single row follows itself.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).cast("bigint").alias("id"))
    rough = ids.where("id is not null").approxQuantile(
        "id", [i / ranges for i in range(ranges)], 0.25 / ranges
    )
    firsts = (
        ids.groupBy(_range_of(F.col("id"), sorted({int(x) for x in rough})).alias("range"))
        .agg(F.min("id").alias("id"), F.max(F.col("id").isNull()).alias("nulls"))
        .collect()
    )
    bounds = sorted(r.id for r in firsts if r.id is not None)
    nulls = any(r.nulls for r in firsts)
    last = max(len(bounds), 1)
    at = F.col(id_col).cast("bigint")
    begins = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    first_of_all = at.isNull() if nulls else at == F.lit(bounds[0] if bounds else None)
    place = F.struct(F.col("_range").alias("range"), F.lit(0).alias("ahead"))
    before = F.struct((F.col("_range") - 1).alias("range"), F.lit(1).alias("ahead"))
    around = F.struct(F.lit(last).alias("range"), F.lit(2).alias("ahead"))
    opens = at == F.get(begins, F.col("_range") - 1)
    placed = (
        docs.withColumn("_range", _range_of(at, bounds))
        .withColumn(
            "_place",
            F.explode(
                F.filter(
                    F.array(
                        place,
                        F.when(opens & (F.col("_range") > 1), before),
                        F.when(first_of_all, around),
                    ),
                    lambda p: p.isNotNull(),
                )
            ),
        )
        .withColumn("_range", F.col("_place.range"))
        .withColumn("_ahead", F.col("_place.ahead"))
        .drop("_place")
    )
    order = Window.partitionBy("_range").orderBy(
        (F.col("_ahead") == 2).cast("int"), F.col(id_col).asc_nulls_first(), *columns
    )
    out = placed.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return out.where(F.col("_ahead") == 0).drop("_range", "_ahead")


def _range_of(at: Column, bounds: list[int], stride: int = 32) -> Column:
    """How many of the sorted bounds are at most ``at``, at least 1; two short scans."""
    fine = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    coarse = F.array(*map(F.lit, bounds[::stride])).cast("array<bigint>")

    def near(whole):
        skip = F.greatest(whole - 1, F.lit(0)) * stride
        return skip + F.size(F.filter(F.slice(fine, skip + 1, stride), lambda b: b <= at))

    counted = _let(F.size(F.filter(coarse, lambda b: b <= at)), near)
    return F.greatest(F.coalesce(counted, F.lit(1)), F.lit(1))


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint (array<bigint>) of every row.

    A null, empty or blank text has an empty fingerprint. Repeated rows give repeated
    results, other columns are ignored; one narrow pass.
    """
    return docs.select("doc_id", fingerprint(F.col("text"), k).alias("fingerprint"))


def edited_neighbours(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprints of each text, of its edited form and the likeness to both neighbours.

    The edited text has its last quarter replaced by the start of the next document.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Null texts count as empty. The texts are shuffled once, by id range.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("fp", fingerprint(F.col("text"), k))
    paired = with_next(own, ["text", "fp"])
    n = F.char_length("text").cast("bigint")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), (n - quarter).cast("int")),
        F.substring(F.col("next_text"), F.lit(1), quarter),
    )
    out = paired.select(
        "doc_id",
        n.alias("n_chars"),
        "fp",
        "next_fp",
        F.inline(F.array(F.struct(edited.alias("edited"), F.lit(0).alias("one")))),
    )
    out = out.withColumn("edited_fp", fingerprint(F.col("edited"), k))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
