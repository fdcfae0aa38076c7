"""Personal data: fixed forms, and identifiers found by bootstrapped contexts.

All of this is DataFrame and SQL functions; no Python runs on the executors.

The fixed forms (email, ip, card, phone) are the seeds. Patterns are lexical: the word to
the left of an instance, the word to its right and, for well-formed card and phone numbers,
the form in which it is written. Other identifier-like strings are candidates; so are the
well-formed numbers inside a form that was dropped because it ran on into the next one.
Patterns and strings are a graph which is scored in rounds: a pattern's confidence is what
it has beside it of known instances over the number of documents that use it at all, and a
string's score is the noisy-or of its patterns. Strings above a threshold are identifiers
not seen before; they are instances of the next round, until one accepts nothing more, and
their places become ``id`` spans.

Work is linear in a text, but for sorting its spans: positions are running sums in blocks,
and spans of several kinds meet in one sorted list.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# The forms. They accept what the plain expressions of the contract
# accept; possessive repeats and a guard on the left keep them linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: Kinds whose way of writing is a pattern.
FORMED = ("card", "phone")
#: Whole card numbers and phone numbers inside a match that was dropped.
PART = (
    r"(?<![0-9])[0-9]{13,19}(?![0-9])"
    r"|(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])"
    r"|\+[0-9]{1,3}[\x20-]?\(?[0-9]{2,4}\)?[\x20-]?[0-9]{3,4}[\x20-][0-9]{3,4}(?![0-9])"
)
FOUND = "id"
#: Identifier-like: at least six signs, four digits among them, with inner joints.
WORD = (
    r"(?<![A-Za-z0-9])(?=[A-Za-z0-9._:/@-]{6})[A-Za-z]*+(?=[0-9](?:[A-Za-z._:/@-]*+[0-9]){3})"
    r"[0-9][A-Za-z0-9]*+(?:[._:/@-][A-Za-z0-9]++)*+"
)
CANDIDATE = f"{PART}|{WORD}"
CANDIDATE_LENGTH = 6
CANDIDATE_DIGITS = 4
SMOOTHING = 2.0
ACCEPT = 0.5
#: Tasks that share the strings beside one word.
SALTS = 8

_SPAN = "struct<start:int,end:int,body:string,left:string,right:string,form:string>"
_BLOCK = 128
_CHUNK = 1024
_FAR = 2**31 - 1
_WORDS = r"[^\p{L}]+"


def _let(value: Column, body: Callable) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, merge: Callable, depth: int = 2) -> Column:
    """``merge`` of each value and all before it.

    An array is copied whenever it grows, so it grows in blocks, which carry on the last
    value of the blocks before them; ``depth`` levels of blocks.
    """

    def grown(v):
        return F.aggregate(
            F.slice(v, F.lit(2), F.size(v)),
            F.slice(v, 1, 1),
            lambda done, x: F.concat(done, F.array(merge(F.element_at(done, F.lit(-1)), x))),
        )

    def over(v):
        if not depth:
            return grown(v)

        def joined(blocks):
            def carried(before):
                return F.flatten(
                    F.transform(
                        blocks,
                        lambda block, i: F.when(i == 0, block).otherwise(
                            F.transform(block, lambda x: merge(F.get(before, i - 1), x))
                        ),
                    )
                )

            lasts = F.transform(blocks, lambda block: F.element_at(block, F.lit(-1)))
            return _let(_running(lasts, merge, depth - 1), carried)

        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")),
            lambda b: _let(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK)), grown),
        )
        return F.when(F.size(v) <= _BLOCK, grown(v)).otherwise(_let(blocks, joined))

    return _let(values, over)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _WORDS), lambda w: w != "")


def _last_word(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?<!\p{L})(\p{L}++)[^\p{L}]*+\z", 1)
    return F.nullif(F.lower(found), F.lit(""))


def _first_word(text: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(text, r"^[^\p{L}]*+(\p{L}++)", 1)), F.lit(""))


def located(rows: DataFrame, searches: dict[str, tuple]) -> DataFrame:
    """``rows`` with a column of matches in ``text`` for each name -> (pattern, sign, keep, form).

    A match that ``keep`` has start, end (code points), body, the words beside it and its
    form. The words are those between a match and the next one on either side, kept or
    not. A text without ``sign`` is not searched. Matches, pieces and ends are columns of
    their own: each is used more than once.
    """
    def found(name, pattern, sign):
        every = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        if not sign:
            return every
        return F.when(F.contains("text", F.lit(sign)), every).otherwise(F.array().cast("array<string>"))

    def ends(name):
        sizes = F.transform(
            f"_found_{name}", lambda m, i: F.char_length(m) + F.char_length(F.get(f"_pieces_{name}", i))
        )
        return _running(sizes, lambda a, b: a + b)

    def spans(name, keep, form):
        end = lambda i: F.get(f"_ends_{name}", i)
        piece = lambda i: F.get(f"_pieces_{name}", i)
        made = F.transform(
            f"_found_{name}",
            lambda m, i: F.struct((end(i) - F.char_length(m)).alias("start"), end(i).alias("end"), m.alias("body"), i.alias("i")),
        )
        return F.transform(
            F.filter(made, lambda s: keep(s["body"])),
            lambda s: F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                s["body"].alias("body"),
                _last_word(piece(s["i"])).alias("left"),
                _first_word(piece(s["i"] + 1)).alias("right"),
                form(s["body"]).cast("string").alias("form"),
            ),
        )

    kept = rows.columns
    rows = rows.withColumns({f"_found_{n}": found(n, p, s) for n, (p, s, _, _) in searches.items()})
    rows = rows.withColumns(
        {f"_pieces_{n}": F.when(F.size(f"_found_{n}") > 0, F.split("text", p, -1)) for n, (p, _, _, _) in searches.items()}
    )
    rows = rows.withColumns({f"_ends_{n}": ends(n) for n in searches})
    return rows.select(*kept, *(spans(n, k, f).alias(n) for n, (_, _, k, f) in searches.items()))


def luhn(digits: Column) -> Column:
    values = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: c.cast("int") * (1 + i % 2),
    )
    total = F.aggregate(
        values, F.lit(0), lambda s, v: s + v - F.when(v > 9, F.lit(9)).otherwise(F.lit(0))
    )
    return total % 10 == 0


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _valid(kind: str, body: Column) -> Column:
    if kind == "ip":
        def small(part):
            bare = F.ltrim(part, F.lit("0"))
            return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

        return F.forall(F.split(body, r"\."), small)
    if kind == "card":
        return F.when(
            F.length(_digits(body)).between(13, 19), luhn(_digits(body))
        ).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(body)).between(9, 15)
    return F.lit(True)


def _form(body: Column) -> Column:
    return F.regexp_replace(body, "[0-9]", "9")


def base_spans(rows: DataFrame) -> DataFrame:
    """``rows`` with the matches of each fixed form that pass its test; a failing match is dropped whole."""
    signs = {"email": "@", "phone": "+", "ip": "."}

    def search(kind):
        form = _form if kind in FORMED else lambda body: F.lit(None)
        return PATTERNS[kind], signs.get(kind), lambda body: _valid(kind, body), form

    return located(rows, {kind: search(kind) for kind in KINDS})


def _apart(spans: Column, taken: Column) -> Column:
    """``spans`` that overlap none of those ``taken``: all in one sorted list.

    Of the taken spans, the furthest end so far must not lie beyond a span's start, nor the
    next start before its end.
    """
    mark = lambda m, own: F.struct(m["start"].alias("at"), F.lit(own).alias("own"), m.alias("m"))

    def kept(events):
        behind = _running(
            F.transform(events, lambda e: F.when(e["own"] == 1, F.lit(-1)).otherwise(e["m"]["end"])), F.greatest
        )
        ahead = _running(
            F.transform(F.reverse(events), lambda e: F.when(e["own"] == 1, F.lit(_FAR)).otherwise(e["at"])), F.least
        )

        def fits(behind, ahead):
            free = F.filter(
                events,
                lambda e, i: (e["own"] == 1)
                & (F.get(behind, i) <= e["at"])
                & (F.get(ahead, F.size(events) - 1 - i) >= e["m"]["end"]),
            )
            return F.transform(free, lambda e: e["m"])

        return _let(behind, lambda x: _let(ahead, lambda y: fits(x, y)))

    events = F.array_sort(
        F.concat(F.transform(taken, lambda m: mark(m, 0)), F.transform(spans, lambda m: mark(m, 1)))
    )
    return F.when((F.size(spans) == 0) | (F.size(taken) == 0), spans).otherwise(_let(events, kept))


def candidates(rows: DataFrame) -> DataFrame:
    """``rows`` with identifier-like strings and well-formed numbers that overlap no fixed form."""
    phone = lambda body: F.startswith(body, F.lit("+"))
    number = lambda body: ~F.rlike(body, F.lit("[^0-9\\x20-]")) & (F.length(_digits(body)) >= 13)

    def well_formed(body):
        return F.when(phone(body), _valid("phone", body)).otherwise(number(body) & _valid("card", body))

    def wanted(body):
        word = (F.char_length(body) >= CANDIDATE_LENGTH) & (F.length(_digits(body)) >= CANDIDATE_DIGITS)
        return F.when(phone(body) | F.contains(body, F.lit(" ")), well_formed(body)).otherwise(word)

    form = lambda body: F.when(well_formed(body), _form(body))
    found = located(rows, {"_all": (CANDIDATE, None, wanted, form)}).withColumn("_base", F.concat(*KINDS))
    return found.withColumn("candidates", _apart(F.col("_all"), F.col("_base"))).drop("_all", "_base")


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, key_a, key_b, one array of spans per kind, and candidates.

    The keys are hashes of a row's id and text, so equal rows share results and rows
    of one id but other texts don't.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", *_keys(), text.alias("text"))
    return candidates(base_spans(rows)).drop("text")


def _keys() -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [
        F.xxhash64(F.col("doc_id"), text).alias("key_a"),
        F.hash(text, F.col("doc_id")).alias("key_b"),
    ]


def word_frequency(docs: DataFrame) -> DataFrame:
    """word, docs: how many rows use each word, over all rows."""
    words = F.array_distinct(_words(F.coalesce(F.col("text"), F.lit(""))))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("docs"))


def graph(extracted: DataFrame) -> DataFrame:
    """side, word, body, is_seed, n: in how many rows a string stands in a pattern.

    A pattern is the word on the left or right, or the form a number is written in.
    """
    def beside(spans: Column, seed: bool) -> Column:
        def three(m):
            return F.array(
                *(
                    F.struct(
                        F.lit(side).alias("side"),
                        m[side].alias("word"),
                        F.lower(m["body"]).alias("body"),
                        F.lit(int(seed)).alias("is_seed"),
                    )
                    for side in ("left", "right", "form")
                )
            )

        return F.flatten(F.transform(spans, three))

    seeds = (beside(F.col(k), True) for k in KINDS)
    every = F.concat(*seeds, beside(F.col("candidates"), False))
    return (
        extracted.select(F.explode(F.array_distinct(every)).alias("e"))
        .select("e.*")
        .where(F.col("word").isNotNull())
        .groupBy("side", "word", "body")
        .agg(F.max("is_seed").alias("is_seed"), F.count("*").alias("n"))
    )


def discover(
    edges: DataFrame,
    frequency: DataFrame,
    smoothing: float = SMOOTHING,
    accept: float = ACCEPT,
) -> DataFrame:
    """body, score of strings that are no seeds and came to score at least ``accept``.

    A pattern weighs n of the instances known so far over (docs + smoothing), at most 1;
    ``docs`` of a word are all rows that use it, of a form all that write a number so. A
    string scores the noisy-or of its patterns. What is accepted counts as known in the
    next round; weights never fall, and rounds end when one accepts nothing more.
    Patterns are one row each and the strings beside them are dealt out by word and salt,
    so a frequent word is many tasks' work; there is no row for a pair of strings.
    """
    words, forms = edges.where("side <> 'form'"), edges.where("side = 'form'")
    written = forms.groupBy("word").agg(F.sum("n").alias("docs"))
    salt = F.pmod(F.xxhash64("body"), F.lit(SALTS)).cast("int").alias("salt")
    graph = words.join(frequency, "word").unionByName(forms.join(written, "word"))
    edges = materialize(graph.select("side", "word", salt, "body", "is_seed", "n", "docs"), "pii-graph")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    known = edges.where("is_seed = 1").select("body").distinct().withColumn("score", F.lit(1.0))
    known = materialize(known, "pii-known")
    seeds, found = known, []
    while True:
        patterns = (
            edges.join(known.select("body"), "body")
            .groupBy("side", "word")
            .agg(F.least(F.lit(1.0), F.sum("n") / (F.max("docs") + smoothing)).alias("weight"))
        )
        scored = (
            edges.join(known.select("body"), "body", "left_anti")
            .join(patterns.select("side", "word", "weight", every), ["side", "word", "salt"])
            .groupBy("body")
            .agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("weight")))))).alias("score"))
        )
        new = materialize(scored.where(F.col("score") >= accept), "pii-accepted")
        if new.isEmpty():
            break
        found.append(new)
        known = known.unionByName(new)
    return reduce(DataFrame.unionByName, found, seeds.limit(0))


def find(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, key_a, key_b, arrays of base spans by kind, and found (start, end).

    One row for each row of ``docs``. Null and empty texts have no spans; repeated rows
    get the same spans; other columns are ignored; without rows the result is empty.
    Whole texts are searched. A string is an ``id`` wherever it occurs as a candidate,
    once its patterns anywhere in the corpus are convincing.
    """
    extracted = materialize(extract(docs), "pii-spans")
    accepted = discover(graph(extracted), word_frequency(docs), **settings)
    places = (
        extracted.select("key_a", "key_b", F.explode("candidates").alias("m"))
        .select("key_a", "key_b", "m.start", "m.end", F.lower("m.body").alias("body"))
        .join(accepted.select("body"), "body")
        .groupBy("key_a", "key_b")
        .agg(F.collect_set(F.struct("start", "end")).alias("_places"))
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    return (
        extracted.drop("candidates")
        .join(places, ["key_a", "key_b"], "left")
        .withColumn(FOUND, F.array_sort(F.coalesce("_places", none)))
        .drop("_places")
    )


def _listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans by kind, then start, joined by commas."""
    one = lambda kind: F.transform(
        F.col(kind), lambda m: F.concat_ws(":", F.lit(kind), m["start"], m["end"])
    )
    return F.array_join(F.concat(*map(one, kinds)), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_<kind>, base_sha256, spans."""
    return found.select(
        "doc_id",
        *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS),
        F.sha2(_listed(KINDS).cast("binary"), 256).alias("base_sha256"),
        _listed((*KINDS, FOUND)).alias("spans"),
    )


def _between(chunks: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` up to ``end`` of a text given in chunks."""
    def part(c):
        low = F.greatest(start - c * _CHUNK, F.lit(0))
        high = F.least(end - c * _CHUNK, F.lit(_CHUNK))
        return F.substring(F.get(chunks, c), low + 1, high - low)

    first, last = (F.floor(x / _CHUNK).cast("int") for x in (start, end - 1))
    return F.when(end <= start, "").otherwise(
        F.array_join(F.transform(F.sequence(first, last), part), "")
    )


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span (start, end, kind) replaced by its kind in brackets.

    Of overlapping spans each takes what those before it left; one inside others vanishes.
    """
    length = F.char_length(text)

    def over(ordered):
        def cut(ends):
            def chunked(chunks):
                numbered = F.transform(
                    ordered,
                    lambda s, i: F.struct(
                        F.when(i == 0, 0).otherwise(F.get(ends, i - 1)).alias("at"), s.alias("s")
                    ),
                )
                pieces = F.transform(
                    F.filter(numbered, lambda n: n["s"]["end"] > n["at"]),
                    lambda n: F.concat(
                        _between(chunks, n["at"], n["s"]["start"]),
                        F.lit("["),
                        F.upper(n["s"]["kind"]),
                        F.lit("]"),
                    ),
                )
                tail = _between(chunks, F.element_at(ends, F.lit(-1)), length)
                return F.concat(F.array_join(pieces, ""), tail)

            return _let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _CHUNK), F.lit(0)), chunked)

        return _let(_running(F.transform(ordered, lambda s: s["end"]), F.greatest), cut)

    return F.when(F.size(spans) == 0, text).otherwise(_let(F.array_sort(spans), over))


def redact(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with every span of ``find`` replaced by its kind in brackets.

    Spans that overlap are replaced once, by the kind that begins first. ``n_chars``,
    where there is such a column, is set to the new length. A null text stays null; all
    other columns, whatever their names, stay as they are.
    """
    spans = find(docs, **settings)

    def labelled(kind: str) -> Column:
        return F.transform(
            F.col(kind),
            lambda m: F.struct(
                m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")
            ),
        )

    touched = (
        spans.select("key_a", "key_b", F.concat(*map(labelled, (*KINDS, FOUND))).alias("spans"))
        .where(F.size("spans") > 0)
        .dropDuplicates(["key_a", "key_b"])
    )
    # The whole row is one column meanwhile, so no name of it can clash.
    names = [f"`{c}`" for c in docs.columns]
    key_a, key_b = _keys()
    keyed = docs.select(F.struct(*names).alias("row"), key_a.alias("key_a"), key_b.alias("key_b"))
    # What is touched grows with the corpus, so it is never broadcast.
    joined = keyed.join(touched.hint("merge"), ["key_a", "key_b"], "left").select(
        "row",
        F.when(F.col("spans").isNotNull(), masked(F.col("row.text"), F.col("spans")))
        .otherwise(F.col("row.text"))
        .alias("clean"),
        F.col("spans").isNotNull().alias("changed"),
    )
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        length = F.char_length("clean").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("changed"), length).otherwise(F.col("row.n_chars"))
    return joined.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
