"""Personal data: pattern spans and information-theoretic sanitisation, in
DataFrame operations only.

**Base spans.** Email, ip, card and phone patterns are matched leftmost and
non-overlapping per kind. A text is split by a pattern and its matches are
extracted by the same pattern; the running lengths of gaps and matches give
each match's place in code points, whatever characters the text holds. The
patterns are written with possessive repeats and start guards, which find the
same matches as the plain forms. A text is worked on in parts of some thousand
characters, cut where no match and no word crosses, so that time is linear in
the text however many spans it has; only within a longer run without such a
place (one line of nothing but the patterns' own characters, without a space
beside a letter) it grows with the square of the run's matches.

**Added spans.** The values found are the protected entities. Each also belongs
to a pool (a mail's domain, an address's first three numbers, a card's first six
digits, a phone number without its last four digits), which is protected like an
entity, so that values seen once each give evidence together. Words near an
entity (``window`` characters on the same line) are terms that may reveal it.

Texts (rows) that show a pair or an entity in the same context count as one, so
copies of a text or of its words are no evidence: of N texts, c hold entity e, n
hold term t and x have t near e. With
``IC(e) = log2 N/c`` and ``PMI(t; e) = log2 (x/N) / ((n+1)/N * c/N)``, smoothed
by one more text that holds t alone, the disclosure of e by t is ``PMI / IC``:
the part of e's information that seeing t gives away. A term discloses e where
that is at least ``disclosure`` and chance is no explanation: were t dealt to n
texts at random, x or more of them would hold e with a probability (Chernoff's
bound, times the number of terms near e) of at most ``chance``. So a single
place is enough for a term that hardly stands anywhere else, in a table large
enough to know that, and several are asked for from terms that do.

A disclosing term becomes a span of kind ``term`` wherever it stands, in any
text. Sanitising replaces base spans by their kind in brackets and terms by
``[TERM]``.

Defined results: null texts count as empty; rows with null or repeated ids each
get their row; empty texts and an empty table give no spans. No other columns
are read, so extra columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import PRIVATE, filled, written

#: Kinds in their order for ties.
KINDS = ("email", "ip", "card", "phone", "term")

#: Equivalents of the plain patterns. A start guard (not preceded by a
#: character of the first class, or right after the previous match) skips
#: starts that can't be leftmost; possessive repeats never need to give back.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: A cheap test that holds for every text with a match.
MAY_HOLD = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}

#: Characters after which a text is cut into parts.
PART = 2048
#: Places that no match and no word crosses: after a character that none of
#: them holds, and after a space that doesn't stand between two characters of a
#: number (only numbers hold spaces).
CUT = r"(?<=[^\p{L}\p{N}._%+@\x20()'-])|(?<=[^0-9\x20().-]\x20)|(?<=\x20)(?=[^0-9\x20().-])"

#: A term: a word of three letters or more.
TERM = r"[\p{L}][\p{L}\p{N}_'-]{2,}"

_KEY, _ROW, _TEXT, _TERMS, _PARTS, _SALT = (PRIVATE + x for x in ("key", "row", "text", "terms", "parts", "salt"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def running(sizes: Column, levels: int = 1, block: int = 64) -> Column:
    """For each number of an array the sum of those before it. Appending to an
    array copies it, so sums run within blocks, and over the blocks' totals in
    the same way, for so many levels."""

    def along(some: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("found"))
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["found"], F.array(acc["at"])).alias("found"))
        return F.aggregate(some, start, step, lambda acc: acc["found"])

    if levels == 0:
        return along(sizes, F.lit(0))
    last = lambda n: F.greatest(F.floor((F.size(n) - 1) / block).cast("int"), F.lit(0))
    blocks = let(sizes, lambda n: F.transform(F.sequence(F.lit(0), last(n)), lambda i: F.slice(n, i * block + 1, block)))
    total = lambda some: F.aggregate(some, F.lit(0), lambda acc, n: acc + n)
    return let(blocks, lambda some: F.flatten(F.zip_with(some, running(F.transform(some, total), levels - 1, block), along)))


def placed(text: Column, pattern: str) -> Column:
    """All matches of a pattern as ``array<struct<at, value>>``, ``at`` in code
    points from 0."""
    # gaps[i] stands before match i: a match's start is the length of the gaps
    # up to it and of the matches before it.
    gaps = F.transform(F.split(text, pattern, -1), lambda gap: F.length(gap))

    def of(values: Column, gap: Column) -> Column:
        ends = F.zip_with(gap, values, lambda g, value: g + F.coalesce(F.length(value), F.lit(0)))
        return let(running(ends), lambda at: F.transform(values, lambda value, i: F.struct((F.get(at, i) + F.get(gap, i)).alias("at"), value.alias("value"))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda values: let(gaps, lambda gap: of(values, gap)))


def parts(text: Column, size: int = PART) -> Column:
    """A text cut where no match and no word is cut, at the first such place
    after ``size`` characters each, as ``array<struct<at, text>>``."""
    found = F.regexp_extract_all(text, F.lit(rf"(?s).{{{size}}}.*?(?:{CUT}|\z)|.+"), F.lit(0))
    return let(found, lambda some: F.zip_with(running(F.transform(some, lambda t: F.length(t)), levels=2), some, lambda at, t: F.struct(at.alias("at"), t.alias("text"))))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    reverse = F.reverse(digits)

    def worth(i):
        d = F.substring(reverse, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """Whether a match of a kind's pattern counts."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.rlike("^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


SPANS = "array<struct<start:int,rank:int,stop:int,value:string>>"


def part_spans(text: Column) -> Column:
    """The base spans of a part in order, as ``SPANS``; ``rank`` indexes KINDS."""

    def of_kind(rank: int, kind: str) -> Column:
        found = F.filter(placed(text, PATTERNS[kind]), lambda m: holds(kind, m["value"]))
        spans = F.transform(found, lambda m: F.struct(m["at"].alias("start"), F.lit(rank).alias("rank"), (m["at"] + F.length(m["value"])).alias("stop"), m["value"].alias("value")))
        return F.when(MAY_HOLD[kind](text), spans).otherwise(F.array().cast(SPANS))

    return F.array_sort(F.concat(*(of_kind(rank, kind) for rank, kind in enumerate(KINDS[:4]))))


def may_hold(text: Column) -> Column:
    """Whether a text may hold base spans at all."""
    return reduce(lambda a, b: a | b, (test(text) for test in MAY_HOLD.values()))


def moved(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), s["rank"].alias("rank"), (s["stop"] + by).alias("stop"), s["value"].alias("value")))


def base_spans(text: Column, size: int = PART) -> Column:
    """The base spans of a text in order, as ``SPANS``."""
    spans = F.flatten(F.transform(parts(text, size), lambda p: moved(part_spans(p["text"]), p["at"])))
    return F.when(may_hold(text), spans).otherwise(F.array().cast(SPANS))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans in order, joined by commas."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def nearby(text: Column, span: Column, window: int) -> Column:
    """The terms within ``window`` characters of a span on its line, whole
    words only, as ``array<struct<at, value>>`` placed in the text."""
    # One character more on either side shows whether a word is cut.
    low = F.greatest(span["start"] - window - 1, F.lit(0))
    before = F.substring(text, low + 1, span["start"] - low)
    after = F.substring(text, span["stop"] + 1, F.lit(window + 1))
    line = F.regexp_extract(before, r"[^\n]*\z", 0)
    rest = F.regexp_extract(after, r"\A[^\n]*", 0)
    line_at, rest_at = span["start"] - F.length(line), span["stop"]
    left = F.filter(placed(line, TERM), lambda m: (line_at + m["at"] > low) | (low == 0))
    right = F.filter(placed(rest, TERM), lambda m: m["at"] + F.length(m["value"]) <= window)
    by = lambda found, n: F.transform(found, lambda m: F.struct((m["at"] + n).alias("at"), m["value"].alias("value")))
    return F.concat(by(left, line_at), by(right, rest_at))


def found_spans(docs: DataFrame, text_col: str = "text", window: int = 64, size: int = PART) -> DataFrame:
    """Per row: a number of its own, the base spans and, for each base span, the
    terms near it. Numbers hold once the rows are written."""
    edge = window + 2

    def of(some: Column) -> Column:
        """A part's spans in the text and, from the part and the ends of those
        beside it, the terms near them."""

        def part(p: Column, i: Column) -> Column:
            # One place more than looked at: a part's edge isn't taken for the text's.
            before = F.coalesce(F.right(F.get(some, i - 1)["text"], F.lit(edge)), F.lit(""))
            after = F.coalesce(F.left(F.get(some, i + 1)["text"], F.lit(edge)), F.lit(""))
            place = lambda s, by: F.struct((s["start"] + by).alias("start"), (s["stop"] + by).alias("stop"))
            near = lambda spans: let(F.concat(before, p["text"], after), lambda wide: let(F.length(before), lambda by: F.transform(spans, lambda s: nearby(wide, place(s, by), window))))
            none = F.array().cast("array<array<struct<at:int,value:string>>>")
            return let(part_spans(p["text"]), lambda spans: F.struct(moved(spans, p["at"]).alias("spans"), F.when(F.size(spans) > 0, near(spans)).otherwise(none).alias("near")))

        return F.transform(some, part)

    text = F.col(_TEXT)
    found = docs.select(filled(text_col).alias(_TEXT)).select(F.monotonically_increasing_id().alias(_ROW), F.when(may_hold(text), let(parts(text, max(size, edge)), of)).alias("parts"))
    spans = F.flatten(F.transform("parts", lambda p: p["spans"]))
    return found.select(_ROW, F.coalesce(spans, F.array().cast(SPANS)).alias("spans"), F.when(F.size(spans) > 0, F.flatten(F.transform("parts", lambda p: p["near"]))).alias("near"))


def pool(rank: Column, value: Column) -> Column:
    """What an entity has in common with others of its owner."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(rank == KINDS.index("email"), F.regexp_extract(value, "@.*", 0))
        .when(rank == KINDS.index("ip"), F.regexp_extract(value, r"^.*\.", 0))
        .when(rank == KINDS.index("card"), F.concat(F.substring(digits, 1, 6), F.lit("*")))
        .otherwise(F.concat(F.lit("+"), F.regexp_extract(digits, "^(.*)....$", 1), F.lit("*")))
    )


def words_of(text: Column) -> Column:
    """A text's different terms."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def of_these(words: DataFrame, terms: DataFrame, bits: int = 24) -> DataFrame:
    """``words`` without most of those that aren't among ``terms``, before any
    shuffle: a term's hash marks one of 2**bits places, a table of fixed size
    (2 MB) that every task has; a word whose place isn't marked is none of them.
    What passes is still to be joined."""
    place = F.pmod(F.xxhash64("term"), F.lit(1 << bits))
    at, bit = F.floor(place / 64), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    marked = terms.select(at.alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit"))
    # A row for each 64 places, marked or not: always as many.
    every = words.sparkSession.range(1 << (bits - 6)).select(F.col("id").alias("at")).join(marked, "at", "left")
    table = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("bit", F.lit(0)).alias("bit")))), lambda x: x["bit"]).alias("t"))
    return words.filter(F.get(table.scalar(), at.cast("int")).bitwiseAND(bit) != 0)


def power(n: Column | str) -> Column:
    """The power of two that a number reaches."""
    return F.length(F.bin(n)) - 1


def disclosing(docs: DataFrame, found: DataFrame, text_col: str = "text", disclosure: float = 0.8, chance: float = 0.01) -> DataFrame:
    """The pairs (entity, term) in which the term discloses the entity or pool."""
    s = F.col("s.spans")
    near = found.filter("size(spans) > 0").select(_ROW, F.explode(F.arrays_zip("spans", "near")).alias("s")).select(
        _ROW,
        F.explode(F.array(F.lower(s["value"]), pool(s["rank"], F.lower(s["value"])))).alias("entity"),
        F.array_distinct(F.transform("s.near", lambda m: F.lower(m["value"]))).alias("terms"),
        F.xxhash64(F.array_join(F.transform("s.near", lambda m: F.lower(m["value"])), " ")).alias("context"),
    ).distinct()

    def counted(rows: DataFrame, by: list[str], texts: str, contexts: str) -> DataFrame:
        """Texts and, of them, those that count as evidence."""
        # One row per text, and one per context, before they are counted.
        n = rows.select(*by, _ROW).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias(texts))
        c = rows.select(*by, "context").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias(contexts))
        return n.join(c, by).withColumn(contexts, F.least(texts, contexts))

    pairs = written(counted(near.select("entity", _ROW, "context", F.explode("terms").alias("term")), ["entity", "term"], "df_te", "x"), "pii-pairs")
    entities = counted(near, ["entity"], "df_e", "c")
    term_df = written(docs.select(F.explode(words_of(filled(text_col))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_t")), "pii-terms-of-all")
    # How many terms there are by powers of two of their texts: at most 64 numbers.
    sizes = term_df.groupBy(power("df_t").alias("power")).agg(F.count(F.lit(1)).alias("terms")).agg(F.collect_list(F.struct("power", "terms")).alias("sizes"))
    total = found.agg(F.count(F.lit(1)).alias("total")).crossJoin(F.broadcast(sizes))
    c, x = F.col("c"), F.col("x")
    texts = F.col("total") - (F.col("df_e") - c)
    n = F.col("df_t") - (F.col("df_te") - x)
    scored = pairs.join(entities, "entity").join(term_df, "term").crossJoin(F.broadcast(total)).select("entity", "term", "sizes", c, x, n.alias("n"), texts.alias("texts"), (c / texts).alias("p"))
    n, p = F.col("n"), F.col("p")
    alike = F.filter("sizes", lambda s: s["power"].between(power(x), power(n)))
    tried = F.aggregate(alike, F.lit(0).cast("long"), lambda acc, s: acc + s["terms"])
    ic, pmi = -F.log(p), F.log(x / ((n + 1) * p))
    missed = F.when(n > x, (n - x) * F.log((1 - p) * n / (n - x))).otherwise(0.0)
    bound = x * F.log(p * n / x) + missed + F.log(F.greatest(tried, F.lit(1)))
    return scored.filter((p < 1) & (x > n * p)).filter((pmi >= disclosure * ic) & (bound <= math.log(chance))).select("entity", "term")


def marks(text: Column, terms: Column) -> Column:
    """All places of some terms in a part, as ``SPANS``: a string of its length
    has ``xyy..`` where they stand."""
    dots = lambda t: F.regexp_replace(t, r"(?s).", ".")
    parts = F.zip_with(
        F.split(text, TERM, -1),
        F.regexp_extract_all(text, F.lit(TERM), F.lit(0)),
        lambda gap, word: F.concat(dots(gap), F.when(word.isNull(), "").when(F.array_contains(terms, F.lower(word)), F.concat(F.lit("x"), F.repeat(F.lit("y"), F.length(word) - 1))).otherwise(dots(word))),
    )
    rank = F.lit(len(KINDS) - 1)
    return F.transform(placed(F.array_join(parts, ""), "xy+"), lambda m: F.struct(m["at"].alias("start"), rank.alias("rank"), (m["at"] + F.length(m["value"])).alias("stop"), F.lower(F.substring(text, m["at"] + 1, F.length(m["value"]))).alias("value"))).cast(SPANS)


def spanned(docs: DataFrame, text_col: str = "text", window: int = 64, disclosure: float = 0.8, chance: float = 0.01, salts: int = 32) -> DataFrame:
    """``docs`` with a key of the text and its parts, each with its place, text
    and spans, base and added, placed in the part."""
    text = filled(text_col)
    found = written(found_spans(docs, text_col, window), "pii-found")
    terms = written(disclosing(docs, found, text_col, disclosure, chance).select("term").distinct(), "pii-terms")
    # Texts that share a key share their terms: only those that a text holds are
    # marked in it. The key is made before the words are dealt out.
    words = docs.select(F.xxhash64(text).alias(_KEY), words_of(text).alias(_TERMS)).select(_KEY, F.explode(_TERMS).alias("term"))
    hits = of_these(words, terms).join(terms, "term", "left_semi").groupBy(_KEY).agg(F.collect_set("term").alias(_TERMS))
    # A text with many copies goes to as many tasks as there are salts.
    hits = hits.select(_KEY, _TERMS, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(_SALT))
    rows = docs.withColumn(_KEY, F.xxhash64(text)).withColumn(_SALT, F.spark_partition_id() % salts).join(hits, [_KEY, _SALT], "left")

    def with_terms(part: Column, spans: Column) -> Column:
        # Words inside a base span are that span's already.
        inside = lambda t: F.exists(spans, lambda s: (t["start"] < s["stop"]) & (s["start"] < t["stop"]))
        added = lambda some: F.array_sort(F.concat(spans, F.filter(marks(part, some), lambda t: ~inside(t))))
        return let(F.array_intersect(_TERMS, words_of(part)), lambda some: F.when(F.size(some) > 0, added(some)).otherwise(spans))

    def part(p: Column) -> Column:
        spans = let(part_spans(p["text"]), lambda base: F.when(F.col(_TERMS).isNull(), base).otherwise(with_terms(p["text"], base)))
        return F.struct(p["at"].alias("at"), p["text"].alias("text"), spans.alias("spans"))

    whole = F.array(F.struct(F.lit(0).alias("at"), text.alias("text"), F.array().cast(SPANS).alias("spans")))
    some = F.when(may_hold(text) | F.col(_TERMS).isNotNull(), F.transform(parts(text), part)).otherwise(whole)
    return rows.withColumn(_PARTS, some).select(*docs.columns, _KEY, _PARTS)


def pii_spans(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, **options) -> DataFrame:
    """Per row: its kept columns, a key of its text and ``spans``, base and added."""
    spans = F.flatten(F.transform(_PARTS, lambda p: moved(p["spans"], p["at"])))
    return spanned(docs, text_col, **options).select(*(keep or []), _KEY, spans.alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """A part with each span replaced by its kind in brackets; of overlapping
    spans the first stands for all it reaches into."""
    mark = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], gap, F.get(mark, s["rank"]))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def sanitised(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with personal data and disclosing terms removed from the text.
    Only texts with spans are rewritten."""
    rows = spanned(docs, text_col, **options)
    clean = F.array_join(F.transform(_PARTS, lambda p: F.when(F.size(p["spans"]) == 0, p["text"]).otherwise(redacted(p["text"], p["spans"]))), "")
    return rows.withColumn(text_col, F.when(F.exists(_PARTS, lambda p: F.size(p["spans"]) > 0), clean).otherwise(F.col(text_col))).select(*docs.columns)
