"""Loaders: rows of CSV files and paragraphs of Markdown as text chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T

#: Longest chunk by mode of loading; None: not cut.
LONGEST = {"standard": 1000, "robust": 1000, "fixed": 1000, "slow": 800, "ultra-slow": 500, "legacy": None, "legacy-slow": 800, "legacy-ultra-slow": 500, "legacy-robust": 1000, "legacy-fixed": 800}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, names from the header."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def picked_text(df: DataFrame, names: tuple[str, ...] = ("text", "content", "description")) -> Column:
    """The first of the named columns, then of all, that isn't empty; else the
    row as JSON. A column of white space counts as not empty."""
    given = [F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (*(n for n in names if n in df.columns), *df.columns[:1])]
    return F.coalesce(*given, F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))


def truncated(c: Column | str, longest: int | None) -> Column:
    """The first ``longest`` characters and ``...`` where there are more."""
    text = F.col(c) if isinstance(c, str) else c
    return text if longest is None else F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("..."))).otherwise(text)


def validated(c: Column | str, least: int = 10, cjk: bool = False) -> Column:
    """The text with white space collapsed; null if it is too short or, where
    asked for, has no CJK character."""
    text = T.collapsed(c)
    good = F.length(text) >= least
    return F.when(good & text.rlike(T.CJK) if cjk else good, text)


def csv_chunks(df: DataFrame, mode: str = "standard", order: str | None = None, rows: int | None = None) -> DataFrame:
    """Chunks of a table of texts: picked, trimmed, non-blank, cut to the mode's
    length; ``rows`` limits accepted chunks, in order of the column ``order``."""
    text = T.trimmed(picked_text(df.drop(order) if order and order not in ("text",) else df))
    if mode.endswith("fixed"):
        text = validated(text, cjk=mode == "legacy-fixed")
    kept = df.select(*([order] if order else []), text.alias("content")).filter("content is not null and content != ''")
    out = kept.withColumn("content", truncated("content", LONGEST[mode]))
    return out.orderBy(order).limit(rows) if rows is not None and order else out


def paragraphs(c: Column | str) -> Column:
    """A text's paragraphs: parted by blank lines, trimmed, non-empty."""
    text = F.col(c) if isinstance(c, str) else c
    return F.filter(F.transform(F.split(text, r"\n\s*\n", -1), T.trimmed), lambda p: p != "")


def _packed(parts: Column, most: int, glue: str, flush_blank: bool) -> Column:
    """Neighbouring parts joined as long as they have at most ``most``
    characters (glue not counted); longer parts stand alone, uncut."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"), F.lit(0).alias("size"))

    def step(acc, part):
        has = (F.length(T.trimmed(acc["now"])) > 0) if flush_blank else (F.length(acc["now"]) > 0)
        flush = has & (acc["size"] + F.length(part) > most)
        joined = F.when(F.length(acc["now"]) == 0, part).otherwise(F.concat(acc["now"], F.lit(glue), part))
        # The length that counts is that of the text so far, glue included.
        now = F.when(flush, part).otherwise(joined)
        return F.struct(F.when(flush, F.array_append(acc["out"], T.trimmed(acc["now"]))).otherwise(acc["out"]).alias("out"), now.alias("now"), F.length(now).alias("size"))

    def end(acc):
        return F.when(F.length(T.trimmed(acc["now"])) > 0, F.array_append(acc["out"], T.trimmed(acc["now"]))).otherwise(acc["out"])

    return F.aggregate(parts, start, step, end)


def packed_paragraphs(c: Column | str, most: int = 1000) -> Column:
    """Paragraphs packed into chunks, joined by a blank line."""
    return _packed(paragraphs(c), most, "\n\n", flush_blank=False)


def packed_sentences(c: Column | str, most: int = 300) -> Column:
    """Sentences (ended by a CJK full stop, mark or semicolon) packed into
    chunks."""
    text = F.col(c) if isinstance(c, str) else c
    return _packed(F.filter(F.split(text, r"(?<=[。！？；])", -1), lambda s: s != ""), most, "", flush_blank=True)


def chunked_paragraphs(c: Column | str, least: int = 50, most: int = 300) -> Column:
    """Paragraphs with white space collapsed: long ones packed by sentences,
    those of at most ``least`` characters dropped."""
    clean = F.transform(paragraphs(c), T.collapsed)
    return F.flatten(F.transform(clean, lambda p: F.when(F.length(p) > most, packed_sentences(p, most)).when(F.length(p) > least, F.array(p)).otherwise(F.array().cast("array<string>"))))
