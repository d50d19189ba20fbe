"""Replies of a model to mentions, and mentions to merged nodes and edges.

Order matters for ties and joined descriptions: a mention carries its place
(document, chunk, record) and everything collected is sorted by it.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from graphloom.functions import text as T

TYPES = ("person", "organization", "company", "location", "agreement", "law")
POSITION = ("doc_id", "chunk_seq", "rec_seq")


def record_rows(replies: DataFrame, reply: str = "response") -> DataFrame:
    """A row per record of a reply, with its place: the ``record``, its cleaned
    fields ``f`` (null where it isn't wrapped) and the ``last`` one as it is.

    The fields are worked out before rows are made, so that what reads them
    further on doesn't parse the record again.
    """
    # One step after another: a lambda would work out again what it names twice.
    inner = F.transform(T.records(reply), lambda r: F.struct(r.alias("record"), T.unwrapped(r).alias("inner")))
    raw = F.transform(inner, lambda s: F.struct(s["record"].alias("record"), F.when(s["inner"] != "", T.fields(s["inner"])).alias("raw")))
    parsed = F.transform(raw, lambda s: F.struct(s["record"].alias("record"), F.transform(s["raw"], T.clean_str).alias("f"), F.element_at(s["raw"], -1).alias("last")))
    rows = replies.select("doc_id", "chunk_seq", F.posexplode(parsed).alias("rec_seq", "r"))
    return rows.select("doc_id", "chunk_seq", "rec_seq", "r.record", "r.f", "r.last")


def entity_mentions(rows: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """Records of entities: at least four fields, a name, an allowed type."""
    f = F.col("f")
    parsed = rows.filter((F.size(f) >= 4) & (F.get(f, F.lit(0)) == "entity")).select(
        *POSITION, F.upper(f[1]).alias("entity_name"), F.upper(f[2]).alias("entity_type"), f[3].alias("description")
    )
    return parsed.filter((F.col("entity_name") != "") & F.lower("entity_type").isin([t.lower() for t in types])).withColumn("source_id", F.col("doc_id").cast("string"))


def relation_mentions(rows: DataFrame) -> DataFrame:
    """Records of relationships: at least five fields; the last one is the
    weight, 1 if it doesn't start with a number; ends in order of name."""
    f = F.col("f")
    a, b = F.upper(f[1]), F.upper(f[2])
    return rows.filter((F.size(f) >= 5) & (F.get(f, F.lit(0)) == "relationship")).select(
        *POSITION, F.least(a, b).alias("src_id"), F.greatest(a, b).alias("tgt_id"), F.coalesce(T.parse_float("last"), F.lit(1.0)).alias("weight"),
        f[3].alias("description"), f[4].alias("keywords"), F.col("doc_id").cast("string").alias("source_id"),
    )


def _place(mentions: DataFrame) -> Column:
    """A mention's place as one value that goes up with it: a number where
    documents are numbered, which a sum by hashing can hold (it can't hold a
    struct: rows would be sorted), else a struct."""
    kinds = [mentions.schema[c].dataType for c in POSITION]
    if not isinstance(kinds[0], S.IntegralType) or not all(isinstance(k, S.IntegerType) for k in kinds[1:]):
        return F.struct(*POSITION)
    doc, chunk, rec = (F.coalesce(F.col(c).cast("long"), F.lit(least).cast("long")) for c, least in zip(POSITION, (-(1 << 63), 0, 0)))
    return doc.cast("decimal(19,0)") * F.lit(Decimal(1 << 62)) + (F.shiftleft(chunk, 31) + rec).cast("decimal(19,0)")


def _values(mentions: DataFrame, key: list[str], values: list[str], *sums: Column) -> DataFrame:
    """Per key, each distinct value ``v`` of each of the columns (``kind`` is the
    column's number), how often it is there, the place ``at`` of the first and
    what else is summed. One row each before any list is made."""
    kinds = F.inline(F.array(*(F.struct(F.lit(i).alias("kind"), F.col(v).alias("v")) for i, v in enumerate(values))))
    rest = [c for c in ("weight",) if c in mentions.columns]
    rows = mentions.dropna(subset=key).select(*key, *rest, _place(mentions).alias("at"), kinds)
    return rows.groupBy(*key, "kind", "v").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"), *sums)


def _listed(kind: int) -> Column:
    """The values of a column in the order in which they were first seen."""
    found = F.collect_list(F.when(F.col("kind") == kind, F.struct("at", "v")))
    return F.transform(F.array_sort(found), lambda s: s["v"])


def merged_nodes(mentions: DataFrame) -> DataFrame:
    """A node per name: its most frequent type (of ties, the one first seen
    latest), distinct descriptions in order, distinct sources."""
    found = _values(mentions, ["entity_name"], ["entity_type", "description", "source_id"])
    vote = F.when(F.col("kind") == 0, F.struct("n", "at"))
    return found.groupBy(F.col("entity_name").alias("id")).agg(F.max_by("v", vote).alias("entity_type"), F.array_join(_listed(1), T.JOIN).alias("description"), _listed(2).alias("source_ids"))


def merged_edges(mentions: DataFrame) -> DataFrame:
    """An edge per pair: the sum of weights, distinct descriptions, keywords and
    sources in order."""
    found = _values(mentions, ["src_id", "tgt_id"], ["description", "keywords", "source_id"], F.sum("weight").alias("weight"))
    weight = F.sum(F.when(F.col("kind") == 0, F.col("weight")))
    return found.groupBy(F.col("src_id").alias("source"), F.col("tgt_id").alias("target")).agg(
        F.array_join(_listed(0), T.JOIN).alias("description"), weight.alias("weight"), _listed(1).alias("keywords"), _listed(2).alias("source_ids")
    )


def to_summarise(rows: DataFrame, most: int = 12, description: str = "description") -> DataFrame:
    """The rows whose description has more than ``most`` parts."""
    return rows.filter(F.size(F.split(description, T.JOIN.replace("<", r"\<"), -1)) > most)


def reply_size(prompts: DataFrame, prompt: str = "prompt", reply: str = "response") -> DataFrame:
    """Characters of prompts and replies, together."""
    return prompts.agg(F.sum(F.length(prompt) + F.length(reply)).alias("characters"))


def ranked(df: DataFrame, by: list, partition: list | None = None, start: int = 0) -> DataFrame:
    """``df`` with ``i``, the place within its partition from ``start``."""
    return df.withColumn("i", F.row_number().over(Window.partitionBy(*(partition or [])).orderBy(*by)) - 1 + start)


def numbered(df: DataFrame, by: list[str], partition: list[str], cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with ``i``, the place within its partition from 0 (long), where a
    partition may hold any share of the rows, or all of them.

    Rows are dealt out by ranges of the order and written, so that their range
    is fixed; they are numbered within it, and the numbers of rows of the ranges
    before are added.
    """
    part = "__range"
    rows = cut(df.repartitionByRange(*partition, *by).withColumn(part, F.spark_partition_id()))
    before = Window.partitionBy(*partition).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # A row per partition and range that holds some of it.
    base = rows.groupBy(*partition, part).agg(F.count(F.lit(1)).alias("n")).select(*partition, part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*partition, part).orderBy(*by)
    same = F.lit(True)
    for c in (*partition, part):
        same = same & F.col("r." + c).eqNullSafe(F.col("b." + c))
    placed = rows.withColumn("i", F.row_number().over(within) - 1).alias("r").join(base.alias("b"), same)
    return placed.select(*(f"r.{c}" for c in df.columns), (F.col("r.i") + F.col("b.__base")).alias("i"))
