"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Texts are equal when they are identical after every run of ASCII white space
has become one space. Copies are combined in three steps, each of which groups
by the whole normalised text and not only by its digest:

1. within each input partition (the partial aggregation before the shuffle),
2. within ``(digest, text, salt)``, where the salt is the partition's number
   modulo ``salts``, so a text that makes up a third of all rows is merged by
   up to ``salts`` tasks, each of which gets one row per input partition,
3. over the salts, where a text has at most ``salts`` rows left.

Rows find their class by its digest; those of a class with many rows are dealt
out by a salt.

Defined results: a null text counts as empty; null ids never win against an id;
a group with null ids only has ``keep_id`` null and one of its rows is kept; of
repeated rows (same id, equal text) exactly one is kept; an empty table gives
an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import PRIVATE, filled, tie_order, with_classes, written

#: One run of these becomes one space.
SPACES = r"[\x20\x09-\x0D]+"

_SHA, _NORM, _SALT, _ID = (PRIVATE + x for x in ("sha", "norm", "salt", "id"))


def normalised(text: Column | str) -> Column:
    return F.regexp_replace(filled(text), SPACES, " ")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias(_ID), normalised(text_col).alias(_NORM)).withColumn(_SHA, F.sha2(_NORM, 256))


def _winners(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    """One row per distinct text: digest, text, smallest id, number of rows."""
    salted = (
        _keyed(docs, id_col, text_col)
        .withColumn(_SALT, F.spark_partition_id() % salts)
        .groupBy(_SHA, _NORM, _SALT)
        .agg(F.min(_ID).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return salted.groupBy(_SHA, _NORM).agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def copy_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> tuple[DataFrame, list[str]]:
    """The classes of equal texts and the columns that identify one.

    The digest identifies a class unless two different texts of this corpus
    share it, which is looked up; then digest and text do.
    """
    winners = _winners(docs, id_col, text_col, salts)
    classes = written(winners.drop(_NORM), "copy-classes")
    shared = classes.groupBy(_SHA).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if shared.isEmpty():
        return classes, [_SHA]
    return winners, [_SHA, _NORM]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    classes, key = copy_classes(docs, id_col, text_col, salts)
    # Rows that repeat both id and text travel as one, with their number.
    rows = _keyed(docs, id_col, text_col).groupBy(*key, _ID).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return with_classes(rows, classes, key, "group_size").select(
        F.col(_ID).alias(id_col),
        "keep_id",
        "group_size",
        F.explode(F.sequence(F.lit(1), F.col("n"))).alias("n"),
        F.col(_SHA).alias("text_sha256"),
    ).select(
        id_col,
        "keep_id",
        "group_size",
        (F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("n") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows with one
    id and equal texts the first in order of their other columns, then of their
    texts as they are."""
    classes, key = copy_classes(docs, id_col, text_col, salts)
    stay = classes.select(*key, F.col("keep_id").alias(_ID)).alias("s")
    rows = docs.withColumn(_ID, F.col(id_col)).withColumn(_NORM, normalised(text_col)).withColumn(_SHA, F.sha2(_NORM, 256))
    if _NORM not in key:
        rows = rows.drop(_NORM)
    both = [*key, _ID]
    first = Window.partitionBy(*both).orderBy(*tie_order(docs, id_col, text_col))
    same = F.col("r." + _ID).eqNullSafe(F.col("s." + _ID))
    for k in key:
        same &= F.col("r." + k) == F.col("s." + k)
    return rows.alias("r").join(stay, same, "left_semi").withColumn(PRIVATE + "nth", F.row_number().over(first)).filter(F.col(PRIVATE + "nth") == 1).select(*docs.columns)
