"""What the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sources.shared import fresh_path, shared_dir, table, written

__all__ = ["PRIVATE", "filled", "fresh_path", "shared_dir", "table", "tie_order", "with_classes", "written"]

#: Name prefix of working columns, so that they don't clash with a table's own.
PRIVATE = "__gl_"


def filled(text: Column | str) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def tie_order(df: DataFrame, *last: str) -> list[Column]:
    """All columns as an order among rows that are equal otherwise, those of
    ``last`` at the end; columns without an order by their JSON."""
    names = [c for c in df.columns if c not in last] + list(last)
    plain = lambda c: not any(kind in df.schema[c].dataType.simpleString() for kind in ("map<", "variant", "interval"))
    return [F.col(f"`{c}`") if plain(c) else F.to_json(F.struct(F.col(f"`{c}`"))) for c in names]


def with_classes(rows: DataFrame, classes: DataFrame, key: list[str], size: str, often: int = 1024, salts: int = 64) -> DataFrame:
    """``rows`` with the columns of their class, joined on ``key``; a class of
    more than ``often`` rows (its column ``size``) is dealt out to as many tasks
    as there are salts. Rows without a class get nulls. ``classes`` is read
    twice."""
    salt, hot, rest = PRIVATE + "salt", PRIVATE + "hot", PRIVATE + "rest"
    more = [c for c in classes.columns if c not in key]
    held = F.struct(*more)
    large = classes.filter(F.col(size) > often).select(*key, F.explode(F.sequence(F.lit(1), F.lit(salts))).alias(salt), held.alias(hot))
    small = classes.filter(F.col(size) <= often).select(*key, F.lit(0).alias(salt), held.alias(rest))
    dealt = rows.withColumn(salt, F.spark_partition_id() % salts + 1).join(large, [*key, salt], "left")
    # Rows that have found their class keep their salt, which no small class has.
    found = dealt.withColumn(salt, F.when(F.col(hot).isNull(), 0).otherwise(F.col(salt))).join(small, [*key, salt], "left")
    return found.select(*rows.columns, *(F.coalesce(f"{hot}.{c}", f"{rest}.{c}").alias(c) for c in more))
