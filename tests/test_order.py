"""The seeded shuffle, against one that goes one after another."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import order
from graphloom.sources.shared import written


def states(seed, n):
    x, out = seed & 0xFFFFFFFF, []
    for _ in range(n):
        x ^= (x << 13) & 0xFFFFFFFF
        x ^= x >> 17
        x ^= (x << 5) & 0xFFFFFFFF
        out.append(x)
    return out


def shuffled(n, seed):
    held, drawn = list(range(n)), states(seed, n)
    for k, i in enumerate(range(n - 1, 0, -1)):
        j = int(drawn[k] / 2**32 * (i + 1))
        held[i], held[j] = held[j], held[i]
    return held


def test_the_first_numbers_equal_a_sequential_run(spark):
    got = [r.state for r in order.seeded_numbers(spark, 100_000, 123456).orderBy("k").collect()]
    assert got == states(123456, 100_000)
    assert order.seeded_numbers(spark, 1000, -5).repartition(7).agg(F.sum("state")).first()[0] == sum(states(-5, 1000))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 20, 3_000])
def test_the_permutation_equals_a_sequential_shuffle(spark, n):
    got = {r.place: r.i for r in order.permutation(spark, n, 42 + n, written).collect()}
    assert [got[p] for p in range(n)] == shuffled(n, 42 + n)


def test_rows_are_placed_at_any_number_of_partitions(spark):
    rows = spark.range(500).select((F.col("id") * 3).alias("v"), F.lit("x").alias("i2"))
    want = {3 * v: p for p, v in enumerate(shuffled(500, 9))}
    for parts in (1, 6):
        got = order.seeded_order(rows.repartition(parts), ["v"], 9, written)
        assert got.columns == ["v", "i2", "place"] and {r.v: r.place for r in got.collect()} == want
