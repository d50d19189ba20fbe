"""A seeded order of rows: the shuffle of Fisher and Yates with the xorshift
generator, the same as one after another, worked out in parallel.

*Numbers.* A step of the generator is linear over bits, so many steps are a power
of its 32 x 32 bit matrix. Blocks of numbers start from their own state, reached
by the matrix powers for the bits of the block's number.

*Permutation.* Step i, from n - 1 down to 1, exchanges the places i and j(i) <= i;
place i is never touched again. What stands at place p before step i was put there
by the smallest step i' > i with j(i') = p, which took it from place i'; without
such a step it is p's own. So each place points to one that it has its content
from, and what a place ends with is found by following pointers, doubled each
round. Chains are as long as the logarithm of the number of rows, as a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators.extract import numbered
from graphloom.operators.graph import Cut
from graphloom.sources.shared import dropped

#: Numbers in a block: a power of two.
BLOCK = 256


def _step(x: int) -> int:
    """The next state."""
    x ^= x << 13 & 0xFFFFFFFF
    x ^= x >> 17
    return x ^ (x << 5 & 0xFFFFFFFF)


def _times(matrix: list[int], x: int) -> int:
    """A matrix, as its columns, times the bits of a number."""
    out = 0
    for i, column in enumerate(matrix):
        if x >> i & 1:
            out ^= column
    return out


def jumps(first: int, number: int) -> list[list[int]]:
    """Matrices of ``first``, twice, four times ... as many steps; ``first`` is a
    power of two."""
    matrix, steps, out = [_step(1 << i) for i in range(32)], 1, []
    while len(out) < number:
        if steps >= first:
            out.append(matrix)
        matrix, steps = [_times(matrix, c) for c in matrix], 2 * steps
    return out


def _jumped(state: Column, blocks: Column, bits: int) -> Column:
    """The state so many blocks further on."""
    held = F.array(*(F.array(*(F.lit(c).cast("long") for c in m)) for m in jumps(BLOCK, bits)))
    bit = lambda x, i: F.call_function("shiftright", x, i).bitwiseAND(F.lit(1).cast("long")) == 1
    applied = lambda x, b: F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda out, i: F.when(bit(x, i), out.bitwiseXOR(F.get(F.get(held, b), i))).otherwise(out))
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), state.cast("long"), lambda x, b: F.when(bit(blocks, b), applied(x, b)).otherwise(x))


def seeded_numbers(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """``(k, state)``: the generator's first n states, k from 1; over 2**32 a
    state is a number from 0 to less than 1."""
    blocks = -(-n // BLOCK)
    rows = spark.range(blocks).withColumn("x", _jumped(F.lit(seed & 0xFFFFFFFF).cast("long"), F.col("id"), max(1, blocks.bit_length())))
    empty = F.array().cast("array<long>")
    states = F.aggregate(F.sequence(F.lit(1), F.lit(BLOCK)), F.struct(F.col("x").alias("x"), empty.alias("all")), lambda s, _: F.struct(T.xorshift32(s["x"]).alias("x"), F.concat(s["all"], F.array(T.xorshift32(s["x"]))).alias("all")), lambda s: s["all"])
    out = rows.select("id", F.posexplode(states).alias("p", "state"))
    return out.select((F.col("id") * BLOCK + F.col("p") + 1).alias("k"), "state").filter(F.col("k") <= n)


def permutation(spark: SparkSession, n: int, seed: int, cut: Cut) -> DataFrame:
    """``(place, i)``: the row of number i comes to this place; both from 0."""
    if n < 2:
        return spark.range(n).select(F.col("id").alias("place"), F.col("id").alias("i"))
    steps = seeded_numbers(spark, n - 1, seed).select((n - F.col("k")).alias("i"), "state")
    swaps = steps.select("i", F.floor(F.col("state") / 4294967296.0 * (F.col("i") + 1)).alias("j"))
    # The steps that use a place are few: as many as the logarithm of n, as a rule.
    order = Window.partitionBy("j").orderBy("i")
    swaps = cut(swaps.withColumn("after", F.lead("i").over(order)))
    # What place p has from: the first step above p that puts something there.
    pointer = swaps.filter("i > j").groupBy(F.col("j").alias("p")).agg(F.min("i").alias("next"))
    places = cut(spark.range(n).select(F.col("id").alias("p")).join(pointer, "p", "left").select("p", F.coalesce("next", "p").alias("next")))
    while True:
        far = places.select(F.col("p").alias("next"), F.col("next").alias("far"))
        jumped = cut(places.join(far, "next").select("p", F.col("far").alias("next"), (F.col("far") != F.col("next")).alias("moved")))
        done = jumped.filter("moved").isEmpty()
        dropped(places)
        places = jumped
        if done:
            break
    # Place i gets what place j held: from the next step that used j, or j's own
    # row. Place 0 is left with what it has from.
    own = swaps.filter("after IS NULL").select(F.col("i").alias("place"), F.col("j").alias("i"))
    taken = swaps.filter("after IS NOT NULL").select(F.col("i").alias("place"), F.col("after").alias("p"))
    first = spark.range(1).select(F.col("id").alias("place"), F.col("id").alias("p"))
    return own.union(taken.union(first).join(places, "p").select("place", F.col("next").alias("i")))


def seeded_order(rows: DataFrame, by: list[str], seed: int, cut: Cut) -> DataFrame:
    """``rows`` with their ``place`` (from 0) in the seeded shuffle of their order
    by ``by``."""
    placed = cut(numbered(rows, by, [], cut))
    return placed.join(permutation(rows.sparkSession, placed.count(), seed, cut), "i").drop("i")
