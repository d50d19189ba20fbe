"""Similar names by signatures."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.operators import resolve
from graphloom.sources.shared import written


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar(a, b):
    if edits(a.lower(), b.lower()) <= min(len(a), len(b)) // 2:
        return True
    x, y = set(a.lower()), set(b.lower())
    j = len(x & y) / len(x | y) if x | y else 0
    return j > 0.6 if max(len(a), len(b)) < 4 else j >= 0.8


def found(spark, names, **options):
    df = spark.createDataFrame([(n, t) for t, n in names], "id string, entity_type string")
    return sorted(tuple(r) for r in resolve.similar_pairs(df, **options).collect())


def wanted(names):
    held = sorted({(t or "-", n) for t, n in names if n is not None})
    return [(t, a, b) for i, (t, a) in enumerate(held) for u, b in held[i + 1 :] if t == u and similar(a, b)]


def test_pairs_equal_a_comparison_of_all(spark):
    draw = random.Random(7)
    names = [(draw.choice(["x", "y", None]), "".join(draw.choice("abcdeé中 ") for _ in range(draw.randrange(0, 14)))) for _ in range(260)]
    names += [("x", "long" * 12), ("x", "long" * 12 + "er"), ("x", "LONG" * 11 + "lo"), ("x", "İstanbul"), ("x", "istanbul"), ("x", "q" * 33), ("x", "q" * 32), ("x", None), ("y", "ab"), ("y", "AB"), ("y", "ba")]
    assert found(spark, names) == wanted(names)
    assert found(spark, names, often=3) == wanted(names)  # every key is hot
    assert found(spark, []) == []


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text("abcxyz", min_size=1, max_size=9), min_size=2, max_size=40))
def test_pairs_of_drawn_names(spark, names):
    assert found(spark, [("t", n) for n in names]) == wanted([("t", n) for n in names])


@pytest.fixture(scope="module")
def many(spark):
    draw = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = ["".join(draw.choice(letters) for _ in range(draw.randrange(8, 25))) for _ in range(15_000)]
    names += ["".join(draw.choice(letters) if draw.random() < 0.2 else c for c in draw.choice(names[:1000])) for _ in range(5_000)]
    return spark.createDataFrame([(n, "t") for n in names], "id string, entity_type string")


def test_few_pairs_of_a_large_type_are_candidates(spark, many):
    rows = written(resolve.described(many))
    n = rows.count()
    met = written(resolve.similar_candidates(rows))
    assert met.select(F.least("a", "b"), F.greatest("a", "b")).distinct().count() < 0.02 * n * (n - 1) / 2
    # Names that were changed in few places are found again.
    some = rows.select("n").filter("length > 12").orderBy(F.xxhash64("n")).limit(300).collect()
    for_each = [(r.n, r.n[:5] + "#" + r.n[6:]) for r in some]
    both = written(resolve.described(spark.createDataFrame([(x, "t") for pair in for_each for x in pair], "id string, entity_type string")))
    pairs = {tuple(sorted((r.a, r.b))) for r in resolve.similar_candidates(both).collect()}
    assert {tuple(sorted(p)) for p in for_each} <= pairs
