"""Plans of steps that many queries share: what they shuffle and how they sum."""

import random

from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import extract, search
from graphloom.plans import rag


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def mentions(spark):
    rows = [(d, c, r, f"N{(d + r) % 3}", "P", f"d{r}", str(d)) for d in (5, 3, 11) for c in (2, 10) for r in (9, 1)]
    return spark.createDataFrame(rows, "doc_id long, chunk_seq int, rec_seq int, entity_name string, entity_type string, description string, source_id string")


def test_merging_sums_by_hashing_and_keeps_the_order_of_places(spark):
    found = extract.merged_nodes(mentions(spark))
    assert "SortAggregate" not in plan(found)
    named = extract.merged_nodes(mentions(spark).withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 5, "0")))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, named.collect()), key=str)
    assert {r["id"]: r["source_ids"] for r in found.collect()}["N0"] == ["3", "5", "11"]


def test_edges_are_linked_without_merging_nodes(spark):
    replies = spark.createDataFrame([(1, 0, '("entity"<|>A<|>person<|>d)##("entity"<|>B<|>person<|>d)##("relationship"<|>A<|>B<|>d<|>k<|>2)##("relationship"<|>A<|>C<|>d<|>k<|>2)')], "doc_id long, chunk_seq int, response string")
    _, edges = rag.build_graph(replies)
    assert [(r["source"], r["target"], r["weight"]) for r in edges.collect()] == [("A", "B", 2.0)]
    assert "entity_type" not in plan(edges)


def test_terms_are_counted_where_they_are_made(spark):
    items = spark.createDataFrame([("node", f"n{i % 5}", "aba ab") for i in range(10)], "type string, id string, text string")
    found = search.postings(items, "bigram")
    assert plan(found).count("Exchange ") == 1 and "hashpartitioning(type" in plan(found)
    assert {(r["term"], r["tf"]) for r in found.collect()} == {("ab", 4), ("ba", 2)}


def test_grams_and_trimming_are_as_by_character(spark):
    draw = random.Random(2)
    texts = ["".join(draw.choice("ab  \t\x85 　中文\U0001f600&\"<;") for _ in range(draw.randrange(9))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.grams("t", 2).alias("g"), T.trimmed("t").alias("s"), F.regexp_replace("t", f"^{T.SPACE}+|{T.SPACE}+$", "").alias("p"))
    for r in rows.collect():
        assert r["g"] == [a + b for a, b in zip(r["t"], r["t"][1:]) if a != " " and b != " "]
        assert r["s"] == r["p"]


def test_components_go_through_fewer_edges_each_time(spark):
    from graphloom.operators.components import connected_components
    from graphloom.sources.shared import written

    counts = []

    def cut(df):
        out = written(df)
        if out.columns == ["a", "b"]:
            counts.append(out.count())
        return out

    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(100, 160)] + [(7, 7), (300, 301)]
    found = connected_components(spark.createDataFrame(edges, "src long, dst long"), cut)
    assert {r["node"]: r["component"] for r in found.collect()} == {i: 0 for i in range(61)} | {i: 100 for i in [*range(100, 160), 200]} | {300: 300, 301: 300}
    assert counts == [121, 59, 0]
