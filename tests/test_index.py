"""The stored index: ranked and fuzzy lookup, hot terms, following a graph."""

import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import search
from graphloom.sources.search_index import SearchIndex, Term, depths
from graphloom.sources.shared import fresh_path, written
from graphloom.sources.store import EDGES, NODES, GraphStore

WORDS = "the amber river under stone walls 中文 silent fox of birch and old gate keeper in north field with copper bells".split()


def drawn(n, seed=1):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        words = [draw.choice(WORDS[:3] if draw.random() < 0.3 else WORDS) for _ in range(draw.randrange(1, 14))] + (["zephyr"] if i % 97 == 0 else [])
        out.append(("node" if i % 3 else "edge", f"item {i}", " ".join(words) + draw.choice(["", ".", " 文字"])))
    return out


@pytest.fixture(scope="module")
def items(spark):
    return written(spark.createDataFrame(drawn(3_000), "type string, id string, text string"))


@pytest.fixture(scope="module")
def idx(spark, items):
    return SearchIndex(spark, fresh_path(spark, "index"), block=32).write(items)


def rows(df, *names):
    return [tuple(round(x, 9) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x for x in r) for r in df.select(*names).collect()]


QUESTIONS = ["the river", "amber zephyr of the north", "copper bells with the old gate keeper", "中文 fox", "qqq", ""]


@pytest.mark.parametrize("question", QUESTIONS)
def test_ranked_lookup_equals_an_exhaustive_search(items, idx, question):
    names = ("type", "id", "total_score", "methods")
    assert rows(idx.search(question, 20), *names) == rows(search.combined_search(items, question, 20), *names)


@pytest.mark.parametrize("question", ["gate keeper zephyr", "zzz 字", "qq"])
def test_tiers_equal_those_of_a_search_over_texts(items, idx, question):
    names = ("type", "id", "total_score", "method")
    assert rows(idx.sequential(question, 20), *names) == rows(search.sequential_search(items, question, 20), *names)


@pytest.mark.parametrize("question", ["old gate keeper in north field with copper belles", "fox", "a b c d e", ""])
@pytest.mark.parametrize("threshold", [0.7, 0.5])
def test_fuzzy_lookup_equals_a_scan(items, idx, question, threshold):
    want = sorted(rows(search.fuzzy_search(items, question, threshold), "type", "id", "similarity"))
    assert sorted(rows(idx.fuzzy(question, threshold), "type", "id", "similarity")) == want


def test_fuzzy_lookup_reads_texts_of_candidates_only(idx):
    plan = idx.fuzzy("silent fox of birch and old gate")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "text#" in line.split("Batched")[0]]
    assert len(scans) == 1 and "dynamicpruning" in plan


def test_few_blocks_of_common_terms_are_read(spark):
    draw = random.Random(3)
    texts = [("node", f"n{i}", "the " * draw.choice([1, 1, 1, 1, 1, 1, 1, 2, 3]) + f"code{draw.randrange(3000)}") for i in range(20_000)]
    items = written(spark.createDataFrame(texts, "type string, id string, text string"))
    idx = SearchIndex(spark, fresh_path(spark, "index")).write(items)
    for question in ("the code17", "the the the code123"):
        got = [tuple(r) for r in idx.ranked(question, 5)]
        assert idx.told["read"] < 0.1 * idx.told["blocks"], idx.told
        assert rows(search.combined_search(items, question, 5), "type", "id", "total_score") == [(t, i, round(s, 9)) for t, i, s, _ in got]
    # A term that all items hold is in many blocks of bounded size.
    blocks = spark.read.parquet(f"{idx.path}/segments/*/blocks").filter("index = 'keyword' AND term = 'the'")
    assert blocks.agg(F.max("n")).first()[0] <= idx.block and blocks.agg(F.sum("n")).first()[0] == 20_000
    common = search.write_index(items, fresh_path(spark, "plain-index"))
    parts = common.filter("index = 'keyword' AND term = 'the'").groupBy(F.input_file_name()).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 20_000


def test_depths_leave_less_than_the_bound_unread():
    terms = [Term("bigram", "a", 0.5, {1: (1000, 10), 2: (100, 1), 9: (3, 1)}), Term("keyword", "b", 2.0, {1: (50, 1)}), Term("bigram", "c", 0.1, {1: (5000, 50)})]
    for least in (0.05, 0.3, 0.7, 2.5, 9.0):
        at = depths(terms, least)
        assert sum(t.bound(v) for t, v in zip(terms, at)) < least
    assert depths(terms, 0.7)[2] == 1  # the long list isn't read


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(i, "PERSON", d, ["s"]) for i, d in nodes], NODES)
    return n, spark.createDataFrame([(a, b, d, 1.0, ["k"], ["s"]) for a, b, d in edges], EDGES)


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_the_index_follows_upserts(spark):
    store = GraphStore(spark, fresh_path(spark, "graph"), upserts=100)
    store.write(*graph(spark, [(f"N{i}", f"plain words {i}") for i in range(400)], [("N1", "N2", "first link"), ("N1", "LATE", "waits for its end")]))
    idx = SearchIndex(spark, fresh_path(spark, "index"), fan=3).follow(store)
    same = lambda q: rows(idx.search(q, 30), "type", "id", "total_score") == rows(search.combined_search(search.items(*store.read()), q, 30), "type", "id", "total_score")
    assert same("words 17") and not [r for r in idx.ranked("waits") if r["id"] == "N1|LATE"]
    store.upsert(*graph(spark, [("N7", "changed entirely"), ("LATE", "now here")], [("N1", "N2", "second link")]))
    before = {r["segment"] for r in idx.segments()}
    idx.follow(store)
    new = [r["segment"] for r in idx.segments() if r["segment"] not in before]
    assert len(new) == 1 and before <= {r["segment"] for r in idx.segments()}
    folder = idx.path.removeprefix("file://")
    assert size_of(f"{folder}/segments/{new[0]}") < 0.5 * size_of(f"{folder}/segments/{min(before)}")
    for question in ("changed words 7", "first second link"):
        assert same(question), question
    assert any(r["id"] == "N1|LATE" for r in idx.ranked("waits")) and all("first" not in r["text"] for r in idx.items().collect())
    for i in range(3):  # segments are merged as they gather
        store.upsert(*graph(spark, [(f"M{i}", f"more text {i}"), ("N7", f"version {i}")], []))
        idx.follow(store)
    assert len(idx.segments()) < 4 and same("version 1 more")
    assert idx.items().count() == search.items(*store.read()).count()
    store.write(*graph(spark, [("ONLY", "one left")], []))
    assert idx.follow(store) and same("one left") and same("version")


def test_an_upsert_that_is_slow_is_not_lost(spark):
    store = GraphStore(spark, fresh_path(spark, "graph"))
    store.write(*graph(spark, [("A", "a")], []))
    nodes, edges = graph(spark, [("C", "c")], [])
    slow = store.parts.new()  # the first writer takes part 1
    nodes.write.parquet(f"{slow}/nodes")
    store.upsert(*graph(spark, [("B", "b")], []))
    store.compact()
    edges.write.parquet(f"{slow}/edges")
    assert {r.id for r in store.read()[0].collect()} == {"A", "B", "C"}
    store.compact()
    assert {r.id for r in store.read()[0].collect()} == {"A", "B", "C"}


def test_merged_parts_are_removed_and_numbers_not_given_twice(spark):
    store = GraphStore(spark, fresh_path(spark, "graph"), upserts=2)
    idx = SearchIndex(spark, fresh_path(spark, "index"))
    store.write(*graph(spark, [("A", "a")], []))
    for i in range(11):
        store.upsert(*graph(spark, [(f"B{i}", "b"), ("A", f"a{i}")], []))
        if i in (1, 10):
            idx.follow(store)
    assert len(store.parts._numbers()) < 10 and store.parts._numbers()[-1] == 11
    found = {r.id: r.description for r in store.read()[0].collect()}
    assert len(found) == 12 and found["A"] == "a10"
    assert {(r.id, r.text) for r in idx.items().collect()} == {(r.id, r.text) for r in search.items(*store.read()).collect()}


def test_an_items_postings_are_written_where_they_are_counted(spark):
    """No posting is shuffled: an item's lie in one file of each index, sorted by term."""
    texts = [("node", f"n{i}", f"the word{i % 7} code{i} code{i}") for i in range(400)] + [("edge", "a|b", ""), ("edge", "空", "中文 the")]
    items = spark.createDataFrame(texts, "type string, id string, text string")
    idx = search.write_index(items, fresh_path(spark, "plain-index"))
    assert sorted(map(tuple, idx.select("index", "term", "type", "id", "tf").collect())) == sorted(map(tuple, search.index(items).collect()))
    held = idx.withColumn("file", F.input_file_name())
    assert held.groupBy("index", "type", "id").agg(F.countDistinct("file").alias("n")).filter("n > 1").isEmpty()
    assert held.filter("index = 'keyword' AND term = 'the'").select("file").distinct().count() > 1
    for file in held.select("file").distinct().collect()[:3]:
        terms = [r["term"] for r in spark.read.parquet(file["file"]).coalesce(1).collect()]
        assert terms == sorted(terms, key=lambda t: t.encode())


def test_blocks_are_cut_where_postings_are_counted(spark, items, idx):
    """No posting of a segment is shuffled: an item's lie in one file of each index, in blocks of one term and frequency."""
    blocks = spark.read.parquet(f"{idx.path}/segments/*/blocks")
    held = blocks.withColumn("file", F.input_file_name()).select("file", "index", "term", "tf", "short", "long", "n", F.explode("items").alias("e"))
    assert held.groupBy("index", "e.type", "e.id").agg(F.countDistinct("file").alias("f")).filter("f > 1").isEmpty()
    assert held.filter("e.length NOT BETWEEN short AND long").isEmpty() and blocks.filter("n != size(items) OR n > 32").isEmpty()
    assert sorted(map(tuple, held.select("index", "term", "e.type", "e.id", "tf").collect())) == sorted(map(tuple, search.index(items).select("index", "term", "type", "id", "tf").collect()))
