"""The whole way over stored graphs, and what changes when pairs are added."""

import random

from pyspark.sql import functions as F

from graphloom.operators import resolve
from graphloom.operators.components import connected_components, extended_components
from graphloom.plans import build
from graphloom.plans.base import KnowledgeBase
from graphloom.plans.chat_model import Template
from graphloom.sources.shared import fresh_path, written
from graphloom.sources.store import EDGES, NODES

RECORDS = '("entity"<|>{0}<|>person<|>{0} keeps the amber gate)##("entity"<|>Acme {1}<|>company<|>a works by the river)##("relationship"<|>{0}<|>Acme {1}<|>{0} works at Acme<|>work<|>2)'


def reading():
    """A model for a whole build: names of the text, yes to all pairs."""
    ask, records = build.ASK_PROMPT, RECORDS

    def reply(prompt):
        text = prompt if isinstance(prompt, str) else prompt[0]["parts"][0]["text"]
        if "Question 1:" in text:
            return "(For question <|>1<|>, <|>yes<|>)"
        if "Report on" in text:
            return '{"title": "t", "summary": "s", "rating": 3, "rating_explanation": "e", "findings": [{"summary": "f", "explanation": "g"}]}'
        if not isinstance(prompt, str) and prompt[-1]["parts"][0]["text"] == ask:
            return "N"
        return "" if not isinstance(prompt, str) and len(prompt) > 1 else records.format("Alice", text.strip()[-1])

    return reply


def test_from_texts_to_stored_graphs_to_answers(spark):
    base = KnowledgeBase(spark, fresh_path(spark, "base"))
    chunks = spark.createDataFrame([(1, 0, "text 1"), (2, 0, "text 2")], "doc_id long, chunk_seq int, content string")
    base.build(chunks, Template(reading()), "m")
    assert {r.id for r in base.graph(resolved=False)[0].collect()} == {"ALICE", "ACME 1", "ACME 2"}
    assert {r.id for r in base.graph()[0].collect()} == {"ALICE", "ACME 1"}
    assert base.table("reports").count() == 1 and {tuple(r) for r in base.table("names").select("member", "target").collect()} == {("ACME 1", "ACME 1"), ("ACME 2", "ACME 1")}
    stored = base.cache.entries().count()
    assert stored > 3
    again = KnowledgeBase(spark, base.path)
    asked = []
    found = again.answer("who keeps the amber gate", Template(lambda p: asked.append(p) or 'Alice does.\n["ALICE"]'))
    assert found["answer"] == "Alice does." and found["entities"] == ["ALICE"] and "amber gate" in asked[0]
    assert "ACME 2" not in asked[0] and "ACME 2" in again.answer("works by the river", Template(str), resolved=False, sequential=True)["context"]
    nodes = spark.createDataFrame([("BOB", "PERSON", "Bob polishes copper bells", ["3"])], NODES)
    again.stores["resolved"].upsert(nodes, spark.createDataFrame([], EDGES))
    again.follow()
    assert "BOB" in again.answer("copper bells", Template(str))["context"]


def whole_run(pairs):
    """Each name's smallest connected name."""
    found = {n: n for p in pairs for n in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(found[a], found[b])
            changed |= found[a] != low or found[b] != low
            found[a] = found[b] = low
    return found


def test_components_after_each_batch_equal_a_full_run(spark):
    draw = random.Random(6)
    names = [f"n{i:03}" for i in range(120)]
    pairs, labels = [], spark.createDataFrame([], "node string, component string")
    for batch in range(7):
        new = [(draw.choice(names), draw.choice(names)) for _ in range(9)]
        pairs += new
        before = {r.node: r.component for r in labels.collect()}
        labels, touched = extended_components(labels, spark.createDataFrame(new, "a string, b string"), written)
        got = {r.node: r.component for r in labels.collect()}
        assert got == whole_run(pairs)
        changed = {got[n] for n in got if before.get(n) != got[n]}
        assert changed <= {r.component for r in touched.collect()}


def test_touched_groups_alone_are_merged_again(spark):
    draw = random.Random(8)
    names = [f"N{i:02}" for i in range(40)]
    nodes = spark.createDataFrame([(n, "T", f"d {n}", [n]) for n in names], NODES)
    ends = sorted({tuple(sorted(draw.sample(names, 2))) for _ in range(120)})
    edges = spark.createDataFrame([(a, b, f"{a}-{b}", float(i % 5), ["k"], [a]) for i, (a, b) in enumerate(ends)], EDGES)
    shown = lambda g: [sorted(map(str, part.select(*sorted(part.columns)).collect())) for part in g]
    as_names = lambda labels: labels.select(F.col("node").alias("member"), F.col("component").alias("target"))
    labels = connected_components(spark.createDataFrame([("N01", "N02"), ("N05", "N09")], "src string, dst string"), written)
    held = resolve.merged_graph(nodes, edges, as_names(labels))
    labels, touched = extended_components(labels, spark.createDataFrame([("N02", "N20"), ("N30", "N31")], "a string, b string"), written)
    part = resolve.remerged(nodes, edges, as_names(labels), touched.withColumnRenamed("component", "target"))
    assert {r.id for r in part[2].collect()} == {"N01", "N02", "N20", "N30", "N31"} and part[0].count() == 2
    assert shown(resolve.replaced(*held, *part)) == shown(resolve.merged_graph(nodes, edges, as_names(labels)))
