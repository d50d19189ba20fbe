"""Ranks brought up to date by residuals."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.sources.shared import written


def converged(names, edges, alpha=0.85):
    out, rank = {}, dict.fromkeys(names, 1 / len(names))
    for a, _, w in edges:
        out[a] = out.get(a, 0) + w
    for _ in range(400):
        lost = sum(r for n, r in rank.items() if n not in out)
        new = dict.fromkeys(names, (1 - alpha + alpha * lost) / len(names))
        for a, b, w in edges:
            new[b] += alpha * rank[a] * w / out[a]
        rank = new
    return rank


def test_ranks_after_changes_equal_a_converged_run(spark):
    draw = random.Random(2)
    names = [f"n{i}" for i in range(300)]
    edges = [(draw.choice(names[:250]), draw.choice(names), float(draw.randrange(1, 4))) for _ in range(900)]
    frame = lambda rows: spark.createDataFrame(rows, "src string, dst string, weight double")
    listed = lambda ns: spark.createDataFrame([(n,) for n in ns], "node string")
    old = converged(names, edges)
    ranks = spark.createDataFrame(list(old.items()), "node string, pagerank double")
    pushed = []
    same = graph.updated_pagerank(listed(names), frame(edges), ranks, written, told=pushed)
    assert sum(abs(r.pagerank - old[r.node]) for r in same.collect()) < 1e-6 and not pushed
    changed = [e for e in edges if e[0] != "n7"] + [("n3", "new", 2.0), ("new", "n5", 1.0), ("n9", "n11", 1.0)]
    more = [n for n in names if n != "n8"] + ["new"]
    changed = [e for e in changed if "n8" not in e[:2]]
    for error in (1e-4, 1e-6):
        pushed.clear()
        got = {r.node: r.pagerank for r in graph.updated_pagerank(listed(more), frame(changed), ranks, written, error=error, told=pushed).collect()}
        want = converged(more, changed)
        assert set(got) == set(want) and sum(abs(got[n] - want[n]) for n in want) <= error and min(pushed) < len(more)
    assert graph.updated_pagerank(listed(["a"]).limit(0), frame(edges).limit(0), ranks, written).count() == 0
    assert graph.updated_pagerank(listed(["a", "b"]), frame([("a", "b", 1.0)]), ranks.limit(0), written).agg(F.sum("pagerank")).first()[0] == pytest.approx(1, abs=1e-5)


def test_edges_are_dealt_out_once_and_hubs_in_pieces(spark, monkeypatch):
    """Rounds neither write nor deal out edges again, and all are written."""
    draw = random.Random(11)
    names = [f"n{i:02}" for i in range(40)]
    edges = [("n00", n, 1.0) for n in names[1:]] + [(draw.choice(names[:30]), draw.choice(names), draw.choice([1.0, 2.0, None])) for _ in range(80)]
    frame = spark.createDataFrame(edges, "src string, dst string, weight double")
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    monkeypatch.setattr(graph, "PIECE", 10)
    tables = []

    def cut(df):
        tables.append(df.columns)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    plans: list[str] = []
    found = {r.node: r.pagerank for r in graph.pagerank(nodes, frame, cut, rounds=4, tolerance=None).collect()}
    want = dict.fromkeys(names, 1 / 40)
    out: dict = {}
    for s, _, w in edges:
        out[s] = out.get(s, 0) + (1.0 if w is None else w)
    for _ in range(4):
        lost = sum(v for k, v in want.items() if k not in out)
        new = dict.fromkeys(names, 0.15 / 40 + 0.85 * lost / 40)
        for s, d, w in edges:
            new[d] += 0.85 * want[s] * (1.0 if w is None else w) / out[s]
        want = new
    assert found == pytest.approx(want, abs=1e-12)
    assert sum("dst" in c for c in tables) == 1
    rounds = [p for c, p in zip(tables, plans) if "old" in c]
    assert len(rounds) == 4 and all("InMemoryTableScan" in p for p in rounds)
