"""Graph measures and communities on small graphs."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.operators import community, extract, graph, resolve
from graphloom.operators.components import connected_components
from graphloom.sources.shared import written

BASIC = [("A", "B", 2.0), ("B", "C", 2.0), ("D", "E", 2.0), ("E", "F", 2.0), ("C", "D", 1.0)]
GROUPS = [("A", "B", 3.0), ("B", "C", 3.0), ("C", "D", 3.0), ("A", "D", 2.0), ("E", "F", 3.0), ("F", "G", 3.0), ("E", "G", 2.0), ("H", "I", 3.0), ("I", "J", 3.0), ("H", "J", 2.0), ("D", "E", 1.0), ("G", "H", 1.0)]


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def nodes_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def placed(spark, groups):
    return spark.createDataFrame([(n, c) for c, ns in groups.items() for n in ns], "node string, community string")


def test_modularity_by_hand(spark):
    e = edges_of(spark, BASIC)
    assert graph.modularity(e, placed(spark, {"x": "ABC", "y": "DEF"})).first().q == pytest.approx(8 / 9 - 1 / 2)
    assert graph.modularity(e, placed(spark, {c: c for c in "ABCDEF"})).first().q == pytest.approx(-58 / 324)
    assert graph.modularity(edges_of(spark, []), placed(spark, {"x": "A"})).first().q == 0


def test_aggregation_keeps_the_weight(spark):
    nodes, merged = graph.aggregated(edges_of(spark, BASIC), placed(spark, {"x": "ABC", "y": "DEF"}))
    assert {(r.src, r.dst, r.weight) for r in merged.collect()} == {("x", "x", 4.0), ("y", "y", 4.0), ("x", "y", 1.0)}
    assert {(r.node, r["size"]) for r in nodes.collect()} == {("x", 3), ("y", 3)}


def test_loops_count_twice(spark):
    assert {(r.node, r.k) for r in graph.degrees(edges_of(spark, [("A", "A", 2.0), ("A", "B", None)])).collect()} == {("A", 5.0), ("B", 1.0)}


def test_gain_is_the_change_of_modularity(spark):
    e = edges_of(spark, BASIC)
    before = {"a": "A", "b": "BC", "d": "DEF"}
    alone = {"a": "A", "b": "C", "n": "B", "d": "DEF"}
    after = {"a": "AB", "b": "C", "d": "DEF"}
    q = lambda g: graph.modularity(e, placed(spark, g)).first().q
    gain = {(r.node, r.community): r.gain for r in graph.gains(e, placed(spark, before)).collect()}
    assert gain["B", "a"] == pytest.approx(q(after) - q(alone))


@pytest.mark.parametrize("rows, groups", [(BASIC, {"ABC", "DEF"}), (GROUPS, {"ABCD", "EFG", "HIJ"})])
def test_leiden_finds_the_groups(spark, rows, groups):
    found = community.leiden(nodes_of(spark, sorted({x for r in rows for x in r[:2]})), edges_of(spark, rows), written, levels=2)
    top = {}
    for r in found.collect():
        top.setdefault(r.level, {}).setdefault(r.community, set()).add(r.leaf)
    q = [graph.modularity(edges_of(spark, rows), placed(spark, {c: m for c, m in level.items()})).first().q for _, level in sorted(top.items())]
    assert q == sorted(q)
    assert {"".join(sorted(m)) for m in top[max(top)].values()} == groups


def test_local_moving_goes_on_until_no_node_wants_to(spark):
    # Of a hub and its neighbours only one moves in a round.
    rows = [("hub", f"a{i}", 1.0) for i in range(12)] + [(f"a{i}", f"a{i + 1}", 1.0) for i in range(11)] + [(f"a{i}", f"b{i}", 1.5) for i in range(12)]
    edges = written(edges_of(spark, rows))
    names = sorted({x for r in rows for x in r[:2]})
    found, q = community.local_moving(edges, nodes_of(spark, names).select("node", F.col("node").alias("community")), written)
    best = graph.gains(edges, found).groupBy("node").agg(F.max("gain").alias("best"), F.max(F.when(F.col("community") == F.col("own"), F.col("gain"))).alias("stay"))
    assert best.filter("best > stay + 1e-9 and best > 0").count() == 0
    assert q == pytest.approx(graph.modularity(edges, found).first().q)
    with pytest.raises(RuntimeError):
        community.local_moving(edges, nodes_of(spark, names).select("node", F.col("node").alias("community")), written, rounds=1)


def test_moves_apart_share_no_community(spark):
    moves = spark.createDataFrame([("a", "A", "B", 5), ("b", "C", "B", 4), ("c", "D", "A", 3), ("d", "E", "F", 2)], "node string, `from` string, `to` string, rank int")
    assert {r.node for r in community.disjoint(moves).collect()} == {"a", "d"}


def test_edge_cases(spark):
    none = edges_of(spark, [])
    assert community.leiden(nodes_of(spark, []), none, written, levels=1).count() == 0
    assert community.leiden(nodes_of(spark, "A"), none, written, levels=1).count() == 1
    assert community.leiden(nodes_of(spark, "ABC"), none, written, levels=1, use_lcc=False).count() == 3
    assert community.leiden(nodes_of(spark, "ABCD"), edges_of(spark, [("A", "B", None)]), written, levels=1).count() == 2
    assert community.louvain(nodes_of(spark, "ABC"), none, written, levels=1).count() == 3


def test_communities_are_connected(spark):
    split = community.split_communities(edges_of(spark, BASIC), placed(spark, {"x": "ABF", "y": "CDE"}), written)
    assert {(r.node, r.community) for r in split.collect()} == {("A", "A"), ("B", "A"), ("F", "F"), ("C", "C"), ("D", "C"), ("E", "C")}


MONOTONE = [("A", "B", 2.0), ("B", "C", 2.0), ("C", "D", 2.0), ("A", "D", 1.0), ("E", "F", 2.0), ("F", "G", 2.0), ("G", "H", 2.0), ("E", "H", 1.0), ("D", "E", 1.0)]


def test_refinement_splits_and_moves_back(spark):
    for rows, groups in ((BASIC, {"x": "ABF", "y": "CDE"}), (GROUPS, {"x": "ABJ", "y": "CDEFGHI"}), (MONOTONE, {"x": "ABCH", "y": "DEFG"})):
        edges, before = written(edges_of(spark, rows)), placed(spark, groups)
        after = community.refined(edges, before, written)
        q = lambda c: graph.modularity(edges, c).first().q
        assert q(after) >= q(community.split_communities(edges, before, written)) - 1e-9 and q(after) > q(before)
        assert community.split_communities(edges, after, written).select("community").distinct().count() == after.select("community").distinct().count()
        # Refined once more, nothing changes.
        assert q(community.refined(edges, after, written)) == pytest.approx(q(after))


def test_levels_never_lose_modularity(spark):
    edges = edges_of(spark, MONOTONE)
    found = community.leiden(nodes_of(spark, "ABCDEFGH"), edges, written)
    q = [graph.modularity(edges, found.filter(F.col("level") == i).select(F.col("leaf").alias("node"), "community")).first().q for i in range(found.agg(F.max("level")).first()[0] + 1)]
    assert all(b >= a - 1e-4 for a, b in zip(q, q[1:])) and q[-1] > 0.3


def plain_pagerank(nodes, rows, rounds):
    n, out = len(nodes), {}
    for s, _, w in rows:
        out[s] = out.get(s, 0) + w
    r = dict.fromkeys(nodes, 1 / n)
    for _ in range(rounds):
        lost = sum(v for k, v in r.items() if k not in out)
        new = dict.fromkeys(nodes, 0.15 / n + 0.85 * lost / n)
        for s, d, w in rows:
            new[d] += 0.85 * r[s] * w / out[s]
        r = new
    return r


def test_pagerank(spark):
    found = {r.node: r.pagerank for r in graph.pagerank(nodes_of(spark, "ABCDEFG"), edges_of(spark, BASIC), written).collect()}
    assert found == pytest.approx(plain_pagerank("ABCDEFG", BASIC, 100), abs=1e-5)
    assert sum(found.values()) == pytest.approx(1)
    assert graph.pagerank(nodes_of(spark, []), edges_of(spark, []), written).count() == 0


def test_community_contexts_use_converged_ranks(spark, data, monkeypatch):
    from graphloom.plans import queries, rag

    seen = {}

    def contexts(nodes, edges, communities, ranks):
        seen["ranks"] = {r.node: r.pagerank for r in ranks.collect()}
        return nodes

    chain = [(f"n{i}", f"n{i + 1}", 1.0) for i in range(11)] + [("n11", "n3", 2.0), ("n11", "n7", 1.0)]
    edges = edges_of(spark, chain).selectExpr("src source", "dst target", "weight")
    names = sorted({x for r in chain for x in r[:2]})
    monkeypatch.setattr(rag, "build_graph", lambda *_, **__: (nodes_of(spark, names).withColumnRenamed("node", "id"), edges))
    monkeypatch.setattr(rag, "community_contexts", contexts)
    queries.community_contexts(spark, data)
    assert seen["ranks"] == pytest.approx(plain_pagerank(names, chain, 200), abs=1e-4)
    assert plain_pagerank(names, chain, 5) != pytest.approx(plain_pagerank(names, chain, 200), abs=1e-4)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    everything = spark.createDataFrame([(i,) for i in range(13)], "node int")
    found = connected_components(spark.createDataFrame(pairs, "src int, dst int"), written, nodes=everything)
    assert {(r.node, r.component) for r in found.collect()} == {(i, find(i)) for i in range(13)}


def test_a_long_chain_is_one_component(spark):
    found = connected_components(spark.range(200).selectExpr("id src", "id + 1 dst"), written)
    assert found.count() == 201 and found.select("component").distinct().count() == 1


def test_merging(spark):
    nodes = spark.createDataFrame([("A", "P", "a", ["1"]), ("B", "Q", "b", ["1", "2"]), ("C", "P", "c", ["3"])], "id string, entity_type string, description string, source_ids array<string>")
    edges = spark.createDataFrame([("A", "C", "own", 1.0), ("B", "C", "moved", 2.0), ("A", "B", "between", 4.0)], "source string, target string, description string, weight double").selectExpr("*", "array() keywords", "array() source_ids")
    names = resolve.canonical(spark.createDataFrame([("A", "B")], "a string, b string"), written)
    n, e = resolve.merged_graph(nodes, edges, names)
    assert {(r.id, r.entity_type, r.description, tuple(r.source_ids)) for r in n.collect()} == {("A", "P", "a <SEP> b", ("1", "2")), ("C", "P", "c", ("3",))}
    assert {(r.source, r.target, r.description, r.weight) for r in e.collect()} == {("A", "C", "own", 1.0), ("A", "A", "between", 4.0)}
    n, e = resolve.merged_graph(nodes, edges, names, add_weights=True, keep_loops=False)
    assert {(r.source, r.target, r.weight) for r in e.collect()} == {("A", "C", 3.0)}


@pytest.mark.parametrize("partition", [["kind"], []])
def test_numbering_of_a_partition_with_nearly_all_rows(spark, partition):
    rows = spark.range(5000).select(F.when(F.col("id") % 50 == 0, "rare").when(F.col("id") % 77 != 0, "hot").alias("kind"), ((F.col("id") * 7919) % 5003).alias("v"))
    got = {(r["kind"], r["v"]): r["i"] for r in extract.numbered(rows, ["v"], partition, written).collect()}
    groups: dict = {}
    for kind, v in sorted(got, key=lambda kv: kv[1]):
        groups.setdefault(kind if partition else "", []).append((kind, v))
    assert len(got) == 5000
    assert got == {kv: i for held in groups.values() for i, kv in enumerate(held)}


def test_top_members_are_cut_before_the_shuffle(spark):
    members = spark.range(1000).select((F.col("id") % 3).alias("community"), F.col("id").cast("string").alias("node"), (F.col("id") % 10).cast("double").alias("pagerank"))
    top = community.top_members(members)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert [r["i"] for r in top.orderBy("community", "i").collect()] == 3 * list(range(12))


def sparse(n=90, seed=5):
    draw = random.Random(seed)
    rows = {(min(p), max(p)) for p in ((f"n{i:03}", f"n{(i + draw.choice([1, 2, 3, 7, 30])) % n:03}") for i in range(n) for _ in range(2)) if p[0] != p[1]}
    return [(a, b, float(draw.randrange(1, 4))) for a, b in sorted(rows)]


@pytest.mark.parametrize("few", [0, 8, 2048])
def test_local_moving_ends_where_no_node_wants_to_move(spark, monkeypatch, few):
    """In rounds alone, by a frontier that outgrows its bound, and by the frontier alone."""
    monkeypatch.setattr(community, "FEW", few)
    edges = written(edges_of(spark, sparse()))
    start = nodes_of(spark, sorted({x for r in sparse() for x in r[:2]})).select("node", F.col("node").alias("community"))
    moving = community.Moving(edges, written)
    found, q = community.settled(moving, start, 200, 7)
    assert q == pytest.approx(graph.modularity(edges, found).first()["q"], abs=1e-9) and q > 0.3
    best = graph.gains(edges, found).groupBy("node").agg(F.max(F.when(F.col("community") != F.col("own"), F.col("gain"))).alias("to"), F.max(F.when(F.col("community") == F.col("own"), F.col("gain"))).alias("stay"))
    assert best.filter("to > stay + 1e-8 AND to > 0").count() == 0
    assert moving.told and (few or all(moved <= wanted for wanted, moved in moving.told))


def test_later_rounds_weigh_only_what_was_woken(spark, monkeypatch):
    """After few moves neighbours of what moved and what was put off are weighed;
    those want what they want when all are weighed."""
    draw = random.Random(4)
    rows = [(f"{g:02}{i}", f"{g:02}{j}", draw.choice([1.0, 2.0])) for g in range(24) for i in range(5) for j in range(i) if draw.random() < 0.8] + [(f"{g:02}0", f"{g + 1:02}1", 1.0) for g in range(23)]
    edges = graph.undirected(edges_of(spark, rows))
    names = sorted({x for r in rows for x in r[:2]})
    moving = community.Moving(edges, written)
    nodes, totals, _ = moving.state(nodes_of(spark, names).withColumn("community", F.col("node")))
    every, _ = moving.wanting(nodes, totals, 3)
    some = nodes_of(spark, names[:30])
    part, _ = moving.wanting(nodes, totals, 3, some)
    fields = ["node", "to", "from", "k"]
    assert sorted(map(tuple, part.select(fields).collect())) == sorted(tuple(r) for r in every.select(fields).collect() if r["node"] in names[:30])
    moved = moving.moves(every, False).limit(3).localCheckpoint()
    gone = {r["node"] for r in moved.collect()}
    near = {b for r in rows for a, b in (r[:2], r[1::-1]) if a in gone}
    assert {r["node"] for r in moving.woken(every, moved).collect()} == near | {r["node"] for r in every.collect()} - gone

    asked = []
    weighed = community.Moving.wanting

    def wanting(self, nodes, totals, seed, active=None):
        found = weighed(self, nodes, totals, seed, active)
        asked.append((active is None, found[1]))
        return found

    monkeypatch.setattr(community.Moving, "wanting", wanting)
    monkeypatch.setattr(community, "FEW", 0)
    monkeypatch.setattr(community, "WAKES", 1)
    _, q = community.settled(community.Moving(edges, written), nodes_of(spark, names).withColumn("community", F.col("node")), 200, 7)
    assert any(not all_ for all_, _ in asked) and asked[-1] == (True, 0) and q > 0.6


def test_neighbours_where_a_node_went_are_not_woken(spark):
    edges = written(graph.undirected(edges_of(spark, sparse())))
    names = sorted({x for r in sparse() for x in r[:2]})
    moving = community.Moving(edges, written)
    groups = {n: f"g{int(n[1:]) // 9}" for n in names}
    nodes, totals, _ = moving.state(spark.createDataFrame(list(groups.items()), "node string, community string"))
    want, _ = moving.wanting(nodes, totals, 3)
    moved = written(moving.moves(want, False))
    gone = {r["node"]: r["to"] for r in moved.collect()}
    after = groups | gone
    beside = {b for r in sparse() for a, b in (r[:2], r[1::-1]) if a in gone and after[b] != gone[a]}
    put_off = {r["node"] for r in want.collect()} - set(gone)
    assert gone and {r["node"] for r in moving.woken(want, moved, nodes).collect()} == beside | put_off
    # What moves change is known from what they were weighed with and the edges between them.
    q = lambda c: graph.modularity(edges, spark.createDataFrame(list(c.items()), "node string, community string")).first()["q"]
    assert moving.change(totals, moved) == pytest.approx(q(after) - q(groups), abs=1e-12)
    moving.close()


def test_a_small_graph_is_settled_in_few_jobs(spark):
    """It is read once, and gone through until no node wants to move."""
    made = []

    def cut(df):
        made.append(df.columns)
        return written(df)

    edges = written(edges_of(spark, sparse()))
    moving = community.Moving(edges, cut)
    start = nodes_of(spark, sorted({x for r in sparse() for x in r[:2]})).select("node", F.col("node").alias("community"))
    found, q = community.settled(moving, start, 200, 7)
    assert len(made) <= 6 and len(moving.told) == 1, (made, moving.told)
    assert q == pytest.approx(graph.modularity(edges, found).first()["q"], abs=1e-9)
    moving.close()
