"""Graph measures over edge lists ``(src, dst, weight)``; undirected edges stand
once per pair, self-loops count twice towards a degree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components
from graphloom.sources.shared import dropped

Cut = Callable[[DataFrame], DataFrame]


def undirected(edges: DataFrame) -> DataFrame:
    """One row per unordered pair, weights added; a missing weight is 1."""
    w = F.coalesce(F.col("weight"), F.lit(1.0))
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum(w).alias("weight"))


def edge_weights(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs`` ``(src, dst)`` with the ``weight`` of the edge between them,
    either way round: 1 where it has none, 0 where there is no edge."""
    held = undirected(edges).select(F.col("src").alias("__a"), F.col("dst").alias("__b"), F.col("weight").alias("__w"))
    return pairs.select("*", F.least("src", "dst").alias("__a"), F.greatest("src", "dst").alias("__b")).join(held, ["__a", "__b"], "left").select(*pairs.columns, F.coalesce("__w", F.lit(0.0)).alias("weight"))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(node, k)``: the sum of weights at each node, 0 without edges."""
    w = F.coalesce(F.col("weight"), F.lit(1.0)).alias("w")
    ends = edges.select(F.col("src").alias("node"), w).unionAll(edges.select(F.col("dst").alias("node"), w))
    k = ends.groupBy("node").agg(F.sum("w").alias("k"))
    return k if nodes is None else nodes.select("node").join(k, "node", "left").select("node", F.coalesce("k", F.lit(0.0)).alias("k"))


def placed_edges(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Edges with the communities ``a`` and ``b`` of their ends."""
    a = communities.select(F.col("node").alias("src"), F.col("community").alias("a"))
    b = communities.select(F.col("node").alias("dst"), F.col("community").alias("b"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight"), "a", "b")


def community_degrees(edges: DataFrame, communities: DataFrame) -> DataFrame:
    return degrees(edges).join(communities, "node").groupBy("community").agg(F.sum("k").alias("tot"))


def modularity(edges: DataFrame, communities: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row ``q``: the sum over communities of L/m - gamma d^2/(4 m^2); 0
    without edges."""
    placed = placed_edges(edges, communities)
    inner = placed.filter("a = b").groupBy(F.col("a").alias("community")).agg(F.sum("weight").alias("l"))
    total = edges.agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("m"))
    parts = community_degrees(edges, communities).join(inner, "community", "left").crossJoin(F.broadcast(total))
    q = F.sum(F.coalesce("l", F.lit(0.0)) / F.col("m") - gamma * F.col("tot") ** 2 / (4 * F.col("m") ** 2))
    return parts.agg(F.coalesce(q, F.lit(0.0)).alias("q"))


def aggregated(edges: DataFrame, communities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of communities: weights inside become self-loops, those
    between two are added. Nodes carry their size."""
    placed = placed_edges(edges, communities)
    merged = placed.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("weight").alias("weight"))
    return communities.groupBy(F.col("community").alias("node")).agg(F.count(F.lit(1)).alias("size")), merged


def gains(edges: DataFrame, communities: DataFrame, gamma: float = 1.0) -> DataFrame:
    """For each node and each community among its neighbours (and its own):
    ``(node, community, own, gain)``, the change of modularity by putting the
    node, taken out of its community, into this one."""
    loops = edges.filter("src != dst")
    w = F.coalesce(F.col("weight"), F.lit(1.0))
    both = loops.select(F.col("src").alias("node"), F.col("dst").alias("other"), w.alias("w")).unionAll(loops.select(F.col("dst").alias("node"), F.col("src").alias("other"), w.alias("w")))
    near = both.join(communities.select(F.col("node").alias("other"), "community"), "other").groupBy("node", "community").agg(F.sum("w").alias("kin"))
    own = communities.select("node", "community").withColumn("kin", F.lit(0.0))
    options = near.unionByName(own).groupBy("node", "community").agg(F.sum("kin").alias("kin"))
    k = degrees(edges)
    tot = community_degrees(edges, communities)
    m = edges.agg(F.sum(w).alias("m"))
    rows = options.join(k, "node").join(communities.select("node", F.col("community").alias("own")), "node").join(tot, "community").crossJoin(F.broadcast(m))
    rest = F.col("tot") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(F.lit(0.0))
    return rows.select("node", "community", "own", (F.col("kin") / F.col("m") - gamma * F.col("k") * rest / (2 * F.col("m") ** 2)).alias("gain"))


def largest_component(nodes: DataFrame, edges: DataFrame, cut: Cut) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the component with most nodes; of equal ones that with
    the smallest node."""
    found = cut(connected_components(edges, cut, nodes=nodes.select("node")))
    first = found.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    inside = cut(found.join(F.broadcast(first), "component", "left_semi").select("node"))
    return nodes.join(inside, "node", "left_semi"), edges.join(inside, edges["src"] == inside["node"], "left_semi")


#: Most edges out of a node that lie in one piece.
PIECE = 100_000


def pagerank(nodes: DataFrame, edges: DataFrame, cut: Cut | None = None, alpha: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """``(node, pagerank)`` along edges from src to dst by weight; the rank of
    nodes without a way out is spread over all. Stops when the changes add up to
    less than the number of nodes times ``tolerance`` (None: after ``rounds``).

    Edges are dealt out and sorted by src once, a hub's in several pieces, and kept
    so on the executors' disks; a round deals out ranks and sums, which are taken
    before the shuffle, so a hub's incoming rank is never gathered row by row. Each
    round's ranks are written, and what is asked of them is summed on the way.
    """
    w = F.coalesce(F.col("weight"), F.lit(1.0))
    edges = edges.select("src", "dst", w.alias("w"))
    if cut:
        edges = cut(edges)
    out = edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("out"), F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    base = nodes.select("node").join(out, "node", "left").select("node", F.col("out").isNull().alias("stuck"), "out", "pieces")
    if cut:
        base = cut(base)
    n, stuck = base.agg(F.count(F.lit(1)), F.count_if("stuck")).first()
    if not n:
        return base.select("node", F.lit(0.0).alias("pagerank"))
    # Hubs are no more than one for so many edges.
    hubs = base.filter("pieces > 1").select(F.col("node").alias("src"), "pieces").distinct()
    if cut:
        hubs = cut(hubs)
    dealt = edges.join(hubs, "src", "left").select("src", F.coalesce(F.pmod(F.xxhash64("dst"), "pieces").cast("int"), F.lit(0)).alias("piece"), "dst", "w")
    if cut:
        number = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = dealt.repartition(number, "src", "piece").sortWithinPartitions("src", "piece").persist(StorageLevel.DISK_ONLY)
    ranks = base.withColumn("r", F.lit(1.0 / n))
    lost = stuck / n
    told = [F.coalesce(F.sum(F.when(F.col("stuck"), F.col("r"))), F.lit(0.0)).alias("lost"), F.coalesce(F.sum(F.abs(F.col("r") - F.col("old"))), F.lit(0.0)).alias("moved")]
    for _ in range(rounds):
        sent = ranks.filter("NOT stuck").select(F.col("node").alias("src"), (F.col("r") / F.col("out")).alias("r"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
        given = dealt.join(sent, ["src", "piece"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("r") * F.col("w")).alias("in"))
        new = (1 - alpha) / n + alpha * (F.coalesce("in", F.lit(0.0)) + F.lit(lost) / n)
        step = ranks.join(given, "node", "left").select("node", "stuck", "out", "pieces", new.alias("r"), F.col("r").alias("old"))
        before = ranks
        if cut:
            seen = Observation()
            ranks = cut(step.observe(seen, *told))
            row = seen.get
            dropped(before)
        else:
            ranks = step
            row = step.agg(*told).first().asDict()
        lost = row["lost"]
        if tolerance is not None and row["moved"] < n * tolerance:
            break
    if cut:
        dealt.unpersist()
        dropped(edges, hubs, *([base] if rounds else []))
    return ranks.select("node", F.col("r").alias("pagerank"))


def updated_pagerank(nodes: DataFrame, edges: DataFrame, ranks: DataFrame, cut: Cut, alpha: float = 0.85, error: float = 1e-6, rounds: int = 200, told: list[int] | None = None) -> DataFrame:
    """``(node, pagerank)`` of a graph that has changed since ``ranks`` were worked
    out: all ranks together are off by at most ``error``.

    One pass gives each node's residual, by how much its rank doesn't follow from
    its neighbours'. Then only nodes whose residual is more than their share of
    the error push it along their edges; what is left of all residuals, over
    1 - alpha, bounds the error. What nodes without a way out push goes to all
    alike, and is kept as one number until it is too much. ``told`` gets how many
    nodes pushed in each round.
    """
    w = F.coalesce(F.col("weight"), F.lit(1.0))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.sum(w).alias("out"))
    share = cut(edges.join(out.withColumnRenamed("node", "src"), "src").select("src", "dst", (w / F.col("out")).alias("share")))
    base = nodes.select("node").distinct().join(out, "node", "left").join(ranks.select("node", F.col("pagerank").alias("x")), "node", "left")
    base = cut(base.select("node", F.col("out").isNull().alias("stuck"), "x"))
    n, known = base.agg(F.count(F.lit(1)), F.sum("x")).first()
    if not n:
        return base.select("node", F.lit(0.0).alias("pagerank"))
    # Ranks of nodes that have gone are spread again, new nodes begin with a mean rank.
    base = base.select("node", "stuck", (F.coalesce(F.col("x") / F.lit(known or 1.0), F.lit(1.0 / n))).alias("x"))
    given = lambda rows, value: share.join(rows.select(F.col("node").alias("src"), F.col(value).alias("v")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("v") * F.col("share")).alias("in"))
    lost = base.agg(F.sum(F.when(F.col("stuck"), F.col("x")))).first()[0] or 0.0
    start = (1 - alpha + alpha * lost) / n
    state = cut(base.join(given(base, "x"), "node", "left").select("node", "stuck", "x", (start + alpha * F.coalesce("in", F.lit(0.0)) - F.col("x")).alias("r")))
    even = 0.0  # a residual that all nodes have besides their own
    for _ in range(rounds):
        left, stuck = state.agg(F.sum(F.abs(F.col("r") + even)), F.count_if("stuck")).first()
        if left <= error * (1 - alpha):
            break
        least = error * (1 - alpha) / (2 * n)
        push = F.abs(F.col("r") + even) > least
        active = cut(state.filter(push).select("node", "stuck", (F.col("r") + even).alias("v")))
        pushed, spread_ = active.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("stuck"), F.col("v"))), F.lit(0.0))).first()
        if told is not None:
            told.append(pushed)
        moved = state.join(given(active, "v"), "node", "left").select(
            "node", "stuck", (F.col("x") + F.when(push, F.col("r") + even).otherwise(0.0)).alias("x"),
            (F.when(push, F.lit(-even)).otherwise(F.col("r")) + alpha * F.coalesce("in", F.lit(0.0))).alias("r"),
        )
        before, state = state, cut(moved)
        even += alpha * spread_ / n
        dropped(before, active)
    else:
        raise RuntimeError(f"residuals did not settle in {rounds} rounds")
    return state.select("node", F.col("x").alias("pagerank"))
