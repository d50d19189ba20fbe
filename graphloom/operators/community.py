"""Communities: Louvain and Leiden as rounds of DataFrame operations.

Local moving is done by all nodes at once instead of one after another: each
round weighs every node's neighbouring communities by their gain in modularity
and those for which another one is strictly better want to move. A node's move
is put off where a neighbour of higher seeded rank wants to leave the community
it goes to, or to enter the one it comes from. Where such a round doesn't raise
modularity it is taken back, and only moves that touch different communities and
nodes are made, which always raises it. So rounds go on until no node wants to
move. A round after few moves weighs only what was put off and those neighbours of
what has moved that aren't where it went; all nodes are weighed again before moving
ends. Where few want to move they move one after another on the driver, from their
own edges alone, and wake their neighbours; that frontier is bounded, and what
outgrows it is left to the rounds. Modularity is kept by what the moves change.
Within ``detect`` nodes are numbers in the order of their names.

Leiden then refines: communities that aren't connected are split, nodes for
which it is better move to communities next to them (one node a round for each
community, so that what it enters stays connected), and what a leaving node has
cut is split again. Communities become the nodes of the next level until they no
longer get fewer, or ``levels`` times where that is given.

No group of rows is gathered anywhere; a level's tables are written once per
round, so a lost executor costs one round.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import count

import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components
from graphloom.operators.graph import Cut, aggregated, degrees, gains, largest_component, undirected
from graphloom.sources.shared import dropped


def together(*jobs):
    """What small jobs give, run at the same time: one alone leaves cores idle."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(SparkSession.active())(job)) for job in jobs]]


class Moving:
    """A graph's edges as local moving reads them. ``cut`` must write what it is
    given, as sums are taken along the way. ``names`` ``(node, name)``: what nodes
    are ranked by, else themselves. Edges are dealt out and sorted by ``other`` once,
    and kept so on the executors' disks until ``close``: a round brings the nodes to
    them and deals out what it weighs once, by ``node``."""

    def __init__(self, edges: DataFrame, cut: Cut, gamma: float = 1.0, least: float = 1e-9, names: DataFrame | None = None):
        w = F.coalesce(F.col("weight"), F.lit(1.0)).alias("w")
        apart = edges.filter("src != dst")
        self.cut, self.gamma, self.least, self.names = cut, gamma, least, names
        self.number = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        both = apart.select(F.col("src").alias("node"), F.col("dst").alias("other"), w).unionAll(apart.select(F.col("dst").alias("node"), F.col("src").alias("other"), w))
        sums = lambda: edges.agg(F.sum(w).alias("m"), F.sum(F.when(F.col("src") == F.col("dst"), w)).alias("loops"), F.count_if(F.col("src") != F.col("dst")).alias("apart")).first()
        self.degrees, total = together(lambda: cut(degrees(edges)), sums)
        self.m, self.loops, self.ends = total["m"] or 0.0, total["loops"] or 0.0, 2 * total["apart"]
        self.both = both.repartition(self.number, "other").sortWithinPartitions("other").persist(StorageLevel.DISK_ONLY)
        #: For each round how many nodes wanted to move and did; for moves one after
        #: another how many there were, in how many steps.
        self.told: list[tuple[int, int]] = []

    def close(self) -> None:
        self.both.unpersist()
        dropped(self.degrees)

    def counted(self, df: DataFrame) -> tuple[DataFrame, int]:
        """A table written, and how many rows it has."""
        seen = Observation()
        out = self.cut(df.observe(seen, F.count(F.lit(1)).alias("number")))
        return out, seen.get["number"] or 0

    def placed(self, nodes: DataFrame) -> DataFrame:
        """``(node, community, k, h)`` with the degree of the community, written."""
        return self.cut(nodes.join(nodes.groupBy("community").agg(F.sum("k").alias("tot")), "community").select("node", "community", "k", "h", "tot"))

    def totals(self, nodes: DataFrame) -> DataFrame:
        return nodes.groupBy("community").agg(F.first("tot").alias("tot"))

    def state(self, communities: DataFrame) -> tuple[DataFrame, DataFrame, float]:
        """Nodes with their community, its degree, theirs and a hash of their name,
        the degrees of communities, and modularity: one pass over all edges."""
        held = communities.select("node", "community").join(self.degrees, "node", "left")
        held = held.withColumn("name", F.col("node")) if self.names is None else held.join(self.names, "node")
        nodes = self.placed(held.select("node", "community", F.coalesce("k", F.lit(0.0)).alias("k"), F.xxhash64(F.col("name").cast("string")).alias("h")))
        totals = self.totals(nodes)
        if not self.m:
            return nodes, totals, 0.0
        a, b = nodes.select("node", F.col("community").alias("ca")), nodes.select(F.col("node").alias("other"), F.col("community").alias("cb"))
        inner, square = together(
            lambda: self.both.join(b, "other").join(a, "node").filter("ca = cb").agg(F.sum("w")).first()[0] or 0.0,
            lambda: totals.agg(F.sum(F.col("tot") ** 2)).first()[0] or 0.0,
        )
        return nodes, totals, (inner / 2 + self.loops) / self.m - self.gamma * square / (4 * self.m**2)

    def wanting(self, nodes: DataFrame, totals: DataFrame, seed: int, active: DataFrame | None = None) -> tuple[DataFrame | None, int]:
        """The nodes (of the ``active`` ones, where given) that want to move:
        ``node, to, from, rank, gain, k, into``, and how many; ``into`` is the weight
        of their edges to where they go, less that to where they are."""
        if not self.m:
            return None, 0
        # Degrees of communities come along with the nodes, so that edges aren't dealt out by community.
        both = self.both if active is None else self.both.join(active, "node", "left_semi")
        near = both.join(nodes.select(F.col("node").alias("other"), "community", "tot"), "other").select("node", "community", "tot", "w")
        kin = near.repartition(self.number, "node").groupBy("node", "community").agg(F.sum("w").alias("kin"), F.first("tot").alias("tot"))
        placed = nodes.select("node", F.col("community").alias("from"), "k", "h", (F.col("tot") - F.col("k")).alias("rest"))
        share = self.gamma / (2 * self.m**2)
        own = F.col("community") == F.col("from")
        options = kin.join(placed, "node").select(
            "node", "community", own.alias("own"), "from", "k", "h", "rest", "kin",
            (F.col("kin") / self.m - share * F.col("k") * F.when(own, F.col("rest")).otherwise(F.col("tot"))).alias("gain"),
        )
        best = options.groupBy("node").agg(
            F.max(F.when(~F.col("own"), F.struct("gain", "community", "kin"))).alias("best"), F.max(F.when(F.col("own"), F.col("kin"))).alias("kin"),
            F.first("from").alias("from"), F.first("k").alias("k"), F.first("h").alias("h"), F.coalesce(F.max(F.when(F.col("own"), F.col("gain"))), F.first(-share * F.col("k") * F.col("rest"))).alias("stay"),
        )
        better = best.filter((F.col("best.gain") > F.col("stay") + self.least) & (F.col("best.gain") > 0))
        rank = F.struct(F.xxhash64("h", F.lit(seed)).alias("r"), F.col("node"))
        into = F.col("best.kin") - F.coalesce("kin", F.lit(0.0))
        better, n = self.counted(better.select("node", F.col("best.community").alias("to"), "from", rank.alias("rank"), F.col("best.gain").alias("gain"), "k", into.alias("into")))
        return (better, n) if n else (None, 0)

    def woken(self, wanting: DataFrame, moved: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
        """What the next round weighs: neighbours of what has moved, and what
        wanted to and was put off. Given the ``nodes`` before, without neighbours
        that are where it went, which have one more reason to stay."""
        near = self.both.select("node", "other").join(moved.select(F.col("node").alias("other"), F.col("to").alias("community")), "other").select("node", "community")
        if nodes is not None:
            near = near.distinct().join(self.put(nodes, moved).select("node", "community"), ["node", "community"], "left_anti")
        near = near.select("node")
        return self.cut(near.unionAll(wanting.join(moved.select("node"), "node", "left_anti").select("node")).distinct())

    def moves(self, wanting: DataFrame, alone: bool) -> DataFrame:
        """Those that move in one round; ``alone``: their gains add up exactly."""
        mine = wanting.select("node", F.col("to").alias("mine_to"), F.col("from").alias("mine_from"))
        other = wanting.select(F.col("node").alias("other"), "to", "from", F.col("rank").alias("rival"))
        pairs = self.both.select("node", "other").join(other, "other").join(mine, "node")
        if not alone:
            pairs = pairs.filter("`from` = mine_to OR `to` = mine_from")
        rivals = pairs.groupBy("node").agg(F.max("rival").alias("rival"))
        moved = wanting.join(rivals, "node", "left").filter(F.col("rival").isNull() | (F.col("rank") > F.col("rival"))).select("node", "to", "from", "rank", "k", "into")
        return disjoint(moved) if alone else moved

    def change(self, totals: DataFrame, moved: DataFrame) -> float:
        """What moves change of modularity: what each was weighed with, put right
        for edges between two that move, and the communities they leave and enter."""
        a = moved.select("node", F.col("to").alias("ta"), F.col("from").alias("fa"))
        b = moved.select(F.col("node").alias("other"), F.col("to").alias("tb"), F.col("from").alias("fb"))
        same = lambda x, y: (F.col(x) == F.col(y)).cast("int")
        # Such an edge is there from both ends.
        inner = self.both.join(b, "other").join(a, "node").select((0.5 * F.col("w") * (same("ta", "tb") + same("fa", "fb") - same("ta", "fb") - same("tb", "fa"))).alias("x"))
        inner = inner.unionAll(moved.select("into")).agg(F.sum("x").alias("inner"))
        ends = moved.select(F.explode(F.array(F.struct(F.col("to").alias("community"), F.col("k").alias("d")), F.struct(F.col("from").alias("community"), (-F.col("k")).alias("d")))).alias("e"))
        deltas = ends.groupBy("e.community").agg(F.sum("e.d").alias("delta"))
        square = deltas.join(totals, "community", "left").agg(F.sum(2 * F.coalesce("tot", F.lit(0.0)) * F.col("delta") + F.col("delta") ** 2).alias("square"))
        row = inner.crossJoin(F.broadcast(square)).first()
        return (row["inner"] or 0.0) / self.m - self.gamma * (row["square"] or 0.0) / (4 * self.m**2)

    def put(self, nodes: DataFrame, moved: DataFrame) -> DataFrame:
        return nodes.join(moved.select("node", "to"), "node", "left").select("node", F.coalesce("to", "community").alias("community"), "k", "h")

    def after(self, nodes: DataFrame, moved: DataFrame) -> DataFrame:
        return self.placed(self.put(nodes, moved))

    def overlaid(self, nodes: DataFrame, moved: dict, totals: dict) -> DataFrame:
        """Nodes after moves that the driver holds, with the degrees of the
        communities that these have changed; few of both."""
        spark = nodes.sparkSession
        to = spark.createDataFrame(pa.table({"node": list(moved), "to": list(moved.values())}))
        by = spark.createDataFrame(pa.table({"community": list(totals), "now": list(totals.values())}))
        placed = nodes.join(F.broadcast(to), "node", "left").select("node", F.coalesce("to", "community").alias("community"), "k", "h", "tot")
        return self.cut(placed.join(F.broadcast(by), "community", "left").select("node", "community", "k", "h", F.coalesce("now", "tot").alias("tot")))

    def whole(self, number: int) -> bool:
        """Whether a graph of so many nodes is read once, as a frontier may be."""
        return self.ends <= FEW_EDGES and number <= 8 * FEW

    def frontier(self, nodes: DataFrame, wanting: DataFrame, whole: bool) -> tuple[dict, dict, float, list]:
        """Moves of few nodes one after another, then of their neighbours, and so
        on while there are few: ``{node: community}``, the degrees of communities
        that have changed, the gain in modularity, which is exact, and the nodes that
        are still awake. A step reads the edges of the active nodes that haven't been
        read; it ends where those are more than FEW nodes or all that was read is
        more than FEW_EDGES edges, for the rounds to go on. A ``whole`` graph is read
        once, and gone through until none wants to move."""
        spark, share = nodes.sparkSession, self.gamma / (2 * self.m**2)
        held: dict = {}
        tot: dict = {}
        delta: dict = {}
        gained, steps, read = 0.0, 0, 0
        first = wanting.select("node", "rank").toArrow().to_pylist()
        active = [r["node"] for r in sorted(first, key=lambda r: (r["rank"]["r"], r["rank"]["node"]), reverse=True)]
        kind = nodes.schema["node"].dataType
        near: dict = {}
        home: dict = {}
        while active:
            unread = [x for x in active if x not in home]
            if unread and len(unread) > FEW and not whole:
                break
            if unread:
                rows, own = self.both, nodes
                if not whole:
                    act = F.broadcast(spark.createDataFrame(pa.table({"node": unread})))
                    rows, own = rows.join(act, "node"), own.join(act, "node")
                rows = rows.join(nodes.select(F.col("node").alias("other"), "community", "tot"), "other").select("node", "other", "w", "community", "tot")
                own = own.select("node", F.lit(None).cast(kind).alias("other"), F.col("k").alias("w"), "community", "tot")
                found = rows.unionAll(own)
                found = (found if whole else found.limit(FEW_EDGES - read + 1)).toArrow()
                read += found.num_rows
                if read > FEW_EDGES and not whole:
                    break
                for node, other, w, c, t in zip(*(found.column(x).to_pylist() for x in ("node", "other", "w", "community", "tot"))):
                    tot.setdefault(c, t)
                    if other is None:
                        home[node] = (w, c)
                    else:
                        near.setdefault(node, []).append((other, w, c))
            woken: dict = {}
            for node in active:
                k, at = home[node]
                at = held.get(node, at)
                kin: dict = {}
                for other, w, c in near.get(node, ()):
                    c = held.get(other, c)
                    kin[c] = kin.get(c, 0.0) + w
                now = lambda c: tot[c] + delta.get(c, 0.0)
                stay = kin.get(at, 0.0) / self.m - share * k * (now(at) - k)
                options = [(w / self.m - share * k * now(c), c) for c, w in kin.items() if c != at]
                gain, to = max(options, default=(0.0, None))
                if to is None or gain <= max(stay + self.least, 0.0):
                    continue
                gained += gain - stay
                held[node] = to
                delta[at] = delta.get(at, 0.0) - k
                delta[to] = delta.get(to, 0.0) + k
                woken.update((other, None) for other, _, c in near[node] if held.get(other, c) != to)
            # All nodes of a whole graph are weighed before it ends.
            every = whole and not woken and len(active) < len(home)
            active, steps = list(home) if every else list(woken), steps + 1
        self.told.append((len(held), steps))
        return held, {c: tot[c] + d for c, d in delta.items()}, gained, active


#: Most nodes of a step and edges in all that the driver takes for moves one after
#: another, however large the graph.
FEW, FEW_EDGES = 8_192, 400_000
#: All nodes are weighed where more than one of so many has moved.
WAKES = 8


def settled(graph: Moving, communities: DataFrame, rounds: int, seed: int, alone: bool = False) -> tuple[DataFrame, float]:
    """Communities after moving nodes until none wants to. A round weighs all
    nodes or, after few moves, those that these have woken; once few want to move,
    those move one after another, then the neighbours that they have woken. All
    are weighed before it ends."""
    nodes, totals, q = graph.state(communities)
    number = nodes.count()
    active = None
    for r in range(rounds):
        wanting, want = graph.wanting(nodes, totals, seed + r, active)
        if wanting is None and active is None:
            return nodes.select("node", "community"), q
        if active is not None:
            dropped(active)
        every, active = active is None, None
        if wanting is None:
            continue
        before = nodes, wanting
        whole = graph.whole(number)
        if (want <= FEW or whole) and not alone:
            held, now, gained, awake = graph.frontier(nodes, wanting, whole)
            if gained > graph.least:
                nodes = graph.overlaid(nodes, held, now)
                totals = graph.totals(nodes)
                q += gained
                dropped(*before)
                if awake:
                    active = nodes.sparkSession.createDataFrame(pa.table({"node": awake}))
                continue
        for way in (True,) if alone else (False, True):
            moved, count_ = graph.counted(graph.moves(wanting, way))
            if not count_:
                dropped(moved)
                continue
            # Nearly always modularity is raised, so what comes next is worked out meanwhile.
            few = WAKES * count_ <= number
            change, next_, woken = together(lambda: graph.change(totals, moved), lambda: graph.after(nodes, moved), lambda: graph.woken(wanting, moved, nodes) if few else None)
            if change > graph.least:
                break
            dropped(moved, next_, *([woken] if few else []))
        else:
            if not every:
                dropped(wanting)
                continue
            # The gains add up here, so what is left is within rounding.
            return nodes.select("node", "community"), q
        graph.told.append((want, count_))
        nodes, totals, active = next_, graph.totals(next_), woken
        q += change
        dropped(*before, moved)
    raise RuntimeError(f"local moving did not settle in {rounds} rounds")


def local_moving(edges: DataFrame, communities: DataFrame, cut: Cut, rounds: int = 10_000, gamma: float = 1.0, seed: int = 123456, least: float = 1e-9) -> tuple[DataFrame, float]:
    """Communities after moving nodes until none wants to, and their modularity;
    ``rounds`` only guards against going on forever."""
    graph = Moving(edges, cut, gamma, least)
    found = settled(graph, communities, rounds, seed)
    graph.close()
    return found


def disjoint(moved: DataFrame) -> DataFrame:
    """Of moves that leave or enter one community, only that of highest rank: the
    gains of what stays add up exactly."""
    ends = moved.select("rank", F.explode(F.array("from", "to")).alias("end"))
    tops = ends.groupBy("end").agg(F.max("rank").alias("top"))
    at = lambda end: tops.select(F.col("end").alias(end), F.col("top").alias("top_" + end))
    return moved.join(at("from"), "from").join(at("to"), "to").filter((F.col("rank") == F.col("top_from")) & (F.col("rank") == F.col("top_to")))


def split_communities(edges: DataFrame, communities: DataFrame, cut: Cut) -> DataFrame:
    """Each community's connected parts as communities of their own, named by
    their smallest node; no edge inside a community is cut."""
    a, b = communities.select(F.col("node").alias("src"), F.col("community").alias("ca")), communities.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    inside = edges.join(a, "src").join(b, "dst").filter("ca = cb").select("src", "dst")
    return connected_components(inside, cut, nodes=communities.select("node")).select("node", F.col("component").alias("community"))


def refine_candidates(edges: DataFrame, communities: DataFrame, cut: Cut, gamma: float = 1.0, least: float = 1e-9) -> DataFrame:
    """``(node, community, own, gain, connected)``: the communities next to each
    node, other than its own, that it would gain by joining, and whether they
    would be connected with it: it has an edge into them, so whether they are by
    themselves."""
    parts = split_communities(edges, communities, cut).select("node", F.col("community").alias("part"))
    whole = communities.join(parts, "node").groupBy("community").agg((F.min("part") == F.max("part")).alias("connected"))
    options = gains(edges, communities, gamma).filter((F.col("community") != F.col("own")) & (F.col("gain") > least))
    near = edges.filter("src != dst").select(F.col("src").alias("node"), F.col("dst").alias("other"))
    near = near.union(near.select("other", "node")).join(communities.select(F.col("node").alias("other"), "community"), "other").select("node", "community").distinct()
    return options.join(near, ["node", "community"], "left_semi").join(whole, "community").select("node", "community", "own", "gain", "connected")


def refined(edges: DataFrame, communities: DataFrame, cut: Cut, graph: Moving | None = None, rounds: int = 10_000, seed: int = 123456) -> DataFrame:
    """Communities split into their connected parts, then nodes moved to
    communities next to them where that raises modularity, all of them
    connected in the end."""
    parts = split_communities(edges, communities, cut)
    number = lambda found: found.agg(F.countDistinct("community")).first()[0]
    before, after = together(lambda: number(communities), lambda: number(parts))
    if after == before:
        # Nothing was split, so what no node wanted to leave before it doesn't now.
        return parts
    mine = graph or Moving(edges, cut)
    moved, _ = settled(mine, parts, rounds, seed, alone=True)
    if graph is None:
        mine.close()
    return split_communities(edges, moved, cut)


def detect(nodes: DataFrame, edges: DataFrame, cut: Cut, levels: int | None = None, refine: bool = True, use_lcc: bool = True, gamma: float = 1.0, seed: int = 123456, rounds: int = 10_000) -> DataFrame:
    """``(level, node, community, leaf)``: at level 0 nodes are the graph's own,
    above they are the communities below; ``leaf`` is the graph's own node.

    Nodes outside the largest component get no row where ``use_lcc``; an empty
    graph gives none at all.
    """
    nodes = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    names, nodes, edges = numbered(nodes, edges, cut)
    if use_lcc:
        nodes, edges = largest_component(nodes, edges, cut)
    nodes, edges = cut(nodes), cut(edges)
    leaves = nodes.select("node", F.col("node").alias("leaf"))
    out = None
    for level in range(levels) if levels is not None else count():
        start = nodes.select("node", F.col("node").alias("community"))
        graph = Moving(edges, cut, gamma, names=names)
        found, _ = settled(graph, start, rounds, seed + level)
        if refine:
            found = refined(edges, found, cut, graph, rounds, seed + level)
        graph.close()
        rows = cut(leaves.join(found, "node").select(F.lit(level).alias("level"), "node", "community", "leaf"))
        out = rows if out is None else out.unionByName(rows)
        if level + 1 == levels:
            break
        above, merged = aggregated(edges, found)
        above, before = together(lambda: graph.counted(above.select("node")), nodes.count)
        if above[1] <= 1 or above[1] == before:
            break
        leaves, nodes, edges = rows.select(F.col("community").alias("node"), "leaf"), above[0], cut(merged)
    for c in ("node", "community", "leaf"):
        out = out.join(names.select(F.col("node").alias(c), "name"), c).drop(c).withColumnRenamed("name", c)
    return cut(out.select("level", "node", "community", "leaf"))


def numbered(nodes: DataFrame, edges: DataFrame, cut: Cut) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(node, name)`` with numbers that go up with the names, and nodes and
    edges by number, these with one row per pair."""
    every = nodes.select(F.col("node").alias("name")).union(edges.select("src")).union(edges.select("dst")).filter("name is not null").distinct()
    names = cut(every.repartitionByRange("name").sortWithinPartitions("name").select(F.monotonically_increasing_id().alias("node"), "name"))
    at = lambda c: names.select(F.col("name").alias(c), F.col("node").alias("n_" + c))
    ends = edges.join(at("src"), "src", "left").join(at("dst"), "dst", "left").select(F.col("n_src").alias("src"), F.col("n_dst").alias("dst"), "weight")
    return names, cut(nodes.join(names.withColumnRenamed("node", "n"), F.col("name") == nodes["node"]).select(F.col("n").alias("node"))), cut(undirected(ends))


def leiden(nodes: DataFrame, edges: DataFrame, cut: Cut, **options) -> DataFrame:
    return detect(nodes, edges, cut, **({"refine": True, "use_lcc": True} | options))


def louvain(nodes: DataFrame, edges: DataFrame, cut: Cut, **options) -> DataFrame:
    """Without refinement, over the whole graph, one set of communities."""
    found = detect(nodes, edges, cut, **({"refine": False, "use_lcc": False} | options))
    top = Window.partitionBy("leaf").orderBy(F.desc("level"))
    return found.withColumn("n", F.row_number().over(top)).filter("n = 1").select(F.col("leaf").alias("node"), "community")


def community_weights(members: DataFrame, rank: str = "rank", weight: str = "weight") -> DataFrame:
    """``(level, community, weight)``: the sum of rank times weight, over the
    level's largest where that is positive. A missing rank is 0, weight 1."""
    sums = members.groupBy("level", "community").agg(F.sum(F.coalesce(rank, F.lit(0.0)) * F.coalesce(weight, F.lit(1.0))).alias("s"))
    most = sums.groupBy("level").agg(F.max("s").alias("most"))
    return sums.join(most, "level").select("level", "community", F.when(F.col("most") > 0, F.col("s") / F.col("most")).otherwise(F.col("s")).alias("weight"))


def top_members(members: DataFrame, most: int = 12, rank: str = "pagerank") -> DataFrame:
    """Of each community the ``most`` members of highest rank, with their place
    ``i`` from 0."""
    order = Window.partitionBy("community").orderBy(F.desc(F.coalesce(rank, F.lit(0.0))), "node")
    # The limit is on the row number itself: Spark then cuts before the shuffle too.
    return members.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= most).withColumn("i", F.col("i") - 1)


def community_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends in one community, with that community."""
    a, b = members.select(F.col("node").alias("src"), "community"), members.select(F.col("node").alias("dst"), "community")
    return edges.join(a, "src").join(b, ["dst", "community"])


def annotated(nodes: DataFrame, communities: DataFrame, labels: str = "communities") -> DataFrame:
    """Nodes with ``leiden_community_<id>`` among their labels."""
    name = F.concat(F.lit("leiden_community_"), F.col("community").cast("string"))
    mine = communities.groupBy("node").agg(F.array_sort(F.collect_set(name)).alias("__new"))
    old = F.coalesce(F.col(labels), F.array().cast("array<string>")) if labels in nodes.columns else F.array().cast("array<string>")
    return nodes.join(mine, "node", "left").withColumn(labels, F.array_union(old, F.coalesce("__new", F.array().cast("array<string>")))).drop("__new")
