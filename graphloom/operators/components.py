"""Connected components of an undirected graph by contraction.

Every node points to the smallest of its neighbours and itself; pointers are
followed by doubling until they end at nodes that point to themselves. Those are
the nodes of the next graph, its edges those between different ones. So edges are
gone through once for a graph that has at most half as many nodes every second
time, not once for each round that labels take to pass. Labels are node values,
and a component's smallest node points to itself throughout, so it is its label.
What is carried on is handed to ``cut``, which must write it, to reliable storage:
lineage stays short and a lost executor costs one round at most. Hubs don't gather
in one task: messages are reduced by ``min`` before the shuffle, and the joins can
be split where a key is hot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.sources.shared import dropped


def connected_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame], src: str = "src", dst: str = "dst", nodes: DataFrame | None = None, rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (and of ``nodes``, whose
    first column is taken). Edges with a null end are ignored, self-loops and
    repeated edges change nothing; no edges give an empty result (or single
    nodes)."""
    ends = edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    pairs, left = _counted(ends.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).distinct(), F.count(F.lit(1)), cut)
    levels: list[DataFrame] = []
    while left:
        if len(levels) == rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        both = pairs.unionAll(pairs.select("b", "a"))
        roots = _followed(cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component"))), cut, rounds)
        levels.append(roots)
        at = lambda end: roots.select(F.col("node").alias(end), F.col("component").alias("c" + end))
        apart = pairs.join(at("a"), "a").join(at("b"), "b").filter("ca != cb")
        before = pairs
        pairs, left = _counted(apart.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), F.count(F.lit(1)), cut)
        dropped(before)
    dropped(pairs)
    # A node's label is its root's in the next graph, if that has an edge there.
    labels = levels[-1] if levels else None
    for roots in reversed(levels[:-1]):
        next_ = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        before, labels = labels, cut(roots.join(next_, "component", "left").select("node", F.coalesce("next", "component").alias("component")))
        dropped(before, roots)
    if nodes is None:
        return labels if labels is not None else cut(pairs.select(F.col("a").alias("node"), F.col("b").alias("component")))
    alone = nodes.select(F.col(nodes.columns[0]).alias("node")).filter("node is not null").distinct()
    if labels is None:
        return cut(alone.select("node", F.col("node").alias("component")))
    found = cut(alone.join(labels, "node", "full_outer").select("node", F.coalesce("component", "node").alias("component")))
    dropped(labels)
    return found


def _counted(df: DataFrame, number: Column, cut: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """A table written, and what is counted on the way."""
    seen = Observation()
    out = cut(df.observe(seen, number.alias("number")))
    return out, seen.get["number"] or 0


def _followed(pointers: DataFrame, cut: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    """Pointers ``(node, component)`` followed to nodes that point to themselves,
    by taking the pointer of what is pointed to until none changes."""
    for _ in range(rounds):
        further = pointers.filter("node != component").select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = pointers.join(further, "component", "left").select("node", F.coalesce("next", "component").alias("component"), F.col("next").isNotNull().alias("moved"))
        before = pointers
        pointers, moved = _counted(jumped, F.count_if("moved"), cut)
        pointers = _plain(pointers)
        dropped(before)
        if not moved:
            return pointers
    raise RuntimeError(f"pointers did not end in {rounds} rounds")


def _plain(pointers: DataFrame) -> DataFrame:
    """Without the mark of what has moved, and removed like the table it is of."""
    out = pointers.select("node", "component")
    if path := getattr(pointers, "_written_to", None):
        out._written_to = path
    return out


def extended_components(labels: DataFrame, pairs: DataFrame, cut: Callable[[DataFrame], DataFrame], a: str = "a", b: str = "b") -> tuple[DataFrame, DataFrame]:
    """``labels`` ``(node, component)``, as ``connected_components`` gives them,
    after further pairs; and the components that are new or have grown,
    ``(component)``.

    Only the graph of labels that the pairs join is solved, which is no larger
    than the pairs; other labels are passed through. A label is its component's
    smallest node, and so is the smallest of joined labels."""
    ends = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    known = labels.select("node", "component")
    at = lambda end: known.select(F.col("node").alias(end), F.col("component").alias("c" + end))
    joined = cut(ends.join(at("a"), "a", "left").join(at("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("src"), F.coalesce("cb", "b").alias("dst")))
    moved = cut(connected_components(joined.filter("src != dst"), cut).select(F.col("node").alias("old"), "component"))
    named = joined.select(F.col("a").alias("node"), F.col("src").alias("old")).union(joined.select("b", "dst")).distinct()
    fresh = named.join(known.select("node"), "node", "left_anti")
    every = known.select("node", F.col("component").alias("old")).unionByName(fresh)
    out = cut(every.join(moved, "old", "left").select("node", F.coalesce("component", "old").alias("component")))
    touched = cut(moved.select("component").union(fresh.join(moved, "old", "left").select(F.coalesce("component", "old"))).distinct())
    dropped(joined, moved)
    return out, touched
