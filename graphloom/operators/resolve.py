"""Entity resolution: pairs of similar names, decisions, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators.components import connected_components
from graphloom.operators.extract import numbered
from graphloom.operators.graph import Cut
from graphloom.sources.shared import written


#: Names of up to so many characters meet by segments; each has a number of keys
#: that grows with the cube of its length.
SEGMENTED = 32


def described(nodes: DataFrame, name: str = "id", kind: str = "entity_type") -> DataFrame:
    """Each type's distinct names with what signatures and cheap tests read:
    ``entity_type, n, low, length, size, mask, bag_a, bag_b, plain`` and the
    name's characters, those first that the fewest names have (``rare``)."""
    rows = nodes.select(F.coalesce(kind, F.lit("-")).alias("entity_type"), F.col(name).alias("n")).filter("n is not null").distinct()
    bag_a, bag_b = T.bag_masks("n")
    told = rows.withColumns({
        "low": F.lower("n"), "length": F.length("n").cast("long"), "chars": T.characters("n"), "mask": T.character_mask("n"), "bag_a": bag_a, "bag_b": bag_b,
    }).withColumns({"size": F.size("chars").cast("long"), "plain": (F.length("low") == F.col("length")) & F.col("length").between(1, SEGMENTED)})
    apart = told.select("entity_type", "n", F.explode("chars").alias("c"))
    common = apart.groupBy("c").agg(F.count(F.lit(1)).alias("often"))
    # As many rows for a name as it has characters.
    rare = apart.join(common, "c").groupBy("entity_type", "n").agg(F.array_sort(F.collect_list(F.struct("often", "c"))).alias("rare"))
    return told.drop("chars").join(rare, ["entity_type", "n"], "left").withColumn("rare", F.transform("rare", lambda x: x["c"]))


def edit_keys(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys of which two names with few edits share one: of the shorter name,
    cut into one segment more than edits are allowed, and of the longer one, its
    substrings at each place where such a segment can stand uncut."""
    text = lambda at, long: F.substring("low", at + 1, long)
    key = lambda la, i, seg: F.xxhash64("entity_type", la, i, seg)
    # A single character, then pairs; an even length leaves one more single.
    start = lambda i: F.greatest(2 * i - 1, F.lit(0))
    long = lambda i: F.when(i == 0, 1).otherwise(2)
    plain = rows.filter("plain").withColumn("l", F.col("length").cast("int"))
    half = lambda la: F.floor(la / 2).cast("int")
    cut = F.transform(F.sequence(F.lit(0), half(F.col("l"))), lambda i: key(F.col("l"), i, text(start(i), long(i))))
    held = plain.withColumn("key", F.explode(cut))
    probe = plain.withColumn("la", F.explode(F.sequence(F.ceil(2 * F.col("l") / 3).cast("int"), F.col("l"))))
    probe = probe.withColumn("i", F.explode(F.sequence(F.lit(0), half(F.col("la")))))
    i, la, lb, k, p = F.col("i"), F.col("la"), F.col("l"), half(F.col("la")), start(F.col("i"))
    size = F.least(long(i), la - p)
    low, high = F.greatest(F.lit(0), p - i, p + lb - la - (k - i)), F.least(lb - size, p + i, p + lb - la + (k - i))
    places = F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda q: key(la, i, text(q, size))))
    probe = probe.withColumn("key", F.explode(F.array_distinct(places)))
    return held.drop("l"), probe.drop("l", "la", "i")


def character_keys(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys of which two names with about the same characters share one: two of
    their rarest characters, by the number of characters."""
    least = F.when(F.col("length") < 4, 0.6).otherwise(0.8)
    shared = F.ceil(least * F.col("size") - 1e-9)
    some = rows.filter("size > 0").withColumn("first", F.slice("rare", F.lit(1), (F.col("size") - shared + F.when(F.col("size") > 1, 2).otherwise(1)).cast("int")))
    two = F.flatten(F.transform("first", lambda x, i: F.transform(F.slice("first", i + 2, F.size("first")), lambda y: F.concat(x, y))))
    signed = some.withColumn("sign", F.explode(F.when(F.col("size") > 1, two).otherwise(F.col("first")))).drop("first")
    key = lambda size: F.xxhash64("entity_type", size.cast("long"), "sign")
    held = signed.withColumn("key", key(F.col("size")))
    sizes = F.sequence(F.ceil(least * F.col("size") - 1e-9), F.floor(F.col("size") / least + 1e-9))
    probe = signed.withColumn("s", F.explode(F.when(F.col("size") > 1, sizes).otherwise(F.array(F.lit(1).cast("long"))))).withColumn("key", key(F.col("s")))
    return held.drop("sign"), probe.drop("sign", "s")


_TOLD = ("length", "size", "mask", "bag_a", "bag_b")


def _met(held: DataFrame, probe: DataFrame, key: list[str], often: int) -> DataFrame:
    """Both sides joined on their key, as ``a_*`` and ``b_*``. What more than
    ``often`` names hold is cut into blocks, each of which meets all that ask."""
    cut = held.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / often).cast("int").alias("blocks")).filter("blocks > 1")
    side = lambda df, at: df.select(*key, F.col("entity_type").alias("type" if at == "a" else "b_type"), F.col("n").alias(at), *(F.col(c).alias(f"{at}_{c}") for c in _TOLD), "block")
    blocks = F.coalesce("blocks", F.lit(1))
    a = side(held.join(cut, key, "left").withColumn("block", F.pmod(F.xxhash64("n"), blocks).cast("int")), "a")
    b = side(probe.join(cut, key, "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))), "b")
    return a.join(b, [*key, "block"]).filter(F.col("type") == F.col("b_type"))


def similar_candidates(rows: DataFrame, often: int = 2000) -> DataFrame:
    """``(entity_type, a, b)``, a pair in either order and maybe more than once:
    all pairs that may be similar, found by shared keys and then tested by
    lengths and by characters as bits. Names too long for segments, or that
    change their length in lower case, meet all names of fitting length."""
    a, b = ({k: F.col(f"{at}_{k}") for k in _TOLD} for at in "ab")
    some = lambda met, test: met.filter((F.col("a") != F.col("b")) & test).select(F.col("type").alias("entity_type"), "a", "b")
    by_edits = some(_met(*edit_keys(rows), ["key"], often), T.may_have_few_edits(a, b))
    by_characters = some(_met(*character_keys(rows), ["key"], often), T.may_share_characters(a, b))
    kind = F.xxhash64("entity_type")
    others = some(_met(rows.withColumn("key", kind), rows.filter("not plain").withColumn("key", kind), ["key"], often), T.may_be_similar(a, b))
    return by_edits.unionByName(by_characters).unionByName(others)


def similar_pairs(nodes: DataFrame, name: str = "id", kind: str = "entity_type", often: int = 2000) -> DataFrame:
    """``(entity_type, a, b)`` with a < b: pairs of one type that may be the
    same. Names meet by signatures that similar names have to share, so not
    every pair of a type is made; few are left for the predicate after cheap
    tests. A missing type is ``-``."""
    # A name is described once, and read by each kind of key.
    found = similar_candidates(written(described(nodes, name, kind), "names"), often)
    pairs = found.select("entity_type", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.filter(T.similar_names("a", "b"))


def pair_batches(pairs: DataFrame, cut: Cut, size: int = 50) -> DataFrame:
    """Pairs with their ``batch`` within the type and ``i`` in the batch (from
    1), as they are put to a model. One type may have most of the pairs."""
    rows = numbered(pairs, ["a", "b"], ["entity_type"], cut)
    return rows.withColumn("batch", F.floor(F.col("i") / size).cast("int")).withColumn("i", (F.col("i") % size + 1).cast("int"))


def agreed(batches: DataFrame, replies: DataFrame) -> DataFrame:
    """The pairs that replies ``(entity_type, batch, response)`` say yes to."""
    sizes = batches.groupBy("entity_type", "batch").agg(F.max("i").alias("n"))
    yes = replies.join(sizes, ["entity_type", "batch"]).select("entity_type", "batch", F.explode(F.array_distinct(T.decisions("response", F.col("n")))).alias("i"))
    return batches.join(yes, ["entity_type", "batch", "i"]).select("entity_type", "a", "b")


def canonical(pairs: DataFrame, cut: Cut) -> DataFrame:
    """``(member, target)``: each name of a merged group and the group's first."""
    return connected_components(pairs, cut, "a", "b").select(F.col("node").alias("member"), F.col("component").alias("target"))


def merged_graph(nodes: DataFrame, edges: DataFrame, names: DataFrame, add_weights: bool = False, keep_loops: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after merging. A group keeps its target's type; its
    descriptions are joined and sources united, the target's first, then in order
    of name. Edges move to targets; where two meet, that of the target's own
    stays, then the first by name (or weights are added)."""
    to = names.select(F.col("member").alias("id"), "target")
    placed = nodes.join(to, "id", "left").withColumn("target", F.coalesce("target", "id"))
    order = F.struct((F.col("id") != F.col("target")).alias("second"), F.col("id").alias("id"))
    merged = placed.groupBy("target").agg(
        F.max(F.when(F.col("id") == F.col("target"), F.col("entity_type"))).alias("entity_type"),
        F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce("description", F.lit("")).alias("d"), "source_ids"))).alias("all"),
    )
    out_nodes = merged.select(
        F.col("target").alias("id"), "entity_type",
        F.array_join(F.transform("all", lambda x: x["d"]), T.JOIN).alias("description"),
        F.array_distinct(F.flatten(F.transform("all", lambda x: F.coalesce(x["source_ids"], F.array().cast("array<string>"))))).alias("source_ids"),
    )
    a, b = names.select(F.col("member").alias("source"), F.col("target").alias("ta")), names.select(F.col("member").alias("target"), F.col("target").alias("tb"))
    moved = edges.join(a, "source", "left").join(b, "target", "left").withColumn("s", F.coalesce("ta", "source")).withColumn("t", F.coalesce("tb", "target"))
    rank = F.struct(((F.col("source") != F.col("s")) | (F.col("target") != F.col("t"))).alias("moved"), F.col("source").alias("source"), F.col("target").alias("target"))
    kept = moved.groupBy(F.least("s", "t").alias("x"), F.greatest("s", "t").alias("y")).agg(
        F.min_by(F.struct("description", "weight", "keywords", "source_ids"), rank).alias("e"), F.sum("weight").alias("total")
    )
    out_edges = kept.select(F.col("x").alias("source"), F.col("y").alias("target"), "e.description", (F.col("total") if add_weights else F.col("e.weight")).alias("weight"), "e.keywords", "e.source_ids")
    return out_nodes, out_edges if keep_loops else out_edges.filter("source != target")


def remerged(nodes: DataFrame, edges: DataFrame, names: DataFrame, touched: DataFrame, add_weights: bool = False, keep_loops: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a resolved graph changes when some groups have: its nodes and edges of
    the ``touched`` groups ``(target)``, merged from the graph as it was extracted
    by all ``names`` ``(member, target)``; and the names ``(id)`` whose nodes and
    edges they stand for, to be taken out first. Other groups aren't read."""
    members = names.join(touched, "target", "left_semi").select(F.col("member").alias("id"))
    merged, _ = merged_graph(nodes.join(members, "id", "left_semi"), edges.limit(0), names)
    near = edges.join(members.select(F.col("id").alias("source")), "source", "left_semi").select(*edges.columns)
    near = near.union(edges.join(members.select(F.col("id").alias("target")), "target", "left_semi").select(*edges.columns)).dropDuplicates(["source", "target"])
    _, moved = merged_graph(nodes.limit(0), near, names, add_weights, keep_loops)
    return merged, moved, members


def replaced(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A resolved graph with what ``remerged`` found in place of what it was."""
    out = gone.select("id")
    kept = edges.join(out.withColumnRenamed("id", "source"), "source", "left_anti").join(out.withColumnRenamed("id", "target"), "target", "left_anti")
    return nodes.join(out, "id", "left_anti").select(*new_nodes.columns).unionByName(new_nodes), kept.select(*new_edges.columns).unionByName(new_edges)
