"""Contexts for reports, insights and projections for viewers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators.extract import numbered, ranked
from graphloom.operators.graph import Cut, degrees
from graphloom.sources.store import linked_edges

#: Colours of nodes by entity type.
COLOURS = {
    "PERSON": "#FF6B6B",
    "LOCATION": "#4ECDC4",
    "ORGANIZATION": "#45B7D1",
    "EVENT": "#96CEB4",
    "CONCEPT": "#FECA57",
    "OTHER": "#DDA0DD",
}


def _lines(rows: DataFrame, header: str, line, out: str) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.groupBy("community").agg(F.concat(F.lit(header + "\n"), joined).alias(out))


def report_context(members: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """``(community, entities, relationships)`` as CSV text. ``members`` have
    ``community, node, description, i``; ``edges`` lie inside communities. The
    first ``most`` members of each community and the edges among them are told
    of, so that no list grows with the graph."""
    members = members.filter(F.col("i") < most)
    for end in ("src", "dst"):
        edges = edges.join(members.select("community", F.col("node").alias(end)), ["community", end], "left_semi")
    quoted = lambda c: F.concat(F.lit('"'), T.csv_escaped(c), F.lit('"'))
    entities = _lines(members, "id,entity,description", F.concat_ws(",", F.col("i").cast("string"), T.csv_escaped("node"), quoted("description")), "entities")
    numbered = ranked(edges, ["src", "dst"], ["community"])
    links = _lines(numbered, "id,source,target,description", F.concat_ws(",", F.col("i").cast("string"), "src", "dst", quoted("description")), "relationships")
    return entities.join(links, "community", "left").select("community", "entities", F.coalesce("relationships", F.lit("id,source,target,description")).alias("relationships"))


def type_histogram(nodes: DataFrame, missing: str | None = None) -> DataFrame:
    kind = F.coalesce("entity_type", F.lit(missing)) if missing else F.col("entity_type")
    return nodes.groupBy(kind.alias("entity_type")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity_type")


def edge_insights(edges: DataFrame) -> DataFrame:
    """Number, largest and mean weight (two places); weight 0 or none is 1."""
    w = F.coalesce(F.nullif("weight", F.lit(0.0)), F.lit(1.0))
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.max(w).alias("max_weight"), F.round(F.avg(w), 2).alias("mean_weight"))


def verified(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts, and whether there are both nodes and edges."""
    counts = nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))
    return counts.withColumn("ok", (F.col("nodes") > 0) & (F.col("edges") > 0))


def viz_nodes(nodes: DataFrame) -> DataFrame:
    kind = F.coalesce("entity_type", F.lit("OTHER"))
    colour = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in COLOURS.items() for x in kv)), kind), F.lit(COLOURS["OTHER"]))
    return nodes.select("id", F.col("id").alias("label"), F.coalesce("description", F.lit("")).alias("title"), kind.alias("group"), colour.alias("color"))


def viz_edges(edges: DataFrame) -> DataFrame:
    w = F.coalesce(F.nullif("weight", F.lit(0.0)), F.lit(1.0))
    return edges.select(
        F.concat_ws("|", "source", "target").alias("id"), F.col("source").alias("from"), F.col("target").alias("to"), F.coalesce("description", F.lit("")).alias("title"),
        F.lit("").alias("label"), F.greatest(F.lit(1.0), F.least(F.lit(5.0), w * 2)).alias("width"),
    )


def mention_ids(entities: DataFrame, order: list, cut: Cut) -> DataFrame:
    """Entities of a list with ``entity_<i>`` for those without a name."""
    return numbered(entities, order, [], cut).withColumn("entity_name", F.coalesce(F.nullif("entity_name", F.lit("")), F.concat(F.lit("entity_"), F.col("i").cast("string"))))


def relation_ends(relations: DataFrame, order: list, cut: Cut) -> DataFrame:
    """Relationships of a list with ``src_<i>`` and ``tgt_<i>`` for ends without
    a name."""
    named = lambda c, p: F.coalesce(F.nullif(c, F.lit("")), F.concat(F.lit(p), F.col("i").cast("string")))
    return numbered(relations, order, [], cut).withColumns({"src_id": named("src_id", "src_"), "tgt_id": named("tgt_id", "tgt_")})


def plain_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes for the plain viewer: no colours, ``unknown`` where a type is missing."""
    kind = F.coalesce(F.nullif("entity_type", F.lit("")), F.lit("unknown"))
    return nodes.select("id", F.col("id").alias("label"), F.coalesce("description", F.lit("")).alias("title"), kind.alias("group"))


def plain_edges(edges: DataFrame) -> DataFrame:
    """Edges for the plain viewer; weight 0 or none is 1."""
    return edges.select(F.col("source").alias("from"), F.col("target").alias("to"), F.coalesce(F.nullif("weight", F.lit(0.0)), F.lit(1.0)).alias("weight"), F.coalesce("description", F.lit("")).alias("title"))


def central(nodes: DataFrame, edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The ``most`` nodes of highest total weight and the edges among them."""
    ends = degrees(edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), "weight"))
    first = nodes.join(ends.withColumnRenamed("node", "id"), "id", "left").orderBy(F.desc(F.coalesce("k", F.lit(0.0))), "id").limit(most).drop("k")
    return first, linked_edges(edges, first)


def page(nodes: DataFrame, edges: DataFrame, template: str, mark: str = "//__DATA__HERE__", most: int | None = None) -> str:
    """A viewer's page with nodes and edges as JSON in place of the mark. The
    driver builds it, so a large graph is shown by its ``most`` central nodes."""
    if most is not None:
        nodes, edges = central(nodes, edges, most)
    rows = lambda df: "[" + ",".join(r[0] for r in df.select(F.to_json(F.struct("*"))).toLocalIterator()) + "]"
    return template.replace(mark, f"const graph = {{nodes: {rows(viz_nodes(nodes))}, edges: {rows(viz_edges(edges))}}};")
