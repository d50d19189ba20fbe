"""From texts to a graph, and from a question to an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import extract, report, search
from graphloom.operators.graph import Cut
from graphloom.plans.chat_model import Provider
from graphloom.sources.search_index import SearchIndex
from graphloom.sources.store import linked_edges

EMPTY_GRAPH = "The graph is empty."
NOTHING_FOUND = "Nothing in the graph matches the question."

ANSWER_PROMPT = """Answer the question from the context only. End with a JSON list of the entities you used.

Context:
{context}

Question: {question}
"""


def build_graph(replies: DataFrame, types: tuple[str, ...] = extract.TYPES, cut: Cut | None = None) -> tuple[DataFrame, DataFrame]:
    """Replies ``(doc_id, chunk_seq, response)`` to nodes and edges; edges
    without both ends are left out. ``cut`` writes the parsed records, which
    merging reads several times."""
    rows = extract.record_rows(replies).drop("record")
    if cut:
        rows = cut(rows)
    mentions = extract.entity_mentions(rows, types)
    # Nodes are the names that are mentioned: edges needn't wait for all the rest of them.
    names = mentions.select(F.col("entity_name").alias("id")).distinct()
    return extract.merged_nodes(mentions), linked_edges(extract.merged_edges(extract.relation_mentions(rows)), names)


def context_lines(hits: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(type, id, line)``: hits with what is known of them, for a prompt."""
    known = nodes.select(F.lit("node").alias("type"), "id", "entity_type", "description").unionByName(
        edges.select(F.lit("edge").alias("type"), F.concat_ws("|", *(F.replace(c, F.lit("|"), F.lit("\\|")) for c in ("source", "target"))).alias("id"), F.lit(None).cast("string").alias("entity_type"), "description")
    )
    percent = F.format_string("%.1f%%", F.col("total_score") * 100)
    methods = F.array_join("methods", "+") if dict(hits.dtypes).get("methods", "").startswith("array") else F.col("method")
    line = F.concat_ws(" ", F.concat(F.lit("["), F.col("type"), F.lit("]")), F.col("id"), F.concat(F.lit("("), F.coalesce("entity_type", F.lit("-")), F.lit(")")), F.coalesce("description", F.lit("")), F.concat(F.lit("score "), percent, F.lit(" by "), methods))
    return hits.join(known, ["type", "id"], "left").select("type", "id", "total_score", line.alias("line"))


def answer(question: str, nodes: DataFrame, edges: DataFrame, provider: Provider, sequential: bool = False, most: int = 20, idx: DataFrame | None = None, **options) -> dict:
    """``{answer, context, entities}``. The driver sees at most ``most`` hits.
    ``idx`` is a stored index of these nodes and edges, as ``search.write_index``
    makes it or a ``SearchIndex``, which reads no texts but those of hits; other
    options are the search's: ``threshold``, ``use_bigram``,
    ``use_keywords``, ``use_fuzzy``."""
    if nodes.isEmpty():
        raise ValueError(EMPTY_GRAPH)
    if isinstance(idx, SearchIndex):
        hits = (idx.sequential if sequential else idx.search)(question, most, **options)
    else:
        hits = (search.sequential_search if sequential else search.combined_search)(search.items(nodes, edges), question, most, idx=idx, **options)
    lines = list(dict.fromkeys(r["line"] for r in context_lines(hits, nodes, edges).orderBy(F.desc("total_score"), "type", "id").collect()))
    if not lines:
        return {"answer": NOTHING_FOUND, "context": "", "entities": []}
    context = "\n".join(lines)
    reply = provider.chat(ANSWER_PROMPT.format(context=context, question=question))
    row = nodes.sparkSession.createDataFrame([(reply,)], "r string").select(T.answer_text("r").alias("a"), T.answer_entities("r").alias("e")).first()
    return {"answer": row["a"], "context": context, "entities": list(row["e"])}


def community_contexts(nodes: DataFrame, edges: DataFrame, communities: DataFrame, ranks: DataFrame, most: int = 12, least: int = 2) -> DataFrame:
    """What a report on each community is written from: its top members and the
    edges among them. Communities of fewer than ``least`` members are skipped."""
    from graphloom.operators.community import community_edges, top_members

    members = communities.join(ranks, "node").join(nodes.select(F.col("id").alias("node"), "description"), "node")
    big = members.groupBy("community").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("community")
    top = top_members(members.join(big, "community", "left_semi"), most)
    inside = community_edges(edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), "description"), top.select("node", "community"))
    weights = top.groupBy("community").agg(F.sum("pagerank").alias("weight"), F.transform(F.array_sort(F.collect_list(F.struct("i", "node"))), lambda x: x["node"]).alias("members"))
    return report.report_context(top, inside).join(weights, "community")


def run_pipeline(replies: DataFrame, cut: Cut) -> dict[str, DataFrame]:
    """Graph, ranks, communities and report contexts from replies."""
    from graphloom.operators.community import leiden
    from graphloom.operators.graph import pagerank

    nodes, edges = build_graph(replies, cut=cut)
    nodes, edges = cut(nodes), cut(edges)
    ids = nodes.select(F.col("id").alias("node"))
    plain = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), "weight")
    ranks = pagerank(ids, plain, cut)
    levels = leiden(ids, plain, cut)
    communities = levels.filter("level = 0").select("node", "community")
    return {"nodes": nodes, "edges": edges, "pagerank": ranks, "communities": levels, "contexts": community_contexts(nodes, edges, communities, ranks)}
