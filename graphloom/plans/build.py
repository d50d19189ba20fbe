"""The build that a model takes part in: chunks to records, many descriptions to
one, pairs of names to decisions, communities to reports. Each step makes its
prompts as columns and asks through ``chat_model.answered``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import extract, resolve
from graphloom.operators.graph import Cut, pagerank
from graphloom.plans import rag
from graphloom.plans.chat_model import CONTENTS, Provider, answered, filled, said

EXTRACT_PROMPT = """Find the entities of these types in the text, and how they are related: {entity_types}.
Use only what the text says, and answer in {language}.
Write a record ("entity"<|>name<|>type<|>description) for each entity, and
("relationship"<|>name<|>other name<|>description<|>keywords<|>strength as a number) for each related pair.
Put ## between records.

Text:
{input_text}
"""

MORE_PROMPT = "Some entities or relationships are still missing. Add records for them in the same form, none twice."

ASK_PROMPT = "Are there any left? Answer Y or N only."

SUMMARY_PROMPT = """Join these descriptions of {entity_name} into one, in {language}. Keep every fact; settle contradictions.

{description_list}
"""

SAME_PROMPT = """Decide for each question whether both names mean the same thing.
Answer each as (For question <|>number<|>, <|>yes<|>) or (For question <|>number<|>, <|>no<|>), with ## between answers.

{input_text}
"""

REPORT_PROMPT = """Report on the community of entities below, from what is given only.
Answer with JSON: {"title": text, "summary": text, "rating": number from 0 to 10 for its impact, "rating_explanation": text,
"findings": [{"summary": text, "explanation": text}]}.

Entities:
{entity_df}

Relationships:
{relation_df}
"""


def extracted(chunks: DataFrame, provider: Provider, model: str, types: tuple[str, ...] = extract.TYPES, language: str = "English", gleanings: int = 2, **options) -> DataFrame:
    """Chunks ``(doc_id, chunk_seq, content)`` to ``(doc_id, chunk_seq, response,
    characters)``: a first reply and up to ``gleanings`` further ones, joined as
    records. After each further one but the last the model is asked whether there
    is more, and gets the whole conversation each time. ``characters`` counts the
    prompt and all replies. Chunks whose first call fails have a null response."""
    key, talk = ["doc_id", "chunk_seq"], F.col("contents")
    prompt = filled(EXTRACT_PROMPT, entity_types=F.lit(",".join(types)), language=F.lit(language), input_text="content")
    rows = chunks.select(*key, said("user", prompt).cast(CONTENTS).alias("contents"), F.lit("").alias("response"), F.length(prompt).cast("long").alias("characters"))

    def asked(open_rows: DataFrame, counts: bool) -> DataFrame:
        """The rows after one more turn; a reply that counts is added to them."""
        turn = answered(open_rows.withColumnRenamed("response", "before"), provider, model, "contents", **options)
        reply = F.coalesce("response", F.lit(""))
        both = F.when(F.col("response").isNull(), F.col("before")).when(F.col("before") == "", reply).otherwise(F.concat("before", F.lit("##"), reply))
        return turn.select(
            *key, F.concat(talk, said("model", reply).cast(CONTENTS)).alias("contents"), (both if counts else F.col("before")).alias("response"),
            (F.col("characters") + F.length(reply)).alias("characters"), reply.alias("reply"), F.col("response").isNull().alias("failed"),
        )

    put = lambda df, text: df.withColumn("contents", F.concat(talk, said("user", F.lit(text)).cast(CONTENTS)))
    rows = asked(rows, True)
    out, open_rows = rows.filter("failed"), rows.filter("not failed")
    for i in range(gleanings):
        open_rows = asked(put(open_rows, MORE_PROMPT), True)
        if i + 1 < gleanings:
            open_rows = asked(put(open_rows, ASK_PROMPT), False)
            done = F.col("failed") | (F.lower(F.substring(F.trim("reply"), 1, 1)) == "n")
            out, open_rows = out.unionByName(open_rows.filter(done)), open_rows.filter(~done)
    return out.unionByName(open_rows).select(*key, F.nullif("response", F.lit("")).alias("response"), "characters")


def summarised(rows: DataFrame, name: str | Column, provider: Provider, model: str, language: str = "English", most: int = 12, **options) -> DataFrame:
    """``rows`` whose descriptions of more than ``most`` parts are replaced by the
    model's summary; where it fails, the parts stay."""
    many = F.size(F.split("description", T.JOIN.replace("<", r"\<"), -1)) > most
    who = F.col(name) if isinstance(name, str) else name
    prompt = filled(SUMMARY_PROMPT, entity_name=who, language=F.lit(language), description_list="description")
    found = answered(rows.filter(many).withColumn("prompt", prompt), provider, model, **options)
    short = found.withColumn("description", F.coalesce("response", "description")).select(*rows.columns)
    return rows.filter(~F.coalesce(many, F.lit(False))).unionByName(short)


def adjudicated(batches: DataFrame, provider: Provider, model: str, **options) -> DataFrame:
    """Batches of pairs ``(entity_type, batch, i, a, b)`` to the pairs that the
    model says are the same."""
    line = F.concat(F.lit("Question "), F.col("i").cast("string"), F.lit(": name of "), "entity_type", F.lit(" A is "), "a", F.lit(", name of "), "entity_type", F.lit(" B is "), "b")
    # A batch is at most as long as ``resolve.pair_batches`` makes it.
    texts = batches.groupBy("entity_type", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "\n").alias("questions"))
    found = answered(texts.withColumn("prompt", filled(SAME_PROMPT, input_text="questions")), provider, model, **options)
    return resolve.agreed(batches, found.filter("response is not null").select("entity_type", "batch", "response"))


def community_reports(contexts: DataFrame, provider: Provider, model: str, **options) -> DataFrame:
    """Contexts (see ``rag.community_contexts``) to ``(community, title, summary,
    rating, rating_explanation, findings, weight, entities, report)``; a reply
    that is no valid report gives no row."""
    prompt = filled(REPORT_PROMPT, entity_df="entities", relation_df="relationships")
    found = answered(contexts.withColumn("prompt", prompt), provider, model, **options)
    parsed = found.withColumn("r", T.report("response")).filter("r is not null")
    return parsed.select("community", "r.title", "r.summary", "r.rating", "r.rating_explanation", "r.findings", "weight", F.col("members").alias("entities"), T.report_markdown("r").alias("report"))


def built(chunks: DataFrame, provider: Provider, model: str, cut: Cut, types: tuple[str, ...] = extract.TYPES, language: str = "English", algorithm: str = "leiden", level: int = 0, **options) -> dict[str, DataFrame]:
    """From chunks to reports: the graph as extracted and as resolved, ranks,
    communities, reports."""
    from graphloom.operators.community import leiden, louvain

    ask = {"provider": provider, "model": model, **options}
    told = cut(extracted(chunks, types=types, language=language, **ask))
    nodes, edges = rag.build_graph(told.filter("response is not null").select("doc_id", "chunk_seq", "response"), types, cut)
    nodes = cut(summarised(nodes, "id", language=language, **ask))
    edges = cut(summarised(edges, F.concat_ws(" -> ", "source", "target"), language=language, **ask))
    batches = cut(resolve.pair_batches(resolve.similar_pairs(nodes), cut))
    names = cut(resolve.canonical(adjudicated(batches, **ask), cut))
    merged_nodes, merged_edges = map(cut, resolve.merged_graph(nodes, edges, names))
    ids = merged_nodes.select(F.col("id").alias("node"))
    plain = merged_edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), "weight")
    ranks = cut(pagerank(ids, plain, cut))
    if algorithm == "leiden":
        communities = leiden(ids, plain, cut)
        chosen = communities.filter(F.col("level") == level).select(F.col("leaf").alias("node"), "community")
    else:
        communities = chosen = louvain(ids, plain, cut)
    contexts = rag.community_contexts(merged_nodes, merged_edges, chosen, ranks)
    return {
        "replies": told, "nodes": nodes, "edges": edges, "resolved_nodes": merged_nodes, "resolved_edges": merged_edges, "names": names,
        "pagerank": ranks, "communities": communities, "reports": cut(community_reports(contexts, **ask)),
    }
