"""Queries of the graph engine, each with its SQL where SQL can express it."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import community, extract, graph, order, report, resolve, search
from graphloom.operators.components import connected_components
from graphloom.plans import build, chat_model, rag
from graphloom.plans.tables import GRAPH_SQL, MENTIONS_SQL, RELATIONAL_SQL, relational_edges, relational_nodes, replies
from graphloom.sources import loaders, store
from graphloom.sources.search_index import SearchIndex
from graphloom.sources.shared import fresh_path, table, written

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: What the search queries look for.
QUESTION, NAME, LINE = "Anre of en src1 src7", "Theatin", "Theain en src17"
#: One word of few items, with others like an item's text; a word that only shares bigrams.
FEW, UNKNOWN = "Theain enn srcc17", "Theainqq"
#: One white-space character in SQL patterns, and the search normalisation.
_W = r"[\s\x0B\p{Z}\x{FEFF}]"
_NORM = r"trim(regexp_replace(regexp_replace(lower({}), '[^\x{{4e00}}-\x{{9fff}}A-Za-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _joined(c: str, glue: str = ","):
    return F.array_join(c, glue).alias(c)


# -- Parsing -------------------------------------------------------------------


@_query(rf"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(
  replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''),
  '["\x00-\x1f\x7f-\x{{9f}}]', '', 'g'), '^{_W}+|{_W}+$', '', 'g'), '[<>]', '', 'g') AS clean
FROM pages""")
def clean_str(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.clean_str("html").alias("clean"))


@_query(r"""
SELECT item_id, list_aggregate(list_filter(list_transform(regexp_split_to_array(text, '\.|,'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), 'string_agg', '|') AS parts
FROM benchmark""")
def split_markers(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.split_markers("text", ".", ","), "|").alias("parts"))


@_query(f"""
WITH {MENTIONS_SQL}, e AS (
  SELECT doc_id, chunk_seq, 0 AS kind, k, '("entity"<|>' || tok || '<|>' || CASE (length(tok) + length(source)) % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'organization' ELSE 'location' END || '<|>' || lang || ' ' || source || ')' AS record FROM names
  UNION ALL SELECT a.doc_id, a.chunk_seq, 1, a.k, '("relationship"<|>' || a.tok || '<|>' || b.tok || '<|>' || a.lang || '<|>' || a.source || '<|>1)'
  FROM names a JOIN names b ON a.doc_id = b.doc_id AND a.chunk_seq = b.chunk_seq AND b.k = a.k + 1)
SELECT doc_id, CAST(chunk_seq AS INTEGER) AS chunk_seq, CAST(row_number() OVER (PARTITION BY doc_id, chunk_seq ORDER BY kind, k) - 1 AS INTEGER) AS rec_seq, record FROM e""")
def record_split(spark, sf_dir):
    return extract.record_rows(replies(spark, sf_dir)).drop("f", "last")


@_query(f"WITH {MENTIONS_SQL} SELECT doc_id, CAST(chunk_seq AS INTEGER) AS chunk_seq, CAST(rec_seq AS INTEGER) AS rec_seq, entity_name, entity_type, description, source_id FROM em")
def entity_parse(spark, sf_dir):
    return extract.entity_mentions(extract.record_rows(replies(spark, sf_dir)))


@_query(f"WITH {MENTIONS_SQL} SELECT doc_id, CAST(chunk_seq AS INTEGER) AS chunk_seq, src_id, tgt_id, weight, description, keywords, source_id FROM rm")
def relation_parse(spark, sf_dir):
    return extract.relation_mentions(extract.record_rows(replies(spark, sf_dir))).drop("rec_seq")


@_query(r"""
SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(o_orderpriority, '^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)', 1), '') AS DOUBLE) AS priority FROM orders""")
def parse_float(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.parse_float("o_orderpriority").alias("priority"))


@_query("SELECT CAST(c_custkey // 50 AS BIGINT) AS batch, CAST(c_custkey % 50 + 1 AS INTEGER) AS i FROM customer WHERE c_acctbal > 0")
def decision_parse(spark, sf_dir):
    """Replies about batches of 50 customers, yes to those not in debt."""
    n = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_acctbal", F.floor(n / 50).alias("batch"), (n % 50 + 1).cast("int").alias("i"))
    said = F.concat(F.lit("(For question <|>"), F.col("i").cast("string"), F.lit("<|>, <|>"), F.when(F.col("c_acctbal") > 0, "Yes").otherwise("no"), F.lit("<|>)"))
    response = rows.groupBy("batch").agg(F.array_join(F.collect_list(said), "##").alias("response"))
    return response.select("batch", F.explode(T.decisions("response", F.lit(50))).alias("i"))


_REPORT = """SELECT p_partkey, p_name AS title, CAST(p_size % 13 AS DOUBLE) AS rating,
  '# ' || p_name || chr(10) || chr(10) || p_brand || chr(10) || chr(10) || '## ' || p_type || chr(10) || chr(10) || p_brand AS report
FROM part WHERE p_size % 13 <= 10"""


@_query(_REPORT)
def report_json_validate(spark, sf_dir):
    reply = F.format_string('Here it is: ```json\n{"title": "%s", "summary": "%s", "rating": %d, "rating_explanation": "by size", "findings": [{"summary": "%s", "explanation": "%s",},], "other": 1}\n```', "p_name", "p_brand", F.col("p_size") % 13, "p_type", "p_brand")
    parsed = table(spark, sf_dir, "part").withColumn("r", T.report(reply)).filter("r is not null")
    return parsed.select("p_partkey", F.col("r.title").alias("title"), F.col("r.rating").alias("rating"), T.report_markdown("r").alias("report"))


@_query("SELECT p_partkey, p_name AS answer, p_brand || '|' || p_type AS entities FROM part")
def answer_split(spark, sf_dir):
    reply = F.concat("p_name", F.lit('\n ["'), "p_brand", F.lit('", "'), "p_type", F.lit('"]'))
    return table(spark, sf_dir, "part").select("p_partkey", T.answer_text(reply).alias("answer"), F.array_join(T.answer_entities(reply), "|").alias("entities"))


# -- Loading -------------------------------------------------------------------


@_query("SELECT doc_id, coalesce(nullif(text, ''), nullif(source, '')) AS content FROM documents")
def csv_text_pick(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", loaders.picked_text(docs.select("text", "source", "lang")).alias("content"))


@_query("SELECT doc_id, CASE WHEN length(text) > 800 THEN substr(text, 1, 800) || '...' ELSE text END AS content FROM documents")
def truncate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", loaders.truncated("text", loaders.LONGEST["slow"]).alias("content"))


@_query(rf"""
WITH c AS (SELECT item_id, regexp_replace(regexp_replace(text, '{_W}+', ' ', 'g'), '^{_W}+|{_W}+$', '', 'g') AS content FROM benchmark)
SELECT item_id, content FROM c WHERE length(content) >= 10""")
def clean_validate(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", loaders.validated("text").alias("content")).filter("content is not null")


@_query(rf"""
WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{_W}+', ' ', 'g'), '^{_W}+|{_W}+$', '', 'g') AS chunk FROM documents)
SELECT doc_id, 0 AS chunk_seq, chunk FROM c WHERE length(chunk) > 50""")
def paragraph_chunk(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(loaders.chunked_paragraphs("text")).alias("chunk_seq", "chunk"))


def _packed_sql(parts: str, most: int, glue: str) -> str:
    """Neighbouring parts ``(doc_id, k, part)``, k from 1, joined to chunks."""
    return f"""parts AS MATERIALIZED ({parts}),
pack AS (
  SELECT doc_id, k, part AS now, NULL::VARCHAR AS done FROM parts WHERE k = 1
  UNION ALL
  SELECT p.doc_id, p.k, CASE WHEN length(regexp_replace(now, '^{_W}+|{_W}+$', '', 'g')) > 0 AND length(now) + length(part) > {most} THEN part ELSE now || {glue} || part END,
    CASE WHEN length(regexp_replace(now, '^{_W}+|{_W}+$', '', 'g')) > 0 AND length(now) + length(part) > {most} THEN now END
  FROM pack JOIN parts p ON p.doc_id = pack.doc_id AND p.k = pack.k + 1),
ends AS (SELECT doc_id, k, done AS chunk FROM pack WHERE done IS NOT NULL UNION ALL SELECT doc_id, k + 1, now FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) AS r FROM pack) WHERE r = 1),
kept AS (SELECT doc_id, k, regexp_replace(chunk, '^{_W}+|{_W}+$', '', 'g') AS chunk FROM ends)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_seq, chunk FROM kept WHERE chunk <> ''"""


@_query(f"""WITH RECURSIVE {_packed_sql("""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS k, part FROM (
  SELECT doc_id, regexp_replace(raw, '^"""+_W+"""+|"""+_W+"""+$', '', 'g') AS part, j FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS j FROM documents)) WHERE part <> ''""", 1000, "chr(10) || chr(10)")}""")
def markdown_pack(spark, sf_dir):
    """Lines of a document as paragraphs, packed to 1000 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(loaders.packed_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("chunk_seq", "chunk"))


@_query(f"""WITH RECURSIVE {_packed_sql("""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS k, part FROM (
  SELECT doc_id, CASE WHEN j < n THEN raw || '。' ELSE raw END AS part, j FROM (SELECT doc_id, unnest(string_split(replace(text, '.', '。'), '。')) AS raw, unnest(range(1, 1 + len(string_split(replace(text, '.', '。'), '。')))) AS j, len(string_split(replace(text, '.', '。'), '。')) AS n FROM documents)) WHERE part <> ''""", 300, "''")}""")
def sentence_chunk(spark, sf_dir):
    """Sentences, their stops put as CJK ones, packed to 300 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(loaders.packed_sentences(F.replace("text", F.lit("."), F.lit("。")))).alias("chunk_seq", "chunk"))


@_query(rf"""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS j FROM documents),
c AS (SELECT doc_id, j, regexp_replace(regexp_replace(raw, '{_W}+', ' ', 'g'), '^{_W}+|{_W}+$', '', 'g') AS chunk FROM p)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS INTEGER) AS chunk_seq, chunk FROM c WHERE length(chunk) > 50""")
def paragraph_chunks(spark, sf_dir):
    """Lines as paragraphs: several chunks of a document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(loaders.chunked_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("chunk_seq", "chunk"))


@_query(rf"""
WITH c AS (SELECT item_id, regexp_replace(regexp_replace(replace(text, 'whi', '中'), '{_W}+', ' ', 'g'), '^{_W}+|{_W}+$', '', 'g') AS content FROM benchmark)
SELECT item_id, content FROM c WHERE length(content) >= 10 AND contains(content, '中')""")
def cjk_validate(spark, sf_dir):
    """Texts that must have a CJK character; some are given one."""
    text = F.replace("text", F.lit("whi"), F.lit("中"))
    return table(spark, sf_dir, "benchmark").select("item_id", loaders.validated(text, cjk=True).alias("content")).filter("content is not null")


@_query("""
WITH a AS (SELECT o_orderkey, o_orderkey & 4294967295 AS x FROM orders), b AS (SELECT o_orderkey, xor(x, (x << 13) & 4294967295) AS x FROM a),
c AS (SELECT o_orderkey, xor(x, x >> 17) AS x FROM b)
SELECT o_orderkey, CAST(xor(x, (x << 5) & 4294967295) AS BIGINT) AS state FROM c""")
def xorshift32(spark, sf_dir):
    """A step of the seeded generator."""
    return table(spark, sf_dir, "orders").select("o_orderkey", T.xorshift32("o_orderkey").alias("state"))


@_query("""
WITH RECURSIVE a AS (SELECT list(c_custkey ORDER BY c_custkey) AS a, count(*) AS n FROM customer),
s AS (
  SELECT n - 1 AS i, CAST(20240914 AS BIGINT) AS x, a FROM a
  UNION ALL
  SELECT i - 1, y, list_transform(a, lambda v, p: CASE p WHEN i + 1 THEN a[j] WHEN j THEN a[i + 1] ELSE v END)
  FROM (SELECT i, a, y, CAST(floor(y / 4294967296.0::DOUBLE * (i + 1)) AS BIGINT) + 1 AS j FROM (
    SELECT i, a, xor(x2, (x2 << 5) & 4294967295) AS y FROM (SELECT i, a, xor(x1, x1 >> 17) AS x2 FROM (
      SELECT i, a, xor(x, (x << 13) & 4294967295) AS x1 FROM s WHERE i > 0))))
)
SELECT unnest(a) AS c_custkey, CAST(unnest(range(len(a))) AS BIGINT) AS place FROM s WHERE i = 0""")
def seeded_shuffle(spark, sf_dir):
    """The customers in the generator's order, worked out in parallel."""
    return order.seeded_order(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 20240914, written)


@_query(rf"""
WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(nullif(text, ''), source), '{_W}+', ' ', 'g'), '^{_W}+|{_W}+$', '', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 1000 THEN substr(t, 1, 1000) || '...' ELSE t END AS content FROM c WHERE length(t) >= 10""")
def csv_chunks(spark, sf_dir):
    return loaders.csv_chunks(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "fixed", order="doc_id")


@_query(rf"""
WITH c AS (SELECT doc_id, regexp_replace(coalesce(nullif(text, ''), source), '^{_W}+|{_W}+$', '', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 500 THEN substr(t, 1, 500) || '...' ELSE t END AS content FROM c WHERE t <> '' ORDER BY doc_id LIMIT 100""")
def csv_row_limit(spark, sf_dir):
    """The loaders' limit: the first 100 accepted chunks."""
    return loaders.csv_chunks(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "ultra-slow", order="doc_id", rows=100)


@_query("SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'model' ELSE role END AS role, md5('model-1:' || text) AS key FROM conversations")
def cache_key(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", store.chat_role("role").alias("role"), store.cache_key("model-1", "text").alias("key"))


@_query("""
WITH n AS (SELECT max(ts) AS now FROM events)
SELECT event_id, CAST(floor(epoch(now - ts) / 3600) AS BIGINT) AS age_hours FROM events, n WHERE ts >= now - INTERVAL 24 HOUR""")
def cache_ttl(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    rows = events.crossJoin(F.broadcast(now))
    return rows.filter(store.fresh("ts", F.col("now"))).select("event_id", store.age_hours("ts", F.col("now")).alias("age_hours"))


@_query("""
WITH c AS (SELECT md5('model-1:' || text) AS key, min(conv_id % 48) AS age, min(role) AS response FROM conversations WHERE turn = 0 AND text IS NOT NULL GROUP BY ALL)
SELECT conv_id, turn, c.response FROM conversations r LEFT JOIN c ON c.key = md5('model-1:' || r.text) AND c.age <= 24""")
def cache_lookup(spark, sf_dir):
    """Messages against cached replies to first ones, up to two days old; null where a model would be asked."""
    turns = table(spark, sf_dir, "conversations")
    now = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    first = turns.filter("turn = 0 and text is not null").groupBy(store.cache_key("model-1", "text").alias("key")).agg(F.min(F.col("conv_id") % 48).cast("int").alias("age"), F.min("role").alias("response"))
    cached = first.select("key", (now - F.make_interval(hours=F.col("age"))).alias("timestamp"), "response")
    hits, misses = store.cache_hits(turns.select("conv_id", "turn", store.cache_key("model-1", "text").alias("key")), cached, now)
    return hits.select("conv_id", "turn", "response").unionByName(misses.select("conv_id", "turn", F.lit(None).cast("string").alias("response")))


@_query("SELECT count(*) AS entries, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes, round(sum(octet_length(encode(props))) / (1024 * 1024), 2) AS megabytes FROM events")
def cache_statistics(spark, sf_dir):
    return store.cache_stats(table(spark, sf_dir, "events"), "props")


@_query("""
SELECT 'C:' || c_custkey AS id, CASE WHEN c_acctbal > 0 THEN 'NEW' ELSE 'OLD' END AS entity_type FROM customer
UNION ALL SELECT 'S:' || s_suppkey, 'NEW' FROM supplier""")
def upsert_nodes(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    key = F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("id")
    new = customers.filter("c_acctbal > 0").select(key, F.lit("NEW").alias("entity_type")).unionByName(
        table(spark, sf_dir, "supplier").select(F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("NEW").alias("entity_type")))
    return store.upserted(customers.select(key, F.lit("OLD").alias("entity_type")), new, ["id"])


# -- Merging -------------------------------------------------------------------


@_query(f"WITH {GRAPH_SQL} SELECT * FROM nodes")
def node_merge(spark, sf_dir):
    return extract.merged_nodes(extract.entity_mentions(written(extract.record_rows(replies(spark, sf_dir))))).select("id", "entity_type", "description", _joined("source_ids"))


@_query(f"WITH {GRAPH_SQL} SELECT * FROM edges")
def edge_merge(spark, sf_dir):
    return extract.merged_edges(extract.relation_mentions(written(extract.record_rows(replies(spark, sf_dir))))).select("source", "target", "description", "weight", _joined("keywords"), _joined("source_ids"))


@_query(f"WITH {GRAPH_SQL} SELECT id, CAST(len(string_split(description, ' <SEP> ')) AS INTEGER) AS parts FROM nodes WHERE len(string_split(description, ' <SEP> ')) > 12")
def summary_flag(spark, sf_dir):
    nodes, _ = rag.build_graph(replies(spark, sf_dir), cut=written)
    return extract.to_summarise(nodes).select("id", F.size(F.split("description", r" \<SEP> ", -1)).alias("parts"))


@_query(f"WITH {GRAPH_SQL}, p AS (SELECT * FROM nodes WHERE entity_type <> 'PERSON') SELECT e.source, e.target, e.weight FROM edges e WHERE source IN (SELECT id FROM p) AND target IN (SELECT id FROM p)")
def endpoint_semi_join(spark, sf_dir):
    nodes, edges = rag.build_graph(replies(spark, sf_dir), cut=written)
    return store.linked_edges(edges, nodes.filter("entity_type != 'PERSON'")).select("source", "target", "weight")


@_query("SELECT CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations")
def token_count(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return extract.reply_size(turns.select(F.when(F.col("role") != "assistant", F.col("text")).otherwise("").alias("prompt"), F.when(F.col("role") == "assistant", F.col("text")).otherwise("").alias("response")))


# -- Search --------------------------------------------------------------------


def _items(spark, sf_dir) -> DataFrame:
    """The stored graph's items: searches read them more than once."""
    nodes, edges = rag.build_graph(replies(spark, sf_dir), cut=written)
    return written(search.items(nodes, edges))


_ITEMS = f"""{GRAPH_SQL}, items AS (
  SELECT 'node' AS type, id, {_NORM.format("id || ' ' || description")} AS t FROM nodes
  UNION ALL SELECT 'edge', source || '|' || target, {_NORM.format("source || ' ' || target || ' ' || description")} FROM edges)"""


def _grams_sql(n: int, text: str = "t") -> str:
    return f"list_filter(list_transform(range(1, greatest(length({text}) - {n - 2}, 1)), lambda i: substr({text}, i, {n})), lambda g: length(trim(g)) = {n})"


_KEYWORDS = "list_distinct(list_filter(string_split({0}, ' '), lambda w: length(w) >= 2))"


def _postings_sql(terms: str) -> str:
    return f"SELECT term, type, id, count(*) AS tf FROM (SELECT type, id, unnest({terms}) AS term FROM items) GROUP BY ALL"


def _search_sql(question: str) -> str:
    return f"""{_ITEMS},
q AS (SELECT {_NORM.format("'" + question + "'")} AS t),
qb AS (SELECT g AS term, count(*) AS qtf FROM (SELECT unnest({_grams_sql(2)}) AS g FROM q) GROUP BY g),
qk AS (SELECT unnest({_KEYWORDS.format("t")}) AS term FROM q),
pb AS ({_postings_sql(_grams_sql(2))}),
pk AS ({_postings_sql(_KEYWORDS.format("t"))}),
b AS (SELECT type, id, CAST(sum(qtf * tf) AS BIGINT) AS score, sum(qtf * tf) / (SELECT sum(qtf) FROM qb) AS relevance FROM pb JOIN qb USING (term) GROUP BY ALL),
k AS (SELECT type, id, count(*) AS score, count(*) / (SELECT count(*) FROM qk) AS relevance FROM pk JOIN qk USING (term) GROUP BY ALL),
f AS (SELECT type, id, len({_grams_sql(2, "items.t")}) AS times, 1 - levenshtein(q.t, items.t) / greatest(length(q.t), length(items.t)) AS similarity FROM items, q WHERE length(items.t) + length(q.t) > 0)"""


_SEARCH = _search_sql(QUESTION)


@_query(f"SELECT doc_id, {_NORM.format('text')} AS normalized FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalized("text").alias("normalized"))


@_query(f"WITH {_ITEMS} {_postings_sql(_grams_sql(2))}")
def bigram_index(spark, sf_dir):
    return search.postings(_items(spark, sf_dir), "bigram")


@_query(f"WITH {_ITEMS} {_postings_sql(_grams_sql(3))}")
def trigram_index(spark, sf_dir):
    return search.postings(_items(spark, sf_dir), "trigram")


@_query(f"WITH {_ITEMS} {_postings_sql(_KEYWORDS.format('t'))}")
def keyword_index(spark, sf_dir):
    return search.postings(_items(spark, sf_dir), "keyword")


@_query(f"""WITH {_ITEMS}
SELECT 'bigram' AS "index", count(DISTINCT term) AS terms FROM ({_postings_sql(_grams_sql(2))})
UNION ALL SELECT 'trigram', count(DISTINCT term) FROM ({_postings_sql(_grams_sql(3))})
UNION ALL SELECT 'keyword', count(DISTINCT term) FROM ({_postings_sql(_KEYWORDS.format('t'))})""")
def index_stats(spark, sf_dir):
    return search.index_stats(search.index(_items(spark, sf_dir)))


@_query(f"WITH {_SEARCH} SELECT type, id, score, round(relevance, 9) AS relevance FROM b")
def bigram_search(spark, sf_dir):
    return search.bigram_search(_items(spark, sf_dir), QUESTION).withColumn("relevance", F.round("relevance", 9))


@_query(f"WITH {_SEARCH} SELECT type, id, score, round(relevance, 9) AS relevance FROM k")
def keyword_search(spark, sf_dir):
    return search.keyword_search(_items(spark, sf_dir), QUESTION).withColumn("relevance", F.round("relevance", 9))


@_query(f"WITH {_search_sql(LINE)} SELECT type, id, round(similarity, 9) AS similarity FROM f WHERE similarity >= 0.7")
def fuzzy_search(spark, sf_dir):
    return search.fuzzy_search(_items(spark, sf_dir), LINE).withColumn("similarity", F.round("similarity", 9))


@_query(f"""WITH {_ITEMS}, f AS (SELECT type, id, {_NORM.format("id")} AS n FROM items)
SELECT type, id, round(1 - levenshtein(lower('{NAME}'), n) / greatest(length('{NAME}'), length(n)), 9) AS similarity FROM f
WHERE 1 - levenshtein(lower('{NAME}'), n) / greatest(length('{NAME}'), length(n)) >= 0.7""")
def fuzzy_names(spark, sf_dir):
    """Names in place of texts."""
    return search.fuzzy_search(_items(spark, sf_dir), NAME, by="id").withColumn("similarity", F.round("similarity", 9))


_COMBINED = f"""WITH {_SEARCH}
SELECT type, id, round(sum(s), 9) AS total_score, string_agg(method, '+' ORDER BY method) AS methods
FROM (SELECT type, id, 0.4::DOUBLE * relevance AS s, 'bigram' AS method FROM b UNION ALL SELECT type, id, 0.6::DOUBLE * relevance, 'keyword' FROM k)
GROUP BY type, id ORDER BY total_score DESC, type, id LIMIT 50"""


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("type", "id", F.round("total_score", 9).alias("total_score"), F.array_join("methods", "+").alias("methods"))


@_query(_COMBINED)
def combined_search(spark, sf_dir):
    return _shown(search.combined_search(_items(spark, sf_dir), QUESTION))


@_query(_COMBINED)
def indexed_search(spark, sf_dir):
    """The same from the stored index: only the question's terms are read."""
    items = _items(spark, sf_dir)
    return _shown(search.combined_search(items, QUESTION, idx=search.write_index(items, fresh_path(spark, "index"))))


@_query(_COMBINED)
def ranked_search(spark, sf_dir):
    """From impact-ordered blocks of postings, a third of the items added later
    in place of others, read no deeper than the best hits need."""
    items = written(_items(spark, sf_dir), "items")
    late = F.pmod(F.xxhash64("type", "id"), F.lit(3)) == 0
    idx = SearchIndex(spark, fresh_path(spark, "index")).write(items.withColumn("text", F.when(late, F.reverse("text")).otherwise(F.col("text"))))
    return _shown(idx.add(items.filter(late)).search(QUESTION))


@_query(f"WITH {_search_sql(LINE)} SELECT type, id, round(similarity, 9) AS similarity FROM f WHERE similarity >= 0.7")
def indexed_fuzzy(spark, sf_dir):
    """Items with few edits, by the bigrams that they have to share."""
    idx = SearchIndex(spark, fresh_path(spark, "index")).write(_items(spark, sf_dir))
    return idx.fuzzy(LINE).select("type", "id", F.round("similarity", 9).alias("similarity"))


@_query(f"""WITH {_search_sql(FEW)}, n AS (SELECT count(*) AS n FROM k)
SELECT type, id, round(sum(s), 9) AS total_score, string_agg(method, '+' ORDER BY method) AS methods
FROM (SELECT type, id, 0.6::DOUBLE * relevance AS s, 'keyword' AS method FROM k
  UNION ALL SELECT type, id, 0.3::DOUBLE * similarity * times, 'fuzzy' FROM f, n WHERE similarity >= 0.7 AND times > 0 AND n < 10)
GROUP BY type, id ORDER BY total_score DESC, type, id LIMIT 50""")
def combined_search_few(spark, sf_dir):
    """So few hits that fuzzy search is asked too."""
    return _shown(search.combined_search(_items(spark, sf_dir), FEW, use_bigram=False))


def _tier_sql(question: str, name: str, table_: str, score: str) -> str:
    return f"WITH {_search_sql(question)} SELECT type, id, round({score}, 9) AS total_score, '{name}' AS method FROM {table_} ORDER BY total_score DESC, type, id LIMIT 50"


def _first_tier(spark, sf_dir, question: str, **options) -> DataFrame:
    return search.sequential_search(_items(spark, sf_dir), question, **options).withColumn("total_score", F.round("total_score", 9))


@_query(_tier_sql(QUESTION, "keyword", "k", "relevance"))
def sequential_search(spark, sf_dir):
    return _first_tier(spark, sf_dir, QUESTION)


@_query(_tier_sql(UNKNOWN, "bigram", "b", "relevance"))
def sequential_bigram(spark, sf_dir):
    """No keyword is known."""
    return _first_tier(spark, sf_dir, UNKNOWN)


@_query(_tier_sql(LINE, "fuzzy", "f WHERE similarity >= 0.7 AND times > 0", "similarity"))
def sequential_fuzzy(spark, sf_dir):
    """Only the last tier is left."""
    return _first_tier(spark, sf_dir, LINE, use_keywords=False, use_bigram=False)


@_query(f"""WITH {GRAPH_SQL} SELECT 'node' AS type, id, id || ' ' || description AS text FROM nodes WHERE contains(lower(id || ' ' || description), 'anre') OR contains(lower(id || ' ' || description), 'src17')
UNION SELECT 'edge', source || '|' || target, source || ' ' || target || ' ' || description FROM edges WHERE contains(lower(source || ' ' || target || ' ' || description), 'anre') OR contains(lower(source || ' ' || target || ' ' || description), 'src17')""")
def substring_search(spark, sf_dir):
    return search.substring_search(_items(spark, sf_dir), "anre of src17")


# -- Resolution ----------------------------------------------------------------

#: Names to resolve: those of parts, by brand.
_SIMILAR = r"""
names_ AS (SELECT DISTINCT p_brand AS t, p_name AS n FROM part),
cs AS (SELECT t, n, list_distinct(string_split(lower(n), '')) AS c FROM names_),
sim AS (SELECT x.t AS entity_type, x.n AS a, y.n AS b, len(list_intersect(x.c, y.c)) AS i, len(x.c) + len(y.c) AS s FROM cs x JOIN cs y ON x.t = y.t AND x.n < y.n),
pairs AS (SELECT entity_type, a, b FROM sim
  WHERE levenshtein(lower(a), lower(b)) <= least(length(a), length(b)) // 2
     OR (CASE WHEN greatest(length(a), length(b)) < 4 THEN i / (s - i) > 0.6 ELSE i / (s - i) >= 0.8 END))
"""


def _pairs(spark, sf_dir) -> DataFrame:
    return resolve.similar_pairs(table(spark, sf_dir, "part").select(F.col("p_name").alias("id"), F.col("p_brand").alias("entity_type")))


@_query(f"WITH {_SIMILAR} SELECT * FROM pairs")
def similar_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@_query(f"WITH {_SIMILAR} SELECT entity_type, a, b, round(i / (s - i), 9) AS jaccard FROM sim JOIN pairs USING (entity_type, a, b)")
def jaccard_chars(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("jaccard", F.round(T.jaccard_chars("a", "b"), 9))


@_query(f"""WITH {_SIMILAR}, n AS (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY a, b) - 1 AS r FROM pairs)
SELECT entity_type, a, b, CAST(r // 50 AS INTEGER) AS batch, CAST(r % 50 + 1 AS INTEGER) AS i FROM n""")
def pair_batches(spark, sf_dir):
    return resolve.pair_batches(_pairs(spark, sf_dir), written)


@_query(f"WITH {_SIMILAR} SELECT entity_type, a, b FROM pairs WHERE length(a) = length(b)")
def agreed_pairs(spark, sf_dir):
    """Replies say yes to pairs of names of equal length; the decisions come back as pairs."""
    batches = written(resolve.pair_batches(_pairs(spark, sf_dir), written))
    word = F.when(F.length("a") == F.length("b"), "yes").otherwise("no")
    said = F.concat(F.lit("(For question <|>"), F.col("i").cast("string"), F.lit("<|>, <|>"), word, F.lit("<|>)"))
    replied = batches.groupBy("entity_type", "batch").agg(F.array_join(F.collect_list(said), "##").alias("response"))
    return resolve.agreed(batches, replied)


#: Names that differ in their last letter only are taken to be one entity.
_MERGE_SQL = GRAPH_SQL + """,
same AS (SELECT id AS member, min(id) OVER (PARTITION BY entity_type, substr(id, 1, length(id) - 1)) AS target, count(*) OVER (PARTITION BY entity_type, substr(id, 1, length(id) - 1)) AS n FROM nodes),
mapping AS (SELECT member, target FROM same WHERE n > 1)
"""


def _to_merge(nodes: DataFrame) -> DataFrame:
    stem = nodes.select("id", "entity_type", F.substring("id", F.lit(1), F.length("id") - 1).alias("stem"))
    first = stem.groupBy("entity_type", "stem").agg(F.min("id").alias("a"))
    return stem.join(first, ["entity_type", "stem"]).filter("id != a").select("a", F.col("id").alias("b"))


@_query(f"WITH {_MERGE_SQL} SELECT * FROM mapping")
def merge_components(spark, sf_dir):
    nodes, _ = rag.build_graph(replies(spark, sf_dir), cut=written)
    return resolve.canonical(_to_merge(nodes), written)


@_query(f"""WITH {_MERGE_SQL},
m AS (SELECT coalesce(x.target, e.source) AS s, coalesce(y.target, e.target) AS t, e.* FROM edges e LEFT JOIN mapping x ON e.source = x.member LEFT JOIN mapping y ON e.target = y.member),
r AS (SELECT least(s, t) AS a, greatest(s, t) AS b, description, weight, row_number() OVER (PARTITION BY least(s, t), greatest(s, t) ORDER BY (source <> s OR target <> t), source, target) AS n FROM m)
SELECT a AS source, b AS target, description, weight FROM r WHERE n = 1""")
def merge_graph(spark, sf_dir):
    nodes, edges = rag.build_graph(replies(spark, sf_dir), cut=written)
    nodes, edges = written(nodes), written(edges)
    _, merged = resolve.merged_graph(nodes, edges, resolve.canonical(_to_merge(nodes), written))
    return merged.select("source", "target", "description", "weight")


@_query(f"""WITH {_MERGE_SQL}, p AS (SELECT coalesce(m.target, n.id) AS id, n.id AS old, n.description, n.entity_type FROM nodes n LEFT JOIN mapping m ON n.id = m.member)
SELECT id, max(entity_type) FILTER (id = old) AS entity_type, string_agg(description, ' <SEP> ' ORDER BY (id <> old), old) AS description FROM p GROUP BY id""")
def merge_nodes(spark, sf_dir):
    nodes, edges = rag.build_graph(replies(spark, sf_dir), cut=written)
    nodes = written(nodes)
    merged, _ = resolve.merged_graph(nodes, edges, resolve.canonical(_to_merge(nodes), written))
    return merged.select("id", "entity_type", "description")


# -- Graph ---------------------------------------------------------------------


@_query(f"WITH {RELATIONAL_SQL} SELECT node, round(coalesce(k, 0), 6) AS k FROM rnodes LEFT JOIN rk USING (node)")
def degree(spark, sf_dir):
    return graph.degrees(relational_edges(spark, sf_dir), relational_nodes(spark, sf_dir)).withColumn("k", F.round("k", 6))


@_query(f"""WITH {RELATIONAL_SQL}, p AS (SELECT 'S:' || (1 + p_partkey % (SELECT count(*) FROM supplier)) AS src, 'P:' || p_partkey AS dst FROM part)
SELECT p.src, p.dst, round(coalesce(weight, 0), 6) AS weight FROM p LEFT JOIN redges e ON e.src = p.dst AND e.dst = p.src""")
def edge_weight(spark, sf_dir):
    """Each part with one of the suppliers, which may not supply it."""
    n = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))
    named = lambda p, c: F.concat(F.lit(p + ":"), c.cast("string"))
    pairs = table(spark, sf_dir, "part").crossJoin(F.broadcast(n)).select(named("S", 1 + F.col("p_partkey") % F.col("n")).alias("src"), named("P", F.col("p_partkey")).alias("dst"))
    return graph.edge_weights(pairs, relational_edges(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@_query(f"WITH {RELATIONAL_SQL} SELECT community, round(tot, 6) AS tot FROM rtot")
def community_degree(spark, sf_dir):
    return graph.community_degrees(relational_edges(spark, sf_dir), relational_nodes(spark, sf_dir)).withColumn("tot", F.round("tot", 6))


@_query(f"""WITH {RELATIONAL_SQL}, l AS (SELECT a AS community, sum(weight) AS l FROM rp WHERE a = b GROUP BY a)
SELECT round(sum(coalesce(l, 0) / m - tot * tot / (4 * m * m)), 9) AS q FROM rtot LEFT JOIN l USING (community), rm_""")
def modularity(spark, sf_dir):
    return graph.modularity(relational_edges(spark, sf_dir), relational_nodes(spark, sf_dir)).select(F.round("q", 9).alias("q"))


@_query(f"""WITH {RELATIONAL_SQL},
kin AS (SELECT node, community, sum(w) AS kin FROM (
  SELECT src AS node, b AS community, weight AS w FROM rp UNION ALL SELECT dst, a, weight FROM rp UNION ALL SELECT node, community, 0 FROM rnodes) GROUP BY ALL)
SELECT kin.node, kin.community, round(kin / m - k * (tot - CASE WHEN kin.community = o.community THEN k ELSE 0 END) / (2 * m * m), 12) AS gain
FROM kin JOIN rk USING (node) JOIN rnodes o ON o.node = kin.node JOIN rtot ON rtot.community = kin.community, rm_""")
def delta_q(spark, sf_dir):
    return graph.gains(relational_edges(spark, sf_dir), relational_nodes(spark, sf_dir)).select("node", "community", F.round("gain", 12).alias("gain"))


@_query(f"WITH {RELATIONAL_SQL} SELECT least(a, b) AS src, greatest(a, b) AS dst, round(sum(weight), 6) AS weight FROM rp GROUP BY ALL")
def aggregate_graph(spark, sf_dir):
    _, merged = graph.aggregated(relational_edges(spark, sf_dir), relational_nodes(spark, sf_dir))
    return merged.withColumn("weight", F.round("weight", 6))


def _rounds_sql(rounds: int) -> str:
    """Least labels passed along the text graph's edges, round by round."""
    parts = ["both_ AS MATERIALIZED (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges)", "c0 AS MATERIALIZED (SELECT id AS node, id AS c FROM nodes)"]
    for i in range(rounds):
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT x.node, least(x.c, coalesce(min(y.c), x.c)) AS c FROM c{i} x LEFT JOIN both_ ON both_.a = x.node LEFT JOIN c{i} y ON y.node = both_.b GROUP BY x.node, x.c)")
    return ", ".join(parts)


_ROUNDS = 40
_CC = f"{GRAPH_SQL}, {_rounds_sql(_ROUNDS)}"


def _text_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    nodes, edges = rag.build_graph(replies(spark, sf_dir), cut=written)
    return written(nodes.select(F.col("id").alias("node"), "description")), written(edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), "weight", "description"))


@_query(f"WITH {_CC} SELECT node, c AS component FROM c{_ROUNDS}")
def components(spark, sf_dir):
    nodes, edges = _text_graph(spark, sf_dir)
    return connected_components(edges, written, nodes=nodes)


@_query(f"""WITH {_CC}, big AS (SELECT c FROM c{_ROUNDS} GROUP BY c ORDER BY count(*) DESC, c LIMIT 1)
SELECT source AS src, target AS dst, weight FROM edges JOIN c{_ROUNDS} x ON x.node = source WHERE x.c IN (SELECT c FROM big)""")
def largest_component(spark, sf_dir):
    nodes, edges = _text_graph(spark, sf_dir)
    return graph.largest_component(nodes, edges, written)[1].select("src", "dst", "weight")


def _pagerank_sql(rounds: int) -> str:
    parts = ["o AS (SELECT src AS node, sum(weight) AS w FROM redges GROUP BY src)", "n_ AS (SELECT count(*) AS n FROM rnodes)", "r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n AS r FROM rnodes, n_)"]
    for i in range(rounds):
        parts.append(f"""i{i} AS MATERIALIZED (SELECT dst AS node, sum(r * weight / w) AS v FROM redges JOIN r{i} ON r{i}.node = src JOIN o ON o.node = src GROUP BY dst),
d{i} AS MATERIALIZED (SELECT coalesce(sum(r), 0) AS lost FROM r{i} WHERE node NOT IN (SELECT node FROM o)),
r{i + 1} AS MATERIALIZED (SELECT r{i}.node, 0.15 / n + 0.85 * (coalesce(v, 0) + lost / n) AS r FROM r{i} LEFT JOIN i{i} USING (node), n_, d{i})""")
    return ", ".join(parts)


@_query(f"WITH {RELATIONAL_SQL}, {_pagerank_sql(5)} SELECT node, round(r, 12) AS pagerank FROM r5")
def pagerank(spark, sf_dir):
    nodes, edges = relational_nodes(spark, sf_dir), relational_edges(spark, sf_dir)
    return graph.pagerank(nodes, edges, written, rounds=5, tolerance=None).withColumn("pagerank", F.round("pagerank", 12))


@_query(f"""WITH {RELATIONAL_SQL}, s AS (SELECT community, sum(k) AS s FROM rk JOIN rnodes USING (node) GROUP BY community)
SELECT 0 AS level, community, round(s / (SELECT max(s) FROM s), 9) AS weight FROM s""")
def community_weight(spark, sf_dir):
    members = graph.degrees(relational_edges(spark, sf_dir)).join(relational_nodes(spark, sf_dir), "node").select(F.lit(0).alias("level"), "community", F.col("k").alias("rank"), F.lit(1.0).alias("weight"))
    return community.community_weights(members).withColumn("weight", F.round("weight", 9))


@_query(f"""WITH {RELATIONAL_SQL}, r AS (SELECT community, node, round(k, 6) AS k, CAST(row_number() OVER (PARTITION BY community ORDER BY k DESC, node) - 1 AS INTEGER) AS i FROM rk JOIN rnodes USING (node))
SELECT * FROM r WHERE i < 12""")
def community_topk(spark, sf_dir):
    members = graph.degrees(relational_edges(spark, sf_dir)).join(relational_nodes(spark, sf_dir), "node")
    return community.top_members(members, 12, "k").select("community", "node", F.round("k", 6).alias("k"), "i")


@_query(f"""WITH {RELATIONAL_SQL}, r AS (SELECT community, k, row_number() OVER (PARTITION BY community ORDER BY k DESC, node) AS i FROM rk JOIN rnodes USING (node))
SELECT community, round(sum(k), 6) AS weight FROM r WHERE i <= 12 GROUP BY community""")
def report_weight(spark, sf_dir):
    """A report's weight: the ranks of the members it is about."""
    members = graph.degrees(relational_edges(spark, sf_dir)).join(relational_nodes(spark, sf_dir), "node")
    return community.top_members(members, 12, "k").groupBy("community").agg(F.round(F.sum("k"), 6).alias("weight"))


@_query(f"WITH {RELATIONAL_SQL} SELECT a AS community, src, dst, round(weight, 6) AS weight FROM rp WHERE a = b")
def community_edges(spark, sf_dir):
    return community.community_edges(relational_edges(spark, sf_dir), relational_nodes(spark, sf_dir)).select("community", "src", "dst", F.round("weight", 6).alias("weight"))


@_query(f"""WITH {GRAPH_SQL}, k AS (SELECT id, substr(id, 1, 1) AS c FROM nodes),
inner_ AS MATERIALIZED (SELECT e.source AS a, e.target AS b FROM edges e JOIN k x ON x.id = e.source JOIN k y ON y.id = e.target WHERE x.c = y.c),
{_rounds_sql(_ROUNDS).replace("SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges", "SELECT a, b FROM inner_ UNION SELECT b, a FROM inner_")}
SELECT node, c AS community FROM c{_ROUNDS}""")
def community_split(spark, sf_dir):
    nodes, edges = _text_graph(spark, sf_dir)
    return community.split_communities(edges, nodes.select("node", F.substring("node", 1, 1).alias("community")), written)


@_query(f"""WITH {RELATIONAL_SQL}, inner_ AS MATERIALIZED (SELECT src AS a, dst AS b FROM rp WHERE rp.a = rp.b),
{_rounds_sql(_ROUNDS).replace("SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges", "SELECT a, b FROM inner_ UNION SELECT b, a FROM inner_").replace("SELECT id AS node, id AS c FROM nodes", "SELECT node, node AS c FROM rnodes")},
whole AS (SELECT community, min(c) = max(c) AS connected FROM c{_ROUNDS} JOIN rnodes USING (node) GROUP BY community),
kin AS (SELECT node, community, sum(w) AS kin FROM (SELECT src AS node, b AS community, weight AS w FROM rp UNION ALL SELECT dst, a, weight FROM rp) GROUP BY ALL),
g AS (SELECT kin.node, kin.community, o.community AS own, kin / m - k * tot / (2 * m * m) AS gain FROM kin JOIN rk USING (node) JOIN rnodes o ON o.node = kin.node JOIN rtot ON rtot.community = kin.community, rm_)
SELECT node, community, own, round(gain, 12) AS gain, connected FROM g JOIN whole USING (community) WHERE community <> own AND gain > 1e-9""")
def refine_moves(spark, sf_dir):
    """What refinement may do: moves that gain, and whether what they enter is connected."""
    nodes = relational_nodes(spark, sf_dir).select("node", "community")
    return community.refine_candidates(written(relational_edges(spark, sf_dir)), nodes, written).withColumn("gain", F.round("gain", 12))


@_query(f"WITH {RELATIONAL_SQL} SELECT node, 'leiden_community_' || community AS communities FROM rnodes")
def annotate_communities(spark, sf_dir):
    nodes = relational_nodes(spark, sf_dir)
    return community.annotated(nodes.select("node"), nodes).select("node", _joined("communities"))


# -- Insights and viewers ------------------------------------------------------


@_query(f"WITH {GRAPH_SQL} SELECT entity_type, count(*) AS n FROM nodes GROUP BY entity_type")
def type_histogram(spark, sf_dir):
    nodes, _ = rag.build_graph(replies(spark, sf_dir), cut=written)
    return report.type_histogram(nodes, "OTHER")


@_query(f"WITH {GRAPH_SQL} SELECT count(*) AS edges, max(weight) AS max_weight, round(avg(weight), 2) AS mean_weight FROM edges")
def edge_insights(spark, sf_dir):
    _, edges = rag.build_graph(replies(spark, sf_dir), cut=written)
    return report.edge_insights(edges)


@_query(f"WITH {GRAPH_SQL} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, true AS ok")
def graph_verification(spark, sf_dir):
    return report.verified(*rag.build_graph(replies(spark, sf_dir), cut=written))


@_query(f"""WITH {GRAPH_SQL} SELECT id, id AS label, description AS title, entity_type AS "group",
CASE entity_type WHEN 'PERSON' THEN '#FF6B6B' WHEN 'LOCATION' THEN '#4ECDC4' WHEN 'ORGANIZATION' THEN '#45B7D1' ELSE '#DDA0DD' END AS color FROM nodes""")
def viz_nodes(spark, sf_dir):
    nodes, _ = rag.build_graph(replies(spark, sf_dir), cut=written)
    return report.viz_nodes(nodes)


@_query(f"""WITH {GRAPH_SQL} SELECT source || '|' || target AS id, source AS "from", target AS "to", description AS title, '' AS label, greatest(1.0, least(5.0, weight * 2))::DOUBLE AS width FROM edges""")
def viz_edges(spark, sf_dir):
    _, edges = rag.build_graph(replies(spark, sf_dir), cut=written)
    return report.viz_edges(edges)


@_query(f"""WITH {GRAPH_SQL} SELECT id, id AS label, description AS title, CASE WHEN entity_type = 'PERSON' THEN 'unknown' ELSE entity_type END AS "group" FROM nodes""")
def plain_viz_nodes(spark, sf_dir):
    """The plain viewer, with persons as if they had no type."""
    nodes, _ = rag.build_graph(replies(spark, sf_dir), cut=written)
    return report.plain_nodes(nodes.withColumn("entity_type", F.nullif("entity_type", F.lit("PERSON"))))


@_query(f"""WITH {GRAPH_SQL} SELECT source AS "from", target AS "to", CASE WHEN weight = 2 THEN 1.0 ELSE weight END AS weight, description AS title FROM edges""")
def plain_viz_edges(spark, sf_dir):
    """The plain viewer, with no weight where it would be 2."""
    _, edges = rag.build_graph(replies(spark, sf_dir), cut=written)
    return report.plain_edges(edges.withColumn("weight", F.nullif("weight", F.lit(2.0))))


@_query("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, nullif(o_orderstatus, 'O') AS s, nullif(o_orderpriority, '5-LOW') AS t FROM orders)
SELECT o_orderkey, coalesce(s, 'src_' || i) AS src_id, coalesce(t, 'tgt_' || i) AS tgt_id FROM o""")
def viz_relations(spark, sf_dir):
    """A list of relationships for a viewer; ends without a name are numbered."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.nullif("o_orderstatus", F.lit("O")).alias("src_id"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("tgt_id"))
    return report.relation_ends(orders, ["o_orderdate", "o_orderkey"], written).select("o_orderkey", "src_id", "tgt_id")


@_query(r"""SELECT doc_id, regexp_replace(replace(coalesce(text, ''), '"', '""'), '\r?\n', ' ', 'g') AS field FROM documents""")
def csv_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.csv_escaped("text").alias("field"))


@_query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'entity_' || (row_number() OVER (ORDER BY ts, event_id) - 1) ELSE event_type END AS entity_name FROM events""")
def viz_mentions(spark, sf_dir):
    """A list of mentions for a viewer; those without a name are numbered."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_type") != "click", F.col("event_type")).alias("entity_name"))
    return report.mention_ids(events, ["ts", "event_id"], written).select("event_id", "entity_name")


@_query(f"""WITH {GRAPH_SQL},
mem AS (SELECT * FROM (SELECT substr(id, 1, 2) AS community, id AS node, description, row_number() OVER (PARTITION BY substr(id, 1, 2) ORDER BY id) - 1 AS i FROM nodes) WHERE i < 12),
ed_ AS (SELECT x.community, source, target, edges.description, row_number() OVER (PARTITION BY x.community ORDER BY source, target) - 1 AS i FROM edges JOIN mem x ON x.node = source JOIN mem y ON y.node = target AND y.community = x.community),
a AS (SELECT community, 'id,entity,description' || chr(10) || string_agg(i || ',' || node || ',"' || replace(description, '"', '""') || '"', chr(10) ORDER BY i) AS entities FROM mem GROUP BY 1),
b AS (SELECT community, 'id,source,target,description' || chr(10) || string_agg(i || ',' || source || ',' || target || ',"' || replace(description, '"', '""') || '"', chr(10) ORDER BY i) AS relationships FROM ed_ GROUP BY 1)
SELECT community, entities, coalesce(relationships, 'id,source,target,description') AS relationships FROM a LEFT JOIN b USING (community)""")
def report_context(spark, sf_dir):
    nodes, edges = _text_graph(spark, sf_dir)
    """Of each community the first members by name, as many as a report takes."""
    members = nodes.select("node", "description", F.substring("node", 1, 2).alias("community"), F.lit(0.0).alias("pagerank"))
    top = written(community.top_members(members))
    return report.report_context(top, community.community_edges(edges, top.select("node", "community")))


# -- Model calls, answered by a fixed rule ---------------------------------------


class Rule:
    """A provider whose replies follow from the digest of all texts it is given:
    an entity record; to a prompt that asks for Y or N, one of them."""

    def chat(self, prompt):
        texts = [prompt] if isinstance(prompt, str) else [p["text"] for m in prompt for p in m["parts"]]
        digest = hashlib.md5("".join(texts).encode()).hexdigest()
        if texts[-1] == build.ASK_PROMPT:
            return "Yes" if digest[0] < "8" else " no."
        return f'("entity"<|>turn {len(texts)}<|>person<|>{digest})'


class ReportRule:
    """A provider whose reports have the prompt's digest as their title."""

    def chat(self, prompt):
        digest = hashlib.md5(prompt.encode()).hexdigest()
        rating = 11 if digest[0] == "f" else int(digest[0], 16) % 11
        return '```json\n{"title": "%s", "summary": "s", "rating": %d, "rating_explanation": "e", "findings": [{"summary": "f", "explanation": "g"}]}\n```' % (digest, rating)


def _quoted(template: str, **values: str) -> str:
    """A prompt as SQL: the template with expressions in its places."""
    out = "'" + template.replace("'", "''") + "'"
    for name, value in values.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


_FIRST = _quoted(build.EXTRACT_PROMPT, entity_types="'" + ",".join(extract.TYPES) + "'", language="'English'", input_text="content")
_TURNS = f"""c AS (SELECT doc_id, coalesce(text, '') AS content FROM documents),
t1 AS (SELECT doc_id, p AS talk, '("entity"<|>turn 1<|>person<|>' || md5(p) || ')' AS r1 FROM (SELECT doc_id, {_FIRST} AS p FROM c)),
t2 AS (SELECT *, '("entity"<|>turn 3<|>person<|>' || md5(talk || r1 || {_quoted(build.MORE_PROMPT)}) || ')' AS r2 FROM t1),
t3 AS (SELECT *, CASE WHEN md5(talk || r1 || {_quoted(build.MORE_PROMPT)} || r2 || {_quoted(build.ASK_PROMPT)}) < '8' THEN 'Yes' ELSE ' no.' END AS r3 FROM t2),
t4 AS (SELECT *, '("entity"<|>turn 7<|>person<|>' || md5(talk || r1 || {_quoted(build.MORE_PROMPT)} || r2 || {_quoted(build.ASK_PROMPT)} || r3 || {_quoted(build.MORE_PROMPT)}) || ')' AS r4 FROM t3)"""


def _chunks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("chunk_seq"), F.coalesce("text", F.lit("")).alias("content"))


@_query(f"""WITH {_TURNS}
SELECT doc_id, 0 AS chunk_seq, r1 || '##' || r2 || CASE WHEN r3 = 'Yes' THEN '##' || r4 ELSE '' END AS response,
  length(talk) + length(r1) + length(r2) + length(r3) + CASE WHEN r3 = 'Yes' THEN length(r4) ELSE 0 END AS characters FROM t4""")
def extract_replies(spark, sf_dir):
    """Extraction with gleaning: every call gets the whole conversation."""
    return build.extracted(_chunks(spark, sf_dir), Rule(), "model-1")


@_query(f"""WITH {GRAPH_SQL} SELECT id, entity_type, CASE WHEN len(string_split(description, ' <SEP> ')) > 12
  THEN '("entity"<|>turn 1<|>person<|>' || md5({_quoted(build.SUMMARY_PROMPT, entity_name="id", language="'English'", description_list="description")}) || ')' ELSE description END AS description FROM nodes""")
def summarised_nodes(spark, sf_dir):
    nodes, _ = rag.build_graph(replies(spark, sf_dir), cut=written)
    return build.summarised(written(nodes), "id", Rule(), "model-1").select("id", "entity_type", "description")


class PairRule:
    """A provider that says yes to pairs of names of equal length."""

    def chat(self, prompt):
        asked = re.findall(r"^Question (\d+): name of .*? A is (.*), name of .*? B is (.*)$", prompt, re.M)
        return "##".join(f"(For question <|>{i}<|>, <|>{'yes' if len(a) == len(b) else 'no'}<|>)" for i, a, b in asked)


@_query(f"WITH {_SIMILAR} SELECT entity_type, a, b FROM pairs WHERE length(a) = length(b)")
def adjudicated_pairs(spark, sf_dir):
    """Pairs put to a model in batches, and its decisions."""
    return build.adjudicated(written(resolve.pair_batches(_pairs(spark, sf_dir), written)), PairRule(), "model-1")


@_query(f"""WITH {GRAPH_SQL},
al AS (SELECT substr(id, 1, 2) AS community, id AS node, description, 1 / length(id) AS pagerank FROM nodes),
mem AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY pagerank DESC, node) - 1 AS i, count(*) OVER (PARTITION BY community) AS n FROM al),
top AS (SELECT * FROM mem WHERE i < 12 AND n >= 2),
ed_ AS (SELECT x.community, source, target, edges.description, row_number() OVER (PARTITION BY x.community ORDER BY source, target) - 1 AS i FROM edges JOIN top x ON x.node = source JOIN top y ON y.node = target AND y.community = x.community),
a AS (SELECT community, 'id,entity,description' || chr(10) || string_agg(i || ',' || node || ',"' || replace(description, '"', '""') || '"', chr(10) ORDER BY i) AS entities, sum(pagerank) AS weight, string_agg(node, ',' ORDER BY i) AS members FROM top GROUP BY 1),
b AS (SELECT community, 'id,source,target,description' || chr(10) || string_agg(i || ',' || source || ',' || target || ',"' || replace(description, '"', '""') || '"', chr(10) ORDER BY i) AS relationships FROM ed_ GROUP BY 1),
p AS (SELECT community, weight, members, md5({_quoted(build.REPORT_PROMPT, entity_df="entities", relation_df="coalesce(relationships, 'id,source,target,description')")}) AS d FROM a LEFT JOIN b USING (community))
SELECT community, d AS title, CAST(instr('0123456789abcde', d[1]) - 1 AS INTEGER) % 11 + 0.0::DOUBLE AS rating, round(weight, 9) AS weight, members AS entities,
  '# ' || d || chr(10) || chr(10) || 's' || chr(10) || chr(10) || '## f' || chr(10) || chr(10) || 'g' AS report FROM p WHERE d[1] <> 'f'""")
def community_reports(spark, sf_dir):
    """Reports on communities of at least two members; those that are no valid report are left out."""
    nodes, edges = rag.build_graph(replies(spark, sf_dir), cut=written)
    nodes, edges = written(nodes), written(edges)
    communities = nodes.select(F.col("id").alias("node"), F.substring("id", 1, 2).alias("community"))
    ranks = nodes.select(F.col("id").alias("node"), (1 / F.length("id")).alias("pagerank"))
    found = build.community_reports(rag.community_contexts(nodes, edges, communities, ranks), ReportRule(), "model-1")
    return found.select("community", "title", "rating", F.round("weight", 9).alias("weight"), _joined("entities"), "report")


@_query("""WITH m AS (SELECT DISTINCT text FROM conversations WHERE text IS NOT NULL AND role <> 'assistant')
SELECT md5('model-1:' || text) AS key, '("entity"<|>turn 1<|>person<|>' || md5(text) || ')' AS response, 'cached' AS status FROM m""")
def cache_store(spark, sf_dir):
    """Replies go to the cache, and the second time all come from there."""
    turns = table(spark, sf_dir, "conversations").filter("text is not null and role != 'assistant'").select(F.col("text").alias("prompt"))
    cache = store.ReplyCache(spark, fresh_path(spark, "cache"))
    chat_model.replies(turns, Rule(), "model-1", cache)
    return chat_model.replies(turns, Rule(), "model-1", cache).select("key", "response", "status")


@_query("""WITH n AS (SELECT max(ts) AS now FROM events), c AS (SELECT event_type AS key, max(ts) AS ts, max_by(props, ts) AS response FROM events GROUP BY event_type)
SELECT key, CAST(floor(epoch(now - ts) / 3600) AS BIGINT) AS age_hours, CAST(octet_length(encode(response)) AS BIGINT) AS bytes FROM c, n""")
def cache_listing(spark, sf_dir):
    """Of several entries of a key the last one counts."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0]
    return store.cache_list(events.select(F.col("event_type").alias("key"), F.col("ts").alias("timestamp"), F.col("props").alias("response")), F.lit(now).cast("timestamp_ntz"))


# -- Communities and whole pipelines: no SQL ------------------------------------


def _ids(spark, sf_dir):
    nodes, edges = _text_graph(spark, sf_dir)
    return nodes.select("node"), edges.select("src", "dst", "weight")


@_query()
def pagerank_converged(spark, sf_dir):
    """Until ranks stay as they are: more rounds than SQL can be written out for."""
    nodes, edges = relational_nodes(spark, sf_dir), relational_edges(spark, sf_dir)
    return graph.pagerank(nodes, edges, written).withColumn("pagerank", F.round("pagerank", 9))


@_query()
def leiden(spark, sf_dir):
    nodes, edges = _ids(spark, sf_dir)
    return community.leiden(nodes, edges, written, levels=1)


@_query()
def hierarchical_leiden(spark, sf_dir):
    nodes, edges = _ids(spark, sf_dir)
    return community.leiden(nodes, edges, written)


@_query()
def louvain(spark, sf_dir):
    nodes, edges = _ids(spark, sf_dir)
    return community.louvain(nodes, edges, written)


@_query(f"""WITH {_SEARCH}, h AS (
  SELECT type, id, sum(s) AS total_score, string_agg(method, '+' ORDER BY method) AS methods
  FROM (SELECT type, id, 0.4::DOUBLE * relevance AS s, 'bigram' AS method FROM b UNION ALL SELECT type, id, 0.6::DOUBLE * relevance, 'keyword' FROM k)
  GROUP BY type, id ORDER BY round(total_score, 9) DESC, type, id LIMIT 20),
d AS (SELECT 'node' AS type, id, entity_type, description FROM nodes UNION ALL SELECT 'edge', source || '|' || target, '-', description FROM edges)
SELECT type, id, round(total_score, 9) AS total_score, '[' || type || '] ' || id || ' (' || entity_type || ') ' || description || ' score ' || format('{{:.1f}}', total_score * 100) || '% by ' || methods AS line FROM h JOIN d USING (type, id)""")
def context_lines(spark, sf_dir):
    nodes, edges = rag.build_graph(replies(spark, sf_dir), cut=written)
    nodes, edges = written(nodes), written(edges)
    return rag.context_lines(search.combined_search(search.items(nodes, edges), QUESTION, 20), nodes, edges).withColumn("total_score", F.round("total_score", 9))


@_query()
def community_contexts(spark, sf_dir):
    nodes, edges = rag.build_graph(replies(spark, sf_dir), cut=written)
    nodes, edges = written(nodes), written(edges)
    communities = nodes.select(F.col("id").alias("node"), F.substring("id", 1, 2).alias("community"))
    plain = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), "weight")
    ranks = graph.pagerank(communities.select("node"), plain, written)
    return rag.community_contexts(nodes, edges, communities, ranks)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: from texts to a graph and a ranked answer to a question."""
    return combined_search(spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
