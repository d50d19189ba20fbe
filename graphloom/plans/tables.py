"""The given tables as inputs of the graph engine.

*Text graph*: each line of a document is a chunk; capitalised words are its
entities, two that follow one another in a line are related. They are put into
the record format that a model would reply in, so that the parsers are used.

*Relational graph*: suppliers and parts linked by quantities, customers and
suppliers linked to nations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.shared import spread, table

KIND = ("person", "organization", "location")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, chunk_seq, response)``."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    docs = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("chunk_seq", "line"))
    # Between spaces, and without what follows the last letter.
    name = r"(?<![^ ])([A-Z][a-z]{3,})[^A-Za-z ]*(?![^ ])"
    chunks = docs.filter(F.col("line").rlike(name)).withColumn("names", F.regexp_extract_all("line", F.lit(name), F.lit(1)))
    kind = F.array(*map(F.lit, KIND))
    entity = F.transform("names", lambda n: F.concat(F.lit('("entity"<|>'), n, F.lit("<|>"), F.get(kind, (F.length(n) + F.length("source")) % 3), F.lit("<|>"), F.col("lang"), F.lit(" "), F.col("source"), F.lit(")")))
    pairs = F.arrays_zip(F.slice("names", F.lit(1), F.size("names") - 1).alias("a"), F.slice("names", F.lit(2), F.size("names") - 1).alias("b"))
    relation = F.transform(pairs, lambda p: F.concat(F.lit('("relationship"<|>'), p["a"], F.lit("<|>"), p["b"], F.lit("<|>"), F.col("lang"), F.lit("<|>"), F.col("source"), F.lit("<|>1)")))
    return chunks.select("doc_id", "chunk_seq", F.array_join(F.concat(entity, relation), "##").alias("response"))


#: The same in SQL: CTEs ``names``, ``em`` (entity mentions), ``rm`` (relation mentions).
MENTIONS_SQL = r"""
lines AS (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
         unnest(range(0, len(string_split(text, chr(10))))) AS chunk_seq
  FROM documents),
toks AS (
  SELECT doc_id, lang, source, chunk_seq, unnest(string_split(line, ' ')) AS raw,
         unnest(range(0, len(string_split(line, ' ')))) AS p
  FROM lines),
clean AS (SELECT doc_id, lang, source, chunk_seq, p, regexp_replace(raw, '[^A-Za-z]+\z', '') AS tok FROM toks),
names AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_seq ORDER BY p) - 1 AS k
  FROM clean WHERE regexp_matches(tok, '\A[A-Z][a-z]{3,}\z')),
em AS (
  SELECT doc_id, chunk_seq, k AS rec_seq, doc_id * 1000000000000 + chunk_seq * 1000000 + k AS pos, upper(tok) AS entity_name,
         CASE (length(tok) + length(source)) % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORGANIZATION' ELSE 'LOCATION' END AS entity_type,
         lang || ' ' || source AS description, CAST(doc_id AS VARCHAR) AS source_id
  FROM names),
rm AS (
  SELECT a.doc_id, a.chunk_seq, a.doc_id * 1000000000000 + a.chunk_seq * 1000000 + a.k AS pos,
         least(upper(a.tok), upper(b.tok)) AS src_id, greatest(upper(a.tok), upper(b.tok)) AS tgt_id, CAST(1.0 AS DOUBLE) AS weight,
         a.lang AS description, a.source AS keywords, CAST(a.doc_id AS VARCHAR) AS source_id
  FROM names a JOIN names b ON a.doc_id = b.doc_id AND a.chunk_seq = b.chunk_seq AND b.k = a.k + 1)
"""


def _first_seen_sql(name: str, rel: str, key: str, value: str, glue: str) -> str:
    return f"{name} AS (SELECT {key}, string_agg({value}, '{glue}' ORDER BY at_) AS v FROM (SELECT {key}, {value}, min(pos) AS at_ FROM {rel} GROUP BY ALL) GROUP BY ALL)"


#: Adds ``nodes(id, entity_type, description, source_ids)`` and ``edges(source,
#: target, description, weight, keywords, source_ids)``, lists joined by commas.
GRAPH_SQL = MENTIONS_SQL + ",\n" + ",\n".join([
    """votes AS (SELECT entity_name, entity_type, row_number() OVER (PARTITION BY entity_name ORDER BY n DESC, at_ DESC) AS r
       FROM (SELECT entity_name, entity_type, count(*) AS n, min(pos) AS at_ FROM em GROUP BY ALL))""",
    _first_seen_sql("nd", "em", "entity_name", "description", " <SEP> "),
    _first_seen_sql("ns", "em", "entity_name", "source_id", ","),
    """nodes AS (SELECT v.entity_name AS id, v.entity_type, nd.v AS description, ns.v AS source_ids
       FROM votes v JOIN nd USING (entity_name) JOIN ns USING (entity_name) WHERE v.r = 1)""",
    "es AS (SELECT src_id, tgt_id, sum(weight) AS weight FROM rm GROUP BY ALL)",
    _first_seen_sql("ed", "rm", "src_id, tgt_id", "description", " <SEP> "),
    _first_seen_sql("ek", "rm", "src_id, tgt_id", "keywords", ","),
    _first_seen_sql("ei", "rm", "src_id, tgt_id", "source_id", ","),
    """edges AS (SELECT es.src_id AS source, es.tgt_id AS target, ed.v AS description, es.weight, ek.v AS keywords, ei.v AS source_ids
       FROM es JOIN ed USING (src_id, tgt_id) JOIN ek USING (src_id, tgt_id) JOIN ei USING (src_id, tgt_id))""",
])


def relational_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src, dst, weight)``, one row per pair, src before dst."""
    prefixed = lambda p, c: F.concat(F.lit(p + ":"), F.col(c).cast("string"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("weight"))
    parts = [
        lines.select(prefixed("P", "l_partkey").alias("src"), prefixed("S", "l_suppkey").alias("dst"), "weight"),
        table(spark, sf_dir, "customer").select(prefixed("C", "c_custkey").alias("src"), prefixed("N", "c_nationkey").alias("dst"), F.lit(1.0).alias("weight")),
        table(spark, sf_dir, "supplier").select(prefixed("N", "s_nationkey").alias("src"), prefixed("S", "s_suppkey").alias("dst"), F.lit(1.0).alias("weight")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def relational_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(node, community)``: the given communities are nations, and a part's
    size modulo 25."""
    read = lambda name, p, key, c: table(spark, sf_dir, name).select(F.concat(F.lit(p + ":"), F.col(key).cast("string")).alias("node"), (F.col(c) % 25).cast("string").alias("community"))
    return (
        read("customer", "C", "c_custkey", "c_nationkey").unionByName(read("supplier", "S", "s_suppkey", "s_nationkey"))
        .unionByName(read("nation", "N", "n_nationkey", "n_nationkey")).unionByName(read("part", "P", "p_partkey", "p_size"))
    )


RELATIONAL_SQL = """
redges AS (
  SELECT 'P:' || l_partkey AS src, 'S:' || l_suppkey AS dst, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL
  UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey, 1.0 FROM customer
  UNION ALL SELECT 'N:' || s_nationkey, 'S:' || s_suppkey, 1.0 FROM supplier),
rnodes AS (
  SELECT 'C:' || c_custkey AS node, CAST(c_nationkey % 25 AS VARCHAR) AS community FROM customer
  UNION ALL SELECT 'S:' || s_suppkey, CAST(s_nationkey % 25 AS VARCHAR) FROM supplier
  UNION ALL SELECT 'N:' || n_nationkey, CAST(n_nationkey % 25 AS VARCHAR) FROM nation
  UNION ALL SELECT 'P:' || p_partkey, CAST(p_size % 25 AS VARCHAR) FROM part),
rk AS (SELECT node, sum(weight) AS k FROM (SELECT src AS node, weight FROM redges UNION ALL SELECT dst, weight FROM redges) GROUP BY node),
rm_ AS (SELECT sum(weight) AS m FROM redges),
rp AS (SELECT e.src, e.dst, e.weight, a.community AS a, b.community AS b FROM redges e JOIN rnodes a ON e.src = a.node JOIN rnodes b ON e.dst = b.node),
rtot AS (SELECT community, sum(k) AS tot FROM rk JOIN rnodes USING (node) GROUP BY community)
"""
