"""A training corpus from raw documents: five stages, each one of the
training-data operators. Each takes the rows that its predecessor kept, with
the columns of ``documents``; the last one returns the packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, near_dup, packing, pii, quality, vocab
from graphloom.llm.shared import table, written

#: Texts that score less go.
LEAST_QUALITY = 0.3
#: Tokens in a training sequence.
SEQUENCE = 2048


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    net = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.rejecting(docs, net, LEAST_QUALITY)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the smallest id stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group stays."""
    return near_dup.drop_near_copies(docs)


def remove_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: personal data and terms that disclose it leave the texts."""
    clean = pii.sanitised(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences."""
    path = vocab.default_path("byte_bpe_50k.json")
    return packing.pack_documents(docs, lambda: vocab.json_ids(path), capacity=SEQUENCE)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram jaccard join", drop_near),
    ("pii", remove_personal),
    ("best-fit packing", pack),
]

#: SQL can express neither the network, nor MinHash, nor the packing; the
#: pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = written(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
