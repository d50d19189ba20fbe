"""A knowledge base under one folder: from texts to stored graphs, and from stored
graphs to answers.

The graph as extracted and the graph as resolved are kept both, each with an index
that follows it; questions go to the resolved one by default. Replies are cached
as they come, so a build that was stopped goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators.graph import Cut
from graphloom.plans import build, rag
from graphloom.plans.chat_model import Provider
from graphloom.sources.search_index import SearchIndex
from graphloom.sources.shared import written
from graphloom.sources.store import GraphStore, ReplyCache, Versions

#: Tables of a build that are kept beside its graphs.
TABLES = ("names", "pagerank", "communities", "reports")


class KnowledgeBase:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.cache = ReplyCache(spark, f"{self.path}/replies")
        self.stores = {kind: GraphStore(spark, f"{self.path}/{kind}") for kind in ("extracted", "resolved")}
        self.indexes = {kind: SearchIndex(spark, f"{self.path}/{kind}-index") for kind in self.stores}

    def build(self, chunks: DataFrame, provider: Provider, model: str, cut: Cut = written, **options) -> None:
        """Build from chunks, and put the results in place of what is there."""
        found = build.built(chunks, provider, model, cut, cache=self.cache, **options)
        self.stores["extracted"].write(found["nodes"], found["edges"])
        self.stores["resolved"].write(found["resolved_nodes"], found["resolved_edges"])
        for name in TABLES:
            versions = Versions(self.spark, f"{self.path}/{name}", "_SUCCESS")
            found[name].write.parquet(versions.new())
            versions.tidy()
        self.follow()

    def follow(self) -> None:
        """Bring the indexes to the state of the graphs, after upserts too."""
        for kind, index in self.indexes.items():
            index.follow(self.stores[kind])

    def graph(self, resolved: bool = True) -> tuple[DataFrame, DataFrame]:
        return self.stores["resolved" if resolved else "extracted"].read()

    def table(self, name: str) -> DataFrame:
        """One of TABLES, of the last build."""
        return self.spark.read.parquet(Versions(self.spark, f"{self.path}/{name}", "_SUCCESS").last())

    def answer(self, question: str, provider: Provider, resolved: bool = True, **options) -> dict:
        """As ``rag.answer``, from the stored graph and its index."""
        return rag.answer(question, *self.graph(resolved), provider, idx=self.indexes["resolved" if resolved else "extracted"], **options)
