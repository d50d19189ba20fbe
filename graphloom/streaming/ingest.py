"""Incremental ingest: new replies stream into the stored graph.

An addition of this engine: each micro-batch is parsed and merged like a whole
load and replaces the nodes and edges that it names, as an upsert does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from graphloom.plans.rag import build_graph
from graphloom.sources.shared import written
from graphloom.sources.store import GraphStore

REPLIES = "doc_id long, chunk_seq int, response string"


def ingest(replies: DataFrame, store: GraphStore, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start the stream of replies into the store; with ``once``, all that is
    there now is taken and the query ends."""

    def put(batch: DataFrame, number: int) -> None:
        # Parsed once, and put in by its keys only.
        nodes, edges = build_graph(batch, cut=written)
        store.upsert(nodes, edges)

    writer = replies.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
