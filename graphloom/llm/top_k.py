"""Exact top-k search by a pivot table.

1. *Pivots.* Some vectors that lie far apart, picked from a fixed sample, and the
   origin. A pivot's distances to a query and a row differ by at most their own
   distance, so the greatest difference over all pivots bounds that distance from
   below, and with the lengths the inner product from above.
2. *Thresholds.* Each query's k-th best score within the sample is a first bound
   of its k-th best score in all.
3. *Elimination.* A block of rows holds its table of distances to the pivots.
   For each query, rows whose bound is under the threshold are gone; the others
   are scored in order of their bounds, and the threshold rises with the k-th
   best found, until the next bound is under it. That stop is exact: bounds of
   the rest are no higher.
4. *Merging.* At most k rows for each query and block are shuffled and ranked.

Defined results: see ``vectors`` for rows that take no part; a row with the
query's own id is its own; repeated rows are rows of their own; of several query
rows with one id that with the smallest vector asks; equal scores come by id;
fewer than k rows give all. An empty table gives no rows. Other columns aren't
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import vectors as V
from graphloom.llm.shared import PRIVATE, written

_LEAST = PRIVATE + "least"

#: Pivots, besides the origin.
PIVOTS = 32


def far_apart(sample: np.ndarray, number: int) -> np.ndarray:
    """Pivots: the first row, then again and again that farthest from all so far."""
    if not len(sample):
        return sample
    held = sample.astype(np.float64)
    chosen, away = [], np.full(len(held), np.inf)
    for _ in range(min(number, len(held))):
        at = int(np.argmax(away)) if chosen else 0
        if away[at] == 0:
            break
        chosen.append(at)
        away = np.minimum(away, ((held - held[at]) ** 2).sum(1))
    return held[chosen]


class PivotTable:
    """A block of rows with its distances to pivots."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, pivots: np.ndarray):
        self.ids, self.rows, self.pivots = ids, rows, pivots
        held = rows.astype(np.float64)
        self.squares = (held**2).sum(1)
        self.distances = np.stack([np.sqrt(self.squares), *(np.sqrt(((held - p) ** 2).sum(1)) for p in pivots)])

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """No row's inner product is higher than its bound."""
        held = query.astype(np.float64)
        square = (held**2).sum()
        to = np.sqrt([square, *((self.pivots - held) ** 2).sum(1)])
        apart = np.abs(self.distances[0] - to[0])
        for own, there in zip(self.distances[1:], to[1:]):
            np.maximum(apart, np.abs(own - there), out=apart)
        both = self.squares + square
        # With what doubles may have rounded away; scores end at the lowest long.
        return np.maximum((both - apart**2) / 2 + 1e-9 * both, float(V.LOWEST))

    def search(self, own: int, query: np.ndarray, k: int, least: int = V.LOWEST, first: int = 64) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and ids of the k best rows that score ``least`` or more, and
        how many rows were scored."""
        bound = self.bounds(query)
        left = np.flatnonzero(bound >= least)
        left = left[np.argsort(-bound[left], kind="stable")]
        score, ids, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, first
        while at < len(left) and bound[left[at]] >= least:
            rows = left[at : at + step]
            rows = rows[: np.searchsorted(-bound[rows], -float(least), side="right")]
            at, step = at + len(rows), step * 2
            new = V.scores(self.rows[rows], query)
            fits = (new >= least) & (self.ids[rows] != own)
            score, ids = V.best(np.concatenate([score, new[fits]]), np.concatenate([ids, self.ids[rows][fits]]), k)
            if len(score) == k:
                least = max(least, int(score[-1]))
        return score, ids, at


def top_k(df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row for which ``is_query``
    holds the k other rows of highest integer inner product."""
    rows = V.quantised(df, id_col, vector_col, asks=is_query)
    known = V.shape(rows)
    sample = V.sampled(rows)
    sample_ids, sample_rows = V.numbers(sample, V.ID), V.matrix(V.column(sample, V.VECTOR), known)
    chosen = far_apart(sample_rows, pivots)

    def first_thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PivotTable(sample_ids, sample_rows, chosen)
        for batch in batches:
            least = []
            for own, query in zip(V.numbers(batch, V.ID), V.matrix(V.column(batch, V.VECTOR), known)):
                found, _, _ = table.search(own, query, k)
                least.append(int(found[-1]) if len(found) == k else V.LOWEST)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least, pa.int64())], names=[V.ID, V.VECTOR, _LEAST])

    queries = V.one_each(rows.filter("asks").select(V.ID, V.VECTOR))
    queries = written(queries.mapInArrow(first_thresholds, f"{V.ID} long, {V.VECTOR} array<long>, {_LEAST} long"), "top-k-queries")
    path = queries._written_to

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in V.blocks(batches):
            table = PivotTable(V.numbers(block, V.ID), V.matrix(V.column(block, V.VECTOR), known), chosen)
            for asked in V.stored(path):
                found = []
                for own, query, least in zip(V.numbers(asked, V.ID), V.matrix(V.column(asked, V.VECTOR), known), V.numbers(asked, _LEAST)):
                    score, ids, _ = table.search(own, query, k, int(least))
                    found.append((np.full(len(ids), own), ids, score))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], names=["query_id", "vec_id", "score"])

    cores = df.sparkSession.sparkContext.defaultParallelism
    hits = rows.select(V.ID, V.VECTOR).repartition(known.parts(cores)).mapInArrow(search, "query_id long, vec_id long, score long")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
