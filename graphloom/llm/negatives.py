"""Hard negatives by coordinate pruning over length buckets.

For an anchor, its best rows of the same label are its positives; for each of
them the best rows of other labels whose score lies in a window under the
positive's score are its negatives.

1. *Length buckets.* Rows are dealt out by ranges of length, longest first, and
   cut into buckets of nearly equal length; each bucket holds its vectors at
   length 1 and a sorted list of values for each coordinate.
2. *Feasible ranges.* A score of at least ``least`` asks for a cosine of at least
   ``least`` over the lengths of anchor and bucket. That confines a vector to a
   cone around the anchor, thus each coordinate to a range. The anchor's largest
   coordinates are its focus; the parts of their lists within range are found by
   binary search, and their intersection alone is scored. Where the shortest part
   is most of the list, the bucket is scored whole.
3. *Rising thresholds.* A fixed sample gives the first threshold of each anchor
   (of each positive); it rises as rows are found. Buckets that are too short end
   the search of a block.
4. Two passes over the rows, one for positives and one for negatives; each block
   gives at most as many rows for each anchor (positive) as are asked for, and
   these are ranked.

Defined results: see ``vectors`` for rows that take no part, besides those
without a label; rows with an anchor's own id are its own; repeated rows are rows
of their own; of several anchor rows with one id that with the smallest vector,
then label, asks; equal scores come by id; a positive that occurs twice counts
twice among the positives, and its negatives come once. Positives with a negative
score have an empty window. An empty table gives no rows. Other columns aren't
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

_LABEL, _LENGTH, _LEAST, _GOOD = (PRIVATE + x for x in ("label", "length", "least", "good"))

#: Most rows of a bucket, and how much shorter its last row may be.
BUCKET, SHORTER = 2_048, 0.9
#: Coordinates in focus, and the part of a list beyond which it doesn't prune.
FOCUS, WHOLE = 4, 0.5


class Bucket:
    """Rows of nearly equal length, in falling order of length."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, lengths: np.ndarray):
        self.ids, self.rows, self.labels = ids, rows, labels
        self.longest, self.shortest = lengths[0], lengths[-1]
        self.unit = rows.astype(np.float64) / np.maximum(lengths, 1e-300)[:, None]
        self.order = np.argsort(self.unit, axis=0, kind="stable")
        self.lists = np.take_along_axis(self.unit, self.order, axis=0)

    def cosine(self, length: float, least: int) -> float:
        """The least cosine that a row with this score can have."""
        if least <= V.LOWEST:
            return -1.0
        by = length * (self.longest if least > 0 else self.shortest)
        if by == 0:
            return 2.0 if least > 0 else -1.0
        return max(-1.0, least / by - 1e-9)

    def candidates(self, focus: np.ndarray, values: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows within the feasible ranges of all focus coordinates; None for all rows."""
        if cosine <= -1 or not len(focus):
            return None
        cone, at = np.arccos(min(1.0, cosine)), np.arccos(np.clip(values, -1, 1))
        low, high = np.cos(np.minimum(np.pi, at + cone)) - 1e-9, np.cos(np.maximum(0, at - cone)) + 1e-9
        ranges = [(f, np.searchsorted(self.lists[:, f], lo, "left"), np.searchsorted(self.lists[:, f], hi, "right")) for f, lo, hi in zip(focus, low, high)]
        ranges.sort(key=lambda r: r[2] - r[1])
        if ranges[0][2] - ranges[0][1] > WHOLE * len(self.ids):
            return None
        seen = np.zeros(len(self.ids), np.uint8)
        for f, lo, hi in ranges:
            seen[self.order[lo:hi, f]] += 1
        return np.flatnonzero(seen == len(ranges))


class Block:
    """Buckets, longest first."""

    def __init__(self, table: pa.Table, known: V.Shape):
        ids, rows, labels = V.numbers(table, V.ID), V.matrix(V.column(table, V.VECTOR), known), V.numbers(table, _LABEL)
        lengths = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
        order = np.argsort(-lengths, kind="stable")
        ids, rows, labels, lengths = ids[order], rows[order], labels[order], lengths[order]
        self.buckets, at = [], 0
        while at < len(ids):
            end = min(at + BUCKET, int(np.searchsorted(-lengths, -SHORTER * lengths[at], "right")))
            self.buckets.append(Bucket(ids[at:end], rows[at:end], labels[at:end], lengths[at:end]))
            at = end
        self.scored = 0

    def _near(self, query: np.ndarray, least) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, labels and scores of all rows that score ``least()`` or more,
        and of others; what it returns may rise meanwhile."""
        held = query.astype(np.float64)
        length = float(np.sqrt((held**2).sum()))
        focus = np.argsort(-np.abs(held), kind="stable")[:FOCUS] if length else np.empty(0, int)
        for bucket in self.buckets:
            cosine = bucket.cosine(length, least())
            if cosine > 1:
                return  # the others are shorter
            rows = bucket.candidates(focus, held[focus] / length if length else held[focus], cosine)
            ids, labels, vectors = (bucket.ids, bucket.labels, bucket.rows) if rows is None else (bucket.ids[rows], bucket.labels[rows], bucket.rows[rows])
            self.scored += len(ids)
            yield ids, labels, V.scores(vectors, query)

    def positives(self, own: int, query: np.ndarray, label: int, k: int, least: int = V.LOWEST) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best rows of the label that score ``least`` or more."""
        score, found = np.empty(0, np.int64), np.empty(0, np.int64)
        for ids, labels, new in self._near(query, lambda: least):
            fits = (new >= least) & (labels == label) & (ids != own)
            score, found = V.best(np.concatenate([score, new[fits]]), np.concatenate([found, ids[fits]]), k)
            if len(score) == k:
                least = max(least, int(score[-1]))
        return score, found

    def negatives(self, query: np.ndarray, label: int, windows: list[tuple[int, int]], k: int, least: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores the k best rows of other labels within it
        that score that window's ``least`` or more."""
        least = [max(lo, at) for (lo, _), at in zip(windows, least)]
        found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in windows]
        for ids, labels, new in self._near(query, lambda: min(least)):
            fits = (labels != label) & (new >= min(least)) & (new <= max(hi for _, hi in windows))
            ids, new = ids[fits], new[fits]
            for i, (_, high) in enumerate(windows):
                inside = (new >= least[i]) & (new <= high)
                if inside.any():
                    found[i] = V.best(np.concatenate([found[i][0], new[inside]]), np.concatenate([found[i][1], ids[inside]]), k)
                    if len(found[i][0]) == k:
                        least[i] = max(least[i], int(found[i][0][-1]))
        return found


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest score of a positive's negatives, in hundredths of its own."""
    return -(-low * score // 100), high * score // 100


def hard_negatives(
    df: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.
    A negative's score is from ``low`` to ``high`` hundredths of the positive's."""
    rows = V.quantised(df, id_col, vector_col, **{_LABEL: label.cast("long"), "asks": is_anchor}).filter(F.col(_LABEL).isNotNull())
    known = V.shape(rows)
    sample = V.sampled(rows, _LABEL)

    def first_thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(sample, known)
        for batch in batches:
            least = []
            for own, query, kind in _asked(batch, known):
                found, _ = block.positives(own, query, kind, positives)
                least.append(int(found[-1]) if len(found) == positives else V.LOWEST)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (V.ID, V.VECTOR, _LABEL)), pa.array(least, pa.int64())], names=[V.ID, V.VECTOR, _LABEL, _LEAST])

    shared = f"{V.ID} long, {V.VECTOR} array<long>, {_LABEL} long"
    anchors = V.one_each(rows.filter("asks").select(V.ID, V.VECTOR, _LABEL))
    anchors = written(anchors.mapInArrow(first_thresholds, f"{shared}, {_LEAST} long"), "negatives-anchors")
    path = anchors._written_to

    length = F.aggregate(V.VECTOR, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    parts = known.parts(df.sparkSession.sparkContext.defaultParallelism)
    # By ranges of length; ids part what is equally long.
    dealt = rows.select(V.ID, V.VECTOR, _LABEL, length.alias(_LENGTH)).repartitionByRange(parts, F.desc(_LENGTH), F.xxhash64(V.ID))
    dealt = written(dealt.select(V.ID, V.VECTOR, _LABEL), "negatives-rows")

    def find_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in V.blocks(batches):
            block = Block(part, known)
            for asked in V.stored(path):
                found = []
                for (own, query, kind), least in zip(_asked(asked, known), V.numbers(asked, _LEAST)):
                    score, ids = block.positives(own, query, kind, positives, int(least))
                    found.append((np.full(len(ids), own), ids, score))
                yield _batch(found, [V.ID, "positive_id", "score"])

    hits = dealt.mapInArrow(find_positives, f"{V.ID} long, positive_id long, score long")
    order = Window.partitionBy(V.ID).orderBy(F.desc("score"), "positive_id")
    hits = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= positives).filter("score >= 0")
    # At most as many as there are positives for an anchor.
    good = hits.groupBy(V.ID).agg(F.array_distinct(F.collect_list(F.struct("positive_id", "score"))).alias(_GOOD))

    def second_thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(sample, known)
        for batch in batches:
            least = []
            for (_, query, kind), pairs in zip(_asked(batch, known), V.column(batch, _GOOD).to_pylist()):
                windows = [window(p["score"], low, high) for p in pairs]
                found = block.negatives(query, kind, windows, negatives, [V.LOWEST] * len(windows))
                least.append([int(s[-1]) if len(s) == negatives else V.LOWEST for s, _ in found])
            names = [V.ID, V.VECTOR, _LABEL, _GOOD]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(least, pa.list_(pa.int64()))], names=[*names, _LEAST])

    pairs = anchors.drop(_LEAST).join(good, V.ID)
    pairs = written(pairs.mapInArrow(second_thresholds, f"{shared}, {_GOOD} array<struct<positive_id: long, score: long>>, {_LEAST} array<long>"), "negatives-pairs")
    pairs_path = pairs._written_to

    def find_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in V.blocks(batches):
            block = Block(part, known)
            for asked in V.stored(pairs_path):
                out = []
                for (own, query, kind), good, least in zip(_asked(asked, known), V.column(asked, _GOOD).to_pylist(), V.column(asked, _LEAST).to_pylist()):
                    windows = [window(p["score"], low, high) for p in good]
                    for pair, (score, ids) in zip(good, block.negatives(query, kind, windows, negatives, least)):
                        fill = [np.full(len(ids), x) for x in (own, pair["positive_id"], pair["score"])]
                        out.append((*fill, ids, score))
                yield _batch(out, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    found = dealt.mapInArrow(find_negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _asked(batch: pa.RecordBatch, known: V.Shape) -> Iterator[tuple[int, np.ndarray, int]]:
    return zip(V.numbers(batch, V.ID), V.matrix(V.column(batch, V.VECTOR), known), V.numbers(batch, _LABEL))


def _batch(found: list[tuple], names: list[str]) -> pa.RecordBatch:
    whole = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in whole], names=names)
