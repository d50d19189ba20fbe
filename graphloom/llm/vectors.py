"""Integer vectors, and a set of queries against all rows in blocks.

Rows with a null id, a null vector, or a null or non-finite component take no
part. A component x becomes floor(256 * x); a vector shorter than the longest
one counts as ended by zeros. Scores are inner products, exact; what lies
beyond 64 bits counts as the largest or smallest long.

The rows stay where they are, in blocks of bounded size; the queries are
written to the shared folder and read by each task in batches. Neither side is
ever held whole, and a lost task just reads them again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import PRIVATE
from graphloom.llm.stores import opened

#: Most rows of a block, and of a batch of queries.
BLOCK, BATCH = 16_384, 1_024

#: Rows of the sample that pivots and first thresholds come from. It changes no
#: result: every row is searched.
SAMPLE = 2_048

ID, VECTOR = PRIVATE + "id", PRIVATE + "vector"

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def quantised(df: DataFrame, id_col: str, vector_col: str, **more: Column) -> DataFrame:
    """``(ID, VECTOR, *more)`` of the rows that take part."""
    held = F.col(vector_col).cast("array<double>")
    odd = F.exists(held, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~odd)
    return rows.select(F.col(id_col).cast("long").alias(ID), F.transform(held, lambda x: F.floor(x * 256)).alias(VECTOR), *(c.alias(k) for k, c in more.items()))


@dataclass(frozen=True)
class Shape:
    """What is known of a whole table: one row that Spark sums up."""

    rows: int
    width: int
    exact: bool

    def parts(self, cores: int) -> int:
        """Into how many tasks the rows are dealt."""
        return max(1, min(cores, -(-self.rows // BATCH)), -(-self.rows // BLOCK))


def shape(rows: DataFrame) -> Shape:
    """Number of rows, length of the longest vector, and whether all scores can
    be had in doubles without rounding."""
    largest = F.array_max(F.transform(VECTOR, lambda x: F.abs(x.cast("double"))))
    n, width, most = rows.agg(F.count(F.lit(1)), F.max(F.size(VECTOR)), F.max(largest)).first()
    return Shape(n, width or 0, (width or 0) * (most or 0.0) ** 2 < 2**53)


def matrix(lists: pa.ListArray, known: Shape) -> np.ndarray:
    """Vectors as rows, ended by zeros; doubles where those are exact."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), known.width), np.int64)
    out[np.arange(known.width) < sizes[:, None]] = flat
    return out.astype(np.float64) if known.exact else out


def scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as longs."""
    if rows.dtype == np.float64:
        return (rows @ query).astype(np.int64)
    found = rows.astype(object) @ query.astype(object) if rows.shape[1] else np.zeros(len(rows), object)
    return np.array([min(max(int(x), LOWEST), HIGHEST) for x in found], np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, of equal ones the smaller ids."""
    if len(score) > 8 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        score, ids = score[score >= least], ids[score >= least]
    order = np.lexsort((ids, ~score))[:k]  # ~x falls as x rises, without overflow
    return score[order], ids[order]


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[pa.Table]:
    """A task's rows, at most so many at a time."""
    held, n = [], 0
    for batch in batches:
        while len(batch):
            part = batch.slice(0, most - n)
            held.append(part)
            n, batch = n + len(part), batch.slice(len(part))
            if n == most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    found = table.column(name)
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def numbers(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return column(table, name).to_numpy(zero_copy_only=False)


def stored(uri: str) -> Iterator[pa.RecordBatch]:
    """The rows of a written table, in batches."""
    system, path = opened(uri)
    for found in system.get_file_info(fs.FileSelector(path)):
        if found.path.endswith(".parquet"):
            with system.open_input_file(found.path) as file:
                yield from pq.ParquetFile(file).iter_batches(batch_size=BATCH)


def sampled(rows: DataFrame, *columns: str) -> pa.Table:
    """A fixed sample of at most SAMPLE rows."""
    return rows.orderBy(F.xxhash64(ID), ID, VECTOR).limit(SAMPLE).select(ID, VECTOR, *columns).toArrow().combine_chunks()


def one_each(queries: DataFrame) -> DataFrame:
    """Of query rows with one id that whose vector (then other columns) is smallest."""
    rest = [c for c in queries.columns if c != ID]
    return queries.groupBy(ID).agg(F.min(F.struct(*rest)).alias("q")).select(ID, *(F.col(f"q.{c}").alias(c) for c in rest))
