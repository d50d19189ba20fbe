"""Best-fit packing of tokenised documents into sequences of fixed length.

Best-fit decreasing, exactly and over the whole corpus: pieces are placed from
the longest to the shortest, each into the open sequence with the least room
that still takes it. Lengths are bounded by the sequence length, so all that
the placement needs is how many pieces there are of each length. The driver
gets that histogram (at most ``capacity`` rows at any corpus size) and places
pieces of equal length by runs; a segment tree over remaining capacities finds
the tightest open sequences in logarithmic time. What it sends out is a table
of runs: pieces number a to b of a length go to sequences from s on, k in each.

Piece numbers are given without gathering a length in one task: pieces are
numbered within (length, bucket of rows) and the buckets' counts are added up.

Defined results: null and empty texts have one piece with id 0 only; documents
with equal ids (repeated rows, null ids) are packed one by one; an empty table
gives no pieces. Of a long document, the first piece is the shorter one.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import PRIVATE, filled, written

#: A number of its own for each piece.
_ROW = PRIVATE + "row"


class RoomTree:
    """A segment tree over room left (0 to capacity): which rooms some open
    sequence has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.held = [False] * (2 * self.leaves)

    def set(self, room: int, held: bool) -> None:
        at = room + self.leaves
        self.held[at] = held
        while at > 1:
            at //= 2
            held = self.held[2 * at] or self.held[2 * at + 1]
            if self.held[at] == held:
                break
            self.held[at] = held

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length``, if any."""
        at = length + self.leaves
        if not self.held[at]:
            while at > 1 and (at % 2 or not self.held[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.held[2 * at] else 2 * at + 1
        return at - self.leaves


def place_runs(lengths: Iterable[tuple[int, int]], capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of ``(length, number)``.

    Yields runs ``(length, first, sequence, each, offset)``: the pieces of a
    length numbered from ``first`` on (to the next run's first) go to
    sequences from ``sequence`` on, ``each`` in one, from ``offset`` on.

    Placing one piece after another into the tightest sequence fills that one
    with as many pieces of this length as it takes, since its room only gets
    tighter; so sequences with equal room form a group that is filled at once.
    """
    tree, groups, opened = RoomTree(capacity), {}, 0

    def put(room: int, first: int, number: int) -> None:
        if room and number:
            groups.setdefault(room, [])
            heapq.heappush(groups[room], (first, number))
            tree.set(room, True)

    for length, number in sorted(lengths, reverse=True):
        done = 0
        while done < number:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                first, room, there = opened, capacity, -(-(number - done) // each)
                opened += there
            else:
                first, there = heapq.heappop(groups[room])
                if not groups[room]:
                    tree.set(room, False)
            each = room // length
            take = min(number - done, there * each)
            yield length, done, first, each, capacity - room
            full, rest = divmod(take, each)
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), there - full - bool(rest))
            done += take


def token_pieces(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Documents as tokens, cut where they are longer than ``capacity``: id,
    piece, start, length, ids_crc32. ``encoder()`` runs in the task and gives a
    function from text to its ids as little-endian 32-bit bytes."""
    wide = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(), end_id.to_bytes(4, "little")
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(texts):
                held = encode(text.as_py()) + last
                low, high, n = 0, len(held) % wide or min(len(held), wide), 0
                while low < len(held):
                    row.append(i)
                    piece.append(n)
                    start.append(low // 4)
                    length.append((high - low) // 4)
                    crc.append(zlib.crc32(held[low:high]))
                    low, high, n = high, high + wide, n + 1
            if row:
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(id_col, filled(text_col).alias(PRIVATE + "text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(cut, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int, id_col: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """``pieces`` (with their ``length``) with ``sequence_id`` and ``offset``.

    ``buckets`` (by default at least 256 and four per shuffle partition) is into
    how many parts the pieces of one length are dealt."""
    buckets = buckets or max(256, 4 * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    number, bucket = PRIVATE + "number", PRIVATE + "bucket"
    told = [_ROW] if _ROW in pieces.columns else [c for c in pieces.columns if c != "length"]
    pieces = pieces.withColumn(bucket, F.pmod(F.xxhash64(*told), F.lit(buckets)))
    counts = pieces.groupBy("length", bucket).agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "pack-counts")
    before = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(PRIVATE + "base"))
    # At most one row per length from 1 to capacity.
    histogram = [(r[0], r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()]
    runs = np.array(sorted(place_runs(histogram, capacity)), dtype=np.int64).reshape(-1, 5)
    within = Window.partitionBy("length", bucket).orderBy(*told)
    numbered = pieces.withColumn(number, F.row_number().over(within)).join(base, ["length", bucket]).withColumn(number, F.col(number) - 1 + F.col(PRIVATE + "base")).drop(bucket, PRIVATE + "base")
    span = int(sum(n for _, n in histogram)) + 1

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = runs[:, 0] * span + runs[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            nth = batch.column(number).to_numpy(zero_copy_only=False)
            run = runs[np.searchsorted(keys, length * span + nth, side="right") - 1]
            in_run = nth - run[:, 1]
            sequence = run[:, 2] + in_run // run[:, 3]
            offset = run[:, 4] + in_run % run[:, 3] * length
            kept = [batch.column(c) for c in out_columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*out_columns, "sequence_id", "offset"])

    out_columns = [c for c in numbered.columns if c not in (number, _ROW)]
    schema = ", ".join(f"`{c}` {numbered.schema[c].dataType.simpleString()}" for c in out_columns)
    return numbered.mapInArrow(look_up, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Tokenise, cut and pack. The pieces are written first, so that the costly
    tokenising is done once and survives lost executors."""
    pieces = token_pieces(docs, encoder, capacity, id_col, text_col, end_id)
    # A number for each row, fixed once written, so that equal rows are dealt out too.
    pieces = written(pieces.withColumn(_ROW, F.monotonically_increasing_id()), "pack-pieces")
    return pack(pieces, capacity, id_col)
