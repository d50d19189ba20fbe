"""N-gram Jaccard join: all pairs of texts whose sets of word n-grams have a
Jaccard similarity of at least ``threshold``.

1. *Sketch.* Texts are lower-cased and white space becomes single spaces; equal
   ones (by SHA-256) are one class from here on. A class's n-gram hashes give
   ``bands * rows`` MinHash values; their numbers are chosen so that a pair at
   the threshold shares a band with probability ``recall`` at least.
2. *Candidates.* Classes are shuffled on band hashes. Classes that share a band
   are candidates; links to each bucket's smallest class give components, within
   which all candidates lie.
3. *Verify.* The texts of a component meet in one unit of work, and those pairs
   that share a band are compared on their full sets of n-grams, by counting
   shared n-grams: rare ones by listing their holders, frequent ones by
   multiplying 0/1 matrices. A component too large for one unit is cut in one of
   two ways, whichever sends fewer texts: into blocks by hash, of which each two
   are a unit, or into its buckets (those with the same members count once, and
   large ones are cut into blocks); a pair that shares several buckets is
   compared in the first. Both compare the same pairs, so the way taken changes
   no result. Memory is bounded by two blocks, and a text is sent at most as
   often as it has bands, unless a bucket is larger than a block. No pair is a
   row: a unit returns the number of links of each class and a forest of links.
4. *Classes.* The components of the forests' links are the near-duplicate
   groups; a document's class id is the smallest document id of its group.

Defined results: null texts count as empty; texts of fewer than n words have
one n-gram, all their words; empty texts are copies of each other and have no
links; repeated rows get a row each; null ids are members and never a class id
unless a class has no other; an empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import PRIVATE, filled, tie_order, with_classes, written
from graphloom.operators.components import connected_components

_KEY, _NORM, _ID = PRIVATE + "key", PRIVATE + "norm", PRIVATE + "id"

#: Most texts and words in a block of a large component or bucket.
BLOCK_TEXTS, BLOCK_WORDS = 256, 500_000


#: Most words whose hashes a worker keeps; then it starts anew.
KNOWN_WORDS = 100_000


def band_plan(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """Bands and rows: the most selective plan of at most ``most`` hashes that
    finds a pair at the threshold with probability ``recall``."""
    best = None
    for rows in range(1, most + 1):
        hit = threshold**rows
        bands = 1 if hit >= recall else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError("no plan of so few hashes reaches this recall")
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers scattered (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=1)
def _word_hashes():
    import xxhash

    class Known(dict):
        def __missing__(self, word: str) -> int:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            found = self[word] = xxhash.xxh64_intdigest(word)
            return found

    return Known()


def ngrams(norm: str, n: int) -> np.ndarray:
    """Hashes of all n-grams of a normalised text, with repeats."""
    if not norm:
        return np.empty(0, np.uint64)
    words = norm.split(" ")
    held = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        total = total * np.uint64(0x100000001B3) + held[i : i + len(total)]
        total ^= total >> np.uint64(27)
    return _mixed(total)


@functools.lru_cache(maxsize=4)
def _permutations(number: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_240_501)
    return (draw.integers(0, 1 << 31, number, dtype=np.uint32) * np.uint32(2) + np.uint32(1)), draw.integers(0, 1 << 32, number, dtype=np.uint32)


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A set's hash for each band."""
    if not len(grams):
        return np.empty(0, np.int64)
    a, b = _permutations(bands * rows)
    low = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    short = (grams >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 4096):
        np.minimum(low, (short[at : at + 4096, None] * a + b).min(axis=0), out=low)
    low = low.reshape(bands, rows).astype(np.uint64)
    total = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for i in range(rows):
        total = _mixed(total * np.uint64(31) + low[:, i])
    return total.view(np.int64)


def normalised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = F.trim(F.regexp_replace(F.lower(filled(text_col)), r"[\s\x0B\x1C-\x1F\x85\p{Z}]+", " "))
    return docs.select(F.col(id_col).alias(_ID), norm.alias(_NORM)).withColumn(_KEY, F.unhex(F.sha2(_NORM, 256)))


def sketches(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """Per row: id, class key, number of words and, where the key is new in this
    partition, its band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys, words, hashes = batch.column(2).to_pylist(), [], []
            for key, norm in zip(keys, batch.column(1)):
                text = norm.as_py()
                words.append(text.count(" ") + bool(text))
                if key in seen:
                    hashes.append(None)
                else:
                    seen.add(key)
                    hashes.append(band_hashes(ngrams(text, n), bands, rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(words, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=[_ID, _KEY, "words", "bands"])

    keyed = normalised(docs, id_col, text_col)
    return keyed.mapInArrow(run, f"{_ID} {keyed.schema[_ID].dataType.simpleString()}, {_KEY} binary, words long, bands array<long>")


def shared_counts(sets: list[np.ndarray], often: int = 16) -> np.ndarray:
    """For sorted sets of hashes, the matrix of the sizes of their pairwise
    intersections (diagonal undefined)."""
    count = len(sets)
    inter = np.zeros((count, count), np.float32)
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    holders = np.diff(np.append(starts, len(values)))
    flat = inter.reshape(-1)
    for size in range(2, often + 1):
        at = starts[holders == size]
        if len(at):
            those = owner[at[:, None] + np.arange(size)]
            for i in range(size):
                for j in range(i + 1, size):
                    np.add.at(flat, those[:, i] * count + those[:, j], 1)
    inter += inter.T
    frequent = np.flatnonzero(holders > often)
    for at in range(0, len(frequent), 2048):
        part = frequent[at : at + 2048]
        wide = np.zeros((count, len(part)), np.float32)
        for column, k in enumerate(part):
            wide[owner[starts[k] : starts[k] + holders[k]], column] = 1
        inter += wide @ wide.T
    return inter


def share_band(bands: np.ndarray, first: int) -> np.ndarray:
    """The 0/1 matrix of pairs that share a band; with ``first`` not negative, of
    those that share this one and none before it."""
    count = len(bands)
    if first < 0 and count <= 64:
        return (bands[:, None, :] == bands[None, :, :]).any(axis=2)
    before = np.zeros((count, count), bool)
    for band in range(bands.shape[1] if first < 0 else first):
        before |= bands[:, band, None] == bands[None, :, band]
    return before if first < 0 else (bands[:, first, None] == bands[None, :, first]) & ~before


def linked(sets: list[np.ndarray], block: np.ndarray, bands: np.ndarray, threshold: float, between: bool, first: int = -1) -> np.ndarray:
    """The 0/1 matrix of pairs at or over the threshold that share a band (see
    ``share_band``); ``between`` keeps only pairs of two blocks, also where one
    of the blocks got no text."""
    inter = shared_counts(sets).astype(np.float64)
    sizes = np.array([len(s) for s in sets], np.float64)
    # inter / (|a| + |b| - inter) >= threshold, without dividing.
    link = inter * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-9
    link &= (inter > 0) & share_band(bands, first)
    np.fill_diagonal(link, False)
    if between:
        link &= block[:, None] != block[None, :]
    return link


def forest(link: np.ndarray) -> np.ndarray:
    """Each row's smallest row that links lead to."""
    label = np.arange(len(link))
    while True:
        best = np.minimum(label, np.where(link, label[None, :], len(link)).min(axis=1))
        best = best[best]
        if (best == label).all():
            return label
        label = best


#: What names a unit of work: a component, a bucket in it (null: all of it), its
#: band (-1) and two blocks (the same one: pairs within it).
UNIT = ["root", "bucket", "first", "low", "high"]


def verify(units: DataFrame, n: int, threshold: float) -> DataFrame:
    """Rows sorted by unit to each class's number of links and its label."""

    def solve(unit: tuple, keys: list[bytes], norms: list[str], blocks: list[int], bands: list) -> pa.RecordBatch | None:
        known = {k: i for i, k in reversed(list(enumerate(keys)))}
        at = sorted(known.values())
        if len(at) < 2:
            return None
        sets = [np.unique(ngrams(norms[i], n)) for i in at]
        link = linked(sets, np.array([blocks[i] for i in at]), np.array([bands[i] for i in at]), threshold, unit[3] != unit[4], unit[2])
        number, label = link.sum(axis=1), forest(link)
        some = np.flatnonzero(number)
        if not len(some):
            return None
        return pa.RecordBatch.from_arrays([pa.array([keys[at[i]] for i in some], pa.binary()), pa.array(number[some], pa.int64()), pa.array([keys[at[label[i]]] for i in some], pa.binary())], names=[_KEY, "links", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, ([], [], [], [])
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*UNIT, _KEY, _NORM, "block", "bands")]
            for row in zip(*columns):
                if row[: len(UNIT)] != unit:
                    if unit and (found := solve(unit, *held)):
                        yield found
                    unit, held = row[: len(UNIT)], ([], [], [], [])
                for column, value in zip(held, row[len(UNIT) :]):
                    column.append(value)
        if unit and (found := solve(unit, *held)):
            yield found

    return units.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(run, f"{_KEY} binary, links long, label binary")


def _blocks(texts: str, words: str):
    """How many blocks so much is cut into."""
    return F.greatest(F.ceil(F.col(texts) / BLOCK_TEXTS), F.ceil(F.col(words) / BLOCK_WORDS)).cast("int")


def _paired(members: DataFrame) -> DataFrame:
    """Members of components or buckets of so many ``blocks``, once for each unit."""
    blocked = members.withColumn("block", F.pmod(F.xxhash64(_KEY), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return blocked.select("root", "bucket", "first", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), _KEY, _ID, "block", "bands")


def work_units(members: DataFrame, cut) -> DataFrame:
    """A row for each unit that a class takes part in. ``members`` are classes
    ``(root, key, id, words, bands)`` of components."""
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("texts"), F.sum("words").alias("all_words")).withColumn("blocks", _blocks("texts", "all_words"))
    placed = cut(with_classes(members, cut(sizes), ["root"], "texts"))
    whole = lambda df: df.withColumns({"bucket": F.lit(None).cast("long"), "first": F.lit(-1)})
    small, large = placed.filter("blocks = 1"), placed.filter("blocks > 1")
    if large.isEmpty():
        return _paired(whole(small))
    spots = large.select("root", _KEY, "words", F.posexplode("bands").alias("first", "bucket"))
    found = spots.groupBy("root", "first", "bucket").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("words").alias("all_words"), F.bit_xor(F.xxhash64(_KEY)).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), _KEY)).alias("y")
    ).filter("texts > 1")
    # Of buckets with the same members the first band's has all their pairs.
    once = cut(found.groupBy("root", "texts", "all_words", "x", "y").agg(F.min(F.struct("first", "bucket")).alias("b")).select("root", "texts", "all_words", "b.first", "b.bucket").withColumn("blocks", _blocks("texts", "all_words")))
    sent = once.groupBy("root").agg(F.sum(F.col("texts") * F.col("blocks")).alias("sent"))
    ways = cut(large.select("root", "texts", "blocks").distinct().join(sent, "root").select("root", (F.col("sent") < F.col("texts") * F.col("blocks")).alias("by_bucket")))
    by_block = large.join(ways.filter("not by_bucket"), "root", "left_semi")
    by_bucket = large.join(ways.filter("by_bucket"), "root", "left_semi").drop("blocks").select("root", _KEY, _ID, "bands", F.posexplode("bands").alias("first", "bucket"))
    buckets = by_bucket.join(once.select("root", "first", "bucket", "blocks"), ["root", "first", "bucket"])
    return _paired(whole(small)).unionByName(_paired(whole(by_block))).unionByName(_paired(buckets))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> tuple[DataFrame, DataFrame]:
    """Rows with their class key, and each linked class's group and links."""
    bands, rows = band_plan(threshold, recall)
    cut = lambda df: written(df, "near-dup")
    sketched = cut(sketches(docs, id_col, text_col, n, bands, rows))
    placed = sketched.filter("bands is not null").select(_KEY, F.explode("bands").alias("band"))
    # The bucket's smallest class, where it holds more than one.
    first = placed.groupBy("band").agg(F.min(_KEY).alias("src"), F.max(_KEY).alias("last")).filter("src != last").select("band", "src")
    stars = placed.join(first, "band").filter(F.col(_KEY) != F.col("src")).select("src", F.col(_KEY).alias("dst")).distinct()
    groups = connected_components(stars, cut).select(F.col("node").alias(_KEY), F.col("component").alias("root"))
    classes = sketched.groupBy(_KEY).agg(F.min(_ID).alias(_ID))
    first_sketch = sketched.filter("bands is not null").join(groups, _KEY).groupBy("root", _KEY).agg(F.min("words").alias("words"), F.first("bands").alias("bands"))
    units = work_units(first_sketch.join(classes, _KEY), cut).alias("m")
    texts = normalised(docs, id_col, text_col).alias("t").join(units, (F.col("t." + _KEY) == F.col("m." + _KEY)) & F.col("t." + _ID).eqNullSafe(F.col("m." + _ID)))
    links = cut(verify(texts.select(*UNIT, F.col("m." + _KEY).alias(_KEY), _NORM, "block", "bands"), n, threshold))
    near = connected_components(links.filter(F.col(_KEY) != F.col("label")).select(F.col(_KEY).alias("src"), F.col("label").alias("dst")), cut)
    counts = links.groupBy(_KEY).agg(F.sum("links").alias("n_links"))
    found = near.select(F.col("node").alias(_KEY), F.col("component").alias("group")).join(counts, _KEY, "left").join(classes, _KEY)
    return sketched.select(_ID, _KEY), found


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """One row per row of ``docs``: id, ``class_id`` (smallest id of its group),
    ``n_links`` (different texts linked to its own) and ``n_copies`` (rows with
    its own text)."""
    rows, found = near_classes(docs, id_col, text_col, n, threshold, recall)
    ids = found.groupBy("group").agg(F.min(_ID).alias("class_id"))
    linked_classes = found.join(ids, "group").select(_KEY, "class_id", "n_links")
    copies = rows.groupBy(_KEY).agg(F.min(_ID).alias("first_id"), F.count(F.lit(1)).alias("n_copies"))
    classes = copies.join(linked_classes, _KEY, "left").select(_KEY, F.coalesce("class_id", "first_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies")
    return with_classes(rows, written(classes, "near-dup-classes"), [_KEY], "n_copies").select(F.col(_ID).alias(id_col), "class_id", "n_links", "n_copies")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of its smallest
    id; of several such the first in order of their other columns, then of their
    texts as they are."""
    rows, found = near_classes(docs, id_col, text_col, n, threshold, recall)
    first = found.groupBy("group").agg(F.min(F.struct(F.col(_ID), F.col(_KEY))).alias("w"))
    alone = rows.groupBy(_KEY).agg(F.min(_ID).alias(_ID)).join(found.select(_KEY), _KEY, "left_anti")
    stay = written(alone.select(_ID, _KEY).union(first.select(f"w.{_ID}", f"w.{_KEY}")), "near-dup-kept").select(F.col(_ID).alias(PRIVATE + "stay"), F.col(_KEY).alias(PRIVATE + "stay_key"))
    norm = F.trim(F.regexp_replace(F.lower(filled(text_col)), r"[\s\x0B\x1C-\x1F\x85\p{Z}]+", " "))
    keyed = docs.withColumn(_ID, F.col(id_col)).withColumn(_KEY, F.unhex(F.sha2(norm, 256)))
    kept = keyed.join(stay, (F.col(_KEY) == F.col(PRIVATE + "stay_key")) & F.col(_ID).eqNullSafe(F.col(PRIVATE + "stay")), "left_semi")
    once = Window.partitionBy(_KEY, _ID).orderBy(*tie_order(docs, id_col, text_col))
    return kept.withColumn(PRIVATE + "nth", F.row_number().over(once)).filter(F.col(PRIVATE + "nth") == 1).select(*docs.columns)
