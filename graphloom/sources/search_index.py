"""A stored full-text index that follows a graph: impact-ordered blocks of
postings, in segments.

*Segments.* What is added is a segment of its own: its items, their postings, and
the keys of items that it replaces or removes in older segments. So what an upsert
writes grows with the upsert, not with the index. When several segments of about
one size have gathered, they are written as one. A manifest names the segments
and the state of the graph that they stand for; readers keep to a manifest.

*Blocks.* Items are dealt out by key, and each task counts the terms of its own and
cuts the postings of a term with one frequency into blocks of bounded size, in the
order of (index, term, frequency, length); so no posting is shuffled, and a term
that every item holds is spread over all tasks and files. A small table has the
number of postings for each term and frequency.

*Ranked lookup.* A score is a sum of weight times frequency over the question's
terms. The rarest terms give a first bound of the k-th best score; from it follows
how deep each term has to be read so that no item outside what was read can reach
it, choosing depths with few blocks. Items read whose score may reach the bound
are scored from their texts.

*Fuzzy lookup.* An item within d edits lacks at most 2 d of the bigrams of the
longer side, so it is found by its bigrams (the most common ones are not read, as
far as the count allows); where that says nothing, by length and by characters as
bits. Only candidates' texts are read.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import search
from graphloom.sources.store import GraphStore, Versions, linked_edges

KEY = ["type", "id"]
ITEM = "type string, id string, length int, grams int, bag_a long, bag_b long, text string, bucket int"
BLOCKS = "term string, tf long, short int, long int, n long, items array<struct<type:string,id:string,length:int,grams:int>>, index string"
LEVELS = "index string, term string, tf long, n long, blocks long"
MANIFEST = "place int, segment string, items long, base long, seen array<long>"


@dataclass
class Term:
    """A term of a question: what an occurrence adds to a score, and how many
    postings (in how many blocks) there are of each frequency."""

    index: str
    term: str
    weight: float
    levels: dict[int, tuple[int, int]] = field(default_factory=dict)

    def bound(self, depth: int) -> float:
        return self.weight * depth


def depths(terms: list[Term], least: float) -> list[int]:
    """For each term the frequency above which its postings are read, so that
    what isn't read adds up to less than ``least``; blocks that take much off
    the sum for their number go first."""
    down = [sorted(t.levels, reverse=True) for t in terms]
    at = [0] * len(terms)
    value = [d[0] if d else 0 for d in down]
    rest = sum(t.bound(v) for t, v in zip(terms, value))
    while rest >= least and any(value):
        # Several levels of a term may be taken in one step.
        best = None
        for i, (t, d) in enumerate(zip(terms, down)):
            cost = 0
            for j in range(at[i], len(d)):
                cost += t.levels[d[j]][1]
                after = d[j + 1] if j + 1 < len(d) else 0
                gain = (t.bound(value[i]) - t.bound(after)) / cost
                if best is None or gain > best[0]:
                    best = gain, i, j + 1, after
        _, i, at[i], after = best
        rest -= terms[i].bound(value[i]) - terms[i].bound(after)
        value[i] = after
    return value


def cut_into(block: int):
    """Sorted postings ``(term, tf, length, grams, type, id, index)``, batch by
    batch, as blocks of at most so many of one term and frequency."""

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for name in ("index", "term", "tf"):
                values = batch.column(name)
                new[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
            at = np.arange(batch.num_rows)
            starts = np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % block == 0)
            ends = np.append(starts[1:], batch.num_rows)
            items = pa.StructArray.from_arrays([batch.column(c) for c in (*KEY, "length", "grams")], names=[*KEY, "length", "grams"])
            first, last = batch.take(pa.array(starts)), batch.take(pa.array(ends - 1))
            yield pa.RecordBatch.from_arrays(
                [first.column("term"), first.column("tf"), first.column("length"), last.column("length"), pa.array(ends - starts), pa.ListArray.from_arrays(pa.array(np.append(starts, batch.num_rows), pa.int32()), items), first.column("index")],
                names=["term", "tf", "short", "long", "n", "items", "index"],
            )

    return cut


class SearchIndex:
    """The index under a folder. ``block``: postings in a block; ``buckets``: into
    how many folders a segment's items are dealt by key; ``fan``: so many segments
    of a size become one."""

    def __init__(self, spark: SparkSession, path: str, block: int = 128, buckets: int = 16, fan: int = 4):
        self.spark, self.path, self.block, self.buckets, self.fan = spark, path.rstrip("/"), block, buckets, fan
        self.manifests = Versions(spark, f"{self.path}/manifests", "_SUCCESS")
        #: Of the last question: blocks of its terms, blocks read, items scored from their texts.
        self.told: dict[str, int] = {}

    # -- Writing

    def segments(self) -> list:
        """The rows of the manifest, oldest segment first."""
        at = self.manifests.last()
        return sorted(self.spark.read.schema(MANIFEST).parquet(at).collect(), key=lambda r: r["place"]) if at else []

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")

    def _described(self, items: DataFrame) -> DataFrame:
        # Normalised once: what is asked of each character mustn't do it again.
        bag_a, bag_b = T.bag_masks("__text")
        return items.select(*KEY, "text", T.normalized("text").alias("__text")).select(
            *KEY, F.length("__text").alias("length"), F.size(T.grams("__text", 2)).alias("grams"), bag_a.alias("bag_a"), bag_b.alias("bag_b"), "text", self._bucket().alias("bucket")
        )

    def _segment(self, items: DataFrame, gone: DataFrame) -> tuple[str, int]:
        """Write a segment from described items; its name and number of items."""
        name = uuid.uuid4().hex
        at = f"{self.path}/segments/{name}"
        number = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # A bucket is written by as many tasks as there are for it.
        pieces = max(1, number // self.buckets)
        piece = (F.col("bucket") * pieces + F.pmod(F.xxhash64(F.lit(1), *KEY), F.lit(pieces))).cast("int")
        items.repartitionById(self.buckets * pieces, piece).sortWithinPartitions("bucket", *KEY).write.partitionBy("bucket").parquet(f"{at}/items")
        held = self.spark.read.schema(ITEM).parquet(f"{at}/items")
        text = T.normalized("text")
        every = F.array(*(F.struct(F.lit(n).alias("index"), g.alias("terms")) for n, g in (("bigram", T.grams(text, 2)), ("trigram", T.grams(text, 3)), ("keyword", T.keywords(text)))))
        # Dealt out by key before they are many: terms are counted, sorted and cut into blocks where they are made.
        dealt = held.select(*KEY, "length", "grams", "text", F.pmod(F.xxhash64(F.lit(2), *KEY), F.lit(number)).cast("int").alias("part")).repartitionById(number, "part")
        rows = dealt.select("part", *KEY, "length", "grams", F.explode(every).alias("e")).select("part", *KEY, "length", "grams", "e.index", F.explode("e.terms").alias("term"))
        postings = rows.groupBy("part", "index", "term", *KEY, "length", "grams").agg(F.count(F.lit(1)).alias("tf"))
        placed = postings.select("term", "tf", "length", "grams", *KEY, "index").sortWithinPartitions("index", "term", F.desc("tf"), "length", *KEY)
        blocks = placed.mapInArrow(cut_into(self.block), BLOCKS)
        blocks.sortWithinPartitions("index", "term", F.desc("tf"), "short").write.partitionBy("index").parquet(f"{at}/blocks")
        levels = self.spark.read.schema(BLOCKS).parquet(f"{at}/blocks").groupBy("index", "term", "tf").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks"))
        levels.repartitionByRange("index", "term").sortWithinPartitions("index", "term").write.parquet(f"{at}/levels")
        gone.select(*KEY).distinct().write.parquet(f"{at}/gone")
        return name, held.count()

    def _publish(self, segments: list[tuple[str, int]], base: int, seen: list[int]) -> None:
        rows = [(i, name, n, base, seen) for i, (name, n) in enumerate(segments)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(self.manifests.new())
        before = self.manifests.whole()[: -Versions.KEPT]
        self.manifests.tidy()
        if before:
            self._tidy()

    def _tidy(self) -> None:
        """Remove segments that no kept manifest names."""
        named = {r["segment"] for n in self.manifests.whole() for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/v{n}").select("segment").collect()}
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/segments")
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in system.listStatus(folder):
            if status.getPath().getName() not in named:
                system.delete(status.getPath(), True)

    def write(self, items: DataFrame, base: int = 0, seen: list[int] | None = None) -> SearchIndex:
        """``(type, id, text)`` in place of all that is there."""
        name, n = self._segment(self._described(items), items.limit(0))
        self._publish([(name, n)], base, seen or [])
        return self

    def add(self, items: DataFrame, gone: DataFrame | None = None, base: int | None = None, seen: list[int] | None = None) -> SearchIndex:
        """Items, each in place of the one with its key; ``gone`` are keys of
        items that are removed."""
        held = self.segments()
        keys = items.select(*KEY) if gone is None else items.select(*KEY).unionByName(gone.select(*KEY))
        name, n = self._segment(self._described(items), keys)
        segments = [(r["segment"], r["items"]) for r in held] + [(name, n)]
        segments = self._merged(segments)
        kept = held[0] if held else None
        self._publish(segments, base if base is not None else kept["base"] if kept else 0, seen if seen is not None else list(kept["seen"]) if kept else [])
        return self

    def _merged(self, segments: list[tuple[str, int]]) -> list[tuple[str, int]]:
        """The newest segments as one, if enough of about one size are there."""
        for i in range(len(segments) - self.fan + 1):
            newer = sum(n for _, n in segments[i + 1 :])
            if segments[i][1] <= self.fan * max(newer, 1):
                run = [name for name, _ in segments[i:]]
                gone = self._table(run, "gone", "type string, id string").drop("segment") if i else self.spark.createDataFrame([], "type string, id string")
                return segments[:i] + [self._segment(self._live(run).drop("segment"), gone)]
        return segments

    def follow(self, store: GraphStore) -> SearchIndex:
        """Bring the index to the state of the graph: upserts that it hasn't
        seen become segments; where some are no longer there, or the graph was
        replaced, all is indexed anew."""
        held = self.segments()
        base, finished, lost = store.state()
        seen = set(held[0]["seen"]) if held else set()
        if not held or held[0]["base"] != base or any(n not in seen for n in lost):
            return self.write(search.items(*store.read()), base, sorted({*finished, *lost}))
        new = [n for n in finished if n not in seen]
        if not new:
            return self
        nodes, edges = store.part(new)
        all_nodes, all_edges = store.read(linked=False)
        # Edges that a new node may have completed come along.
        ends = nodes.select(F.col("id").alias("__end"))
        near = all_edges.join(ends, F.col("source") == F.col("__end"), "left_semi").unionByName(all_edges.join(ends, F.col("target") == F.col("__end"), "left_semi"))
        touched = all_edges.join(edges.select("source", "target"), ["source", "target"], "left_semi").select(*all_edges.columns).unionByName(near.select(*all_edges.columns)).dropDuplicates(["source", "target"])
        fresh = all_nodes.join(nodes.select("id"), "id", "left_semi")
        return self.add(search.items(fresh, linked_edges(touched, all_nodes)), search.items(nodes, edges), base, sorted(seen | set(new)))

    # -- Reading

    def _table(self, names: list[str], what: str, schema: str) -> DataFrame:
        """A table of several segments, with the place of each."""
        out = None
        for i, name in enumerate(names):
            part = self.spark.read.schema(schema).parquet(f"{self.path}/segments/{name}/{what}").withColumn("segment", F.lit(i))
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], schema + ", segment int")

    def _current(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """Without rows of items that a newer segment replaces."""
        if len(names) < 2:
            return rows
        gone = self._table(names, "gone", "type string, id string").filter("segment > 0").groupBy(*KEY).agg(F.max("segment").alias("__last"))
        return rows.join(gone, KEY, "left").filter(F.col("__last").isNull() | (F.col("segment") >= F.col("__last"))).drop("__last")

    def _live(self, names: list[str]) -> DataFrame:
        return self._current(self._table(names, "items", ITEM), names)

    def items(self) -> DataFrame:
        """``(type, id, text)`` of what can be found."""
        return self._live([r["segment"] for r in self.segments()]).select(*KEY, "text")

    def _texts(self, candidates: DataFrame, names: list[str]) -> DataFrame:
        """Candidates ``(type, id)`` with what is stored of them. Their buckets
        are pruned where the planner sees few of them."""
        keys = candidates.select(*KEY).distinct().withColumn("bucket", self._bucket())
        return self._current(self._table(names, "items", ITEM).join(keys, ["bucket", *KEY], "left_semi"), names)

    def _read(self, terms: list[Term], above: list[int], names: list[str], fits: Column | None = None) -> DataFrame:
        """``(type, id, segment, length, grams, term number, tf)`` of the postings
        of more than the given frequency."""
        rows = self._table(names, "blocks", BLOCKS)
        asked = [(F.col("index") == t.index) & (F.col("term") == t.term) & (F.col("tf") > v) for t, v in zip(terms, above) if any(tf > v for tf in t.levels)]
        wanted = F.lit(False)
        for one in asked:
            wanted = wanted | one
        number = F.coalesce(*(F.when((F.col("index") == t.index) & (F.col("term") == t.term), F.lit(i)) for i, t in enumerate(terms))) if terms else F.lit(0)
        rows = rows.filter(wanted if fits is None else wanted & fits)
        rows = rows.select("segment", number.alias("t"), "tf", F.explode("items").alias("e")).select("e.type", "e.id", "segment", "e.length", "e.grams", "t", "tf")
        return self._current(rows, names)

    def _terms(self, query: str, names: list[str], bigrams: bool, words: bool) -> tuple[list[Term], dict[str, int], dict[str, dict[str, int]]]:
        """The question's terms with their levels, how many terms it has in each
        index, and how often it has each."""
        one = self.spark.createDataFrame([(query,)], "q string").select(T.normalized("q").alias("q"))
        row = one.select(T.grams("q", 2).alias("bigram"), T.keywords("q").alias("keyword")).first()
        often = {i: {t: row[i].count(t) for t in dict.fromkeys(row[i])} for i, used in (("bigram", bigrams), ("keyword", words)) if used}
        share = {"bigram": 0.4, "keyword": 0.6}
        number = {i: max(sum(f.values()), 1) for i, f in often.items()}
        terms = {(i, t): Term(i, t, share[i] * n / number[i]) for i, f in often.items() for t, n in f.items()}
        wanted = F.lit(False)
        for i, f in often.items():
            if f:
                wanted = wanted | (F.col("index") == i) & F.col("term").isin(list(f))
        for r in self._table(names, "levels", LEVELS).filter(wanted).groupBy("index", "term", "tf").agg(F.sum("n").alias("n"), F.sum("blocks").alias("blocks")).collect():
            terms[r["index"], r["term"]].levels[r["tf"]] = (r["n"], r["blocks"])
        return [t for t in terms.values() if t.levels], number, often

    def _scored(self, rows: DataFrame, number: dict[str, int], often: dict[str, dict[str, int]]) -> DataFrame:
        """Items with their exact score and the methods that found them."""
        text = T.normalized("text")
        asked = lambda f: F.create_map(*(F.lit(x) for t, n in f.items() for x in (t, n))) if f else F.create_map().cast("map<string,int>")
        counted = lambda every, held: F.aggregate(every, F.lit(0).cast("long"), lambda s, g: s + F.coalesce(F.try_element_at(held, g), F.lit(0)))
        parts, methods = [], []
        for name, share, every in (("bigram", 0.4, T.grams(text, 2)), ("keyword", 0.6, T.keywords(text))):
            if name in often:
                hit = counted(every, asked(often[name]))
                parts.append(F.when(hit > 0, share * (hit / number[name])).otherwise(0.0))
                methods.append(F.when(hit > 0, F.lit(name)))
        total = parts[0] if len(parts) == 1 else parts[0] + parts[1]
        return rows.select(*KEY, total.alias("total_score"), F.filter(F.array(*methods), lambda m: m.isNotNull()).alias("methods")).filter("total_score > 0")

    def ranked(self, query: str, most: int = 50, bigrams: bool = True, words: bool = True) -> list:
        """The ``most`` best rows ``(type, id, total_score, methods)`` by bigrams
        and keywords, as an exhaustive search has them."""
        names = [r["segment"] for r in self.segments()]
        terms, number, often = self._terms(query, names, bigrams, words)
        order = [F.desc(F.round("total_score", 9)), *KEY]
        self.told = {"blocks": sum(b for t in terms for _, b in t.levels.values()), "read": 0, "scored": 0}
        if not terms:
            return []
        # The rarest terms first, until they have postings enough.
        seed, held = [], 0
        for t in sorted(terms, key=lambda t: sum(n for n, _ in t.levels.values())):
            if held >= 4 * most:
                break
            seed.append(t)
            held += sum(n for n, _ in t.levels.values())
        weight = lambda some: F.element_at(F.array(*(F.lit(t.weight) for t in some)), F.col("t") + 1)
        first = self._read(seed, [0] * len(seed), names).groupBy(*KEY).agg(F.sum(weight(seed) * F.col("tf")).alias("s")).orderBy(F.desc("s"), *KEY).limit(4 * most)
        top = self._scored(self._texts(first, names), number, often).orderBy(*order).limit(most).collect()
        least = top[-1]["total_score"] - 1e-8 if len(top) == most else 0.0
        above = depths(terms, least) if least > 0 else [0] * len(terms)
        self.told["read"] = sum(b for t, v in zip(terms, above) for tf, (_, b) in t.levels.items() if tf > v)
        rest = sum(t.bound(v) for t, v in zip(terms, above))
        missed = F.element_at(F.array(*(F.lit(t.bound(v)) for t, v in zip(terms, above))), F.col("t") + 1)
        read = self._read(terms, above, names).groupBy(*KEY).agg(F.sum(weight(terms) * F.col("tf")).alias("s"), F.sum(missed).alias("missed"))
        near = read.filter(F.col("s") + rest - F.col("missed") >= least)
        return self._scored(self._texts(near, names), number, often).orderBy(*order).limit(most).collect()

    def fuzzy(self, query: str, threshold: float = 0.7) -> DataFrame:
        """``(type, id, similarity, times)`` as ``search.fuzzy_search`` finds them;
        ``times`` is the item's number of bigrams."""
        names = [r["segment"] for r in self.segments()]
        one = self.spark.createDataFrame([(query,)], "q string").select(T.normalized("q").alias("q"))
        q = one.select("q", F.length("q").alias("n"), T.grams("q", 2).alias("g"), *(c.alias(k) for k, c in zip(("a", "b"), T.bag_masks("q")))).first()
        long, grams = q["n"], len(q["g"])
        edits = lambda length: F.floor((1 - threshold) * F.greatest(F.lit(long), length) + 1e-9)
        shared = lambda length, g: F.greatest(F.lit(grams), g) - 2 * edits(length)
        shortest, longest = math.ceil(threshold * long - 1e-9), math.floor(long / threshold + 1e-9) if threshold > 0 else 1 << 30
        # The least that any item has to share is what the most common bigrams may be left out for.
        lowest = max(0, min(grams - 2 * math.floor((1 - threshold) * n + 1e-9) for n in range(long, min(longest, 4 * long) + 1)) if long else 0)
        found, _, often = self._terms(query, names, True, False)
        size = lambda t: sum(n for n, _ in t.levels.values())
        found.sort(key=size)
        spared = 0
        while found and spared + often["bigram"][found[-1].term] < lowest:
            spared += often["bigram"][found.pop().term]
        self.told = {"blocks": sum(b for t in found for _, b in t.levels.values()), "read": sum(b for t in found for _, b in t.levels.values())}
        counts = F.element_at(F.array(*(F.lit(often["bigram"][t.term]) for t in found)), F.col("t") + 1) if found else F.lit(0)
        fits = (F.col("long") >= shortest) & (F.col("short") <= longest)
        read = self._read(found, [0] * len(found), names, fits).filter(F.col("length").between(shortest, longest))
        near = read.groupBy(*KEY, "length", "grams").agg(F.sum(F.least(F.col("tf"), counts)).alias("hits")).filter(F.col("hits") + spared >= shared(F.col("length"), F.col("grams"))).select(*KEY)
        # Where the count says nothing: by length and characters alone.
        unsaid = self._table(names, "items", ITEM).select(*KEY, "segment", "length", "grams", "bag_a", "bag_b").filter(F.col("length").between(shortest, longest) & (shared(F.col("length"), F.col("grams")) <= 0))
        only = lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))).cast("int")
        a, b = F.lit(q["a"]).cast("long"), F.lit(q["b"]).cast("long")
        lacks = F.greatest(only(a, F.col("bag_a")) + only(b, F.col("bag_b")), only(F.col("bag_a"), a) + only(F.col("bag_b"), b))
        candidates = near.unionByName(unsaid.filter(lacks <= edits(F.col("length"))).select(*KEY))
        items = self._texts(candidates, names)
        similarity = T.fuzzy_similarity(F.lit(q["q"]), T.normalized("text"))
        return items.select(*KEY, similarity.alias("similarity"), F.col("grams").alias("times")).filter(F.col("similarity") >= threshold)

    def search(self, query: str, most: int = 50, threshold: float = 0.7, few: int = 10, use_bigram: bool = True, use_keywords: bool = True, use_fuzzy: bool = True) -> DataFrame:
        """``(type, id, total_score, methods)``, as ``search.combined_search``."""
        hits = self.ranked(query, max(most, few), use_bigram, use_keywords) if use_bigram or use_keywords else []
        shape = "type string, id string, total_score double, methods array<string>"
        found = self.spark.createDataFrame([tuple(r) for r in hits], shape)
        if use_fuzzy and len(hits) < few:
            near = self.fuzzy(query, threshold).filter("times > 0").select(*KEY, (0.3 * F.col("similarity") * F.col("times")).alias("s"))
            found = found.join(near, KEY, "full_outer").select(
                *KEY, (F.coalesce("total_score", F.lit(0.0)) + F.coalesce("s", F.lit(0.0))).alias("total_score"),
                F.array_sort(F.concat(F.coalesce("methods", F.array().cast("array<string>")), F.when(F.col("s").isNotNull(), F.array(F.lit("fuzzy"))).otherwise(F.array().cast("array<string>")))).alias("methods"),
            )
        return found.orderBy(F.desc(F.round("total_score", 9)), *KEY).limit(most)

    def sequential(self, query: str, most: int = 50, threshold: float = 0.7, use_keywords: bool = True, use_bigram: bool = True, use_fuzzy: bool = True) -> DataFrame:
        """``(type, id, total_score, method)``, as ``search.sequential_search``."""
        for name, share, used in (("keyword", 0.6, use_keywords), ("bigram", 0.4, use_bigram)):
            hits = self.ranked(query, most, name == "bigram", name == "keyword") if used else []
            if hits:
                rows = self.spark.createDataFrame([(r["type"], r["id"], r["total_score"] / share, name) for r in hits], "type string, id string, total_score double, method string")
                return rows.orderBy(F.desc(F.round("total_score", 9)), *KEY)
        near = self.fuzzy(query, threshold).filter("times > 0")
        found = near if use_fuzzy else near.limit(0)
        return found.select(*KEY, F.col("similarity").alias("total_score"), F.lit("fuzzy" if use_fuzzy else "").alias("method")).orderBy(F.desc(F.round("total_score", 9)), *KEY).limit(most)
