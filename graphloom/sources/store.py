"""The stored graph, and the cache of model replies, as Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

NODES = S.StructType([
    S.StructField("id", S.StringType(), False), S.StructField("entity_type", S.StringType()),
    S.StructField("description", S.StringType()), S.StructField("source_ids", S.ArrayType(S.StringType())),
])
EDGES = S.StructType([
    S.StructField("source", S.StringType(), False), S.StructField("target", S.StringType(), False),
    S.StructField("description", S.StringType()), S.StructField("weight", S.DoubleType()),
    S.StructField("keywords", S.ArrayType(S.StringType())), S.StructField("source_ids", S.ArrayType(S.StringType())),
])
CACHE = S.StructType([S.StructField("key", S.StringType(), False), S.StructField("timestamp", S.TimestampType()), S.StructField("response", S.StringType())])


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new``: a new row replaces the old one of its
    key whole."""
    return old.join(new.select(*key), key, "left_anti").select(*new.columns).unionByName(new)


def linked_edges(edges: DataFrame, nodes: DataFrame, source: str = "source", target: str = "target", node: str = "id") -> DataFrame:
    """The edges both of whose ends are nodes."""
    ids = nodes.select(F.col(node).alias("__end"))
    for end in (source, target):
        edges = edges.join(ids, F.col(end) == F.col("__end"), "left_semi")
    return edges


class Versions:
    """A folder of numbered versions; one is written beside the last one, so
    readers never see half of it. ``done`` is a file that a whole version has.
    A number is taken by making its folder, which only one writer can."""

    #: Whole versions that stay, for readers who have begun on them.
    KEPT = 3

    def __init__(self, spark: SparkSession, path: str, done: str):
        self.spark, self.path, self.done = spark, path.rstrip("/"), done

    def _hadoop(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        system, folder = self._hadoop()
        if not system.exists(folder):
            return []
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit())

    def whole(self) -> list[int]:
        return [n for n in self._numbers() if self._hadoop(f"v{n}/{self.done}")[0].exists(self._hadoop(f"v{n}/{self.done}")[1])]

    def last(self) -> str | None:
        found = self.whole()
        return f"{self.path}/v{found[-1]}" if found else None

    def new(self) -> str:
        """The path of a version that no other writer has."""
        system, folder = self._hadoop()
        system.mkdirs(folder)
        number = (self._numbers() or [0])[-1] + 1
        while True:
            # Making a file that must not exist fails for all writers but one.
            mark = self._hadoop(f".v{number}")[1]
            if system.createNewFile(mark):
                return f"{self.path}/v{number}"
            number += 1

    def mark(self, number: int, names) -> None:
        """Put empty files into a version's folder."""
        for name in names:
            system, place = self._hadoop(f"v{number}/{name}")
            system.createNewFile(place)

    def marks(self, number: int, kind: str) -> set[int]:
        """The numbers of a version's marks of a kind."""
        system, folder = self._hadoop(f"v{number}")
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        return {int(n[len(kind) + 1 :]) for n in names if n.startswith(kind + "-")}

    def everywhere(self, kind: str) -> set[int]:
        """Marks that all kept versions have; none while there are fewer."""
        kept = self.whole()
        return set.intersection(*(self.marks(n, kind) for n in kept)) if len(kept) >= self.KEPT else set()

    def drop(self, numbers) -> None:
        """Remove versions for good. The last one's folder must stay, so that no
        number is given twice."""
        for n in numbers:
            for name in (f"v{n}", f".v{n}"):
                system, place = self._hadoop(name)
                system.delete(place, True)

    def tidy(self) -> None:
        """Remove whole versions older than the last few."""
        for n in self.whole()[: -self.KEPT]:
            system, folder = self._hadoop(f"v{n}")
            system.delete(folder, True)


class GraphStore:
    """Nodes and edges under a folder, in numbered versions. A version holds the
    whole graph; upserts are parts, numbered by themselves, that hold only the
    rows they brought. A version names the parts that it holds, so an upsert that
    is still being written while others are merged counts from when it is done.
    Of several rows with one key that of the last part counts. After so many
    upserts the next one writes a whole graph again; merged parts go when no kept
    version needs them."""

    def __init__(self, spark: SparkSession, path: str, upserts: int = 16):
        self.spark, self.upserts = spark, upserts
        self.versions, self.parts = Versions(spark, path, "edges/_SUCCESS"), Versions(spark, f"{path.rstrip('/')}/parts", "edges/_SUCCESS")

    def _last(self) -> int | None:
        return (self.versions.whole() or [None])[-1]

    def _after(self, version: int | None = None) -> list[int]:
        """Numbers of the upserts that are done and not in the (last) version."""
        version = version or self._last()
        held = self.versions.marks(version, "merged") if version else set()
        return [n for n in self.parts.whole() if n not in held]

    def read(self, linked: bool = True) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges; edges without both ends are left out (``linked``)."""
        version = self._last()
        after = self._after(version)
        nodes, edges = self._rows(version, after, "nodes", NODES, ["id"]), self._rows(version, after, "edges", EDGES, ["source", "target"])
        return nodes, linked_edges(edges, nodes) if linked else edges

    def part(self, numbers: list[int]) -> tuple[DataFrame, DataFrame]:
        """The rows that some upserts brought."""
        return self._rows(None, numbers, "nodes", NODES, ["id"]), self._rows(None, numbers, "edges", EDGES, ["source", "target"])

    def state(self) -> tuple[int, list[int], list[int]]:
        """What has to be known to follow the graph: the version that last
        replaced it, the parts that are done and still there, and the numbers of
        parts that aren't there any more."""
        version = self._last()
        root, since = ((max(self.versions.marks(version, kind), default=0) for kind in ("root", "since")) if version else (0, 0))
        there = self.parts._numbers()
        return root, self.parts.whole(), sorted(set(range(since + 1, max(there, default=0))) - set(there))

    def _rows(self, version: int | None, after: list[int], name: str, schema: S.StructType, key: list[str]) -> DataFrame:
        paths = ([f"{self.versions.path}/v{version}"] if version else []) + [f"{self.parts.path}/v{n}" for n in after]
        if not paths:
            return self.spark.createDataFrame([], schema)
        tables = [self.spark.read.schema(schema).parquet(f"{p}/{name}") for p in paths]
        if len(tables) == 1:
            return tables[0]
        every = tables[0].withColumn("__at", F.lit(0))
        for n, part in enumerate(tables[1:], 1):
            every = every.unionByName(part.withColumn("__at", F.lit(n)))
        rest = [c for c in schema.names if c not in key]
        return every.groupBy(*key).agg(F.max_by(F.struct(*rest), "__at").alias("__r")).select(*(F.col(c) if c in key else F.col(f"__r.{c}").alias(c) for c in schema.names))

    def write(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Put a whole graph in place of what is there: of the upserts that are
        done, that is."""
        self._whole(nodes, edges, self.parts.whole(), None)

    def _whole(self, nodes: DataFrame, edges: DataFrame, merged: list[int], before: int | None) -> None:
        """A whole version that holds parts, beside those that the version
        ``before`` holds; without that one it replaces the graph."""
        at = self.versions.new()
        number = int(at.rsplit("v", 1)[1])
        nodes.select(*NODES.names).write.parquet(f"{at}/nodes")
        there = set(self.parts._numbers())
        held = {n for n in self.versions.marks(before, "merged") if n in there} | set(merged) if before else set(merged)
        root = max(self.versions.marks(before, "root"), default=number) if before else number
        since = max(self.versions.marks(before, "since"), default=0) if before else max(there, default=0)
        # ``root``: the version that last replaced the graph; ``since``: the last part before that.
        self.versions.mark(number, (*(f"merged-{n}" for n in held), f"root-{root}", f"since-{since}"))
        edges.select(*EDGES.names).write.parquet(f"{at}/edges")
        self.versions.tidy()
        # Parts that every kept version holds.
        self.parts.drop(self.versions.everywhere("merged") - set(self.parts._numbers()[-1:]))

    def upsert(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Put in rows, each in place of the one with its key. Only they are
        written; their keys must be unique among them."""
        at = self.parts.new()
        nodes.select(*NODES.names).write.parquet(f"{at}/nodes")
        edges.select(*EDGES.names).write.parquet(f"{at}/edges")
        if len(self._after(self._last())) > self.upserts:
            self.compact()

    def compact(self) -> None:
        """Write the graph whole."""
        version = self._last()
        after = self._after(version)
        self._whole(self._rows(version, after, "nodes", NODES, ["id"]), self._rows(version, after, "edges", EDGES, ["source", "target"]), after, version)

    def clear(self) -> None:
        self.write(self.spark.createDataFrame([], NODES), self.spark.createDataFrame([], EDGES))

    def counts(self) -> dict[str, int]:
        nodes, edges = self.read()
        return {"nodes": nodes.count(), "edges": edges.count()}


def chat_role(role: Column | str) -> Column:
    """A message's role in the model's terms."""
    c = F.col(role) if isinstance(role, str) else role
    return F.when(c == "assistant", F.lit("model")).otherwise(c)


def cache_key(model: str, content: Column | str) -> Column:
    return F.md5(F.concat(F.lit(model + ":"), F.col(content) if isinstance(content, str) else content))


def fresh(timestamp: Column | str, now: Column, hours: int = 24) -> Column:
    """Whether an entry is still valid: not older than ``hours``."""
    c = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    return c >= now - F.make_interval(hours=F.lit(hours))


def age_hours(timestamp: Column | str, now: Column) -> Column:
    c = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    return F.floor((now.cast("timestamp").cast("double") - c.cast("timestamp").cast("double")) / 3600).cast("long")


def cache_stats(cache: DataFrame, response: str = "response") -> DataFrame:
    size = F.coalesce(F.sum(F.octet_length(response)), F.lit(0))
    return cache.agg(F.count(F.lit(1)).alias("entries"), size.cast("long").alias("bytes"), F.round(size / (1024 * 1024), 2).alias("megabytes"))


def cache_hits(requests: DataFrame, cache: DataFrame, now: Column, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """Requests with a valid reply, and those without."""
    valid = cache.filter(fresh("timestamp", now, hours)).select("key", "response")
    return requests.join(valid, "key"), requests.join(valid, "key", "left_anti")


def latest(cache: DataFrame) -> DataFrame:
    """Of several entries of a key the one stored last."""
    return cache.groupBy("key").agg(F.max_by(F.struct("timestamp", "response"), F.struct("timestamp", "response")).alias("e")).select("key", "e.timestamp", "e.response")


def cache_list(cache: DataFrame, now: Column) -> DataFrame:
    """``(key, age_hours, bytes)`` of the entries."""
    return latest(cache).select("key", age_hours("timestamp", now).alias("age_hours"), F.octet_length("response").cast("long").alias("bytes"))


class ReplyCache:
    """Model replies under a folder. New ones are parts of their own; cleaning
    and clearing write a version that names the parts it stands for, so what is
    stored meanwhile stays."""

    def __init__(self, spark: SparkSession, path: str, hours: int = 24):
        self.spark, self.hours, self._table = spark, hours, None
        self.versions, self.parts = Versions(spark, path, "entries/_SUCCESS"), Versions(spark, f"{path.rstrip('/')}/parts", "_SUCCESS")

    @classmethod
    def of(cls, table: DataFrame, hours: int = 24) -> ReplyCache:
        """A table of entries as a cache that is only read."""
        found = cls.__new__(cls)
        found.spark, found.hours, found.versions, found._table = table.sparkSession, hours, None, table
        return found

    def _paths(self) -> tuple[list[str], list[int]]:
        """Folders of the entries, and the parts among them."""
        last = (self.versions.whole() or [None])[-1]
        held = self.versions.marks(last, "merged") if last else set()
        after = [n for n in self.parts.whole() if n not in held]
        return ([f"{self.versions.path}/v{last}/entries"] if last else []) + [f"{self.parts.path}/v{n}" for n in after], after

    def entries(self) -> DataFrame:
        if self._table is not None:
            return self._table
        paths, _ = self._paths()
        return self.spark.read.schema(CACHE).parquet(*paths) if paths else self.spark.createDataFrame([], CACHE)

    def hits(self, requests: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """Requests with a valid reply, and those without."""
        return cache_hits(requests, latest(self.entries()), F.current_timestamp() if now is None else now, self.hours)

    def put(self, replies: DataFrame, now: Column | None = None) -> None:
        """Store ``(key, response)`` rows."""
        replies.select("key", (F.current_timestamp() if now is None else now).alias("timestamp"), "response").write.parquet(self.parts.new())

    def _replace(self, entries: DataFrame, merged: list[int]) -> None:
        at = self.versions.new()
        number, there = int(at.rsplit("v", 1)[1]), self.parts._numbers()
        last = (self.versions.whole() or [None])[-1]
        held = {n for n in self.versions.marks(last, "merged") if n in there} if last else set()
        self.versions.mark(number, (f"merged-{n}" for n in held | set(merged)))
        entries.select(*CACHE.names).write.parquet(f"{at}/entries")
        self.versions.tidy()
        self.parts.drop(self.versions.everywhere("merged") - set(there[-1:]))

    def clean(self, now: Column | None = None) -> None:
        """Only valid entries stay, one for each key."""
        merged = self._paths()[1]
        self._replace(latest(self.entries()).filter(fresh("timestamp", F.current_timestamp() if now is None else now, self.hours)), merged)

    def clear(self) -> None:
        self._replace(self.spark.createDataFrame([], CACHE), self._paths()[1])

    def stats(self) -> DataFrame:
        return cache_stats(latest(self.entries()))

    def listed(self, now: Column | None = None) -> DataFrame:
        return cache_list(self.entries(), F.current_timestamp() if now is None else now)
