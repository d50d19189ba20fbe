from pyspark.sql import functions as F

from graphloom.sources import loaders
from graphloom.sources.store import GraphStore, cache_hits, fresh, upserted


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


def test_csv_takes_the_first_filled_column(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,text,content\n1,,from content\n2,from text,x\n3,   ,never\n4,"a ""quoted"" one",y\n')
    df = loaders.read_csv(spark, str(path))
    got = {r.content for r in loaders.csv_chunks(df, order="id").collect()}
    assert got == {"from content", "from text", 'a "quoted" one'}


def test_limit_counts_accepted_chunks(spark):
    df = spark.createDataFrame([(1, " "), (2, "b"), (3, "c")], "n int, text string")
    assert [r.content for r in loaders.csv_chunks(df, order="n", rows=1).collect()] == ["b"]


def test_modes(spark):
    df = spark.createDataFrame([("x" * 900,), ("short",), ("宋江" * 6,)], "text string")
    lengths = lambda mode: sorted(len(r.content) for r in loaders.csv_chunks(df, mode).collect())
    assert lengths("slow") == [5, 12, 803]
    assert lengths("fixed") == [12, 900]
    assert lengths("legacy-fixed") == [12]
    assert lengths("legacy") == [5, 12, 900]


def packed(paragraphs, most):
    out, now = [], ""
    for p in paragraphs:
        if now and len(now) + len(p) > most:
            out.append(now)
            now = p
        else:
            now = p if not now else now + "\n\n" + p
    return out + [now] if now else out


def test_paragraphs_are_packed(spark):
    parts = ["a" * n for n in (400, 300, 350, 1200, 10, 20, 980)]
    assert one(spark, "\n \n".join(parts), loaders.packed_paragraphs) == packed(parts, 1000)
    assert one(spark, "", loaders.packed_paragraphs) == []
    assert one(spark, "　甲　\n\n乙", loaders.packed_paragraphs) == ["甲\n\n乙"]


def test_sentences_are_packed(spark):
    text = "一二三。四五！六七八九？十" 
    assert one(spark, text, lambda c: loaders.packed_sentences(c, 7)) == ["一二三。四五！", "六七八九？十"]
    assert one(spark, "x" * 20, lambda c: loaders.packed_sentences(c, 7)) == ["x" * 20]


def test_short_paragraphs_are_dropped(spark):
    assert one(spark, "ab\n\nlong  enough", lambda c: loaders.chunked_paragraphs(c, 5, 300)) == ["long enough"]


def test_upsert_replaces_whole_rows(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, v string")
    new = spark.createDataFrame([("b", None), ("c", "z")], "id string, v string")
    assert {(r.id, r.v) for r in upserted(old, new, ["id"]).collect()} == {("a", "x"), ("b", None), ("c", "z")}


NODE = "id string, entity_type string, description string, source_ids array<string>"
EDGE = "source string, target string, description string, weight double, keywords array<string>, source_ids array<string>"


def test_store(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    assert store.counts() == {"nodes": 0, "edges": 0}
    nodes = spark.createDataFrame([("A", "P", "d", ["1"]), ("B", "P", None, [])], NODE)
    edges = spark.createDataFrame([("A", "B", "e", 1.0, ["k"], ["1"]), ("A", "GONE", "e", 1.0, [], [])], EDGE)
    store.upsert(nodes, edges)
    assert store.counts() == {"nodes": 2, "edges": 1}
    store.upsert(spark.createDataFrame([("A", "L", "new", ["2"])], NODE), spark.createDataFrame([], EDGE))
    assert {(r.id, r.description) for r in store.read()[0].collect()} == {("A", "new"), ("B", None)}
    store.clear()
    assert store.counts() == {"nodes": 0, "edges": 0}


def test_cache_entries_of_a_day_are_valid(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    cache = spark.createDataFrame([("a", "2024-01-01 00:00:00", "ra"), ("b", "2023-12-31 23:59:59", "rb")], "key string, t string, response string").withColumn("timestamp", F.col("t").cast("timestamp"))
    assert [r.key for r in cache.filter(fresh("timestamp", now)).collect()] == ["a"]
    hits, misses = cache_hits(spark.createDataFrame([("a",), ("b",)], "key string"), cache, now)
    assert [r.response for r in hits.collect()] == ["ra"] and [r.key for r in misses.collect()] == ["b"]
