import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from graphloom.operators import report, search
from graphloom.plans import build, chat_model, rag
from graphloom.sources.shared import fresh_path, written
from graphloom.sources.store import GraphStore, ReplyCache, cache_key
from graphloom.streaming.ingest import REPLIES, ingest

# Workers don't find this module, so its providers go to them whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAID = '("entity"<|>Alice<|>person<|>an engineer)##("entity"<|>Acme<|>company<|>a maker)##("relationship"<|>Alice<|>Acme<|>works at<|>job<|>2)'


def replies(spark, *texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], REPLIES)


def test_question_to_answer(spark):
    nodes, edges = rag.build_graph(replies(spark, SAID, SAID))
    assert edges.first().weight == 4.0
    asked = []
    provider = chat_model.Template(lambda p: asked.append(p) or 'She works at Acme. ["ALICE", "ACME"]')
    got = rag.answer("alice", nodes, edges, provider)
    assert got["answer"] == "She works at Acme." and got["entities"] == ["ALICE", "ACME"] and "ALICE" in asked[0]
    assert rag.answer("zzzz", nodes, edges, provider)["answer"] == rag.NOTHING_FOUND and len(asked) == 1
    with pytest.raises(ValueError):
        rag.answer("alice", nodes.limit(0), edges, provider)


def test_search_strategies(spark):
    items = spark.createDataFrame([("node", "aaa", "aaa"), ("node", "bbb", "bbb aaa"), ("node", "theatre", "theatre")], "type string, id string, text string")
    got = {r.id: (r.score, r.relevance) for r in search.bigram_search(items, "aa").collect()}
    assert got == {"aaa": (2, 2.0), "bbb": (2, 2.0)}
    assert [r.id for r in search.fuzzy_search(items, "theatra").collect()] == ["theatre"]
    assert {r.method for r in search.sequential_search(items, "theatra").collect()} == {"bigram"}
    assert search.bigram_search(items, "").count() == 0
    assert "fuzzy" in search.combined_search(items, "theatra").first().methods
    idx = search.write_index(items, fresh_path(spark, "index"))
    for question in ("aa", "bbb theatre", "theatra", ""):
        for find in (search.combined_search, search.sequential_search):
            assert find(items, question, idx=idx).collect() == find(items, question).collect()
    assert search.combined_search(items, "theatre", use_bigram=False, use_keywords=False, use_fuzzy=False).count() == 0
    assert [r.id for r in search.substring_search(items, "a bbb").collect()] == ["bbb"]


def test_retries_only_passing_failures():
    calls = []

    class Failing:
        def __init__(self, error):
            self.error = error

        def chat(self, prompt):
            calls.append(prompt)
            raise RuntimeError(self.error)

    assert chat_model.call(Failing("UNAVAILABLE"), "p", sleep=lambda s: None)[0].startswith("error") and len(calls) == 4
    calls.clear()
    assert chat_model.call(Failing("bad key"), "p", sleep=lambda s: None)[1] is None and len(calls) == 1


def test_replies_come_from_the_cache_first(spark):
    prompts = spark.createDataFrame([("a",), ("a",), ("b",)], "prompt string")
    cache = spark.createDataFrame([("a", "old")], "p string, response string").select(cache_key("m", "p").alias("key"), F.current_timestamp().alias("timestamp"), "response")
    got = sorted((r.status, r.response) for r in chat_model.replies(prompts, chat_model.Template(str.upper), "m", cache).collect())
    assert got == [("cached", "old"), ("ok", "B")]


def test_messages():
    assert chat_model.contents("x") == [{"role": "user", "parts": [{"text": "x"}]}]
    assert chat_model.contents([{"role": "assistant", "content": "y"}])[0]["role"] == "model"


def test_gleaning_stops_on_no():
    said = iter(["first", "second", "N", "never"])
    heard = []
    assert chat_model.glean(chat_model.Template(lambda p: heard.append(len(p)) or next(said)), "p", "more", "ask") == "first##second"
    assert heard == [1, 3, 5]


def test_whole_pipeline(spark):
    found = rag.run_pipeline(replies(spark, SAID, SAID.replace("Alice", "Bob")), written)
    assert found["nodes"].count() == 3 and found["edges"].count() == 2
    assert found["contexts"].first().members and "ACME" in found["contexts"].first().entities


class Counted:
    """A provider that notes each call in a file."""

    def __init__(self, path, delay=0.0):
        self.path, self.delay = path, delay

    def chat(self, prompt):
        time.sleep(self.delay)
        with open(self.path, "a") as f:
            f.write(f"{time.time()}\n")
        return f"said {prompt}"


def test_each_prompt_is_asked_once_and_cached(spark, tmp_path):
    prompts = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "prompt string").filter("prompt is not null")
    cache, provider = ReplyCache(spark, str(tmp_path / "cache")), Counted(str(tmp_path / "calls"))
    calls = lambda: len((tmp_path / "calls").read_text().splitlines())
    got = chat_model.replies(prompts, provider, "m", cache)
    assert {r.response for r in got.collect()} == {"said a", "said b"} and got.count() == 2 and calls() == 2
    assert {r.status for r in chat_model.replies(prompts, provider, "m", cache).collect()} == {"cached"} and calls() == 2
    assert chat_model.answered(prompts, provider, "m", cache=cache).count() == 3 and calls() == 2
    later = F.current_timestamp() + F.expr("interval 25 hours")
    cache.put(spark.createDataFrame([("k", "new")], "key string, response string"), later)
    assert cache.stats().first().entries == 3 and {r.age_hours for r in cache.listed(later).collect()} == {0, 25}
    cache.clean(later)
    assert [r.key for r in cache.entries().collect()] == ["k"]
    cache.clear()
    assert cache.stats().first().entries == 0


def test_rate_holds_for_the_whole_job(spark, tmp_path):
    prompts = spark.createDataFrame([(str(i),) for i in range(12)], "prompt string")
    chat_model.replies(prompts, Counted(str(tmp_path / "calls")), "m", per_second=6, tasks=2)
    at = sorted(map(float, (tmp_path / "calls").read_text().split()))
    assert at[-1] - at[0] > 1.2


def test_slow_calls_are_given_up(tmp_path):
    assert chat_model.call(Counted(str(tmp_path / "calls"), 5.0), "p", seconds=0.1) == ("error: no reply in 0.1 s", None)


def test_failed_runs_are_begun_anew():
    tries, waits = [], []

    def run():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("away")
        return "done"

    assert chat_model.retried(run, sleep=waits.append) == "done" and waits == [2.0, 4.0]
    with pytest.raises(OSError):
        chat_model.retried(lambda: (_ for _ in ()).throw(OSError("away")), attempts=2, sleep=waits.append)


def test_templates_are_filled_everywhere_and_literally(spark):
    row = spark.createDataFrame([("{b} $&", "x")], "a string, b string")
    assert row.select(chat_model.filled("{a}-{b}-{a} {c}", a="a", b="b").alias("t")).first().t == "{b} $&-x-{b} $& {c}"


class Reader:
    """A provider for a whole build: entities of the text, yes to all pairs, reports."""

    def chat(self, prompt):
        text = prompt if isinstance(prompt, str) else prompt[0]["parts"][0]["text"]
        if "Question 1:" in text:
            return "(For question <|>1<|>, <|>yes<|>)"
        if "Report on" in text:
            return '{"title": "t", "summary": "s", "rating": 3, "rating_explanation": "e", "findings": [{"summary": "f", "explanation": "g"}]}'
        if not isinstance(prompt, str) and prompt[-1]["parts"][0]["text"] == build.ASK_PROMPT:
            return "N"
        return "" if not isinstance(prompt, str) and len(prompt) > 1 else SAID.replace("Acme", "Acme " + text.strip()[-1])


def test_whole_build(spark):
    chunks = spark.createDataFrame([(1, 0, "text 1"), (2, 0, "text 2")], "doc_id long, chunk_seq int, content string")
    found = build.built(chunks, Reader(), "m", written)
    assert {r.id for r in found["nodes"].collect()} == {"ALICE", "ACME 1", "ACME 2"}
    assert {r.id for r in found["resolved_nodes"].collect()} == {"ALICE", "ACME 1"}
    assert [(r.title, sorted(r.entities)) for r in found["reports"].collect()] == [("t", ["ACME 1", "ALICE"])]
    assert build.built(chunks, Reader(), "m", written, algorithm="louvain")["reports"].count() == 1


def test_stream_into_the_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = GraphStore(spark, str(tmp_path / "graph"))
    for n, text in enumerate((SAID, SAID.replace("Alice", "Bob"))):
        replies(spark, text).write.mode("append").json(str(tmp_path / "in"))
        ingest(spark.readStream.schema(REPLIES).json(str(tmp_path / "in")), store, str(tmp_path / "ck")).awaitTermination()
        assert store.counts() == {"nodes": 2 + n, "edges": 1 + n}


def test_page(spark):
    nodes, edges = rag.build_graph(replies(spark, SAID))
    assert '"id":"ALICE"' in report.page(nodes, edges, "<script>//__DATA__HERE__</script>")


def test_page_of_the_central_nodes(spark):
    nodes, edges = rag.build_graph(replies(spark, SAID, SAID.replace("Alice", "Bob")))
    first, among = report.central(nodes, edges, 2)
    assert {r.id for r in first.collect()} == {"ACME", "ALICE"} and among.count() == 1
    page = report.page(nodes, edges, "//__DATA__HERE__", most=2)
    assert "BOB" not in page and "ALICE" in page and "BOB" in report.page(nodes, edges, "//__DATA__HERE__")


def test_upserts_are_put_together_and_made_whole(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"), upserts=2)
    said = lambda name, text: rag.build_graph(replies(spark, SAID.replace("Alice", name).replace("an engineer", text)))
    for n, (name, text) in enumerate([("Alice", "first"), ("Bob", "second"), ("Alice", "third"), ("Carl", "fourth"), ("Bob", "fifth")]):
        store.upsert(*said(name, text))
        if n == 2:
            assert store.versions.last() is not None and not store._after()
    nodes, _ = store.read()
    assert {(r.id, r.description) for r in nodes.collect()} == {("ALICE", "third"), ("BOB", "fifth"), ("CARL", "fourth"), ("ACME", "a maker")}
    assert store.counts() == {"nodes": 4, "edges": 3}
    store.clear()
    assert store.counts() == {"nodes": 0, "edges": 0}
    store.upsert(*said("Dora", "sixth"))
    assert store.counts() == {"nodes": 2, "edges": 1}
