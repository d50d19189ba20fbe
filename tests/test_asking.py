"""Replies written through in batches, pacing by feedback, the cache beside its cleaning."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from graphloom.plans import chat_model
from graphloom.plans.chat_model import Pace, Template, replies
from graphloom.sources.shared import fresh_path
from graphloom.sources.store import ReplyCache, Versions, cache_key


def counting(folder):
    """A provider that notes each call as a file."""

    def reply(prompt):
        with tempfile.NamedTemporaryFile(dir=folder, delete=False) as note:
            note.write(prompt.encode())
        return "re " + prompt

    return Template(reply)


def test_a_stopped_run_goes_on_from_its_last_batch(spark, tmp_path):
    prompts = spark.createDataFrame([(f"prompt {i}",) for i in range(200)], "prompt string")
    cache = ReplyCache(spark, fresh_path(spark, "cache"))
    put, batches = cache.put, []

    def stopping(rows, now=None):
        if len(batches) == 2:
            raise KeyboardInterrupt
        put(rows, now)
        batches.append(rows.count())

    cache.put = stopping
    with pytest.raises(KeyboardInterrupt):
        replies(prompts, counting(str(tmp_path)), "m", cache, batch=50)
    cache.put = put
    asked, stored = len(os.listdir(tmp_path)), sum(batches)
    assert 50 < stored < asked < 200 and cache.entries().count() == stored
    found = replies(prompts, counting(str(tmp_path)), "m", cache, batch=50)
    assert {r.key: r.response for r in found.collect()} == {r.k: "re " + r.prompt for r in prompts.select(cache_key("m", "prompt").alias("k"), "prompt").collect()}
    assert len(os.listdir(tmp_path)) == asked + 200 - stored
    assert {r.status: r["count"] for r in found.groupBy("status").count().collect()} == {"cached": stored, "ok": 200 - stored}
    assert replies(prompts, counting(str(tmp_path)), "m", cache).filter("status = 'ok'").count() == 0


def test_failures_are_not_stored_and_empty_steps_ask_nothing(spark):
    cache = ReplyCache(spark, fresh_path(spark, "cache"))

    def reply(prompt):
        if prompt.endswith("3"):
            raise ValueError("bad prompt")
        return "ok"

    prompts = spark.createDataFrame([(f"p{i}",) for i in range(10)], "prompt string")
    found = {r.key: r.status for r in replies(prompts, Template(reply), "m", cache, per_second=500, tasks=2).collect()}
    assert sorted(found.values()) == ["error: bad prompt"] + ["ok"] * 9 and cache.entries().count() == 9
    assert replies(prompts.limit(0), Template(reply), "m", cache).count() == 0


@pytest.mark.parametrize("limit", [7.0, 100.0, 950.0])
@pytest.mark.parametrize("first", [2.0, 2000.0])
def test_the_rate_finds_what_a_provider_bears(limit, first):
    """A provider that refuses what comes above its rate, with some noise."""
    draw, pace = random.Random(3), Pace(first)
    rates, calls, refusals = [], 0, 0
    for step in range(120):
        begun = max(4, int(3 * pace.rate))
        refused = max(0, round(begun * (1 - limit * draw.uniform(0.98, 1.02) / pace.rate)))
        if step >= 20:
            rates.append(min(pace.rate, limit))
            calls, refusals = calls + begun, refusals + refused
        pace.adapt(begun, refused)
    assert refusals < 0.05 * calls and 0.8 * limit < sum(rates) / len(rates) <= limit


def test_paced_asking_lowers_its_rate_on_refusals(spark, monkeypatch):
    class Refusing:
        def __init__(self):
            self.seen = set()

        def chat(self, prompt):
            if prompt not in self.seen and prompt.endswith("7"):
                self.seen.add(prompt)
                raise RuntimeError("UNAVAILABLE")
            return "ok"

    pace = Pace(100.0, most=400.0)
    prompts = spark.createDataFrame([(f"p{i}",) for i in range(250)], "prompt string")
    found = replies(prompts, Refusing(), "m", pace=pace, tasks=2)
    assert found.filter("status = 'ok'").count() == 250 and pace.met and pace.rate < 100


def test_replies_stored_while_the_cache_is_cleaned_stay(spark):
    cache = ReplyCache(spark, fresh_path(spark, "cache"))
    rows = lambda *keys: spark.createDataFrame([(k, "r " + k) for k in keys], "key string, response string")
    cache.put(rows("a", "b"))
    cache.put(rows("old"), F.current_timestamp() - F.expr("INTERVAL 30 HOURS"))
    entries, late = cache.entries, []

    def slow():
        held = spark.createDataFrame(entries().collect(), entries().schema)
        if not late:
            late.append(cache.put(rows("c")))  # between reading and writing
        return held

    cache.entries = slow
    cache.clean()
    cache.entries = entries
    assert {r.key for r in cache.entries().collect()} == {"a", "b", "c"}
    for i in range(Versions.KEPT + 1):
        cache.put(rows(f"d{i}"))
        cache.clean()
    assert {r.key for r in cache.entries().collect()} == {"a", "b", "c", *(f"d{i}" for i in range(Versions.KEPT + 1))}
    assert len(cache.parts._numbers()) <= Versions.KEPT + 1
    cache.clear()
    assert cache.entries().count() == 0


def test_without_cache_or_rate_all_are_asked_in_one_go(spark, tmp_path):
    prompts = spark.createDataFrame([(f"prompt {i}",) for i in range(100)], "prompt string")
    found = replies(prompts, counting(str(tmp_path)), "m", batch=10)
    assert found.filter("status = 'ok'").count() == len(os.listdir(tmp_path)) == 100
    files = {name.rsplit("at=", 1)[1].split("/")[0] for name in found.inputFiles()}
    assert files == {"0"} and len(found.inputFiles()) > 1
