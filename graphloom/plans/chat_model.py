"""Calls of a chat model from Spark: an injected provider, the reply cache,
bounded retries with a time limit, and statuses in place of error texts.

A step's prompts are rows; each distinct one is asked once, and only if the
cache has no valid reply. Prompts are put into a queue, a table in the order of
their places, which batches of bounded size are read from; each batch's replies
are written, and stored in the cache, before the next is asked. So a run that is
stopped goes on from there, no later action asks again, and a lost task repeats
its calls of one batch only. Without a cache nothing is left of a stopped run, and
without a rate nothing is learnt from a batch: then all are asked in one go, by
tasks of about a batch.

The rate of calls is one for the whole job. Tasks begin calls at their share of
it, and wait for replies in threads. What a provider refuses during a batch
lowers the rate of the next one; without refusals it rises slowly.
"""

from __future__ import annotations

import functools
import random
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.sources.shared import fresh_path, written
from graphloom.sources.store import ReplyCache, cache_key

#: Failures worth another attempt.
PASSING = ("UNAVAILABLE", "DEADLINE_EXCEEDED", "ECONNRESET", "ETIMEDOUT")

#: A conversation, as the provider gets it.
CONTENTS = "array<struct<role:string,parts:array<struct<text:string>>>>"


class Provider(Protocol):
    """``prompt`` is a text, or a conversation as ``[{role, parts: [{text}]}]``."""

    def chat(self, prompt: str | list) -> str: ...


class Template:
    """A provider that fills a text: for tests and dry runs."""

    def __init__(self, reply: Callable[[str | list], str]):
        self.reply = reply

    def chat(self, prompt: str | list) -> str:
        return self.reply(prompt)


def contents(messages) -> list[dict]:
    """A text, a message or a list of them as ``[{role, parts: [{text}]}]``."""
    if isinstance(messages, (str, dict)):
        messages = [messages]
    out = []
    for m in messages:
        m = {"role": "user", "content": m} if isinstance(m, str) else m
        parts = m["parts"] if "parts" in m else [{"text": str(m.get("content", m.get("text", "")))}]
        out.append({"role": "model" if m.get("role") == "assistant" else m.get("role", "user"), "parts": parts})
    return out


def filled(template: str, **values: Column | str) -> Column:
    """A template with each ``{name}`` replaced by a column, wherever it stands;
    braces in the values stay as they are."""
    parts, rest = [], template
    while rest:
        spots = sorted((at, name) for name in values if (at := rest.find("{" + name + "}")) >= 0)
        if not spots:
            parts.append(F.lit(rest))
            break
        at, name = spots[0]
        value = values[name]
        parts += [F.lit(rest[:at]), F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def said(role: str, text: Column) -> Column:
    """A conversation of one message."""
    return F.array(F.struct(F.lit(role).alias("role"), F.array(F.struct(text.alias("text"))).alias("parts")))


class TimedOut(Exception):
    pass


def limited(provider: Provider, prompt: str | list, seconds: float) -> str:
    """The provider's reply, if it comes in time."""
    found: list = []

    def ask() -> None:
        try:
            found.append((True, provider.chat(prompt)))
        except Exception as error:  # noqa: BLE001  a provider may raise anything
            found.append((False, error))

    worker = threading.Thread(target=ask, daemon=True)
    worker.start()
    worker.join(seconds)
    if not found:
        raise TimedOut(f"no reply in {seconds} s")
    ok, value = found[0]
    if not ok:
        raise value
    return value


@dataclass
class Pace:
    """Calls a second for a whole job. ``adapt`` takes what a batch was told: the
    rate falls where more than ``borne`` of the calls were refused, to what got
    through and a little less; else it rises, quickly until the first refusal and
    slowly from then on, up to ``most``."""

    rate: float
    most: float = float("inf")
    rise: float = 1.03
    start: float = 1.5
    fall: float = 0.92
    borne: float = 0.01
    met: bool = False

    def adapt(self, calls: int, refused: int) -> float:
        if calls and refused > self.borne * calls:
            through = max(calls - refused, 1) / calls
            self.rate, self.met = self.rate * max(min(through, 1.0), 0.1) * self.fall, True
        elif calls:
            self.rate = min(self.most, self.rate * (self.rise if self.met else self.start))
        return self.rate


def call(provider: Provider, prompt: str | list, attempts: int = 4, base_ms: int = 400, sleep: Callable[[float], None] = time.sleep, seconds: float = 30.0, refused: Callable[[], None] | None = None) -> tuple[str, str | None]:
    """``(status, text)``; only passing failures are tried again, with growing
    waits. A call that takes too long isn't. ``refused`` is told of each passing
    failure."""
    for attempt in range(attempts):
        try:
            return "ok", limited(provider, prompt, seconds)
        except TimedOut as error:
            return f"error: {error}", None
        except Exception as error:  # noqa: BLE001
            text = str(error)
            passing = any(p in text for p in PASSING)
            if passing and refused:
                refused()
            if attempt + 1 == attempts or not passing:
                return "error: " + text, None
            sleep((base_ms * 2**attempt + random.random() * 200) / 1000)
    return "error", None


#: Most calls of a task that wait for their reply at one time.
IN_FLIGHT = 16


def asking(provider: Provider, column: str, share: float | None, seconds: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A task's work: prompts to ``key, status, response, refused``. With
    ``share`` at most so many calls a second are begun, whatever their replies
    take; else one is made after another."""

    def plain(prompt):
        return prompt if isinstance(prompt, str) else [{"role": m["role"], "parts": [{"text": p["text"]} for p in m["parts"]]} for m in prompt]

    def one(prompt) -> tuple[str, str | None, int]:
        refusals: list = []
        found = call(provider, plain(prompt), seconds=seconds, refused=lambda: refusals.append(1))
        return (*found, len(refusals))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(IN_FLIGHT) as pool:
            due = time.monotonic()
            for frame in frames:
                rows = []
                for prompt in frame[column]:
                    if share:
                        time.sleep(max(0.0, due - time.monotonic()))
                        due = max(due, time.monotonic() - 1 / share) + 1 / share
                    rows.append(pool.submit(one, prompt) if share else one(prompt))
                rows = [r.result() if share else r for r in rows]
                yield pd.DataFrame({"key": frame["key"], "status": [r[0] for r in rows], "response": [r[1] for r in rows], "refused": [r[2] for r in rows]})

    return run


def replies(
    prompts: DataFrame, provider: Provider, model: str, cache: ReplyCache | DataFrame | None = None, per_second: float | None = None,
    tasks: int = 8, seconds: float = 30.0, batch: int = 2_000, pace: Pace | None = None,
) -> DataFrame:
    """``key, status, response`` for the distinct ones of ``prompts``, which have
    a column ``prompt`` (texts) or ``contents`` (conversations).

    With ``per_second`` at most so many calls a second are begun in the whole
    job, by ``tasks`` tasks; with ``pace`` their number follows what the provider
    bears. A batch of about ``batch`` prompts (with ``pace``: of a few seconds) is
    stored in the cache as soon as it is answered.
    """
    column = "contents" if "contents" in prompts.columns else "prompt"
    asked = prompts.select(content_key(model, column).alias("key"), column).dropDuplicates(["key"])
    known = None
    if cache is not None:
        known, asked = (cache if isinstance(cache, ReplyCache) else ReplyCache.of(cache)).hits(asked)
        known = written(known.select("key", F.lit("cached").alias("status"), "response"), "replies")
    placed = asked.withColumn("at", F.pmod(F.xxhash64("key"), F.lit(1 << 20)))
    whole = not isinstance(cache, ReplyCache) and not pace and not per_second
    # In order, so that a batch reads its own files and row groups and no others.
    queue = written(placed if whole else placed.repartitionByRange("at").sortWithinPartitions("at"), "queue")
    spark, left, out, begin = prompts.sparkSession, queue.count(), fresh_path(prompts.sparkSession, "replies"), 0
    total = left
    while left > 0:
        rate = pace.rate if pace else per_second
        number = max(tasks, int(3 * rate)) if pace else left if whole else batch
        # Places are hashes, so a share of them holds about that share of the prompts.
        end = (1 << 20) if number >= left else min(1 << 20, begin + max(1, (1 << 20) * number // total))
        part = queue.filter((F.col("at") >= begin) & (F.col("at") < end)).drop("at")
        part = part.repartition(tasks) if rate else part.repartition(-(-left // batch)) if whole and left > batch else part
        seen = Observation()
        answers = part.mapInPandas(asking(provider, column, rate / tasks if rate else None, seconds), "key string, status string, response string, refused long")
        answers = answers.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("refused").alias("refused"))
        at = f"{out}/at={begin}"
        answers.select("key", "status", "response").write.parquet(at)
        done, refused = seen.get["n"] or 0, seen.get["refused"] or 0
        if isinstance(cache, ReplyCache) and done:
            cache.put(spark.read.parquet(at).filter("status = 'ok'"))
        if pace:
            pace.adapt(done + refused, refused)
        left, begin = left - done, end
        if end >= 1 << 20:
            break
    shape = "key string, status string, response string"
    fresh = spark.read.schema(shape + ", at int").parquet(out).drop("at") if total else spark.createDataFrame([], shape)
    return fresh if known is None else known.unionByName(fresh)


def content_key(model: str, column: str = "prompt") -> Column:
    """The cache's key of a prompt or of a conversation."""
    return cache_key(model, column if column == "prompt" else F.to_json(column))


def answered(rows: DataFrame, provider: Provider, model: str, column: str = "prompt", **options) -> DataFrame:
    """``rows`` with ``status`` and ``response`` to their prompt or conversation."""
    key = "__key"
    keyed = written(rows.withColumn(key, content_key(model, column)), "prompts")
    found = replies(keyed.select(column), provider, model, **options).withColumnRenamed("key", key)
    return keyed.join(found, key, "left").drop(key)


def retried(run: Callable[[], object], attempts: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep):
    """A whole pipeline's result; a failed run is begun anew, after a wait that
    grows with the number of attempts."""
    for attempt in range(1, attempts + 1):
        try:
            return run()
        except Exception:
            if attempt == attempts:
                raise
            sleep(attempt * wait)


def glean(provider: Provider, prompt: str, more: str, ask: str, times: int = 2, record: str = "##") -> str:
    """A first reply and up to ``times`` further ones, joined as records; after
    each but the last the model is asked whether there is more. The model gets
    the whole conversation each time."""
    talk = contents(prompt)
    chat = functools.partial(_turn, provider, talk)
    out = [chat(None)]
    for i in range(times):
        out.append(chat(more))
        if i + 1 < times and no_more(chat(ask)):
            break
    return record.join(out)


def _turn(provider: Provider, talk: list[dict], text: str | None) -> str:
    if text is not None:
        talk += contents(text)
    reply = provider.chat(list(talk))
    talk += contents({"role": "model", "content": reply})
    return reply


def no_more(reply: str) -> bool:
    return reply.strip().lower()[:1] == "n"
