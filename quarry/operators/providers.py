"""Calls to the outside world behind replaceable providers, made once per distinct key and replayed from a table."""

import json
import re
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import cut, stored


class Provider(Protocol):
    """One reply per request; made once per task, so it may hold a client."""

    def __call__(self, requests: list[str]) -> list[str]: ...


def echo() -> Provider:
    """An offline stand-in for a language model: a deterministic tagged reply."""

    def reply(requests: list[str]) -> list[str]:
        return [f"<think>{len(r)}</think><answer>yes</answer><explain>\nset_context(id=\"n0\")\nsimilar_to(id=\"n1\")\n</explain><dag>\nedge(\"n1\", \"n1\", relation=\"causal\")\n</dag>" for r in requests]

    return reply


def table_lookup(table: dict[str, dict]) -> Callable[[], Provider]:
    """An offline stand-in for a keyed service: the JSON of a small dict; unknown keys raise."""
    return lambda: lambda requests: [json.dumps(table[r], ensure_ascii=False) for r in requests]


class _Pace:
    """Calls of a task begin no sooner than its share of the rate allows."""

    def __init__(self, per_second: float | None):
        self.gap, self.lock, self.next = 1 / per_second if per_second else 0.0, threading.Lock(), 0.0

    def wait(self) -> None:
        if self.gap:
            with self.lock:
                now = time.monotonic()
                at = max(now, self.next)
                self.next = at + self.gap
            time.sleep(at - now)


def _patient(provider: Provider, request: str, tries: int, backoff: float, pace: _Pace) -> tuple[str | None, str | None]:
    """The reply and the error of one request."""
    error = None
    for turn in range(tries):
        if turn and backoff:
            time.sleep(backoff * 2 ** (turn - 1))
        pace.wait()
        try:
            (reply,) = provider([request])
            return reply, None
        except Exception as e:  # kept in the row
            error = f"{type(e).__name__}: {e}"
    return None, error


# Tokens of the first cut of a request that is refused, and by how many each further cut is shorter.
CUT, SHORTER = 850_000, 5_000


def shrinking(make: Callable[[], Provider], encode: Callable[[str], list], decode: Callable[[list], str], refused: tuple[type[Exception], ...] = (Exception,), most: int = CUT, step: int = SHORTER) -> Callable[[], Provider]:
    """a provider that cuts a request it is refused for to its first tokens, fewer and fewer, until it has a reply; the last
    refusal is raised when no token is left."""

    def build() -> Provider:
        ask_ = make()

        def one(request: str) -> str:
            try:
                return ask_([request])[0]
            except refused as e:
                tokens, size, last = encode(request), most, e
            while size > 0:
                try:
                    return ask_([decode(tokens[:size])])[0]
                except refused as e:
                    last = e
                    size = min(size, len(tokens)) - step if size >= len(tokens) else size - step  # cuts longer than the request change nothing
            raise last

        return lambda requests: [one(r) for r in requests]

    return build


class ProviderError(Exception):
    """A provider that couldn't be made."""


def _broken(why: str) -> Provider:
    def fail(requests: list[str]) -> list[str]:
        raise ProviderError(why)

    return fail


def call_once(requests: DataFrame, column: str, make: Callable[[], Provider], replay: DataFrame | None = None, tries: int = 3, batch: int = 64, at_once: int = 1, backoff: float = 0.0, per_second: float | None = None) -> DataFrame:
    """Key, request, reply, error of each distinct non-null request.

    Replies in `replay` (key, reply) are used again; the rest is called in batches. Failures, of the provider's making too, go to `error`,
    after so many tries, and never end the job.
    at_once: a task has so many calls of one request each in the air, and gives the replies in order; the wait before a try
    begins at `backoff` seconds and doubles. per_second: calls of all tasks together, at most. Write the result to extend the replay table: a task that runs again repeats its calls.
    """
    asked = requests.select(F.col(column).alias("request")).where("request is not null").distinct().withColumn("key", F.md5(F.col("request").cast("binary")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            provider = make()
        except Exception as e:  # no provider: every request of the task fails with it
            provider = _broken(f"{type(e).__name__}: {e}")
        if at_once > 1 or per_second:
            pace = _Pace(per_second and per_second / max(1, TaskContext.get().numPartitions()))
            with ThreadPoolExecutor(at_once) as pool:
                for frame in frames:
                    got = list(pool.map(lambda r: _patient(provider, r, tries, backoff, pace), frame["request"].tolist()))
                    yield pd.DataFrame({"key": frame["key"], "request": frame["request"], "reply": [a for a, _ in got], "error": [b for _, b in got]})
            return
        for frame in frames:
            replies, errors = [], []
            rows = frame["request"].tolist()
            for i in range(0, len(rows), batch):
                part = rows[i : i + batch]
                try:
                    got = list(provider(part))
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} replies to {len(part)} requests")
                    replies += got
                    errors += [None] * len(part)
                except Exception:
                    for one in part:
                        reply, error = None, None
                        for _ in range(tries):
                            try:
                                (reply,), error = provider([one]), None
                                break
                            except Exception as e:  # kept in the row
                                error = f"{type(e).__name__}: {e}"
                        replies.append(reply)
                        errors.append(error)
            yield pd.DataFrame({"key": frame["key"], "request": frame["request"], "reply": replies, "error": errors})

    schema = "key string, request string, reply string, error string"
    if replay is None:
        return asked.select("key", "request").mapInPandas(run, schema)
    known = replay.select("key", "reply").where("reply is not null").dropDuplicates(["key"])
    old = asked.join(known, "key").select("key", "request", "reply", F.lit(None).cast("string").alias("error"))
    new = asked.join(known, "key", "left_anti").select("key", "request").mapInPandas(run, schema)
    return old.unionByName(new)


def ask(rows: DataFrame, column: str, make: Callable[[], Provider], replay: DataFrame | None = None, into: str = "reply") -> DataFrame:
    """Every row with the reply to its request. Replies are kept before they are used, so none is asked for again."""
    return join_back(rows, column, cut(call_once(rows, column, make, replay)), into)


def join_back(rows: DataFrame, column: str, replies: DataFrame, into: str = "reply") -> DataFrame:
    """Every row with the reply to its request."""
    named = replies.select(F.col("key").alias("_key"), F.col("reply").alias(into), F.col("error").alias(f"{into}_error"))
    return rows.withColumn("_key", F.md5(F.col(column).cast("binary"))).join(named, "_key", "left").drop("_key")


def first_success(words: DataFrame, make: Callable[[], Provider], ok: Callable[[Column], Column], replay: DataFrame | None = None) -> DataFrame:
    """Index, pos, word, reply of each record's first word (index, pos, word) whose reply is ok; records without one have no row.

    Rounds of keyed calls: each round asks for the next word of the records that have no answer yet, once per distinct word, so
    no word is asked for that comes after a success. Replies are kept, so a word that several records reach later isn't asked again.
    """
    place = F.row_number().over(Window.partitionBy("index").orderBy("pos", "word"))
    left = stored(words.where("word <> ''").select("index", "pos", "word").distinct().withColumn("_turn", place))
    found, known = None, replay.select("key", "reply") if replay is not None else None
    turn = 1
    while not left.isEmpty():
        now = left.where(F.col("_turn") == turn).select("index", "pos", "word")
        replies = stored(call_once(now, "word", make, known))
        answers = replies.where(F.col("error").isNull()).select("key", "reply")
        known = answers if known is None else known.unionByName(answers).dropDuplicates(["key"])
        hits = stored(join_back(now, "word", replies).where(F.col("reply_error").isNull() & F.coalesce(ok(F.col("reply")), F.lit(False))).select("index", "pos", "word", "reply"))
        found = hits if found is None else found.unionByName(hits)
        left = stored(left.where(F.col("_turn") > turn).join(hits.select("index"), "index", "left_anti"))
        turn += 1
    return found if found is not None else left.select("index", "pos", "word", F.lit(None).cast("string").alias("reply"))


def dictionary_tagger(terms: dict[str, str]) -> Callable[[str], list[tuple[str, str]]]:
    """X01 offline: (entity, tag) of known terms in order of their places; longer terms win."""
    if not terms:
        return lambda text: []
    pattern = re.compile("|".join(rf"(?<!\w){re.escape(t)}(?!\w)" for t in sorted(terms, key=lambda t: (-len(t), t))))
    return lambda text: [(m.group(), terms[m.group()]) for m in pattern.finditer(text or "")]


def tag(texts: DataFrame, key: str, text: str, make: Callable[[], Callable[[str], list[tuple[str, str]]]]) -> DataFrame:
    """Key, pos, entity, tag; zero or more rows a text, a repeated entity keeping its last tag at its first place."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = make()
        for frame in frames:
            rows = []
            for k, t in zip(frame[key], frame[text]):
                found: dict[str, str] = {}
                for entity, name in tagger(t):
                    found[entity] = name
                rows += [(k, pos, e, n) for pos, (e, n) in enumerate(found.items())]
            yield pd.DataFrame(rows, columns=[key, "pos", "entity", "tag"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, pos long, entity string, tag string")
