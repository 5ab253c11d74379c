"""S13, S14, S21 as a Python data source: pages that follow one another by a cursor, read in partitions by where chains begin, or as a stream.

    pages.register(spark)
    spark.read.format("quarry_pages").option("provider", "module:function").option("starts", '["a", "k"]').load()

The provider is as in operators.providers: made in the task, it gives a reply to each request. A reply is JSON with `next`, the
request of the page after it; a chain ends without one, at a failure, at a page that it has had, or at the start of another
chain. So a service whose cursor can begin anywhere (an offset, a letter, a day) is read by as many tasks as starts are given.
Equality filters on `start` are pushed down: only those chains are asked for. A stream takes one step of `pages` pages a batch, and its
offset is the next request, kept in the checkpoint: a restart goes on there and asks for nothing twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


def register(spark: SparkSession) -> None:
    """Makes the source known, and lets Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Pages)


class _Chain(InputPartition):
    def __init__(self, start: str, ends: frozenset[str]):
        self.start, self.ends = start, ends


def _provider(name: str):
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)()


def follow(provider, start: str, ends: frozenset[str] = frozenset(), most: int | None = None) -> Iterator[tuple[str, int, str, str | None, str | None]]:
    """start, pos, request, reply and the next request of the pages of a chain; reply is null at a failure, which ends it."""
    request, seen, pos = start, set(), 0
    while request and request not in seen and (most is None or pos < most):
        reply = link = None
        try:
            (reply,) = provider([request])
            link = json.loads(reply).get("next")
        except Exception:  # the failing page is the last one
            pass
        seen.add(request)
        yield start, pos, request, reply, None if link in ends else link
        request, pos = None if link in ends else link, pos + 1


class Pages(DataSource):
    """start, pos, request, reply."""

    @classmethod
    def name(cls) -> str:
        return "quarry_pages"

    def schema(self) -> str:
        return "start string, pos long, request string, reply string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.provider, self.starts = options["provider"], json.loads(options["starts"])
        self.asked = list(dict.fromkeys(self.starts))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("start",):
                self.asked = [s for s in self.asked if s == f.value]
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [_Chain(s, frozenset(self.starts)) for s in self.asked] or [_Chain("", frozenset())]

    def read(self, partition: _Chain) -> Iterator[tuple]:
        for *row, _ in follow(_provider(self.provider), partition.start, partition.ends):
            yield tuple(row)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.provider, self.first, self.most = options["provider"], json.loads(options["starts"])[0], int(options.get("pages", "1000"))

    def initialOffset(self) -> dict:
        return {"next": self.first, "pos": 0}

    def _step(self, start: dict, most: int) -> tuple[list[tuple], dict]:
        rows, at = [], dict(start)
        if start["next"]:
            for _, pos, request, reply, link in follow(_provider(self.provider), start["next"], most=most):
                if reply is None:  # tried again by the next batch
                    break
                rows.append((self.first, start["pos"] + pos, request, reply))
                at = {"next": link or "", "pos": start["pos"] + pos + 1}
        return rows, at

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._step(start, self.most)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._step(start, end["pos"] - start["pos"])[0])
