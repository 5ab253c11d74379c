"""Ranked lexical search by Fagin's threshold algorithm over an index that is partitioned by document.

Documents are read once into a forward index of the terms asked for: per document its length, term numbers and
frequencies. A task takes it shard by shard. In a shard, the postings of a term form a list sorted by impact. An item's
lists are read in turn from their tops; each document met gets its whole score by lookups in the forward index. The
scan ends when the threshold, the sum of the impacts last read, falls strictly below the item's k-th score. That score
carries over from the shards a task has done, so later shards end sooner. What tasks found is merged by item.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LETTERS, buffers, kept, ranked, runs, words

TOP = 10

#: Items that are searched in one pass; more go in further passes.
ITEMS = 4096

#: Documents and postings of a shard; bounds a task's memory.
SHARD_DOCS, SHARD_POSTINGS = 1 << 15, 1 << 21

#: Postings read from each list before the threshold is looked at; doubles with every look.
DEPTH = 16

_ID = pa.int64()
_INDEX = pa.schema([("doc_id", _ID), ("n", _ID), ("terms", pa.binary()), ("tf", pa.binary())])
_FOUND = pa.schema([("item", pa.int32()), ("doc_id", _ID), ("score", _ID)])


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the terms of all texts, and per text the index of its first term (one more at the end)."""
    data, at = buffers(texts)
    hashes, _, _, first = words(data, at, lower=True, inside=LETTERS)
    return hashes, first


def _forward(asked: np.ndarray):
    """Index rows of batches (doc_id, text): the numbers of the terms in `asked` (sorted hashes) with their frequencies."""

    def index(batches):
        for batch in batches:
            text = batch.column("text")
            _, at = buffers(text)
            for i, j in runs(at):
                hashes, first = _terms(text.slice(i, j - i))
                slot = np.minimum(np.searchsorted(asked, hashes), max(len(asked) - 1, 0))
                hit = asked[slot] == hashes if len(asked) else np.zeros(len(hashes), bool)
                doc = np.repeat(np.arange(j - i), np.diff(first))[hit]
                pair, tf = np.unique(doc * len(asked) + slot[hit], return_counts=True)
                bounds = np.searchsorted(pair, np.arange(j - i + 1) * len(asked))
                term, tf = (pair % max(len(asked), 1)).astype(np.int32), tf.astype(np.int32)
                blobs = [[x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(first), _ID), *(pa.array(x, pa.binary()) for x in blobs)], schema=_INDEX)

    return index


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of all blobs, and where each blob's begin."""
    data, at = buffers(column.cast(pa.large_binary()).view(pa.large_string()))
    return np.frombuffer(data.tobytes(), np.int32), at // 4


def _holders(batches):
    """How many documents hold a term, as counted by this task."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        terms, _ = _numbers(batch.column("terms"))
        found = np.bincount(terms, minlength=len(total)).astype(np.int64)
        found[: len(total)] += total
        total = found
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], _ID)], names=["term", "df"])


class _Best:
    """The best documents of an item so far: highest score first, then least id, null ids last."""

    def __init__(self, k: int):
        self.k, self.ids, self.null, self.scores = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, null: np.ndarray, scores: np.ndarray) -> None:
        if len(self.scores) == self.k:
            some = scores >= self.scores[-1]
            ids, null, scores = ids[some], null[some], scores[some]
        ids, null, scores = np.append(self.ids, ids), np.append(self.null, null), np.append(self.scores, scores)
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.ids, self.null, self.scores = ids[order], null[order], scores[order]

    def beats(self, threshold: int) -> bool:
        """Whether no document with a score of threshold or less can come among them."""
        return threshold <= 0 or len(self.scores) == self.k and threshold < self.scores[-1]


def search_shard(ids, null, bounds, term, impact, items, best) -> int:
    """Threshold algorithm over one shard: bounds cut term and impact by document; items are (terms, times). Gives the postings read."""
    order = np.lexsort((-impact, term))
    doc = np.repeat(np.arange(len(ids)), np.diff(bounds))[order]
    lists, listed = impact[order], term[order]
    n_terms = int(term.max()) + 1 if len(term) else 0
    start = np.searchsorted(listed, np.arange(n_terms + 1))
    seen, times, read = np.zeros(len(ids), bool), np.zeros(n_terms, np.int64), 0
    for (asked, often), top in zip(items, best, strict=True):
        own = asked < n_terms
        own[own] = start[asked[own] + 1] > start[asked[own]]
        asked, often = asked[own], often[own]
        if not len(asked):
            continue
        low, high = start[asked], start[asked + 1]
        depth, more = 0, DEPTH
        times[asked] = often
        while True:
            open_ = low + depth < high
            threshold = int((lists[np.where(open_, low + depth, 0)] * often)[open_].sum())  # the next of each list: no more is in what follows
            if top.beats(threshold):
                break
            a, b = (low + depth)[open_], np.minimum(low + depth + more, high)[open_]
            span = b - a
            at = np.repeat(a - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
            read += len(at)
            met = np.unique(doc[at])
            met = met[~seen[met]]
            seen[met] = True
            if len(met):  # forward lookups: the whole score of every document met
                size = bounds[met + 1] - bounds[met]
                ends = np.cumsum(size)
                place = np.repeat(bounds[met] - (ends - size), size) + np.arange(ends[-1])
                scores = np.add.reduceat(impact[place] * times[term[place]], ends - size)  # no document met is without a posting
                good = scores > 0
                top.add(ids[met[good]], null[met[good]], scores[good])
            depth, more = depth + more, 2 * more
        seen[:] = False
        times[asked] = 0
    return read


def _searcher(weights: np.ndarray, n_docs: int, n_terms: int, items: list, k: int):
    """Index rows to the best of this task's documents for each item."""

    def shards(batches):
        held, docs, postings = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            docs, postings = docs + batch.num_rows, postings + sum(c.nbytes for c in batch.columns[2:]) // 8
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield pa.Table.from_batches(held)
                held, docs, postings = [], 0, 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        best = [_Best(k) for _ in items]
        for shard in shards(batches):
            id_, n = (shard.column(c).combine_chunks() for c in ("doc_id", "n"))
            null, ids = np.asarray(id_.is_null()), id_.fill_null(0).to_numpy()
            term, bounds = _numbers(shard.column("terms").combine_chunks())
            tf = _numbers(shard.column("tf").combine_chunks())[0].astype(np.int64)
            m = np.repeat(25 + (75 * n.to_numpy() * n_docs) // max(n_terms, 1), np.diff(bounds))
            search_shard(ids, null, bounds, term, weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m)), items, best)
        for item, top in enumerate(best):
            if len(top.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top.ids), item, np.int32)), pa.array(top.ids, _ID, mask=top.null), pa.array(top.scores, _ID)], schema=_FOUND)

    return run


def _pass(docs: DataFrame, asked: list[tuple[int | None, str | None]], k: int) -> DataFrame:
    """The search for some items, given by id and text."""
    spark = docs.sparkSession
    hashes, first = _terms(pa.array([text for _, text in asked], pa.large_string()))
    vocabulary, number = np.unique(hashes, return_inverse=True)
    items = [np.unique(number[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
    index = kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_forward(vocabulary), "doc_id long, n long, terms binary, tf binary"))
    n_docs, n_terms = index.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for row in index.select("terms").mapInArrow(_holders, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a term of these items
        df[row.term] = row.df
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    found = index.mapInArrow(_searcher(weights, n_docs, n_terms, items, k), "item int, doc_id long, score long")
    first_best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = Window.partitionBy("item", "_salt").orderBy(*first_best)  # so that no item's finds, k a task, meet at once
    found = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(64))).withColumn("_n", F.row_number().over(some)).where(F.col("_n") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*first_best))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, id_) for i, (id_, _) in enumerate(asked)], "item int, item_id long")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # at most ITEMS names


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents (doc_id, text) of highest score for each item (item_id, text).

    Scores are those of the integer formula in the README; only scores above 0 count. Equal scores go by ascending doc_id, null ids
    last. Null and empty texts hold no term: as a document they are never found and not counted, as an item they find nothing. Rows
    that repeat are documents or items of their own (with ids that repeat in the result). Other columns play no part.
    """
    lined = ranked(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), F.col("item_id"), F.col("text"))
    lined = kept(lined)
    total = lined.count()
    found = None
    for lo in range(0, max(total, 1), ITEMS):
        block = [(r.item_id, r.text) for r in lined.where((F.col("_rank") >= lo) & (F.col("_rank") < lo + ITEMS)).orderBy("_rank").collect()]
        part = _pass(docs, block, k)
        found = part if found is None else found.unionByName(part)
    return found
