"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams (1 and 2 words), one of the target text, one of all text, give each
document the log ratio of its probabilities. Gumbel noise from a hash of the id is added and the k largest are kept,
which samples k documents without replacement in proportion to their importance.

The raw model counts every document; the target model counts the labelled good ones, of which a sample of at most
`max_labelled` documents (the least hashes of ids) is taken. k is the share of good documents among the labelled ones
times the documents with text.

Defined results: null text and text without a word has null weight and is not kept; ties go to the smaller id; labels
with a null quality or of unknown documents are ignored, a null toxic counts as 0; without any label all documents weigh
0 and all are kept; equal rows are weighed alike and, with equal noise, are neighbours in the order; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, mix, ranked, runs, saved, sums, words

BUCKETS = 1 << 16
MAX_LABELLED = 50_000
SMOOTHING = 1.0


def _grams(data: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of unigrams, buckets of bigrams (that end at each word but the first of a text: mask), first words."""
    h, _, _, first = words(data, at)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    one = (mix(h) >> shift).astype(np.int64)
    before = np.concatenate([np.zeros(1, np.uint64), h[:-1]]) if len(h) else h
    two = (mix(h * np.uint64(0x9E3779B97F4A7C15) + before) >> shift).astype(np.int64)
    inner = np.ones(len(h), bool)
    inner[first[:-1][first[:-1] < len(h)]] = False
    return one, two, inner if len(h) else inner, first


def fit(docs: DataFrame) -> np.ndarray:
    """Log ratio of target and raw probability by bucket; docs: text, target."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, at = buffers(batch.column("text"))
            flag = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
            for i, j in runs(at):
                one, two, inner, first = _grams(data[at[i] : at[j]], at[i : j + 1] - at[i], BUCKETS)
                mine = np.repeat(flag[i:j], np.diff(first))
                raw += np.bincount(one, minlength=BUCKETS) + np.bincount(two[inner], minlength=BUCKETS)
                good += np.bincount(one[mine], minlength=BUCKETS) + np.bincount(two[inner & mine], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], ["bucket", "raw", "good"])

    rows = docs.mapInArrow(count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    raw, good = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    raw[rows["bucket"]] += rows["raw"]
    good[rows["bucket"]] += rows["good"]
    if good.sum() == SMOOTHING * BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def resample(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 7) -> DataFrame:
    """doc_id, log_weight, noisy_weight, kept for every document."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    share = labels.where("quality is not null").agg(F.avg(good.cast("double"))).first()[0]
    sample = labels.where(good & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_good")).distinct().orderBy(F.xxhash64("_good"), "_good").limit(max_labelled)
    sample = saved(sample)
    texts = docs.select(F.col("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_good"), "left")  # of max_labelled rows at most
    ratio = fit(texts.select("text", F.col("_good").isNotNull().alias("target")))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column("text"))
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, j in runs(at):
                one, two, inner, first = _grams(data[at[i] : at[j]], at[i : j + 1] - at[i], BUCKETS)
                total[i:j] = sums(ratio[one] + np.where(inner, ratio[two], 0.0), first)
                n[i:j] = np.diff(first)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, mask=n == 0)], ["doc_id", "log_weight"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, log_weight double")
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    scored = scored.withColumn("noisy_weight", F.round(F.col("log_weight") - F.log(-F.log(u)), 9))
    rows = ranked(scored, F.col("noisy_weight").desc_nulls_last(), F.col("doc_id").asc_nulls_last())
    some = rows.where("log_weight is not null").count()
    k = some if share is None else round(share * some)
    return rows.select("doc_id", "log_weight", "noisy_weight", (F.col("log_weight").isNotNull() & (F.col("_rank") < k)).alias("kept"))
