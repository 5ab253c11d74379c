"""Quality rules: counts on whole texts, and logistic regression on hashed word and character n-grams.

The regression is trained on labelled documents (a sample of at most `max_labelled` of them, by least hash of the id),
calibrated on a part of the sample kept apart, and applied in Arrow batches against fixed thresholds. It has two heads
over the same features: quality, on the mean weight of a text's n-grams, and toxicity, on the sum over its distinct word
n-grams, because a few words decide it. A document is kept if no base rule fails, its quality is likely and its toxicity is not.

Defined results: null text has no words, so it fails; labels with null quality or of unknown documents are ignored, null
toxic counts as 0; without labels of both kinds a head gives the verdict of its only kind, without any label it passes
everything; equal rows get equal results; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LETTERS, buffers, kept, mix, runs, saved, sums, words

MAX_LABELLED = 4000
#: Distinct n-grams, summed over the sampled documents, that the driver learns from at most.
MAX_GRAMS = 16_000_000
WORD_BUCKETS, CHAR_BUCKETS = 1 << 18, 1 << 16
MIN_QUALITY, MAX_TOXICITY = 0.5, 0.5
MIN_WORDS, MAX_REPEAT = 50, 50
LASSO, CALM = 1e-3, 1e-2
#: Steps at most; steps between looks at the texts kept apart; looks without such a fall of their loss that end the training.
STEPS, LOOK, PATIENCE, FALL = 200, 10, 2, 0.02
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _buckets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per letter run its unigram and bigram bucket (2 columns, -1: none), and the first run of each text."""
    h, _, _, first = words(data, at, lower=True, inside=LETTERS)
    both = np.empty((len(h), 2), np.int32)
    both[:, 0] = mix(h) >> np.uint64(46)
    both[1:, 1] = mix(h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1]) >> np.uint64(46)
    both[first[:-1][first[:-1] < len(h)], 1] = -1
    return both, first


def _trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per byte the bucket of the 3 bytes that start there (-1: beyond the text)."""
    if len(data) < 3:
        return np.full(len(data), -1, np.int32), at
    x = data[:-2].astype(np.uint32) | data[1:-1].astype(np.uint32) << np.uint32(8) | data[2:].astype(np.uint32) << np.uint32(16)
    x *= np.uint32(0x9E3779B1)
    out = np.full(len(data), -1, np.int32)
    out[:-2] = x >> np.uint32(16)
    for k in (1, 2):
        tail = at[1:] - k
        out[tail[tail >= 0]] = -1
    return out, at


def features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Of one text: distinct buckets and their counts, word n-grams before character n-grams; how many of each kind."""
    at = np.array([0, len(data)])
    both, _ = _buckets(data, at)
    tri, _ = _trigrams(data, at)
    word, char = both[both >= 0], tri[tri >= 0]
    (a, n), (b, m) = np.unique(word, return_counts=True), np.unique(char, return_counts=True)
    return np.concatenate([a, b + WORD_BUCKETS]).astype(np.int32), np.concatenate([n, m]).astype(np.int32), len(word), len(char)


def _descend(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, apart: np.ndarray, steps: int, rate: float, lasso: float, calm: float = 1e-8) -> tuple[np.ndarray, float]:
    """Logistic regression by Adagrad with an L1 step; classes weigh the same. calm: squared gradients to begin with, so
    that n-grams of weak evidence move less. Texts that are apart don't teach; when their loss no longer falls it ends."""
    w, b, grown, grown_b = np.zeros(WORD_BUCKETS + CHAR_BUCKETS), 0.0, np.full(WORD_BUCKETS + CHAR_BUCKETS, calm), 1e-8
    learn, weight = ~apart, np.zeros(len(y))
    for part in (apart, learn):
        if part.any():
            share = y[part].mean()
            weight[part] = np.where(y[part] == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / part.sum()
    own = learn[rows]
    here, there = (rows[own], cols[own], vals[own]), (rows[~own], cols[~own], vals[~own])
    least, since = np.inf, 0
    for step in range(1, steps + 1):
        at, col, val = here
        z = np.bincount(at, val * w[col], len(y)) + b
        g = np.where(learn, (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight, 0.0)
        grad = np.bincount(col, val * g[at], len(w))
        grown += grad**2
        pace = rate / np.sqrt(grown)
        w = w - pace * grad
        w = np.sign(w) * np.maximum(np.abs(w) - pace * lasso, 0)
        grown_b += g.sum() ** 2
        b -= rate / np.sqrt(grown_b) * g.sum()
        if step % LOOK == 0 and len(there[0]):
            at, col, val = there
            z = np.clip(np.bincount(at, val * w[col], len(y)) + b, -40, 40)[apart]
            loss = (weight[apart] * np.log1p(np.exp(np.where(y[apart] == 1, -z, z)))).sum()
            least, since = (loss, 0) if loss < (1 - FALL) * least else (least, since + 1)
            if since >= PATIENCE:
                break
    return w, b


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid: slope and intercept, by Newton steps on smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -40, 40)))
        v = p * (1 - p) + 1e-9
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        a, c = a - step[0], c - step[1]
        if abs(step).max() < 1e-9:
            break
    return (a, c) if a > 0 else (1.0, 0.0)


class Head:
    """A calibrated probability: sigmoid(a * z + c) of z = bias + the mean weight of a text's n-grams, or the sum over the distinct ones."""

    def __init__(self, mean: bool):
        self.mean, self.w, self.b, self.a, self.c = mean, np.zeros(WORD_BUCKETS + CHAR_BUCKETS, np.float32), 0.0, 1.0, 0.0

    def fit(self, rows: np.ndarray, cols: np.ndarray, counts: np.ndarray, kinds: np.ndarray, y: np.ndarray, apart: np.ndarray) -> Head:
        """rows, cols, counts: the n-grams of all texts; kinds: n-grams of both kinds by text; apart: for calibration."""
        if not len(y) or y.min() == y.max():
            self.b = 0.0 if not len(y) else 40.0 * (1 if y[0] else -1)
            self.a = 0.0 if not len(y) else 1.0
            return self
        if self.mean:
            vals = counts * np.float32(30) / kinds[rows, (cols >= WORD_BUCKETS).astype(np.int8)]
        else:
            use = cols < WORD_BUCKETS
            rows, cols, vals = rows[use], cols[use], np.ones(int(use.sum()), np.float32)
        w, b = _descend(rows, cols, vals, y, apart, STEPS, 0.3 if self.mean else 0.5, 1e-5 if self.mean else LASSO, 1e-8 if self.mean else CALM)
        z = np.bincount(rows, vals * w[cols], len(y)) + b
        if apart.any() and y[apart].min() != y[apart].max():
            self.a, self.c = _calibrate(z[apart], y[apart])
        self.w, self.b = (w * (30 if self.mean else 1)).astype(np.float32), b
        return self

    def score(self, both, first, tri, at) -> np.ndarray:
        value = np.append(self.w[:WORD_BUCKETS], np.float32(0))
        if not self.mean:
            which, side = np.nonzero(value[both])
            text = np.searchsorted(first, which, "right") - 1
            pair = np.unique(text * np.int64(WORD_BUCKETS) + both[which, side])
            z = np.bincount(pair // WORD_BUCKETS, value[pair % WORD_BUCKETS], len(first) - 1)
        else:
            z = sums(value[both].sum(1, dtype=np.float64), first)
            n = np.maximum(1, sums((both >= 0).sum(1), first))
            value = np.append(self.w[WORD_BUCKETS:], np.float32(0))
            z = z / n + sums(value[tri].astype(np.float64), at) / np.maximum(1, sums((tri >= 0).astype(np.int64), at))
        return 1 / (1 + np.exp(-np.clip(self.a * (z + self.b) + self.c, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[Head, Head]:
    names = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_doc")).agg(F.min("quality").alias("quality"), F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("toxic"))
    sample = saved(names.orderBy(F.xxhash64("_doc"), "_doc").limit(max_labelled))
    rows = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("_doc")).select("_doc", "text", "quality", "toxic")  # of max_labelled rows at most

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column("text"))
            for k in range(batch.num_rows):
                cols, counts, n, m = features(data[at[k] : at[k + 1]])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in ("_doc", "quality", "toxic")), pa.array([n]), pa.array([m]), pa.array([cols.tobytes()]), pa.array([counts.tobytes()])], ["doc", "quality", "toxic", "words", "chars", "cols", "counts"])

    found = kept(rows.mapInArrow(extract, "doc long, quality int, toxic int, words long, chars long, cols binary, counts binary").withColumn("id", F.monotonically_increasing_id()))
    # so many n-grams at most go to the driver, however long the documents are: whole documents, by the same hash; the window sees a row a sampled document
    upto = F.sum(F.length("cols") / 4).over(Window.orderBy(F.xxhash64("doc"), "doc", "words", "chars", "id"))
    few = found.select("id", "doc", "words", "chars", "cols").withColumn("upto", upto).where(F.col("upto") <= MAX_GRAMS).select("id")
    got = found.join(F.broadcast(few), "id").drop("id").toArrow().sort_by([("doc", "ascending"), ("words", "ascending"), ("chars", "ascending")])
    size = np.array([len(x) // 4 for x in got["cols"].to_pylist()], np.int64)
    at = np.repeat(np.arange(len(size), dtype=np.int32), size)
    cols, counts = (np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in got[c]] or [np.zeros(0, np.int32)]) for c in ("cols", "counts"))
    kinds = np.maximum(1, np.stack([got["words"].to_numpy(), got["chars"].to_numpy()], 1)).astype(np.float32)
    quality, toxic = (got[c].to_numpy().astype(np.float64) > 0 for c in ("quality", "toxic"))
    del got
    counts, apart = counts.astype(np.float32), np.arange(len(size)) % 4 == 3
    return tuple(Head(mean).fit(at, cols, counts, kinds, y.astype(np.float64), apart) for mean, y in ((True, quality), (False, toxic)))


def repeats(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: words in windows of three words that occur twice or more in it."""
    n = len(h)
    if n < 3:
        return np.zeros(len(first) - 1, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = doc[2:] == doc[:-2]
    key = mix(mix(h[:-2] * np.uint64(3) + mix(h[1:-1] + np.uint64(11))) + h[2:] * np.uint64(0x9E3779B97F4A7C15) + mix(doc[:-2].astype(np.uint64) + np.uint64(77)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice &= whole
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return sums(covered.astype(np.int64), first)


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measure(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_repeat_words per text."""
    h, head, end, first = words(data, at)
    inside = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points
    return [np.diff(first), sums(inside[end] - inside[head], first), sums(_SYMBOL[data].astype(np.int64), at), repeats(h, first)]


def judge(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, the counts, base_failed, kept, p_quality, p_toxic for every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    quality, toxicity = train(docs, labels, max_labelled)
    model = docs.sparkSession.sparkContext.broadcast((quality, toxicity))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = model.value
        for batch in batches:
            data, at = buffers(batch.column("text"))
            for i, j in runs(at):
                part, edge = data[at[i] : at[j]], at[i : j + 1] - at[i]
                n, chars, symbols, again = measure(part, edge)
                lines = np.array([duplicate_lines(t) if t and "\n" in t else 0 for t in batch.column("text").slice(i, j - i).to_pylist()], np.int64)
                failed = (n < MIN_WORDS) | (100 * again > MAX_REPEAT * n)
                both, first = _buckets(part, edge)
                tri, _ = _trigrams(part, edge)
                q, t = good.score(both, first, tri, edge), bad.score(both, first, tri, edge)
                kept = ~failed & (q >= MIN_QUALITY) & (t < MAX_TOXICITY)
                columns = [batch.column("doc_id").slice(i, j - i), *map(pa.array, (n, chars, symbols, lines, again, failed, kept, q, t))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_quality", "p_toxic"])

    return docs.mapInArrow(score, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_quality double, p_toxic double")
