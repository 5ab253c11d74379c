"""Language-model scoring with a hierarchical Pitman-Yor model.

Two levels of Chinese restaurants over words: a restaurant for each word that stands before another (the end token before
a text), whose customers are the words that follow it, and their common parent, the unigram restaurant, whose customers
are the tables of all of them and whose base is uniform over the words and one more for words never seen. All bigrams of
all training documents are counted; counts and seating follow the corpus and stay distributed.

A cell is a word before and a word, with its customers and its tables. Cells are dealt into parts of bounded size: those
of a rare word before by that word, whose restaurant so is in one part; those of the `TOP` most frequent words before by
both words, so a hot restaurant or a hot pair is no part of its own. Gibbs sweeps go over the parts: the tables of a cell
are drawn from their conditional distribution given its customers, the other tables of its restaurant and the parent
(generalised Stirling numbers; beyond `EXACT` customers by seating them one after the other, with jumps to the next new
table). Cells are drawn side by side, given the sweep before. Between sweeps the tables of frequent words, by word before
and by word, are summed up to two vectors of `TOP` numbers, those of rarer words in a table, and the parent's seating is
drawn. Cells of rarer words, and the restaurants that they are in, move once a sweep to meet what the parent knows of those
words; all other cells stay where they are. The rules are the same for all words, so `TOP` and `PART_TOKENS` change the layout
alone. Predictive probabilities are averaged over the sweeps after burn-in.

Scoring sends the cells of all texts to the parts again, runs of texts at a time, and gets the sums of their logarithms
back by run. Words that aren't among the frequent ones go on to the parts of the table of all words, and come back likewise.

Defined results: null and empty text is the end token alone; null ids are in the training fold; rows equal in id and
words get a row each; without training documents every token is unknown and N is 0; an empty table gives no rows; other
columns are ignored. Draws are hashes of the words, and scores are summed in steps of 1e-9, so results don't depend on
the layout.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, doc_fold, mix, runs, saved, shared_dir, sums, words

FOLDS = 5
TOP = 1 << 18
#: Training tokens of a part, on average.
PART_TOKENS = 600_000
#: Text whose cells are counted, and asked for, at once.
RUN_BYTES = 8 << 20
SWEEPS, BURN_IN = 7, 3
KEPT = SWEEPS - BURN_IN
STRENGTH = 5.0
#: Customers up to which a cell's tables are drawn by Stirling numbers.
EXACT = 96
END = np.uint64(1)
#: Scores are summed as whole numbers of this part of a log10.
STEP = 1e-9
#: Numbers of the vectors that are summed up together.
SLICE = 1 << 15
#: Marks the codes of words that aren't frequent.
_RARE = np.uint64(1 << 63)


# ---- small pieces ---------------------------------------------------------------------------------------------------


def _unit(key: np.ndarray, step: int) -> np.ndarray:
    """A number in [0, 1) by key and step."""
    return (mix(key + mix(np.array([step + 1], np.uint64))) >> np.uint64(11)) * 2.0**-53


def _cell(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The key of the cell of u and w."""
    return mix(u * np.uint64(0x9E3779B97F4A7C15) + mix(w))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one blob, byte by byte of all numbers: the upper bytes of small numbers are runs of zeros."""
    raw = [np.ascontiguousarray(np.ascontiguousarray(a).ravel().view(np.uint8).reshape(-1, a.itemsize).T).ravel() for a in arrays]
    return struct.pack(f"<B{len(arrays)}I", len(arrays), *(a.nbytes for a in arrays)) + pa.compress(pa.py_buffer(np.concatenate(raw)), codec="zstd", asbytes=True)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n = blob[0]
    sizes = struct.unpack(f"<{n}I", blob[1 : 1 + 4 * n])
    raw, out, at = pa.decompress(blob[1 + 4 * n :], decompressed_size=sum(sizes), codec="zstd", asbytes=True), [], 0
    for kind, size in zip(kinds, sizes, strict=True):
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(np.dtype(kind).itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size
    return out


def _find(sorted_keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the asked keys are (0 if they aren't there), and whether they are there."""
    if not len(sorted_keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(sorted_keys, asked), len(sorted_keys) - 1)
    return at, sorted_keys[at] == asked


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _per(first: np.ndarray, total: int) -> np.ndarray:
    """The number of the group of each row."""
    return np.repeat(np.arange(len(first)), np.diff(np.append(first, total)))


def tables(c: np.ndarray, d: float, a: np.ndarray, rng: np.random.Generator | None, key: np.ndarray | None = None) -> np.ndarray:
    """Tables after c customers of a dish sat down; a: weight of a new table for it. One by one at first, then by jumps
    to the next new table, whose waiting time has the same intensity. With keys, draws are hashes of them, whatever the layout."""

    def draw(live: np.ndarray, step: int) -> np.ndarray:
        return rng.random(len(live)) if key is None else _unit(key[live], step)

    t = np.ones(len(c))
    live = np.flatnonzero(c > 1)
    for n in range(1, 33):
        live = live[c[live] > n]
        if not len(live):
            return t
        new = a[live] / (a[live] + n - d * t[live])
        t[live] += draw(live, n) < new
    at, jump, most, weight, own = np.full(len(live), 33.0), 33, c[live], a[live], t[live]
    keys = None if key is None else key[live]
    while len(live):
        if keys is not None and (jump - 33) % 1024 == 0:
            salts = mix(np.arange(jump + 1, jump + 1025, dtype=np.uint64))
        u = rng.random(len(live)) if keys is None else (mix(keys + salts[(jump - 33) % 1024]) >> np.uint64(11)) * 2.0**-53
        at = at + (at - d * own + weight) * np.expm1(np.minimum(-np.log1p(-u) / np.maximum(weight, 1e-12), 700))
        go = at < most
        if not go.all():
            t[live[~go]] = own[~go]
            live, at, most, weight, own = (x[go] for x in (live, at, most, weight, own))
            keys = None if keys is None else keys[go]
        at, own, jump = at + 1, own + 1, jump + 1
    return np.minimum(t, c)


def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: ways to seat c customers at t tables, weighted; [c, t]."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, most + 1)
    for c in range(1, most):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = out[c, 1:] + np.log(np.maximum(c - d * t, 1e-300))
        out[c + 1, 1:] = np.logaddexp(np.where(t <= c, stay, -np.inf), out[c, :-1])
    return out


def _weights(a: np.ndarray, p: np.ndarray, d: float, ways: np.ndarray) -> np.ndarray:
    """Running sums of the weights of 1, 2, ... tables (rows) of each cell (columns), as multiples of that of one table; a: STRENGTH + d * other tables."""
    n = len(ways)
    out = np.empty((n, len(p)))
    out[0] = 1.0
    if len(p) < 64:
        out[1:] = (a + d * np.arange(1, n)[:, None]) * p
        np.multiply.accumulate(out, 0, out=out)
    else:
        for k in range(1, n):
            np.multiply(out[k - 1], (a + d * k) * p, out=out[k])
    out *= np.exp(ways - ways[0])[:, None]
    for k in range(1, n):
        out[k] += out[k - 1]
    return out


def draw_tables(c: np.ndarray, t: np.ndarray, room: np.ndarray, p: np.ndarray, d: float, ways: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Tables of each cell drawn given its customers c, the other tables of its restaurant (room, its own t included) and
    the parent's probability p of its word: P(k) is in proportion to ways[c, k] * p^k * prod over j < k of (STRENGTH + d * (room - t + j))."""
    out = np.ones(len(c), np.int64)
    other = room - t
    order, number = np.argsort(c, kind="stable"), _unit(key, 0)
    sizes, at = np.unique(c[order], return_index=True)
    for c0, i, end in zip(sizes.tolist(), at.tolist(), np.append(at, len(c))[1:].tolist()):
        if c0 < 2:
            continue
        if c0 > EXACT:
            these = order[i:]
            out[these] = tables(c[these].astype(np.float64), d, (STRENGTH + d * other[these]) * p[these], None, key[these]).astype(np.int64)
            break
        step = max(1, (1 << 17) // c0)
        for b in range(i, end, step):
            these = order[b : min(end, b + step)]
            a, chance = STRENGTH + d * other[these], p[these]
            large = (a + d * c0) * chance > 10.0 ** (200 / (c0 - 1))  # beyond what products can hold
            if large.any():
                own = these[large]
                weight = np.cumsum(np.log((a[large][:, None] + d * np.arange(c0)) * chance[large][:, None]), 1) + ways[c0, 1 : c0 + 1]
                weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
                out[own] = 1 + (weight < (number[own] * weight[:, -1])[:, None]).sum(1)
                these, a, chance = these[~large], a[~large], chance[~large]
            weight = _weights(a, chance, d, ways[c0, 1 : c0 + 1])
            out[these] = 1 + (weight < number[these] * weight[-1]).sum(0)
    return out


# ---- counting -------------------------------------------------------------------------------------------------------


def word_counts(train: DataFrame) -> DataFrame:
    """h, n of every word of the training documents; the end token is one of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column("text"))
            for i, j in runs(at):
                u, n = np.unique(words(data[at[i] : at[j]], at[i : j + 1] - at[i], lower=True)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(u, END).view(np.int64)), pa.array(np.append(n, j - i))], ["h", "n"])

    return train.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _most_frequent(rows: DataFrame, most: int) -> DataFrame:
    """The rows of the largest n, at most so many, by whole buckets of n."""
    bucket = F.floor(F.log2("n") * 8)
    sizes = rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("k")).orderBy(F.col("b").desc()).collect()  # 512 rows at most
    least, held = None, 0
    for r in sizes:
        held += r.k
        if held > most:
            break
        least = r.b
    return rows.where(bucket >= least) if least is not None else rows.limit(0)


class Words(NamedTuple):
    """The frequent words: hashes, ascending, and counts. A word's code is its place here, or its hash with a mark."""

    hash: np.ndarray
    count: np.ndarray

    def codes(self, h: np.ndarray) -> np.ndarray:
        at, hit = _find(self.hash, h)
        return np.where(hit, at.astype(np.uint64), (h >> np.uint64(1)) | _RARE)

    def names(self, codes: np.ndarray) -> np.ndarray:
        """What draws are made from: the same number for a word, whether it is frequent or not."""
        often = codes < _RARE
        out = codes & ~_RARE
        out[often] = self.hash[codes[often].astype(np.int64)] >> np.uint64(1)
        return out


def _route(u: np.ndarray, w: np.ndarray, parts: int) -> np.ndarray:
    return (np.where(u < _RARE, _cell(u, w), mix(u)) % np.uint64(parts)).astype(np.int32)


def _tokens(data: np.ndarray, at: np.ndarray, top: Words):
    """The codes of these texts, ascending; of each token, ends included, the places there of the word before and of the word,
    and its text; the first word of each text."""
    h, *_, first = words(data, at, lower=True)
    del _
    texts = len(at) - 1
    named = pa.array(h).dictionary_encode()
    codes, back = np.unique(top.codes(np.append(named.dictionary.to_numpy(), END)), return_inverse=True)
    back, end = back.astype(np.uint32), np.uint32(back[-1])
    now = np.full(len(h) + texts, end, np.uint32)
    real = np.ones(len(now), bool)
    real[first[1:] + np.arange(texts)] = False
    now[real] = back[named.indices.to_numpy()]
    before = np.concatenate([np.full(1, end, np.uint32), now[:-1]])
    return codes, before, now, np.repeat(np.arange(texts, dtype=np.uint32), np.diff(first) + 1), first


def _counted(*keys: np.ndarray) -> list[np.ndarray]:
    """The combinations of small numbers, in order, once each, and last how often each is there."""
    bits = [np.uint64(int(k.max(initial=0)).bit_length()) for k in keys]
    if sum(map(int, bits)) > 64:
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        first = _starts(*keys)
        return [*(k[first] for k in keys), np.diff(np.append(first, len(order)))]
    packed = keys[0].astype(np.uint64)
    for k, b in zip(keys[1:], bits[1:]):
        packed <<= b
        packed |= k
    packed.sort()
    first = _starts(packed)
    many, packed, out = np.diff(np.append(first, len(packed))), packed[first], []
    for b in bits[:0:-1]:
        out.append(packed & ((np.uint64(1) << b) - np.uint64(1)))
        packed >>= b
    return [packed, *out[::-1], many]


def _places(code: np.ndarray) -> np.ndarray:
    """Small numbers in the order of the codes: frequent words' codes, and beyond them the places of the others among each other."""
    rare = np.flatnonzero(code >= _RARE)
    out = code.copy()
    out[rare] = 0
    out[rare] = np.unique(code[rare], return_inverse=True)[1].astype(np.uint64) + out.max(initial=0) + np.uint64(1)
    return out


def _order(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows by u and w; rows of one cell in any order."""
    key, last = _places(u), _places(w)
    key <<= np.uint64(int(last.max(initial=0)).bit_length())
    key |= last
    return np.argsort(key)


def _by(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by part, else as they come, and where each part begins (one more at the end)."""
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    return order, np.append(_starts(part[order]), len(order))


def _merged(u: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells in order, once each."""
    order = _order(u, w)
    u, w, n = u[order], w[order], n[order]
    first = _starts(u, w)
    return u[first], w[first], (np.add.reduceat(n, first) if len(first) else n)


def cells(train: DataFrame, top, parts: int) -> DataFrame:
    """part, blob of u, w, n: the cells of runs of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column("text"))
            for i, j in runs(at, RUN_BYTES):
                codes, before, now, *_ = _tokens(data[at[i] : at[j]], at[i : j + 1] - at[i], top.value)
                before, now, n = _counted(before, now)
                u, w = codes[before], codes[now]
                part = _route(u, w, parts)
                order, edge = _by(part, parts)
                blobs = [_pack(u[own], w[own], n[own].astype(np.uint32)) for own in (order[a:b] for a, b in zip(edge[:-1], edge[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array(part[order[edge[:-1]]]), pa.array(blobs, pa.binary())], ["part", "blob"])

    return train.select("text").mapInArrow(count, "part int, blob binary")


_OUT = "kind byte, part int, code long, cells long, blob binary"
_NAMES = ["kind", "part", "code", "cells", "blob"]
#: Kinds of rows: cells that stay, cells that move once a sweep, tables of words that aren't frequent.
_STAY, _MOVE, _SUMS = 0, 5, 4


def _rows(kind: int, part=None, code=None, cells=None, blob=None) -> pa.RecordBatch:
    n = max(len(x) for x in (part, code, cells, blob) if x is not None)
    make = lambda x, t: pa.nulls(n, t) if x is None else pa.array(x, t)
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int8()), make(part, pa.int32()), make(code, pa.int64()), make(cells, pa.int64()), make(blob, pa.binary())], _NAMES)


def _slices(vectors: list[np.ndarray]) -> pa.RecordBatch | None:
    """kind 1: vectors in slices, code being vector and slice."""
    found = [(v << 32 | a // SLICE, _pack(x[a : a + SLICE])) for v, x in enumerate(vectors) for a in range(0, len(x), SLICE) if x[a : a + SLICE].any()]
    return _rows(1, code=[c for c, _ in found], blob=[b for _, b in found]) if found else None


def _vectors(rows: DataFrame, number: int, size: int) -> list[np.ndarray]:
    """The sums of all vectors that tasks gave."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, total = None, None
        one = lambda: pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([_pack(total)], pa.binary())], ["code", "blob"])
        for batch in batches:
            for c, b in zip(batch.column("code").to_pylist(), batch.column("blob")):
                if c != code and code is not None:
                    yield one()
                total = _unpack(b.as_py(), "<i8")[0] + (total if c == code else 0)
                code = c
        if code is not None:
            yield one()

    out = [np.zeros(size, np.int64) for _ in range(number)]
    found = rows.where("kind = 1").select("code", "blob").repartition("code").sortWithinPartitions("code")
    for r in found.mapInArrow(add, "code long, blob binary").collect():  # number * size / SLICE rows
        v, a = r.code >> 32, (r.code & 0xFFFFFFFF) * SLICE
        out[v][a : a + SLICE] = _unpack(bytes(r.blob), "<i8")[0]
    return out


_STATE = ("<u8", "<u8", "<i8", "<u4", "<u4", "<u4")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows that come by part, a part at a time; without part and blob's other columns."""
    part, held = None, []
    for batch in batches:
        for own, *rest in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
            if own != part and held:
                yield part, held
                held = []
            part = own
            held.append(rest)
    if held:
        yield part, held


def _sums(part: int, w: np.ndarray, t: np.ndarray) -> Iterator[pa.RecordBatch]:
    """kind 4: the tables in this part of each word that isn't frequent."""
    rare = w >= _RARE
    code, back = np.unique(w[rare], return_inverse=True)
    if len(code):
        yield _rows(_SUMS, [part] * len(code), code.view(np.int64), np.bincount(back, t[rare], len(code)).astype(np.int64))


def seated(found: DataFrame, size: int) -> DataFrame:
    """From the cells of all runs, by part. kinds 0 and 5: part, blob of the cells of two customers or more (word before, word,
    customers, single cells of a rare word before, tables, tables of the kept sweeps), 5 for those of rare words and of restaurants
    they are in; kind 1: by frequent word before and by frequent word the single cells and the other cells; kind 2: code, cells:
    single cells of a rare word; kind 4: part, code, cells: its tables in other cells; kind 3: cells of one and of two customers."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, ones, twos = [np.zeros(size, np.int64) for _ in range(4)], 0, 0
        for part, held in _by_part(batches):
            u, w, n = (np.concatenate(x) for x in zip(*(_unpack(b, "<u8", "<u8", "<u4") for (b,) in held)))
            u, w, n = _merged(u, w, n.astype(np.int64))
            one, often_u, often_w = n == 1, u < _RARE, w < _RARE
            ones, twos = ones + int(one.sum()), twos + int((n == 2).sum())
            for v, which, keys in ((0, one & often_u, u), (1, one & often_w, w), (2, ~one & often_u, u), (3, ~one & often_w, w)):
                vectors[v] += np.bincount(keys[which].astype(np.int64), minlength=size)
            rare, k = np.unique(w[one & ~often_w], return_counts=True)
            if len(rare):
                yield _rows(2, code=rare.view(np.int64), cells=k)
            first = _starts(u)
            of = _per(first, len(u))
            alone = np.add.reduceat(one.astype(np.int64), first)[of] * ~often_u
            far = ~one & ~often_w
            far |= ~one & ~often_u & np.logical_or.reduceat(far, first)[of]
            for kind, some in ((_STAY, ~one & ~far), (_MOVE, far)):
                if some.any():
                    yield _rows(kind, [part], blob=[_pack(u[some], w[some], n[some], alone[some].astype(np.uint32), np.ones(int(some.sum()), np.uint32), np.zeros(0, np.uint32))])
            yield from _sums(part, w[far], np.ones(int(far.sum()), np.int64))
        if (out := _slices(vectors)) is not None:
            yield out
        yield _rows(3, code=[ones], cells=[twos])

    return found.repartition("part").sortWithinPartitions("part").select("part", "blob").mapInArrow(build, _OUT)


class _Files:
    """Tables of the sweeps in the shared folder; those of the sweep before are deleted."""

    def __init__(self, spark):
        self.spark, self.dir, self.n = spark, shared_dir(spark), 0

    def keep(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.dir}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, *paths: str) -> None:
        for path in paths:
            to = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            to.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(to, True)
        self.spark._jvm.System.gc()  # lets Spark delete the shuffles of the sweep


class Fit(NamedTuple):
    state: DataFrame  # kinds 0 and 5 of seated(), after the last sweep
    rare: DataFrame  # code, n, extra (by kept sweep: the parent's customers less its discounts) of the words that aren't frequent
    d: float
    room: np.ndarray  # by kept sweep and frequent word: tables of its restaurant
    p: np.ndarray  # by kept sweep and frequent word: the parent's probability
    whole: np.ndarray  # by kept sweep: the parent's customers and strength
    rest: np.ndarray  # by kept sweep: the parent's part of every word, seen or not


def fit(train: DataFrame, counts: DataFrame, top, files: _Files, seed: int = 11) -> Fit:
    words_, spark = top.value, counts.sparkSession
    size, (tokens, kinds) = len(words_.hash), counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    parts, base = max(1, -(-tokens // PART_TOKENS)), 1 / (kinds + 1)
    found, found_at = files.keep(seated(cells(train, top, parts), size))
    single_room, single_served, room, served = _vectors(found, 4, size)
    ones, twos = found.where("kind = 3").agg(F.coalesce(F.sum("code"), F.lit(0)), F.coalesce(F.sum("cells"), F.lit(0))).first()
    d = min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))
    some = STRENGTH + d * kinds
    more = kinds > size  # words that aren't frequent

    def drawn(k: np.ndarray, name: np.ndarray, turn: int) -> np.ndarray:
        """The parent's tables of words with k customers."""
        out, two = np.minimum(k, 1), np.flatnonzero(k > 1)
        out[two] = np.minimum(tables(k[two].astype(np.float64), d, np.full(len(two), some * base), None, mix(name[two] + np.uint64(1000 * seed + turn))), k[two]).astype(np.int64)
        return out

    def known(sums: DataFrame, before: DataFrame, turn: int, keep: bool) -> tuple[DataFrame, str, int, int, int]:
        """The words that aren't frequent after a sweep (or before the first): code, n, single, extra, served, now and next (tables
        drawn at this turn and at the next); where it is; the sums of the last three."""

        def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                served = batch.column("served").to_numpy()
                name = batch.column("code").to_numpy().view(np.uint64) & ~_RARE
                now, after = (drawn(served, name, turn + k) for k in range(2))
                extra = batch.column("extra")
                if keep:
                    held = extra.flatten().to_numpy().reshape(len(served), -1)
                    held = np.concatenate([held, (served - d * now)[:, None]], 1)
                    extra = pa.ListArray.from_arrays(pa.array(np.arange(len(served) + 1, dtype=np.int32) * held.shape[1]), pa.array(held.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("code", "n", "single")), extra, batch.column("served"), pa.array(now), pa.array(after)], ["code", "n", "single", "extra", "served", "now", "next"])

        held = before.join(sums.groupBy("code").agg(F.sum("cells").alias("t")), "code", "left")
        held = held.select("code", "n", "single", "extra", (F.col("single") + F.coalesce("t", F.lit(0))).alias("served"))
        out, path = files.keep(held.mapInArrow(seat, "code long, n long, single long, extra array<double>, served long, now long, next long"))
        return out, path, *(x + alone_ for x in out.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("served", "now", "next"))).first())

    mark = lambda c: F.shiftrightunsigned(c, 1).bitwiseOR(F.lit(-(1 << 63)))
    often = spark.createDataFrame(pa.table({"h": pa.array(words_.hash.view(np.int64))}))
    rare = counts.join(F.broadcast(often), "h", "left_anti").select(mark(F.col("h")).alias("code"), "n")  # TOP rows at most
    single = found.where("kind = 2").groupBy("code").agg(F.sum("cells").alias("single"))
    seats = found.where(F.col("kind") == _SUMS).select("code", F.lit(True).alias("seats")).distinct()
    rare = rare.join(single, "code", "left").join(seats, "code", "left").select("code", "n", F.coalesce("single", F.lit(0)).alias("single"), "seats", F.array().cast("array<double>").alias("extra"))
    once, rare_at, rare_served, rare_next = None, None, 0, 0
    if more:
        rare, _ = files.keep(rare)
        once, rare = rare.where("seats is null and single = 1"), rare.where("seats is not null or single > 1")  # one customer has one table, whatever is drawn
        alone_ = once.count()
        rare, rare_at, rare_served, _, rare_next = known(found.where(F.col("kind") == _SUMS), rare, -1, False)
    state, state_at = found, found_at
    ways, rooms, ps, wholes, rests = stirling(d), [], [], [], []

    def parent(turn: int, rare_top: int) -> tuple[np.ndarray, float, float]:
        """The parent's probabilities of the frequent words, its customers and strength, and every word's part of them."""
        k = single_served + served
        top_ = drawn(k, words_.hash >> np.uint64(1), turn)
        whole, rest = STRENGTH + float(k.sum() + rare_served), (STRENGTH + d * float(top_.sum() + rare_top)) * base
        return (k - d * top_ + rest) / whole, whole, rest

    for sweep in range(SWEEPS):
        p, whole, rest = parent(2 * sweep, rare_next)
        shared = spark.sparkContext.broadcast((single_room + room, p))

        def sit(batches: Iterator[pa.RecordBatch], sweep=sweep, shared=shared, whole=whole, rest=rest) -> Iterator[pa.RecordBatch]:
            room_, p_ = shared.value
            vectors = [np.zeros(size, np.int64) for _ in range(2)]
            for part, held in _by_part(batches):
                told = sorted((code, served, top_) for kind, code, served, top_, _ in held if kind == _SUMS)
                code, *numbers = (np.array(x, np.int64) for x in zip(*told)) if told else [np.zeros(0, np.int64)] * 3
                code, far = code.view(np.uint64), (numbers[0] - d * numbers[1] + rest) / whole  # ascending as marked hashes, all of one sign
                for kind, _, _, _, blob in held:
                    if kind == _SUMS:
                        continue
                    u, w, n, alone, t, past = _unpack(blob, *_STATE)
                    often_u, often_w = u < _RARE, w < _RARE
                    first = _starts(u)
                    own = np.add.reduceat(t.astype(np.int64), first)[_per(first, len(u))] + alone
                    tables_ = np.where(often_u, room_[np.where(often_u, u, 0).astype(np.int64)], own) if size else own
                    at, hit = _find(code, w)
                    chance = np.where(hit, far[at], 0.0) if len(code) else np.zeros(len(w))
                    chance = np.where(often_w, p_[np.where(often_w, w, 0).astype(np.int64)], chance) if size else chance
                    key = mix(_cell(top.value.names(u), top.value.names(w)) + np.uint64(1000 * seed + sweep))
                    t = draw_tables(n, t.astype(np.int64), tables_, chance, d, ways, key).astype(np.uint32)
                    for v, which, keys in ((0, often_u, u), (1, often_w, w)):
                        vectors[v] += np.bincount(keys[which].astype(np.int64), t[which], size).astype(np.int64)
                    if sweep >= BURN_IN:
                        past = np.concatenate([past, t])
                    yield _rows(kind, [part], blob=[_pack(u, w, n, alone, t, past)])
                    yield from _sums(part, w, t)
            if (out := _slices(vectors)) is not None:
                yield out

        columns = ["part", "kind", "code", "cells", "top", "blob"]
        own = state.withColumn("top", F.lit(None).cast("long")).select(*columns)
        new = own.where(F.col("kind") == _STAY).mapInArrow(sit, _OUT)
        if more:
            asked = state.where(F.col("kind") == _SUMS).select("part", "kind", "code").join(rare.select("code", F.col("served").alias("cells"), F.col("next").alias("top")), "code")
            moved = own.where(F.col("kind") == _MOVE).unionByName(asked.select("part", "kind", "code", "cells", "top", F.lit(None).cast("binary").alias("blob")))
            new = new.unionByName(moved.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(sit, _OUT))
        new, new_at = files.keep(new)
        room, served = _vectors(new, 2, size)
        rare_top, old = 0, rare_at
        if more:
            rare, rare_at, rare_served, rare_top, rare_next = known(new.where(F.col("kind") == _SUMS), rare.select("code", "n", "single", "extra"), 2 * sweep + 1, sweep >= BURN_IN)
        files.drop(state_at, *([old] if old else []))
        state, state_at = new, new_at
        shared.unpersist()
        if sweep >= BURN_IN:
            p, whole, rest = parent(2 * sweep + 1, rare_top)
            rooms.append(single_room + room)
            ps.append(p)
            wholes.append(whole)
            rests.append(rest)
    rare = rare.select("code", "n", "extra")
    rare = rare.unionByName(once.select("code", "n", F.array_repeat(F.lit(1 - d), KEPT).alias("extra"))) if more else rare.limit(0)
    return Fit(state.where(F.col("kind").isin(_STAY, _MOVE)), rare, d, np.array(rooms), np.array(ps), np.array(wholes), np.array(rests))


def _packed_cells(u: np.ndarray, w: np.ndarray, doc: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted entries of cells as one blob: each cell once, with its entries; numbers as differences and as small as they are."""
    first = _starts(u, w)
    small = lambda x: x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32)
    doc, times, many = small(doc), small(times), np.diff(np.append(first, len(u))).astype(np.uint32)
    kinds = np.array([doc.itemsize, times.itemsize], np.uint8)
    return _pack(np.diff(u[first], prepend=np.uint64(0)), w[first], many, doc.view(np.uint8), times.view(np.uint8), kinds)


def _unpacked_cells(blob: bytes) -> tuple[np.ndarray, ...]:
    """u, w, text, times and whether the text is of the training fold, by entry."""
    u, w, many, doc, times, kinds = _unpack(blob, "<u8", "<u8", "<u4", "<u1", "<u1", "<u1")
    doc, times = (x.view(f"<u{k}").astype(np.uint32) for x, k in zip((doc, times), kinds.tolist(), strict=True))
    return np.repeat(np.cumsum(u, dtype=np.uint64), many), np.repeat(w, many), doc >> 1, times, (doc & 1).astype(np.uint8)


# ---- scoring --------------------------------------------------------------------------------------------------------


def _asked(docs: DataFrame, top, parts: int, floor: float) -> DataFrame:
    """part, kind, run, blob. kind 1: cells of a run of texts: word before, word, text, times, and whether the text is of
    the training fold; kind 2, once a run: per text id (and if it is null), fold, tokens, known tokens, score of the base, the last two of frequent words."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, number, task = top.value, 0, TaskContext.get().partitionId()
        end_at, end_hit = _find(m.hash, np.array([END]))
        end = m.count[end_at[0]] if end_hit[0] else 0
        for batch in batches:
            data, at = buffers(batch.column("text"))
            held_out, ids = batch.column("held_out").to_numpy(zero_copy_only=False), batch.column("doc_id")
            for i, j in runs(at, RUN_BYTES):
                codes, before, now, doc, first = _tokens(data[at[i] : at[j]], at[i : j + 1] - at[i], m)
                run, number = task << 32 | number, number + 1
                frequent = codes < _RARE
                each = np.zeros(len(codes))
                each[frequent] = np.log10(m.count[codes[frequent].astype(np.int64)] + 0.5) - floor
                often, value = frequent[now], each[now]
                ends = first[1:] + np.arange(j - i)
                often[ends], value[ends] = False, 0.0
                base = np.bincount(doc, value, j - i) + (np.log10(end + 0.5) - floor if end_hit[0] else 0.0)
                known = np.bincount(doc, often, j - i).astype(np.int64) + int(end_hit[0])
                own, null = ids.slice(i, j - i), ids.slice(i, j - i).is_null().to_numpy(zero_copy_only=False)
                main = _pack(own.fill_null(0).to_numpy().astype("<i8"), null.astype(np.uint8), held_out[i:j].astype(np.uint8), np.diff(first) + 1, known, base)
                del often, value, ends
                before, now, doc, times = _counted(before, now, doc)
                u, w, doc = codes[before], codes[now], doc.astype(np.uint32)
                del before, now
                part = _route(u, w, parts)
                deal, edge = _by(part, parts)
                train = (~held_out[i:j]).astype(np.uint32)
                blobs = [_packed_cells(u[x], w[x], doc[x] << 1 | train[doc[x]], times[x]) for x in (deal[p:q] for p, q in zip(edge[:-1], edge[1:]))]
                where = [*part[deal[edge[:-1]]].tolist(), int(run % parts)]
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array([1] * len(blobs) + [2], pa.int8()), pa.array([run] * len(where), pa.int64()), pa.array([*blobs, main], pa.binary())], ["part", "kind", "run", "blob"])

    return docs.mapInArrow(ask, "part int, kind byte, run long, blob binary")


_ANSWER = "key int, kind byte, run long, blob binary"
#: In place of the code of a word before that isn't frequent.
_NONE = np.uint64(0xFFFFFFFF)


def _share(d: float, rooms: np.ndarray, customers: np.ndarray) -> np.ndarray:
    """What restaurants leave to the parent."""
    return (STRENGTH + d * rooms) / (STRENGTH + customers)


def _answers(key, kind: int, run, blob) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array([kind] * len(blob), pa.int8()), pa.array(run, pa.int64()), pa.array(blob, pa.binary())], [c.split()[0] for c in _ANSWER.split(", ")])


def _answered(rows: DataFrame, model, parts: int) -> DataFrame:
    """From the state and the cells asked for, by part. kind 2: run, blob as above; kind 1: run, blob of texts and the sums
    of their logarithms; kind 0, dealt by key: code, run, text, times, x of words that aren't frequent, and by word before how many
    of them there are and its code, and by rare word before its share of the parent in each kept sweep; a word's probability is x +
    the mean of share * the parent's."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, room, p, d = model.value
        total = m.count
        for _, held in _by_part(batches):
            seats = []
            runs_, blobs = [], []
            for kind, run, blob in held:
                if kind == _STAY:
                    cu, cw, n, _, _, past = _unpack(blob, *_STATE)
                    seats.append((cu, cw, past.reshape(KEPT, len(n))))
                elif kind == 2:
                    yield _answers([run % parts], 2, [run], [blob])
                else:
                    runs_.append(run)
                    blobs.append(_unpacked_cells(blob))
            del held
            if not blobs:
                continue
            sizes = [len(b[0]) for b in blobs]
            u, w, doc, times, own = (np.concatenate([b[k] for b in blobs]) for k in range(5))
            of = np.repeat(np.arange(len(blobs), dtype=np.int64), sizes)
            del blobs
            order = _order(u, w)
            first = _starts(u[order], w[order])
            cell = np.empty(len(u), np.int64)
            cell[order] = _per(first, len(order))
            n = np.bincount(cell, times * own.astype(np.float64), len(first))
            cu, cw = u[order][first], w[order][first]
            del order, u
            t = np.tile(np.minimum(n, 1).astype(np.uint32), (KEPT, 1))
            if seats:  # those that stayed and those that moved
                t[:, n > 1] = np.concatenate([x[2] for x in seats], 1)[:, _order(*(np.concatenate([x[k] for x in seats]) for k in range(2)))]
            by = _starts(cu)
            group, often_u, often_w = _per(by, len(cu)), cu < _RARE, cw < _RARE
            here = np.where(often_u, cu, 0).astype(np.int64)
            customers, rooms = np.add.reduceat(n, by), np.add.reduceat(t, by, axis=1, dtype=np.float64)  # by word before
            if len(total):
                customers = np.where(often_u[by], total[here[by]], customers)
                rooms = np.where(often_u[by], room[:, here[by]], rooms)
            x = (n - d * t.mean(0)) / (STRENGTH + customers)[group]
            share = _share(d, rooms, customers)
            del rooms, t, here
            smooth, to = np.zeros(len(cu)), np.where(often_w, cw, 0).astype(np.int64)
            for k in range(KEPT if len(total) else 0):
                smooth += share[k][group] * p[k][to] / KEPT
            value = np.where(often_w, np.rint(np.log10(np.maximum(x + smooth, 1e-300)) / STEP), 0).astype(np.int64)
            texts, back = np.unique(of << 32 | doc, return_inverse=True)
            lm = np.zeros(len(texts), np.int64)
            np.add.at(lm, back, value[cell] * times)
            edge = np.append(starts := _starts(texts >> 32), len(texts))
            back_to = [runs_[k] for k in (texts[starts] >> 32).tolist()]
            yield _answers([r % parts for r in back_to], 1, back_to, [_pack((texts[a:b] & 0xFFFFFFFF).astype(np.uint32), lm[a:b]) for a, b in zip(edge[:-1], edge[1:])])
            rare = np.flatnonzero(~often_w[cell])
            if len(rare):
                key = (mix(w[rare]) % np.uint64(parts)).astype(np.int32)
                order = np.lexsort((w[rare], group[cell[rare]], key))  # what depends on the word before alone stands together
                rare, key = rare[order], key[order]
                edge = np.append(starts := _starts(key), len(key))
                names, out = np.array(runs_, np.int64), []
                for i, j in zip(edge[:-1], edge[1:]):
                    r = rare[i:j]
                    new = _starts(group[cell[r]])
                    heads = cell[r[new]]
                    before = np.where(often_u[heads], cu[heads], _NONE).astype(np.uint32)
                    out.append(_pack(w[r], names[of[r]], doc[r], times[r], x[cell[r]], np.diff(np.append(new, len(r))).astype(np.uint32), before, share[:, group[heads[before == _NONE]]]))
                yield _answers(key[starts], 0, [None] * len(starts), out)

    return rows.repartition("part").sortWithinPartitions("part", "kind").select("part", "kind", "run", "blob").mapInArrow(answer, _ANSWER)


def _looked_up(answered: DataFrame, rare: DataFrame, model, parts: int, whole: np.ndarray, rest: np.ndarray, floor: float) -> DataFrame:
    """kinds 1 and 2 as they are; kind 3: run, blob of text, sum of logarithms, known tokens and score of the base of its
    words that aren't frequent; rare: code, n, extra of those that training has; whole, rest: by kept sweep, as in Fit."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, n, extra = *(batch.column(c).to_numpy() for c in ("code", "n")), batch.column("extra").flatten().to_numpy().reshape(-1, KEPT)
            key = (mix(code.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(key, kind="stable")
            if len(order):
                edge = np.append(starts := _starts(key[order]), len(order))
                yield _answers(key[order][starts], -1, [None] * len(starts), [_pack(code[r].view(np.uint64), n[r], extra[r]) for r in (order[i:j] for i, j in zip(edge[:-1], edge[1:]))])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, room, _, d = model.value
        total = m.count
        for key, held in _by_part(batches):
            known = [_unpack(blob, "<u8", "<i8", "<f8") for kind, _, blob in held if kind == -1]
            code, n, more = (np.concatenate([k[c] for k in known]) for c in range(3)) if known else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))
            more = more.reshape(-1, KEPT)
            order = np.argsort(code)
            parts_ = []
            for kind, run, blob in held:
                if kind > 0:
                    yield _answers([key], kind, [run], [blob])
                elif kind == 0:
                    *one, many, before, own = _unpack(blob, "<u8", "<i8", "<u4", "<u4", "<f8", "<u4", "<u4", "<f8")
                    share, often = np.empty((KEPT, len(many))), before < _NONE
                    share[:, ~often] = own.reshape(KEPT, -1)
                    share[:, often] = _share(d, room[:, before[often]], total[before[often]])
                    parts_.append((*one, np.repeat(share, many, 1).T))
            del held
            if not parts_:
                continue
            asked, run, doc, times, x, share = (np.concatenate(c) for c in zip(*parts_))
            at, hit = _find(code[order], asked)
            seen, extra = np.zeros(len(asked)), np.zeros((len(asked), KEPT))
            if len(code):
                seen = np.where(hit, n[order][at], 0)
                extra[hit] = more[order[at[hit]]]
            chance = x + (share * ((extra + rest) / whole)).mean(1)
            lm = times * np.rint(np.log10(np.maximum(chance, 1e-300)) / STEP).astype(np.int64)
            own = np.lexsort((asked, doc, run))  # sums in the same order, whatever the layout
            first = _starts(run[own], doc[own])
            add = lambda v: np.add.reduceat(v[own], first)  # noqa: B023, E731
            of = run[own][first]
            values = doc[own][first], add(lm), add(np.where(seen > 0, times, 0).astype(np.int64)), add(times * (np.log10(seen + 0.5) - floor))
            edge = np.append(starts := _starts(of), len(of))
            yield _answers([key] * len(starts), 3, of[starts], [_pack(*(v[i:j] for v in values)) for i, j in zip(edge[:-1], edge[1:])])

    both = rare.mapInArrow(deal, _ANSWER).unionByName(answered)
    return both.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(look, _ANSWER)


def score(docs: DataFrame, seed: int = 11) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity (a token) of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (doc_fold(F.col("doc_id"), FOLDS) == 1).alias("held_out"))
    counts, files = saved(word_counts(docs.where(~F.col("held_out")))), _Files(spark)
    frequent = _most_frequent(counts, TOP).toArrow()
    order = np.argsort(h := frequent["h"].to_numpy().view(np.uint64))
    words_ = Words(h[order], frequent["n"].to_numpy()[order])
    top = spark.sparkContext.broadcast(words_)
    fitted = fit(docs.where(~F.col("held_out")), counts, top, files, seed)
    n_all, v_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    floor, d = float(np.log10(n_all + 0.5 * (v_all + 1))), fitted.d
    parts = max(1, -(-n_all // PART_TOKENS))
    model = spark.sparkContext.broadcast((words_, fitted.room, fitted.p, d))
    state = fitted.state.select("part", F.lit(_STAY).cast("byte").alias("kind"), F.lit(None).cast("long").alias("run"), "blob")
    found = _looked_up(_answered(state.unionByName(_asked(docs, top, parts, floor)), model, parts), fitted.rare, model, parts, fitted.whole, fitted.rest, floor)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_part(batches):
            ids, null, held_out, tokens, known, base = _unpack(next(b for kind, b in held if kind == 2), "<i8", "<u1", "<u1", "<i8", "<i8", "<f8")
            lm, known, base = np.zeros(len(ids), np.int64), known.copy(), base.copy()
            more = []
            for kind, blob in held:
                if kind == 1:
                    at, part = _unpack(blob, "<u4", "<i8")
                    lm[at] += part
                elif kind == 3:
                    more.append(_unpack(blob, "<u4", "<i8", "<i8", "<f8"))
            for at, part, k, b in sorted(more, key=lambda x: (x[0].tobytes(), x[3].tobytes())):  # the same order, whatever the layout
                lm[at] += part
                known[at] += k
                base[at] += b
            result = lm * STEP
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null.astype(bool)), pa.array(held_out.astype(bool)), pa.array(tokens), pa.array(known), pa.array(np.full(len(ids), n_all, np.int64)), pa.array(base), pa.array(result), pa.array(10 ** np.minimum(300, -result / tokens))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return found.repartition("run").sortWithinPartitions("run").select("run", "kind", "blob").mapInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
