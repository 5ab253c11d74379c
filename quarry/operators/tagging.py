"""X01 with any number of names: every place of a text where a name stands as a whole, leftmost first, the longest of equal starts.

Texts and names are cut into word runs and single other characters. What the beginnings of names (their first pieces, one, two and so on)
and whole names hash to is marked in a filter of bounded size, made by the tasks and shipped once. A batch of texts is walked once from
all its places: step by step only the places that may still be inside a name go on. What may be a whole name is joined with the names
by its characters, so the filter decides nothing, and however many names there are texts are walked once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import stored

#: Characters of text that are walked together.
CHARACTERS = 1_000_000
#: Names that the filter is made for; more are found as well, but more of what is no name goes into the join.
NAMES = 1 << 22
#: Bits of the filter for a name, the least power of two of them, and that of a slice, which a task makes.
PER_NAME, LEAST, SLICE = 64, 20, 15
_WORD: list[np.ndarray] = []
_PLACE = np.random.default_rng(7).integers(1, 1 << 63, 1 << 10, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _is_word() -> np.ndarray:
    """By code point whether it is a word character, as in re."""
    if not _WORD:
        _WORD.append(np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), bool, 0x110000))
    return _WORD[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per piece its hash, its text, its first character there and its end, and whether it is a run of word characters."""
    size = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate([[0], np.cumsum(size)])
    point = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(point)
    if not n:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3, np.zeros(0, bool))
    word = _is_word()[point]
    first = np.ones(n, bool)
    first[1:] = ~(word[1:] & word[:-1])
    first[base[:-1][size > 0]] = True
    start = np.flatnonzero(first)
    span = np.diff(np.append(start, n))
    place = np.minimum(np.arange(n) - np.repeat(start, span), len(_PLACE) - 1)
    total = (point.astype(np.uint64) + np.uint64(1)) * _PLACE[place]
    h = _mix(np.add.reduceat(total, start) + span.astype(np.uint64))
    of = np.searchsorted(base, start, "right") - 1
    return h, of, start - base[of], start - base[of] + span, word[start]


def _next(state: np.ndarray, h: np.ndarray) -> np.ndarray:
    return _mix(state * np.uint64(0x9E3779B97F4A7C15) + h)


def _whole(state: np.ndarray) -> np.ndarray:
    return _mix(state ^ np.uint64(0x5851F42D4C957F2D))


def _marks(names: list[str]) -> np.ndarray:
    """What the beginnings of the names and the whole names hash to."""
    h, of, *_ = pieces(names)
    first = np.searchsorted(of, np.arange(len(names) + 1))
    live, state, depth, out = np.arange(len(names)), np.zeros(len(names), np.uint64), 0, []
    while len(live := live[first[live] + depth < first[live + 1]]):
        state[live] = _next(state[live], h[first[live] + depth])
        out.append(np.unique(state[live]))
        depth += 1
    out.append(_whole(state))
    return np.unique(np.concatenate(out))


def _filter(names: DataFrame, bits: int) -> np.ndarray:
    """The bytes of the filter of all names: slices of it are made by tasks and set side by side here."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_marks(batch.column(0).to_pylist()) >> np.uint64(64 - bits)).astype(np.int64))], ["at"])

    def draw(rows: pa.Table) -> pa.Table:
        at = rows.column("at").to_numpy()
        field = np.zeros(1 << SLICE, bool)
        field[at & ((1 << SLICE) - 1)] = True
        return pa.table({"slice": pa.array([int(at[0]) >> SLICE], pa.int64()), "bits": pa.array([np.packbits(field).tobytes()], pa.binary())})

    marks = names.select("name").mapInArrow(mark, "at long").distinct()
    slices = marks.groupBy(F.shiftright("at", SLICE).alias("_slice")).applyInArrow(draw, "slice long, bits binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in slices.collect():  # 2^(bits - SLICE) rows, 32 MB together at most
        a = r.slice << (SLICE - 3)
        out[a : a + (1 << (SLICE - 3))] = np.frombuffer(r.bits, np.uint8)
    return out


def places(marked: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, start, end (in characters) of all that may be a whole occurrence of a name."""
    bits = (len(marked) * 8).bit_length() - 1

    def has(state: np.ndarray) -> np.ndarray:
        at = state >> np.uint64(64 - bits)
        return (marked[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)

    h, of, start, end, word = pieces(texts)
    same = of[1:] == of[:-1]
    before, after = np.zeros(len(h), bool), np.zeros(len(h), bool)
    before[1:], after[:-1] = word[:-1] & same, word[1:] & same  # a word character stands right before, right after
    last = np.ones(len(h), bool)
    last[:-1] = ~same
    at = np.flatnonzero(~before)
    here, state, out = at, np.zeros(len(at), np.uint64), []
    while len(at):
        state = _next(state, h[here])
        go = has(state)
        at, here, state = at[go], here[go], state[go]
        whole = ~after[here]
        whole[whole] = has(_whole(state[whole]))
        out.append((at[whole], here[whole]))
        more = ~last[here]
        at, here, state = at[more], here[more] + 1, state[more]
    a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
    return of[a], start[a], end[b]


def leftmost(text: np.ndarray, start: np.ndarray, end: np.ndarray, last: int = -1, upto: int = 0) -> tuple[np.ndarray, int, int]:
    """Which of the places, by text, start and falling end, stay if none may overlap an earlier one that stays; the last text and
    where its last place ends, from which the next places go on."""
    keep = np.zeros(len(text), bool)
    for i, (t, s, e) in enumerate(zip(text.tolist(), start.tolist(), end.tolist(), strict=True)):
        if t != last:
            last, upto = t, 0
        if s >= upto:
            keep[i], upto = True, e
    return keep, last, upto


def tag_names(texts: DataFrame, key: str, text: str, names: DataFrame, most: int = NAMES) -> DataFrame:
    """key, start, end, entity, tag of names (name, tag) in texts; a name with several tags has the greatest.

    Null and empty texts and names give nothing; texts are taken whole. Rows that share a key each give their own places.
    """
    own = stored(names.where("name <> ''").groupBy("name").agg(F.max("tag").alias("tag")).select("name", "tag"))
    bits = max(LEAST, math.ceil(math.log2(PER_NAME * max(1, min(most, own.count())))))
    kind = texts.schema[key].dataType.simpleString()
    marked = texts.sparkSession.sparkContext.broadcast(_filter(own, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40  # of a text
        for batch in batches:
            held = [x or "" for x in batch.column(1).to_pylist()]
            size = np.cumsum([len(x) for x in held])
            turns = np.concatenate([[0], np.flatnonzero(np.diff(size // CHARACTERS)) + 1, [len(held)]])
            for a, b in zip(turns[:-1].tolist(), turns[1:].tolist(), strict=True):  # some texts at a time
                t, s, e = places(marked.value, held[a:b])
                found = [held[a + i][j:k] for i, j, k in zip(t.tolist(), s.tolist(), e.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(t)), pa.array(t + (number + a)), pa.array(s), pa.array(e), pa.array(found, pa.string())], ["key", "row", "start", "end", "name"])
            number += len(held)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, upto = -1, 0
        for batch in batches:
            keep, last, upto = leftmost(*(batch.column(c).to_numpy() for c in ("row", "start", "end")), last, upto)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "start", "end", "name", "tag")], [key, "start", "end", "entity", "tag"]).filter(pa.array(keep))

    found = texts.select(key, text).mapInArrow(run, f"key {kind}, row long, start long, end long, name string").join(own, "name")
    found = found.select("key", "row", "start", "end", "name", "tag").repartition("row").sortWithinPartitions("row", "start", F.col("end").desc())
    return found.mapInArrow(settle, f"{key} {kind}, start long, end long, entity string, tag string")
