"""Pieces shared by the training-data operators: table access, durable cuts of lineage and byte-level word hashing."""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import cut, shared_base, ship

#: A word is a maximal run of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

#: Text handled at once by the numpy kernels; bounds their working memory.
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the folder that driver and executors share."""
    return f"{shared_base(spark)}/quarry-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder: later reads survive lost executors and don't recompute."""
    return cut(df)


def kept(df: DataFrame) -> DataFrame:
    """As saved(), for wide tables: compressed columns, of which later reads take what they need."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles and checkpoints of tables that nothing refers to any more; many small files are much disk."""
    gc.collect()
    spark._jvm.System.gc()


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """_rank: the place of a row in a total order, from 0, without any single-task sort."""
    rows = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))  # a row per partition
    sizes = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return rows.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn("_rank", F.col("_base") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_base")


def doc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, mod folds; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def n_words(text: Column) -> Column:
    """Words of the text (null: 0), inside the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---- numpy kernels -------------------------------------------------------------------------------------------------

#: Bytes of letters and digits, and of all other characters beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_WS = np.zeros(256, bool)
_WS[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20260717)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_EXACT, _BYTE_LOWER = _BYTE.copy(), _BYTE[_LOWER].copy()
_BYTE_EXACT[_WS] = _BYTE_LOWER[_WS] = 0
_PLACE = _RNG.integers(1, 2**63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and, per text, where it starts (one more at the end). Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def runs(at: np.ndarray, most: int = 4 * PIECE_BYTES):
    """Consecutive texts (i, j) of at most so many bytes together, or one longer text."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _place(n: int) -> np.ndarray:
    """Odd multipliers by position in a word, extended for the rare longer word."""
    if n <= len(_PLACE):
        return _PLACE
    return np.concatenate([_PLACE, mix(np.arange(len(_PLACE), n, dtype=np.uint64)) | np.uint64(1)])


def words(data: np.ndarray, at: np.ndarray, lower: bool = False, inside: np.ndarray | None = None, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word a 64-bit hash, its first byte and its end; per text the index of its first word (one more at the end).

    Words are runs of the bytes in `inside`, by default of all but white space, parted before the bytes of `cuts`. Works piece by piece, cut at white
    space, so that memory stays bounded however long a text is.
    """
    inside = ~_WS if inside is None else inside
    value = np.where(inside, _BYTE_LOWER if lower else _BYTE_EXACT, np.uint64(0))
    heads, ends, hashes, pos, n = [], [], [], 0, len(data)
    while pos < n:
        end = min(pos + PIECE_BYTES, n)
        while end < n and not _WS[data[end]]:
            gap = np.flatnonzero(_WS[data[end : end + 65536]])
            end = end + int(gap[0]) if len(gap) else min(end + 65536, n)
        part = data[pos:end]
        solid = inside[part]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        inner = at[np.searchsorted(at, pos) : np.searchsorted(at, end)] - pos
        if cuts is not None:
            inner = np.union1d(inner, np.flatnonzero(cuts[pos:end]))
        first[inner] = solid[inner]
        start = np.flatnonzero(first)
        if len(start):
            last = solid.copy()
            last[:-1] &= ~solid[1:]
            cut = inner[inner > 0] - 1
            last[cut] = solid[cut]
            stop = np.flatnonzero(last) + 1
            span = np.diff(np.append(start, len(part)))
            place = np.arange(start[0], len(part)) - np.repeat(start, span)
            long = int((stop - start).max())
            np.minimum(place, long - 1, out=place)
            total = value[part[start[0] :]]
            total *= _place(long)[place]
            hashes.append(mix(np.add.reduceat(total, start - start[0]) + (stop - start).astype(np.uint64)))
            heads.append(start + pos)
            ends.append(stop + pos)
        pos = end
    if not heads:
        zero = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), zero, zero, np.zeros(len(at), np.int64)
    head = np.concatenate(heads)
    return np.concatenate(hashes), head, np.concatenate(ends), np.searchsorted(head, at)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values per text; first as from words()."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


class Slots:
    """A hash table from 64-bit hashes to numbers, with open addressing and whole arrays as arguments."""

    def __init__(self, bits: int = 12):
        self.keys, self.values, self.count = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it has none."""
        out, mask = np.full(len(h), -1, np.int64), np.uint64(len(self.keys) - 1)
        live, at = np.arange(len(h)), h & mask
        while len(live):
            key = self.keys[at]
            hit = key == h[live]
            out[live[hit]] = self.values[at[hit]]
            go = ~hit & (key != 0)
            live, at = live[go], (at[go] + np.uint64(1)) & mask
        return out

    def add(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct hashes that aren't there yet."""
        self.count += len(h)
        if 2 * self.count > len(self.keys):
            old = self.keys != 0
            h, numbers = np.concatenate([self.keys[old], h]), np.concatenate([self.values[old], numbers])
            bits = max(12, int(3 * self.count).bit_length())
            self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)
        mask = np.uint64(len(self.keys) - 1)
        live, at = np.arange(len(h)), h & mask
        while len(live):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[live[free]]
            mine = free & (self.keys[at] == h[live])
            self.values[at[mine]] = numbers[live[mine]]
            live, at = live[~mine], (at[~mine] + np.uint64(1)) & mask
