"""Token ids in binary files with Elias-Fano encoded document boundaries.

A file holds some 2 million ids of documents in ascending id order: a header, the document ids and the document ends,
both as Elias-Fano sequences (low bits packed, high bits in unary), then the concatenated token ids in 16 or 32 bits.
`select(i)` finds set bits of the unary part with counts stored per 512 bits, so the offsets of some documents come from
about 2.1 + log2(ids / documents) bits per document and no 64-bit table; reading back asks for them in that way. Files are written and read by Spark (text
sink with one value a file, binary source), so they go wherever Spark writes and are safe to retry.

Layout, numbers big-endian: magic "QTOK", u8 bytes per id, 3 zero bytes, then u64: first document id, documents, ids,
documents without id, byte length of the two Elias-Fano parts, of all before the newline that the sink adds, and the
task and sequence number that order the files.

Defined results: null and empty text have only the end id; documents of equal id are in order of the md5 of their text, null first; those of
null id come first; an empty table gives no file and no rows; white space only separates; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Slots, buffers, runs, shared_dir, words

END_ID = 1
FILE_IDS = 2_000_000
#: Distinct space-delimited strings whose ids a worker remembers; others are encoded again.
CACHE = 600_000
#: Documents whose offsets are looked up at once.
AT_ONCE = 1024
#: Text encoded at once.
RUN_BYTES = 2 << 20
_HEAD = struct.Struct(">4sB3x9Q")


class EliasFano:
    """A non-decreasing sequence of n integers from 0 to top, in about n * (2.1 + log2(top / n)) bits.

    Per BLOCK bits of the unary part the number of set bits before it is kept (ranks), which select() starts from.
    """

    BLOCK = 512

    def __init__(self, n: int, top: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.top, self.low, self.high, self.ranks, self.shift = n, top, low, high, ranks, self.width(n, top)

    @staticmethod
    def width(n: int, top: int) -> int:
        return max(0, (top // n).bit_length() - 1) if n else 0

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        w = cls.width(n, top)
        bits = ((values[:, None] >> np.arange(w, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        high = np.zeros(-(-(n + (top >> w) + 1) // cls.BLOCK) * cls.BLOCK if n else 0, np.uint8)
        high[(values >> np.uint64(w)).astype(np.int64) + np.arange(n)] = 1
        ranks = np.cumsum(high.reshape(-1, cls.BLOCK).sum(1, dtype=np.int64)) - high.reshape(-1, cls.BLOCK).sum(1, dtype=np.int64)
        return cls(n, top, np.packbits(bits.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), ranks.astype("<u4"))

    def tobytes(self) -> bytes:
        return struct.pack(">QQQQ", self.n, self.top, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.ranks.tobytes()

    @classmethod
    def read(cls, data: memoryview) -> tuple[EliasFano, memoryview]:
        n, top, a, b = struct.unpack(">QQQQ", data[:32])
        c = 8 * b // cls.BLOCK * 4
        low, high, ranks = data[32 : 32 + a], data[32 + a : 32 + a + b], data[32 + a + b : 32 + a + b + c]
        return cls(n, top, np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(ranks, "<u4")), data[32 + a + b + c :]

    def select(self, i: np.ndarray) -> np.ndarray:
        """The values at places i: only the blocks that hold them are opened."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return i
        block = np.searchsorted(self.ranks, i, "right") - 1
        opened, back = np.unique(block, return_inverse=True)
        bits = np.unpackbits(self.high.reshape(-1, self.BLOCK // 8)[opened], axis=1, bitorder="little")
        row, place = np.nonzero(bits)  # set bits in order, those of a block together
        before = np.concatenate([[0], np.cumsum(bits.sum(1, dtype=np.int64))])
        at = place[before[back] + i - self.ranks[block]] + block * self.BLOCK
        low = np.zeros(len(i), np.int64)
        for k in range(self.shift):
            bit = i * self.shift + k
            low |= (self.low[bit >> 3].astype(np.int64) >> (bit & 7) & 1) << k
        return (at - i) << self.shift | low


_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[ord(c) for c in '!"#$%&()*+,-./:;=?@[\\]^_`{|}~']] = 2


def _kinds(data: np.ndarray) -> np.ndarray:
    """1: letters of ASCII and Latin-1, 2: marks of ASCII that join no letter, 0: the rest."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the two signs among them
    kind[lead] = kind[lead + 1] = 1
    return kind


class Encoder:
    """Token ids of whole texts. No token spans white space, so the ids of each space-delimited string are kept by its
    hash and joined; case doesn't matter, and letters and marks beside each other are strings of their own. Strings not yet
    known are encoded many at a time and cut apart again: one of letters or of marks where the tokenizer's word ends, any
    other where a special token parts it from the next. Texts with special tokens aren't split at marks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each keep memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(True)
        self.wide = max(vocabulary.values()) >= 1 << 16
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.bar = "<|startoftext|>"
        self.bar_id = vocabulary[self.bar]
        self.clear()

    def clear(self) -> None:
        self.slots, self.store, self.starts = Slots(), np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.more: list[np.ndarray] = []

    def _code(self, texts: list[str]) -> list[np.ndarray]:
        """A few texts at a time: what the tokenizer returns holds much more than ids."""
        batches = (self.tokenizer.encode_batch_fast(texts[k : k + 16], add_special_tokens=False) for k in range(0, len(texts), 16))
        return [np.array(c.ids, np.uint32) for batch in batches for c in batch]

    def _plain(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings of one word each, and how many of each string."""
        ids = np.concatenate(self._code([b" ".join(strings[k : k + 400]).decode() for k in range(0, len(strings), 400)]))
        return ids, np.diff(np.concatenate([[0], np.flatnonzero(self.final[ids]) + 1]))

    def _other(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [s.decode("utf-8", "replace") for s in strings]
        odd = [k for k, t in enumerate(texts) if "<|" in t]
        own = dict(zip(odd, self._code([texts[k] for k in odd])))
        rest = [t for t in texts if "<|" not in t]
        ids = np.concatenate([np.append(c, np.uint32(self.bar_id)) for c in self._code([f" {self.bar} ".join(rest[k : k + 200]) for k in range(0, len(rest), 200)])] or [np.zeros(0, np.uint32)])
        cuts = np.flatnonzero(ids == self.bar_id)
        sizes = np.diff(np.concatenate([[-1], cuts])) - 1
        ids = ids[ids != self.bar_id]
        if not odd:
            return ids, sizes
        pieces, k, edge = [], 0, np.concatenate([[0], np.cumsum(sizes)])
        for n in range(len(texts)):
            pieces.append(own[n] if n in own else ids[edge[k] : edge[k + 1]])
            k += n not in own
        return np.concatenate(pieces), np.array([len(x) for x in pieces], np.int64)

    def learn(self, h: np.ndarray, data: np.ndarray, head: np.ndarray, end: np.ndarray) -> None:
        """Encode new strings, h distinct."""
        raw, kind = data.tobytes(), _kinds(data)
        letters, marks = np.concatenate([[0], np.cumsum(kind == 1)]), np.concatenate([[0], np.cumsum(kind == 2)])
        size = end - head
        plain = (letters[end] - letters[head] == size) | (marks[end] - marks[head] == size)
        for chosen, code in ((np.flatnonzero(plain), self._plain), (np.flatnonzero(~plain), self._other)):
            if len(chosen):
                ids, n = code([raw[a:b] for a, b in zip(head[chosen].tolist(), end[chosen].tolist())])
                first = len(self.starts) - 1
                self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n)])
                self.more.append(ids.astype(np.uint32))
                self.slots.add(h[chosen], np.arange(first, first + len(chosen)))
        self.store, self.more = np.concatenate([self.store, *self.more]), []

    def encode(self, data: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and the number of ids of each."""
        kind, cuts = _kinds(data), None
        if b"<|" not in data.tobytes():
            cuts = np.zeros(len(data), bool)
            cuts[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        h, head, stop, first = words(data, at, lower=True, cuts=cuts)
        distinct, index, back = np.unique(h, return_index=True, return_inverse=True)
        spot = self.slots.find(distinct)
        new = spot < 0
        if new.any():
            if self.slots.count + int(new.sum()) > CACHE:
                self.clear()
                new[:] = True
            self.learn(distinct[new], data, head[index[new]], stop[index[new]])
            spot = self.slots.find(distinct)
        spot = spot[back]
        a = self.starts[spot]
        size = self.starts[spot + 1] - a
        upto = np.cumsum(size)
        before = np.concatenate([[0], upto])[first]
        n = np.diff(before) + 1
        out = np.full(int(n.sum()), end, np.uint32)
        body = np.ones(len(out), bool)
        body[np.cumsum(n) - 1] = False
        out[body] = self.store[np.arange(len(out) - len(n)) + np.repeat(a - (upto - size), size)]
        return out, n


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack_file(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, wide: bool, task: int, number: int) -> bytes:
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    body = EliasFano.encode((known - first).astype(np.uint64)).tobytes()
    ends = EliasFano.encode(np.cumsum(counts)).tobytes()
    data = ids.astype("<u4" if wide else "<u2").tobytes()
    size = _HEAD.size + len(body) + len(ends) + len(data)
    return _HEAD.pack(b"QTOK", 4 if wide else 2, first & (1 << 64) - 1, len(doc_ids), len(ids), len(doc_ids) - len(known), len(body), len(ends), size, task, number) + body + ends + data


def open_file(blob: bytes) -> tuple[list[None], EliasFano, int, EliasFano, np.ndarray]:
    """Of a file: documents without id, the ids of the others less the first, the first id, document ends and token ids."""
    magic, width, first, docs, n, nameless, body, ends, _, _, _ = _HEAD.unpack(blob[: _HEAD.size])
    if magic != b"QTOK":
        raise ValueError("not a token file")
    first = first - (1 << 64) if first >> 63 else first
    view = memoryview(blob)[_HEAD.size :]
    names, _ = EliasFano.read(view[:body])
    bounds, _ = EliasFano.read(view[body : body + ends])
    ids = np.frombuffer(view[body + ends :][: n * width], "<u4" if width == 4 else "<u2")
    return [None] * nameless, names, first, bounds, ids


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END_ID) -> str:
    """Write the files of docs to a folder."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = _encoder(tokenizer), 0
        task = TaskContext.get().partitionId()
        ids, counts, names, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, counts, names, held, number
            blob = pack_file(names, np.concatenate(counts), np.concatenate(ids), encoder.wide, task, number)
            ids, counts, names, held, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["value"])

        for batch in batches:
            data, at = buffers(batch.column("text"))
            for i, j in runs(at, RUN_BYTES):
                a, n = encoder.encode(data[at[i] : at[j]], at[i : j + 1] - at[i], end)
                ids.append(a)
                counts.append(n)
                names += batch.column("doc_id").slice(i, j - i).to_pylist()
                held += len(a)
                if held >= FILE_IDS:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("sum", F.md5(F.col("text").cast("binary")))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "sum").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "sum").drop("sum")
    blobs = rows.mapInArrow(files, "value binary").select(F.col("value").cast("string").alias("value"))
    blobs.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a folder."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                blob = batch.column("content")[k].as_buffer().to_pybytes()
                nameless, names, first, bounds, ids = open_file(blob)
                key = batch.column("base")[k].as_py()
                for a in range(0, bounds.n, AT_ONCE):  # offsets are asked for some documents at a time
                    b = min(a + AT_ONCE, bounds.n)
                    ends = bounds.select(np.arange(max(0, a - 1), b))
                    starts = ends[:-1] if a else np.concatenate([[0], ends[:-1]])
                    ends = ends[1:] if a else ends
                    sums = [zlib.crc32(ids[p:q].astype("<u4").tobytes()) for p, q in zip(starts.tolist(), ends.tolist())]
                    n = len(nameless)
                    own = nameless[a:b] + (names.select(np.arange(max(0, a - n), max(0, b - n))) + first).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(starts + key, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    try:
        files = spark.read.format("binaryFile").load(path).where("length > 1")
    except Exception as e:  # the folder of an empty table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    number = lambda k: F.conv(F.hex(F.substring("content", 9 + 8 * k, 8)), 16, 10).cast("long")
    heads = files.select("path", number(2).alias("ids"), number(7).alias("task"), number(8).alias("number"))
    heads = heads.withColumn("inside", F.coalesce(F.sum("ids").over(Window.partitionBy("task").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    tasks = heads.groupBy("task").agg(F.sum("ids").alias("all"))  # a row per task of the writing job
    tasks = tasks.withColumn("before", F.coalesce(F.sum("all").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    heads = heads.join(tasks, "task").select("path", (F.col("before") + F.col("inside")).alias("base"))
    return files.select("path", "content").join(F.broadcast(heads) if heads.count() <= 100_000 else heads, "path").select("base", "content").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end: int = END_ID) -> DataFrame:
    spark = docs.sparkSession
    return read(spark, write(docs, shared_dir(spark), tokenizer, end))
