"""Approximate nearest neighbours for the largest inner product, with score-aware anisotropic quantisation.

Vectors are product-quantised, two components and 4 bits a subspace, with four more bits a component of what these codes
leave. Codebooks and codes minimise the anisotropic loss |r|^2 + (eta - 1) (u.r)^2 with u = x / |x|: an error parallel to
the vector, which changes large inner products, costs eta times as much as one across it. Every row is encoded and belongs
to the part of its nearest centre; a part is held in blocks of bounded size.

No vector is lost to an estimate. A query's floor is its k-th product with a sample, which the k-th of all can't be below. It goes
to every part that can reach the floor: the product with the centre and the query's length times the part's radius. There it
scans the codes through its table of partial products, two codes a lookup. A row keeps the length of what its codes miss,
so each estimate has bounds; rows whose upper bound reaches the floor and the block's k-th lower bound are ranked by
their exact products in doubles. So results are those of brute force whatever the rows are, and how well codes
and parts fit decides the time alone: where parts don't separate, all queries scan all codes.

Vectors move once, with their codes, and a query once for each block that it asks; a block gives back k rows of it at most. Codebooks and
centres are fitted on the `SAMPLE` and `CENTRE_SAMPLE` vectors of least id hash.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite components
take no part, nor do rows without an id; of equal queries by id one asks; rows that share an id are separate candidates,
but never for the query of that id; ties go to the smaller id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

SAMPLE, ROUNDS, THRESHOLD = 8192, 8, 0.2
CODES = 16
#: Components of a subspace.
WIDTH = 2
BLOCK, QUERY_BLOCK = 32_768, 256
#: Parts have so many rows on average, and are so many at most.
PART_ROWS, PARTS = 4096, 4096
CENTRE_SAMPLE = 32_768


class Quantiser(NamedTuple):
    books: np.ndarray  # (subspace, code, WIDTH)
    eta: float
    dim: int
    fine: np.ndarray  # (component, code): what is left of a component, in 4 more bits

    def padded(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), WIDTH * len(self.books)))
        out[:, : self.dim] = x
        return out.reshape(len(x), -1, WIDTH)

    def assign(self, x: np.ndarray, sweeps: int = 3) -> np.ndarray:
        """Codes (row, subspace) by coordinate descent on the anisotropic loss."""
        x = self.padded(x)
        u = x / np.maximum(np.sqrt((x**2).sum((1, 2), keepdims=True)), 1e-300)
        cost = ((x[:, :, None] - self.books[None]) ** 2).sum(-1) if len(x) * len(self.books) < 1 << 22 else np.stack([((x[:, j, None] - self.books[j]) ** 2).sum(-1) for j in range(len(self.books))], 1)
        code = cost.argmin(-1)
        rows = np.arange(len(x))
        along = np.einsum("njd,njd->nj", u, x - self.books[np.arange(len(self.books)), code])
        total = along.sum(1)
        for _ in range(sweeps):
            for j in range(len(self.books)):
                other = total - along[:, j]
                mine = (u[:, j] * x[:, j]).sum(1)[:, None] - u[:, j] @ self.books[j].T
                code[:, j] = (cost[:, j] + (self.eta - 1) * (other[:, None] + mine) ** 2).argmin(1)
                along[:, j] = mine[rows, code[:, j]]
                total = other + along[:, j]
        return code.astype(np.uint8)

    def rest(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        """What the codes leave of the vectors."""
        return x - self.books[np.arange(len(self.books)), code].reshape(len(x), -1)[:, : self.dim]

    def refined(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Packed 4-bit codes of the rest."""
        rest = self.rest(x, code)
        out = np.zeros((len(x), 2 * -(-self.dim // 2)), np.uint8)
        for j in range(self.dim):
            out[:, j] = np.searchsorted((self.fine[j, 1:] + self.fine[j, :-1]) / 2, rest[:, j])
        return out[:, 0::2] | out[:, 1::2] << 4

    def unrefined(self, packed: np.ndarray) -> np.ndarray:
        code = np.stack([packed & 15, packed >> 4], -1).reshape(len(packed), -1)[:, : self.dim]
        return self.fine[np.arange(self.dim), code].astype(np.float32)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Partial products by query, byte of code and its 256 values."""
        each = np.einsum("njd,jcd->njc", self.padded(q), self.books).astype(np.float32)
        return (each[:, 1::2, :, None] + each[:, 0::2, None, :]).reshape(len(q), -1, CODES * CODES)


def fit(x: np.ndarray, rounds: int = ROUNDS, seed: int = 3) -> Quantiser:
    """Codebooks by turns: codes for the books, then all books at once by least squares."""
    n, dim = x.shape
    spaces = -(-dim // (2 * WIDTH)) * 2  # an even number: two codes a byte
    eta = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    rng = np.random.default_rng(seed)
    q = Quantiser(np.zeros((spaces, CODES, WIDTH)), eta, dim, np.zeros((dim, CODES)))
    padded = q.padded(x)
    for j in range(spaces):
        q.books[j] = padded[rng.integers(0, n, CODES), j] + rng.normal(0, 1e-6, (CODES, WIDTH))
    norm = np.maximum(np.sqrt((padded**2).sum((1, 2), keepdims=True)), 1e-300)
    u = padded / norm
    slots = spaces * CODES * WIDTH
    for _ in range(rounds):
        code = q.assign(x, 2)
        at = ((np.arange(spaces) * CODES + code)[:, :, None] * WIDTH + np.arange(WIDTH)).reshape(n, -1)
        v = np.zeros((n, slots))
        v[np.arange(n)[:, None], at] = u.reshape(n, -1)
        gram = (eta - 1) * (v.T @ v)
        gram[np.arange(slots), np.arange(slots)] += np.bincount(at.ravel(), minlength=slots) + 1e-6
        right = np.bincount(at.ravel(), (eta * padded).reshape(-1), slots) + 1e-6 * q.books.ravel()
        q.books[:] = np.linalg.solve(gram, right).reshape(q.books.shape)
    rest = np.sort(q.rest(x, q.assign(x)), axis=0)
    for k, part in enumerate(np.array_split(rest, CODES)):
        q.fine[:, k] = part.mean(0) if len(part) else q.fine[:, k - 1]
    return q


def centres(x: np.ndarray, parts: int, rounds: int = 8, seed: int = 4) -> np.ndarray:
    """k-means; a part that gets empty starts again at a vector of the sample."""
    rng = np.random.default_rng(seed)
    found = x[rng.choice(len(x), min(parts, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, found)
        size = np.bincount(near, minlength=len(found))
        total = np.zeros_like(found)
        np.add.at(total, near, x)
        found = np.where(size[:, None] > 0, total / np.maximum(1, size)[:, None], x[rng.integers(0, len(x), len(found))])
    return found


def nearest(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    return np.concatenate([((found**2).sum(1)[None, :] - 2 * x[a : a + 4096] @ found.T).argmin(1) for a in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(1))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part, of the commonest length."""
    v = F.col("embedding")
    odd: Column = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v).where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    rows = rows.where(~odd & F.exists(v, lambda x: x != 0))
    length = rows.groupBy(F.size("embedding").alias("k")).count().orderBy(F.col("count").desc(), "k").limit(1).collect()
    return rows.where(F.size("embedding") == (length[0].k if length else 0))


def search(vectors: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row for which `queries` (on vec_id) holds."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    asking = rows.where(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    if rows.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = rows.select(F.size("embedding")).first()[0]
    # Equal vectors are one entry of the index. Of its k + 1 least ids, k rows each, k are left whichever id asks.
    place = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    copy = F.row_number().over(Window.partitionBy("embedding", "vec_id").orderBy("vec_id"))
    rows = rows.withColumn("place", place).where(F.col("place") <= k + 1).withColumn("copy", copy).where(F.col("copy") <= k)
    rows = kept(rows.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    n = rows.count()
    sample = rows.select(F.get("ids", F.lit(0)).alias("id"), "embedding").orderBy(F.xxhash64("id"), "id", "embedding").limit(CENTRE_SAMPLE).toArrow()
    drawn = _matrix(sample["embedding"], dim)
    x, kind = drawn.astype(np.float64), drawn.dtype
    middle = centres(x, max(1, min(PARTS, n // PART_ROWS, len(x) // 8)))
    quantiser = fit(x[:SAMPLE])
    model = spark.sparkContext.broadcast((quantiser, middle, drawn, sample["id"].to_numpy()))
    width = len(quantiser.books) // 2

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows and radius of the parts; a vector as near to other centres counts for these as well, wherever rounding puts it."""
        _, found, _, _ = model.value
        rows_, radius = np.zeros(len(found), np.int64), np.zeros(len(found))
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                v = _matrix(batch.slice(a, 1024).column("embedding"), dim).astype(np.float64)
                away = (v**2).sum(1)[:, None] + (found**2).sum(1)[None, :] - 2 * v @ found.T
                least = away.min(1)
                row, part = np.nonzero(~(away > (least + 1e-9 * ((v**2).sum(1) + (found**2).sum(1).max()))[:, None]))
                np.add.at(rows_, part, 1)
                np.maximum.at(radius, part, _lengths(v[row] - found[part]))
        some = np.flatnonzero(rows_)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(rows_[some]), pa.array(radius[some])], ["part", "rows", "radius"])

    parts = rows.select("embedding").mapInArrow(measure, "part int, rows long, radius double")
    held, radius = np.zeros(len(middle), np.int64), np.zeros(len(middle))
    for row in parts.groupBy("part").agg(F.sum("rows").alias("rows"), F.max("radius").alias("radius")).collect():  # PARTS rows at most
        held[row.part], radius[row.part] = row["rows"], row["radius"]
    blocks = -(-held // BLOCK)
    columns, schema = ["part", "block", "kind", "id", "number", "body", "ids"], "part int, block int, kind int, id long, number double, body binary, ids array<long>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser, found, _, _ = model.value
        for batch in batches:
            if batch.num_rows:
                own = np.ascontiguousarray(_matrix(batch.column("embedding"), dim))
                v = own.astype(np.float64)
                code = quantiser.assign(v)
                fine = quantiser.refined(v, code)
                rest = quantiser.rest(v, code)
                # what both codes miss, and the rounding of sums in floats
                missed = _lengths(rest - quantiser.unrefined(fine)) + (1e-5 + 1e-7 * dim) * (2 * _lengths(v) + 2 * _lengths(rest))
                part = nearest(v, found)
                block = batch.column("g").to_numpy() % np.maximum(1, blocks[part])
                body = np.concatenate([code[:, 0::2] | code[:, 1::2] << 4, fine, own.view(np.uint8).reshape(len(own), -1)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(np.zeros(len(v), np.int32)), batch.column("g"), pa.array(missed), pa.array([r.tobytes() for r in body], pa.binary()), batch.column("ids").cast(pa.list_(pa.int64()))], columns)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, found, drawn, names = model.value
        drawn = drawn.astype(np.float64)
        longest = _lengths(drawn).max()
        reach = radius + 1e-6 * (radius + _lengths(found))
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                rows_ = batch.slice(a, 64)
                own = np.ascontiguousarray(_matrix(rows_.column("embedding"), dim))
                v, ids = own.astype(np.float64), rows_.column("vec_id").to_numpy()
                floor = np.full(len(v), -np.inf)
                if len(drawn) >= k:
                    score = v @ drawn.T
                    score[ids[:, None] == names[None, :]] = -np.inf
                    floor = np.partition(score, -k, axis=1)[:, -k] - 1e-9 * _lengths(v) * longest
                asks = ~(v @ found.T + _lengths(v)[:, None] * reach < floor[:, None]) & (held > 0)
                row, part = np.nonzero(asks)
                row, part = np.repeat(row, blocks[part]), np.repeat(part, blocks[part])
                first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])))
                block = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) if len(row) else row
                body = [r.tobytes() for r in own]
                for b in range(0, len(row), 4096):
                    r, p = row[b : b + 4096], part[b : b + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(block[b : b + 4096].astype(np.int32)), pa.array(np.ones(len(r), np.int32)), pa.array(ids[r]), pa.array(floor[r]), pa.array([body[i] for i in r], pa.binary()), pa.nulls(len(r), pa.list_(pa.int64()))], columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block: first its codes, then the queries that ask it, some at a time."""
        quantiser, _, _, _ = model.value
        at, entries, asked, block = None, [], [], None

        def close() -> tuple:
            body = np.frombuffer(b"".join(b for b, _, _ in entries), np.uint8).reshape(len(entries), -1)
            codes, fine = body[:, :width].T.copy(), body[:, width : width + -(-dim // 2)]
            own = np.frombuffer(body[:, width + fine.shape[1] :].tobytes(), kind).reshape(-1, dim)
            least = np.array([i[0] for _, _, i in entries], np.int64)
            second = np.array([next((j for j in i if j != i[0]), i[0]) for _, _, i in entries], np.int64)
            return codes, quantiser.unrefined(fine), np.array([m for _, m, _ in entries], np.float32), own, least, second, [i for _, _, i in entries]

        def answer() -> pa.RecordBatch:
            codes, rest, missed, own, least, second, ids = block
            q = np.frombuffer(b"".join(v for _, v, _ in asked), kind).reshape(len(asked), dim).astype(np.float64)
            size = _lengths(q)
            unit = q / size[:, None]
            lut = quantiser.tables(unit)
            scores = unit.astype(np.float32) @ rest.T
            for j, byte in enumerate(codes):
                scores += np.take(lut[:, j], byte, axis=1)
            names, near = [], []
            for r, (i, _, floor) in enumerate(asked):
                high = scores[r] + missed
                # a comparison with what isn't a number leaves the row in
                some = np.flatnonzero(~(high < np.float32(floor / size[r] - 1e-6 * abs(floor / size[r]))) & ((least != i) | (second != i)))
                if len(some) > k:
                    some = some[~(high[some] < np.partition(scores[r, some] - missed[some], -k)[-k])]
                score = np.einsum("nd,d->n", own[some].astype(np.float64), q[r])
                name = np.where(least[some] == i, second[some], least[some])
                best = np.lexsort((name, -score))[:k]
                best = best[~(score[best] < floor)]
                if any(len(ids[some[b]]) > 1 for b in best):
                    pairs = sorted((-score[b], j) for b in best for j in [j for j in ids[some[b]] if j != i][:k])[:k]
                    names.append([j for _, j in pairs])
                    near.append([-s for s, _ in pairs])
                else:
                    names.append(name[best])
                    near.append(score[best])
            return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in asked], pa.int64()), pa.array(names, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.float64()))], ["query_id", "vec_id", "score"])

        for batch in batches:
            for part, number, kind_, i, value, body, ids in zip(*(batch.column(c).to_pylist() for c in columns)):
                if (part, number) != at:
                    if asked and block:
                        yield answer()
                    at, entries, asked, block = (part, number), [], [], None
                if kind_ == 0:
                    entries.append((body, value, ids))
                    continue
                if entries:
                    block, entries = close(), []
                if block:
                    asked.append((i, body, value))
                if len(asked) >= QUERY_BLOCK:
                    yield answer()
                    asked = []
        if asked and block:
            yield answer()

    coded = rows.select("embedding", "ids", F.xxhash64("embedding").alias("g")).mapInArrow(encode, schema)
    both = coded.unionByName(asking.mapInArrow(route, schema)).repartition("part", "block").sortWithinPartitions("part", "block", "kind", "id")
    near = both.mapInArrow(scan, "query_id long, vec_id array<long>, score array<double>").select("query_id", F.explode(F.arrays_zip("vec_id", "score")).alias("e")).select("query_id", "e.vec_id", "e.score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
