"""Exact vector search and similarities in double precision; scans stay in the JVM."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources import readers


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, v: s + v))


METRICS: dict[str, Callable[[Column, Column], Column]] = {"cosine": cosine, "l2": lambda a, b: 1 / (1 + l2(a, b)), "dot": dot}


def similar(nodes: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", key: str = "node_id", vector: str = "embedding") -> DataFrame:
    """V01 of one query vector: the k best by score, ties to the smaller key; a literal query, so no join at all."""
    if metric not in METRICS:
        raise ValueError(f"Unknown similarity metric: {metric}")
    q = F.array(*(F.lit(float(x)) for x in query))
    return nodes.where(F.size(vector) == len(query)).select(key, METRICS[metric](F.col(vector), q).alias("score")).orderBy(F.col("score").desc_nulls_last(), key).limit(k)


def similar_each(nodes: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", key: str = "node_id", vector: str = "embedding", query_key: str = "query_id", most: int = 10_000) -> DataFrame:
    """V01 of a stated table of queries (query_key, vector), which is broadcast after its size is checked."""
    n = queries.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} queries: split them into blocks")
    both = nodes.select(key, F.col(vector).alias("_v")).join(F.broadcast(queries.select(query_key, F.col(vector).alias("_q"))), F.size("_v") == F.size("_q"))
    scored = both.select(query_key, key, METRICS[metric](F.col("_v"), F.col("_q")).alias("score"))
    place = F.row_number().over(Window.partitionBy(query_key).orderBy(F.col("score").desc_nulls_last(), key))  # limited before the shuffle
    return scored.withColumn("rank", place).where(F.col("rank") <= k)


def embed(texts: DataFrame, text: str, make: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 128, into: str = "embedding") -> DataFrame:
    """Vectors of a text column; make() runs once per task and gives the batch encoder."""

    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = make()
        for part in parts:
            rows = part.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(rows), batch) for v in run(rows[i : i + batch])])

    return texts.withColumn(into, encode(F.col(text)))


def embed_cached(texts: DataFrame, text: str, make, model: str, path: str, batch: int = 128, into: str = "embedding") -> DataFrame:
    """As embed(), by a table at `path` that keeps every vector under its model and the digest of its text: the encoder
    is asked for texts that the table doesn't have, once each, and they are added. Null texts have a null vector."""
    spark = texts.sparkSession
    key = F.sha2(F.col(text).cast("binary"), 256)
    asked = texts.where(F.col(text).isNotNull()).select(key.alias("digest"), F.col(text).alias("_text")).groupBy("digest").agg(F.any_value("_text").alias("_text"))
    read = lambda: spark.read.schema("digest string, vector array<float>, model string").parquet(path).where(F.col("model") == model)
    if readers.exists(spark, f"{path}/_SUCCESS"):
        asked = asked.join(read().select("digest"), "digest", "left_anti")
    new = embed(asked, "_text", make, batch, "vector").select("digest", "vector", F.lit(model).alias("model"))
    new.write.mode("append").partitionBy("model").parquet(path)
    known = read().groupBy("digest").agg(F.any_value("vector").alias(into))  # a task that ran twice may have left a vector twice
    return texts.withColumn("_digest", key).join(known.withColumnRenamed("digest", "_digest"), "_digest", "left").drop("_digest")


def best_of(x: np.ndarray, ids: np.ndarray, asked: np.ndarray, k: int, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of asked, where its k best rows of x are and their scores, ties to the smaller id. Products of whole blocks tell which
    rows can be among them, within what rounding can change; those are scored exactly, alike wherever they stand."""
    square = (x**2).sum(1)
    norms, few = np.sqrt(square), 8 * (x.shape[1] + 4) * np.finfo(np.float64).eps
    step = max(1, (1 << 21) // max(1, len(x)))
    for a in range(0, len(asked), step):
        q = asked[a : a + step]
        size = np.sqrt((q**2).sum(1))
        with np.errstate(all="ignore"):
            near = q @ x.T
            if metric == "cosine":
                near /= norms
                near /= size[:, None]
                slack = np.full(len(q), few)
            elif metric == "l2":
                near *= 2
                near -= square
                slack = few * (np.fmax.reduce(square, initial=0) + size**2)
            else:
                slack = few * np.fmax.reduce(norms, initial=0) * size
            near[np.isnan(near)] = -np.inf
            edge = np.partition(near, len(x) - k, axis=1)[:, len(x) - k] - slack if len(x) > k else np.full(len(q), -np.inf)
            edge[~np.isfinite(edge)] = -np.inf
            for one, row, least in zip(q, near, edge):
                some = np.flatnonzero(row >= least)
                part = x[some]
                s = 1 / (1 + np.linalg.norm(part - one, axis=1)) if metric == "l2" else (part * one).sum(1)
                s = s / (np.linalg.norm(part, axis=1) * np.linalg.norm(one)) if metric == "cosine" else s
                top = np.lexsort((ids[some], -np.nan_to_num(s, nan=-np.inf)))[:k]
                yield some[top], s[top]


#: Rows of a block and queries that meet in one task.
BLOCK, ASKING = 20_000, 16_384


def nearest_blocks(nodes: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", key: str = "node_id", vector: str = "embedding", query_key: str = "query_id", blocks: int = 64) -> DataFrame:
    """V02 for any number of queries: nodes are dealt into blocks, at least so many and more if they are large, queries into turns; each block
    meets each turn, and the k best of the blocks meet per query. Nothing is broadcast; what meets in a task is of bounded size."""
    blocks, turns = max(blocks, -(-nodes.count() // BLOCK)), max(1, -(-queries.count() // ASKING))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    many = queries.where(F.col(vector).isNotNull()).select(query_key, F.col(vector).alias("_q"), deal(query_key, turns).alias("_turn"), each(blocks).alias("_block"))
    own = nodes.where(F.col(vector).isNotNull()).select(key, F.col(vector).alias("_v"), deal(key, blocks).alias("_block"), each(turns).alias("_turn"))
    columns = f"{query_key} {queries.schema[query_key].dataType.simpleString()}, {key} {nodes.schema[key].dataType.simpleString()}, score double"

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = {query_key: [], key: [], "score": []}
        by_size = {n: part for n, part in left.groupby(left["_v"].map(len))}
        for n, asked in right.groupby(right["_q"].map(len)):
            part = by_size.get(n)
            if part is None:
                continue
            x, y, ids = np.stack(part["_v"].to_numpy()).astype(np.float64), np.stack(asked["_q"].to_numpy()).astype(np.float64), part[key].to_numpy()
            for name, (top, s) in zip(asked[query_key], best_of(x, ids, y, k, metric)):
                found[query_key] += [name] * len(top)
                found[key] += ids[top].tolist()
                found["score"] += s.tolist()
        return pd.DataFrame(found)

    near = own.groupBy("_block", "_turn").cogroup(many.groupBy("_block", "_turn")).applyInPandas(best, columns)
    place = F.row_number().over(Window.partitionBy(query_key).orderBy(F.col("score").desc_nulls_last(), key))
    return near.withColumn("rank", place).where(F.col("rank") <= k)


def argument_similarity(rows: DataFrame, truth: str, found: str, make, into: str = "similarity") -> DataFrame:
    """Rows with the cosine of the vectors of two text columns, rounded to 4 digits."""
    both = embed(embed(rows, truth, make, into="_a"), found, make, into="_b")
    return both.withColumn(into, F.round(cosine(F.col("_a"), F.col("_b")), 4)).drop("_a", "_b")


def greedy_similarity(rows: DataFrame, truth: str, found: str, make, into: str = "similarity") -> DataFrame:
    """V06 by tokens: make() gives a function from texts to arrays of token vectors; every token is matched with its most
    similar one on the other side, and the F of the two means is rounded to 4 digits."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        run = make()
        for a, b in parts:
            out = []
            for x, y in zip(run(a.fillna("").tolist()), run(b.fillna("").tolist())):
                if not len(x) or not len(y):
                    out.append(0.0)
                    continue
                unit = lambda v: (m := np.asarray(v, np.float64)) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                near = unit(y) @ unit(x).T
                p, r = near.max(1).mean(), near.max(0).mean()
                out.append(2 * p * r / (p + r) if p + r else 0.0)
            yield pd.Series(out)

    return rows.withColumn(into, F.round(score(F.col(truth), F.col(found)), 4))
