"""An index of vectors as a table by coarse cell: pruned when read, several cells asked by margin, exact scores, never fewer than k.

Cells are those of k-means on a bounded sample. A query asks the cells whose centres score within a margin of its best,
and more of them, in order of their centres, until they hold k vectors. The margin is such that sample queries find the share
`cover` of their true neighbours in the sample. What is asked is scored exactly in doubles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import shared_base, stored
from quarry.operators import vectors

SAMPLE, CELL_ROWS, CELLS = 20_000, 1_000, 2_048
#: Rows of a cell and queries that meet in one task.
BLOCK, ASKING = 20_000, 2_000


@dataclass(frozen=True)
class Index:
    """Where the rows are (a table of key, vector and cell, partitioned by cell), and how to ask it.

    Cells 0 to n - 1 have centres; n holds vectors without a length; n + 1 + d those of another size d.
    """

    path: str
    key: str
    kind: str
    metric: str
    centres: np.ndarray
    margin: float
    sizes: dict[int, int]

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{self.key} {self.kind}, vector array<double>, cell long").parquet(self.path)


def _scores(metric: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Scores of all rows of x with all of y; nan where one has no length and the metric needs it."""
    if metric == "l2":
        return 1 / (1 + np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0)))
    s = x @ y.T
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            s = s / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None])
    return s


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _centres(x: np.ndarray, n: int, metric: str, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(5)
    found = x[rng.choice(len(x), n, replace=False)]
    for _ in range(rounds):
        home = _home(x, found)
        size = np.bincount(home, minlength=n)
        total = np.zeros_like(found)
        np.add.at(total, home, x)
        found = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.integers(0, len(x), n)])
    return found


def _home(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)


def _margin(x: np.ndarray, centres: np.ndarray, metric: str, k: int, cover: float, asked: int = 400) -> float:
    """By how much the centre of a neighbour's cell scores less than a query's best, at the quantile `cover` of true neighbours."""
    if len(centres) == 1 or len(x) < 2:
        return math.inf
    q, home = x[:asked], _home(x, centres)
    near = _scores(metric, q, x)
    near[np.arange(len(q)), np.arange(len(q))] = -np.inf
    best = np.argsort(-near, axis=1)[:, : min(k, len(x) - 1)]
    at = _scores(metric, q, centres)
    gaps = at.max(1)[:, None] - np.take_along_axis(at, home[best], 1)
    return float(np.quantile(gaps, cover)) + 1e-12


def build(nodes: DataFrame, metric: str = "cosine", key: str = "node_id", vector: str = "embedding", k: int = 10, cover: float = 0.99, path: str | None = None) -> Index:
    """The index of nodes (key, vector); null and empty vectors are left out, as are those with null or non-finite parts.

    Written in one pass; only the sample, sizes and centres come to the driver, all of bounded size.
    """
    if metric not in ("cosine", "l2", "dot"):
        raise ValueError(f"Unknown similarity metric: {metric}")
    spark = nodes.sparkSession
    path = path or f"{shared_base(spark)}/quarry-index-{np.random.default_rng().integers(1 << 62):x}"
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = nodes.select(key, v.cast("array<double>").alias("vector")).where(v.isNotNull() & (F.size(v) > 0)).where(~odd)
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).collect()
    dim, n = (sizes[0]["d"], sizes[0]["count"]) if sizes else (0, 0)
    real = rows.where((F.size("vector") == dim) & F.exists("vector", lambda x: x != 0))
    sample = real.orderBy(F.xxhash64(key), key).limit(SAMPLE).toPandas()["vector"]
    x = np.stack(sample.to_numpy()) if len(sample) else np.zeros((0, max(dim, 1)))
    x = _unit(x) if metric == "cosine" else x
    cells = max(1, min(CELLS, n // CELL_ROWS, len(x) // 8))
    centres = _centres(x, cells, metric) if len(x) else np.zeros((1, max(dim, 1)))
    margin = _margin(x, centres, metric, k, cover)

    def place(frames):
        for frame in frames:
            cell = np.array([cells if len(r) == dim else cells + 1 + len(r) for r in frame["vector"]], np.int64)
            main = np.flatnonzero([len(r) == dim and bool(np.any(r)) for r in frame["vector"]])
            if len(main):
                m = np.stack(frame["vector"].to_numpy()[main])
                cell[main] = _home(_unit(m) if metric == "cosine" else m, centres)
            frame["cell"] = cell
            yield frame

    kind = nodes.schema[key].dataType.simpleString()
    placed = rows.mapInPandas(place, f"{key} {kind}, vector array<double>, cell long")
    placed.repartition("cell", F.pmod(F.xxhash64(key), F.lit(16))).write.mode("overwrite").partitionBy("cell").parquet(path)
    counts = spark.read.schema("cell long").parquet(path).groupBy("cell").count().collect() if n else []  # a row a cell
    return Index(path, key, kind, metric, centres, margin, {int(r.cell): r["count"] for r in counts})


def search(index: Index, queries: DataFrame, k: int = 10, vector: str = "embedding", query_key: str = "query_id") -> DataFrame:
    """query_key, key, score, rank of the k best found, ties to the smaller key. As many rows as there are vectors of the query's
    size, up to k. Queries are any number: they move once for each cell they ask, and meet it in blocks of bounded size."""
    spark, key, cells, dim = queries.sparkSession, index.key, len(index.centres), index.centres.shape[1]
    held = np.array([index.sizes.get(c, 0) for c in range(cells)])
    centres, margin, metric, lengthless, others = index.centres, index.margin, index.metric, index.sizes.get(cells, 0), {c for c in index.sizes if c > cells}
    asks_as = queries.schema[query_key].dataType.simpleString()

    def route(frames):
        for frame in frames:
            asks = []
            for q in frame["q"]:
                q = np.asarray(q, np.float64)
                if len(q) != dim:
                    asks.append([cells + 1 + len(q)] if cells + 1 + len(q) in others else [])
                    continue
                s = np.nan_to_num(_scores(metric, q[None], centres)[0], nan=0.0)
                order = np.lexsort((np.arange(cells), -s))
                order = order[held[order] > 0]
                first = int((s[order] >= s.max() - margin).sum())
                enough = int(np.searchsorted(np.cumsum(held[order]), k)) + 1
                found = order[: max(first, enough)].tolist()
                short = lengthless > 0 and held[order[: max(first, enough)]].sum() < k
                asks.append([*found, cells] if short else found)
            frame["cells"] = asks
            yield frame

    asked = queries.select(query_key, F.col(vector).cast("array<double>").alias("q")).where(F.col("q").isNotNull() & F.col(query_key).isNotNull())
    asked = asked.mapInPandas(route, f"{query_key} {asks_as}, q array<double>, cells array<long>").select(query_key, "q", F.explode("cells").alias("cell"))
    asked = stored(asked)
    many = asked.groupBy("cell").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("_turns")).join(spark.createDataFrame([(c, -(-n // BLOCK)) for c, n in index.sizes.items()], "cell long, _blocks int"), "cell")
    many = F.broadcast(stored(many))  # a row a cell
    deal = lambda c, n, seed: F.pmod(F.xxhash64(F.col(c), F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.rows(spark).join(many, "cell").select(key, "vector", "cell", deal(key, "_blocks", 1).alias("_block"), each("_turns").alias("_turn"))
    right = asked.join(many, "cell").select(query_key, "q", "cell", each("_blocks").alias("_block"), deal(query_key, "_turns", 2).alias("_turn"))
    group = ["cell", "_block", "_turn"]

    def best(rows: pd.DataFrame, by: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {query_key: [], key: [], "score": []}
        if len(rows) and len(by):
            x, ids = np.stack(rows["vector"].to_numpy()), rows[key].to_numpy()
            for name, (top, s) in zip(by[query_key], vectors.best_of(x, ids, np.stack(by["q"].to_numpy()).astype(np.float64), k, metric)):
                out[query_key] += [name] * len(top)
                out[key] += ids[top].tolist()
                out["score"] += [None if np.isnan(z) else float(z) for z in s]
        return pd.DataFrame(out)

    near = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(best, f"{query_key} {asks_as}, {key} {index.kind}, score double")
    place = F.row_number().over(Window.partitionBy(query_key).orderBy(F.col("score").desc_nulls_last(), key))
    return near.withColumn("rank", place).where(F.col("rank") <= k)
