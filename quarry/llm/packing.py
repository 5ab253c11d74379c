"""Variable-capacity best-fit packing.

A document longer than the largest permitted length is cut into pieces of that length and a rest. Pieces are dealt into
shards of bounded size; each shard packs its pieces in decreasing order. A piece goes to the open bin that it leaves least
room in. If it fits none, all permitted lengths that hold it compete for the new bin: each is expected to be filled by the
smaller pieces still to come that fit beside the first one, then shrunk to the shortest length that holds them; the length
of the least cost a token opens. A longer sequence spares overhead and costs more attention, so it wins where there is
enough to fill it. At the end every bin shrinks to the shortest permitted length that holds its contents.

Defined results: null or empty text is one piece of 0 tokens with null bin; equal rows are packed separately; null ids
are allowed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words, saved

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Pieces that one task packs together.
SHARD_PIECES = 50_000
#: Cost of a sequence of n tokens: OVERHEAD + n * (1 + n / ATTENTION); a token costs least at sqrt(OVERHEAD * ATTENTION) tokens.
OVERHEAD, ATTENTION = 96.0, 16384.0


def cost(length: int) -> float:
    return OVERHEAD + length * (1 + length / ATTENTION)


def best_fit(sizes: list[int], lengths=LENGTHS) -> tuple[list[int], list[int], list[int], list[int]]:
    """For pieces in decreasing order: the bin of each, its offset there; the final and the opened capacity of each bin."""
    lengths = sorted(lengths)
    price = {c: cost(c) for c in lengths}
    room: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]  # open bins by the room they have
    mask = 0  # bit r: some bin has room r
    used: list[int] = []
    cap: list[int] = []
    bins, offsets = [], []
    tail = np.concatenate([[0], np.cumsum(sizes[::-1])]).tolist()  # tokens of the last k pieces
    rising = sizes[::-1]
    for at, n in enumerate(sizes):
        fit = mask >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            to_come = len(sizes) - at - 1
            best = None
            for c in lengths:
                if c >= n:
                    full = n + min(c - n, tail[min(to_come, bisect_left(rising, c - n + 1))])
                    ends = next(x for x in lengths if x >= full)
                    if best is None or price[ends] / full < best[0] - 1e-12:
                        best = price[ends] / full, c
            b, r = len(cap), best[1]
            cap.append(r)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if r - n:
            room[r - n].append(b)
            mask |= 1 << (r - n)
    return bins, offsets, [next(c for c in lengths if c >= u) for u in used], cap


def pack(docs: DataFrame, lengths=LENGTHS, tokens: str | None = None) -> DataFrame:
    """doc_id, piece, n_tokens, bin, position, capacity: one row per piece. tokens: a column of counts, or words of text.

    Rows equal in id and content are one entry with a number until they are dealt, each copy then to a shard of its own
    hash, so neither null nor repeated ids gather in one shard.
    """
    most = max(lengths)
    count = F.col(tokens).cast("long") if tokens else n_words(F.col("text"))
    content = F.lit(0).cast("long") if tokens else F.xxhash64("text")
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)).alias("n"), content.alias("content"))
    sizes = sizes.groupBy("doc_id", "n", "content").agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / most) - 1)
    pieces = sizes.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    pieces = saved(pieces.select("doc_id", "piece", F.least(F.lit(most), F.col("n") - F.col("piece") * most).alias("n_tokens"), F.xxhash64("doc_id", "piece", "content", "copy").alias("deal")))
    shards = max(1, -(-pieces.count() // SHARD_PIECES))
    lengths = tuple(sorted(lengths))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "doc_id", "piece", "deal"], ascending=[False, True, True, True], kind="stable")
        bins, offsets, caps, _ = best_fit(group["n_tokens"].tolist(), lengths)
        base = int(group["shard"].iloc[0]) << 32 if len(group) else 0
        return pd.DataFrame({"doc_id": group["doc_id"], "piece": group["piece"], "n_tokens": group["n_tokens"], "bin": [base + b for b in bins], "position": offsets, "capacity": [caps[b] for b in bins]}).astype({"doc_id": "Int64"})

    dealt = pieces.where("n_tokens > 0").withColumn("shard", F.pmod("deal", F.lit(shards)))
    schema = "doc_id long, piece long, n_tokens long, bin long, position long, capacity long"
    empty = pieces.where("n_tokens = 0").select("doc_id", "piece", "n_tokens", *(F.lit(None).cast("long").alias(c) for c in ("bin", "position", "capacity")))
    return dealt.groupBy("shard").applyInPandas(one, schema).unionByName(empty)


def sequences(packed: DataFrame) -> DataFrame:
    """bin, capacity, used, pieces per opened bin."""
    return packed.where("bin is not null").groupBy("bin", "capacity").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"))
