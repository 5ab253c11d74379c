"""Passages for questions by BM25 over an inverted index, and answers from them by a provider.

Scores are sums of whole numbers, so they don't depend on the order of adding. Passages are dealt into shards of bounded postings
and questions into blocks of bounded terms; where a shard and a block meet, each question adds up the lists of its terms, and only
its k best passages leave the shard. Pairs of questions and passages are never rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import ship, stored
from quarry.operators import providers

K1, B = 1.2, 0.75
#: Postings of a shard and terms of a block of questions, on average.
SHARD, ASKED = 1_000_000, 200_000
TERM = r"[\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def postings(passages: DataFrame, asked: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """term, key, impact of the asked terms (term): inverse frequency in millionths times the saturated frequency, rounded down.

    Frequencies and lengths are of all passages that have a term; terms nobody asks for are dropped before anything is shuffled.
    """
    some = passages.where(F.col(key).isNotNull() & F.lower(text).rlike(TERM))
    words = some.select(key, terms(F.col(text)).alias("t")).select(key, "t", F.size("t").alias("n"))
    many, length = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = words.select(key, "n", F.explode("t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    held = stored(held.groupBy("term", key, "n").agg(F.count("*").alias("tf")))
    spread = held.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1e6) * F.ln(1 + (F.lit(many) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("n") / F.lit(length / max(1, many))))
    return held.join(spread.select("term", weight.alias("w")), "term").select("term", key, F.floor(F.col("w") * saturated).alias("impact"))


def best_passages(questions: DataFrame, passages: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", question: str = "question") -> DataFrame:
    """index, key, score, rank: the k best passages (key, text) of each question (index, question); equal scores by key.

    A term that a question repeats counts as often. Null and empty questions and passages have no terms and no rows.
    """
    asked = questions.select("index", F.explode(terms(F.col(question))).alias("term")).groupBy("index", "term").agg(F.count("*").alias("times"))
    asked = stored(asked)
    found = stored(postings(passages, asked, key, text))
    spark = found.sparkSession
    ship(spark)
    shards, blocks = (max(1, -(-rows.count() // most)) for rows, most in ((found, SHARD), (asked, ASKED)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = found.select(F.col(key).alias("key"), "term", "impact", deal(key, shards).alias("shard"), each(blocks).alias("block"))
    right = asked.select("index", "term", "times", each(shards).alias("shard"), deal("index", blocks).alias("block"))
    kinds = {c: df.schema[n].dataType.simpleString() for c, df, n in (("index", questions, "index"), ("key", passages, key))}
    near = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_best(k), f"index {kinds['index']}, key {kinds['key']}, score long")
    rank = F.row_number().over(Window.partitionBy("index").orderBy(F.col("score").desc(), "key"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("index", F.col("key").alias(key), "score", "rank")


def _best(k: int):
    """From the postings of a shard and the terms of some questions: the k best passages of each question there."""

    def best(postings: pa.Table, asked: pa.Table) -> pa.Table:
        terms_ = pc.unique(asked.column("term"))
        code = pc.index_in(postings.column("term"), value_set=terms_)
        postings = postings.append_column("code", code).filter(pc.is_valid(code))
        names = pc.unique(postings.column("key"))
        names = names.take(pc.sort_indices(names))  # ascending, so that equal scores go by place
        at = pc.index_in(postings.column("key"), value_set=names).to_numpy()
        code = postings.column("code").to_numpy()
        order = np.lexsort((at, code))
        at, code, impact = at[order], code[order], postings.column("impact").to_numpy()[order]
        edge = np.searchsorted(code, np.arange(len(terms_) + 1))
        asked = asked.append_column("code", pc.index_in(asked.column("term"), value_set=terms_)).sort_by("index")
        question = pc.index_in(asked.column("index"), value_set=(asks := pc.unique(asked.column("index")))).to_numpy()
        turns = np.searchsorted(question, np.arange(len(asks) + 1))
        term, times = asked.column("code").to_numpy(), asked.column("times").to_numpy()
        which, where, score = [], [], []
        for q, (i, j) in enumerate(zip(turns[:-1].tolist(), turns[1:].tolist())):
            total = np.zeros(len(names), np.int64)
            met = np.zeros(len(names), bool)
            for t, n in zip(term[i:j].tolist(), times[i:j].tolist()):
                own = slice(edge[t], edge[t + 1])
                np.add.at(total, at[own], n * impact[own])  # an id of several lengths stands there more than once
                met[at[own]] = True
            here = np.flatnonzero(met)
            if len(here) > k:
                least = np.partition(total[here], -k)[-k]
                here = here[total[here] >= least]
            here = here[np.lexsort((here, -total[here]))][:k]
            which.append(np.full(len(here), q))
            where.append(here)
            score.append(total[here])
        which, where, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (which, where, score))
        return pa.table({"index": asks.take(pa.array(which)), "key": names.take(pa.array(where)), "score": score})

    return best


def answers(questions: DataFrame, passages: DataFrame, make, k: int = 10, key: str = "doc_id", text: str = "text", replay: DataFrame | None = None) -> DataFrame:
    """Index, answer, error, passages (keys in order of rank): the provider is asked once for each question with its passages."""
    near = best_passages(questions, passages, k, key, text).join(passages.select(key, text), key)
    each = F.sort_array(F.collect_list(F.struct("rank", F.col(key).alias("_key"), F.col(text).alias("_text"))))  # k a question
    held = near.groupBy("index").agg(each.alias("r"))
    rows = questions.select("index", "question").join(held, "index", "left")
    context = F.coalesce(F.array_join(F.transform("r", lambda r: r["_text"]), "\n\n"), F.lit(""))
    prompt = F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), "question")
    told = providers.ask(rows.select("index", F.transform("r", lambda r: r["_key"]).alias("passages"), prompt.alias("prompt")), "prompt", make, replay, "answer")
    return told.select("index", "answer", F.col("answer_error").alias("error"), "passages")
