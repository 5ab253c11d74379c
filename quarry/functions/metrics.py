"""Scores of explanations. A01-A06, A14, A15 and ROUGE-N are Column expressions, BLEU of a table is an aggregation of counts; ROUGE-L and METEOR are Arrow UDFs."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quarry import ship

from . import dsl, text


def f1(tp: Column, fp: Column, fn: Column, digits: int = 4) -> Column:
    """Struct of precision, recall and f1; zero where a denominator is."""
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = share(tp, tp + fp), share(tp, tp + fn)
    return F.struct(F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(share(2 * p * r, p + r), digits).alias("f1"))


def _counts(values: Column) -> Column:
    return F.transform(F.array_distinct(values), lambda v: F.struct(v.alias("v"), F.size(F.filter(values, lambda x: x == v)).alias("n")))


def multiset_f1(truth: Column, found: Column) -> Column:
    """A01 of one row: overlap of two arrays as multisets."""
    at = lambda values, v: F.size(F.filter(values, lambda x: x == v))
    tp = F.aggregate(_counts(truth), F.lit(0), lambda s, c: s + F.least(c["n"], at(found, c["v"])))
    return f1(tp, F.size(found) - tp, F.size(truth) - tp)


def edge_f1(truth: Column, found: Column) -> Column:
    """Of the edge sets of two graphs (arrays of dsl.edges, each once)."""
    tp = F.size(F.array_intersect(truth, found))
    return f1(tp, F.size(found) - tp, F.size(truth) - tp)


def validity(explain: Column, vocabulary: Column) -> Column:
    """Share of primitives, repeats included, in a vocabulary; 0 if there is none."""
    found = dsl.primitives(explain)
    return F.coalesce(F.try_divide(F.size(F.filter(found, lambda x: F.array_contains(vocabulary, x))), F.size(found)), F.lit(0.0))


def id_coherence(explain: Column, dag: Column) -> Column:
    """After the first line, as many ids as lines, and no other id in the graph."""
    lines = F.split(dsl.strip(explain), "\n")
    rest = F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))
    ids = dsl.defined_ids(F.array_join(rest, "\n"))
    good = (F.size(rest) > 0) & (F.size(ids) == F.size(rest)) & (F.size(F.array_except(dsl.used_ids(dag), ids)) == 0)
    return F.coalesce(good, F.lit(False)).cast("int")


def schema_validity(reply: Column) -> Column:
    """A06."""
    return F.coalesce(F.reduce(F.array(*(reply.rlike(f"(?s)<{t}>.*?</{t}>") for t in dsl.SECTIONS)), F.lit(True), lambda a, b: a & b), F.lit(False)).cast("int")


def correctness(reply: Column) -> Column:
    """1 if the judge's answer is yes; null without an answer."""
    return F.when(F.lower(dsl.judge_answer(reply)) == "yes", 1.0).when(dsl.judge_answer(reply).isNotNull(), 0.0)


def acyclic(edges: Column) -> Column:
    """1 unless a graph (an array of dsl.edges) has a cycle; no edges count as none. Edges whose source no edge
    enters, or whose target no edge leaves, are peeled off; what stays when nothing more can go holds a cycle."""

    def peel(s: Column) -> Column:
        targets, sources = F.transform(s, lambda e: e["tgt"]), F.transform(s, lambda e: e["src"])
        both = F.array_intersect(targets, sources)  # nodes inside
        return F.filter(s, lambda e: F.array_contains(both, e["src"]) & F.array_contains(both, e["tgt"]))

    rest = F.aggregate(F.sequence(F.lit(0), F.size(edges)), edges, lambda s, _: F.when(F.size(s) > 0, peel(s)).otherwise(s))
    return (F.size(rest) == 0).cast("int")


def tokens(words: Column) -> Column:
    """Runs of a-z and 0-9 in lower case, as ROUGE splits words."""
    return F.coalesce(F.regexp_extract_all(F.lower(words), F.lit("([a-z0-9]+)"), F.lit(1)), F.array().cast("array<string>"))


def rouge_n(truth: Column, found: Column, n: int = 1) -> Column:
    """ROUGE-N F without stemming: multiset overlap of n-grams of tokens, in the JVM."""

    def grams(t: Column) -> Column:
        last = F.size(t) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    both = F.struct(grams(tokens(truth)).alias("a"), grams(tokens(found)).alias("b"))

    def score(x: Column) -> Column:
        at = lambda values, v: F.size(F.filter(values, lambda y: y == v))
        hits = F.aggregate(_counts(x["a"]), F.lit(0), lambda s, c: s + F.least(c["n"], at(x["b"], c["v"])))
        return F.coalesce(F.try_divide(2.0 * hits, F.size(x["a"]) + F.size(x["b"])), F.lit(0.0))

    return F.get(F.transform(F.array(both), score), F.lit(0))


@F.pandas_udf(DoubleType())
def _rouge_l(truth: pd.Series, found: pd.Series) -> pd.Series:
    return pd.Series([2 * n / (len(a) + len(b)) if (n := text.lcs(list(a), list(b))) else 0.0 for a, b in zip(truth, found)])


def rouge_l(truth: Column, found: Column) -> Column:
    """ROUGE-L F without stemming."""
    return _rouge_l(tokens(truth), tokens(found))


@F.pandas_udf(DoubleType())
def _bleu(truth: pd.Series, found: pd.Series) -> pd.Series:
    return pd.Series([text.corpus_bleu([b or ""], [a or ""]) for a, b in zip(truth, found)])


# The marks that the 13a tokenizer parts from words, by code points, and its rules for points, commas and hyphens, in order.
MARKS = r"([\x7B-\x7E\x5B-\x60\x20-\x26\x28-\x2B\x3A-\x40\x2F])"
RULES = ((MARKS, " $1 "), (r"([^0-9])([.,])", "$1 $2 "), (r"([.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "))
ENTITIES = (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def tokens_13a(column: Column) -> Column:
    """Words and marks as the 13a tokenizer parts them; null counts as empty."""
    out = F.coalesce(column, F.lit(""))
    for old, new in ENTITIES:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for rule, to in RULES:
        out = F.regexp_replace(out, rule, to)
    return F.filter(F.split(out, r"(?U)\s+"), lambda x: x != "")


def lines_13a(column: Column) -> Column:
    """The tokens, a line each; none holds white space."""
    return F.array_join(tokens_13a(column), "\n")


def _numbered(truth: str, found: str) -> list[np.ndarray]:
    """The tokens of both texts, a line each, by numbers: equal ones have one."""
    sides = [x.split("\n") if x else [] for x in (truth, found)]
    codes = pd.factorize(np.array([*sides[0], *sides[1]], object))[0].astype(np.int64)
    return [codes[: len(sides[0])], codes[len(sides[0]) :]]


def _overlap(truth: str, found: str, most: int) -> list[int]:
    """Tokens of either text, then for each n the n-grams of `found` that `truth` has too (as multisets), and all of `found`. An n-gram is
    the number of its first n - 1 tokens with that of its last, numbered anew, so different ones never share a number."""
    words = _numbered(truth, found)
    out, grams, kinds = [len(words[0]), len(words[1])], words, max((int(w.max()) for w in words if len(w)), default=0) + 1
    for n in range(1, most + 1):
        if n > 1:
            grams = [g[:-1] * kinds + w[n - 1 :] for g, w in zip(grams, words)]
        size = len(grams[0])
        both = pd.factorize(np.concatenate(grams))[0]
        grams = [both[:size], both[size:]]
        many = int(both.max()) + 1 if len(both) else 0
        out += [int(np.minimum(np.bincount(grams[0], minlength=many), np.bincount(grams[1], minlength=many)).sum()), len(grams[1])]
    return out


def bleu_table(rows: DataFrame, key: list[str], truth: str, found: str, most: int = 4) -> DataFrame:
    """Key, bleu of the rows of each key together (a row a part): counts summed over them, effective order, exponential smoothing,
    from 0 to 1. Null texts count as empty; without common words it is 0."""
    return bleu_of_lines(rows.select(*key, lines_13a(F.col(truth)).alias("_a"), lines_13a(F.col(found)).alias("_b")), key, "_a", "_b", most)


def bleu_of_lines(rows: DataFrame, key: list[str], truth: str, found: str, most: int = 4) -> DataFrame:
    """As bleu_table(), of texts as lines_13a() gives them: a text that is in many rows need be parted but once. N-grams are counted where
    the two texts of a row are, and only counts are shuffled."""
    ship(rows.sparkSession)
    names = ["_other", "_own", *(f"{c}{n}" for n in range(1, most + 1) for c in ("hits", "total"))]

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def counted(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_overlap(x, y, most) for x, y in zip(a, b)], columns=names, dtype=np.int64)

    both = rows.select(*key, counted(F.col(truth), F.col(found)).alias("_c")).groupBy(*key).agg(*(F.sum(f"_c.{n}").alias(n) for n in names))
    logs, orders, misses, hits = F.lit(0.0), F.lit(0), F.lit(0), F.lit(0)
    for n in range(1, most + 1):
        h, t = F.col(f"hits{n}"), F.col(f"total{n}")
        misses = misses + F.when((t > 0) & (h == 0), 1).otherwise(0)
        logs = logs + F.when(t == 0, 0.0).when(h > 0, F.ln(h / t)).otherwise(F.ln(1 / (F.pow(F.lit(2.0), misses) * t)))
        orders, hits = orders + F.when(t > 0, 1).otherwise(0), hits + h
    brief = F.when(F.col("_own") >= F.col("_other"), 1.0).otherwise(F.exp(1 - F.col("_other") / F.col("_own")))
    return both.select(*key, F.when(hits == 0, 0.0).otherwise(brief * F.exp(logs / orders)).alias("bleu"))


def sentence_bleu(truth: Column, found: Column) -> Column:
    """BLEU of one pair on 13a tokens, with effective order and exponential smoothing, from 0 to 1."""
    return _bleu(truth, found)


TOKEN_SCORES = ", ".join(f"{n}_{kind} double" for kind in ("micro", "macro") for n in text.NAMES)


def token_accuracy(truth: Column, found: Column, kind: str) -> Column:
    """A struct of ten scores: BLEU, stemmed ROUGE and METEOR of the joined parts, and their means over parts. Null counts as empty."""

    @F.pandas_udf(TOKEN_SCORES)
    def score(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text.scores(x or "", y or "", kind) for x, y in zip(a, b)], columns=[n.split()[0] for n in TOKEN_SCORES.split(", ")])

    return score(truth, found)


def token_scores(df, key: str, truth: str, found: str, kind: str):
    """A08 as columns beside the key."""
    return df.select(key, token_accuracy(F.col(truth), F.col(found), kind).alias("_s")).select(key, "_s.*")


def means(df, skip: tuple[str, ...] = ()):
    """Metric, value: the mean of each numeric column, nested ones as metric/key, rounded to 4 digits."""
    columns: dict[str, Column] = {}
    for field in df.schema:
        if field.name in skip:
            continue
        if field.dataType.typeName() == "struct":
            columns |= {f"{field.name}/{k}": F.col(f"`{field.name}`.`{k}`") for k in field.dataType.names}
        elif field.dataType.typeName() in ("integer", "long", "double", "float", "short"):
            columns[field.name] = F.col(f"`{field.name}`")
    wide = df.agg(*(F.round(F.avg(c.cast("double")), 4).alias(n) for n, c in columns.items()))
    return wide.unpivot([], [F.col(f"`{n}`") for n in columns], "metric", "value")
