"""From raw documents to packed sequences: language ID, line dedup, near duplicates, mixing to weights, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry import ship
from quarry.llm import langid, line_dedup, mixing, ngram_join, packing
from quarry.llm.common import shared_dir, table

#: Documents without a letter, or whose language is less sure than this, are rejected.
MIN_LANG_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language, unchanged. Null text and text without a letter go; equal rows fare alike; null ids stay."""
    ship(spark)
    return langid.identify(docs, accept=MIN_LANG_SCORE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occurred before; those left without a word, or with a remnant only (what is left of a
    near copy), go. Null text stays; rows equal in id and text are one document; null ids come first."""
    return line_dedup.dedup(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the least id, then the least md5 of the text. Rows equal in both are
    one document; rows without id or without a word are in no group and stay. Groups are those of the texts as they are, and
    those of the texts as they came, before lines were taken out of them, if sf_dir has them."""
    ship(spark)
    return ngram_join.one_of_each(docs, before=as_they_came(spark, sf_dir))


def as_they_came(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """doc_id, text of the table documents, None if the folder has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last time of a few cut to the words left. Null text is never taken; a
    null source is a source; equal rows are taken together."""
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins: doc_id, piece, n_tokens, bin, position, capacity. Empty text is a piece without bin; equal
    rows are packed separately."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Trained networks and greedy packing are beyond SQL; tests/llm hold the pipeline against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again, so none is computed twice."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
