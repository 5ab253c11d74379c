"""Sinks (K01-K08): partitioned tables; a rerun replaces only the partitions it holds."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry.sources import readers


def write_table(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """K01-K03, K05, K06."""
    writer = df.write.mode(mode)
    if by:
        writer = writer.partitionBy(by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def commit(df: DataFrame, path: str, number: int) -> None:
    """Rows as one numbered commit of a table. A commit that is written again replaces itself, so a job that was killed can
    be run again; what was there before is never touched."""
    df.withColumn("commit", F.lit(number).cast("long")).write.mode("overwrite").partitionBy("commit").option("partitionOverwriteMode", "dynamic").parquet(path)


def latest(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The rows of a table of commits, the last commit's where several have a key; None if there is no commit yet."""
    if not readers.exists(spark, f"{path}/commit=*"):
        return None
    rows = spark.read.parquet(path)
    last = rows.groupBy(key).agg(F.max("commit").alias("commit"))
    return rows.join(last, [key, "commit"], "left_semi").drop("commit")


def next_commit(spark: SparkSession, path: str) -> int:
    """One more than the last commit's number; partitions' names alone are read."""
    if not readers.exists(spark, f"{path}/commit=*"):
        return 0
    return int(spark.read.parquet(path).agg(F.max("commit")).first()[0]) + 1


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_metrics(means: DataFrame, path: str, run: str) -> None:
    """Metric, value of a run."""
    write_table(means.withColumn("run", F.lit(run)), path, by="run")


def write_timed(df: DataFrame, path: str, step: str, log: str, by: str | None = None) -> None:
    """Write a table and add step, rows and seconds to a log table; rows are counted on the way."""
    seen, began = Observation(step), time.time()
    write_table(df.observe(seen, F.count(F.lit(1)).alias("rows")), path, by)
    row = [(step, int(seen.get["rows"]), round(time.time() - began, 3))]
    write_table(df.sparkSession.createDataFrame(row, "step string, rows long, seconds double"), log, mode="append")
