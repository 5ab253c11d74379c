"""An extension: the resume logic as Structured Streaming, and event windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import sinks


def process_new(spark: SparkSession, source: str, schema: str, work, target: str, checkpoint: str) -> None:
    """Run work(DataFrame) on the files that came since the last call; the checkpoint makes it exactly once."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = work(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def commit_new(spark: SparkSession, source: str, schema: str, work, target: str, checkpoint: str) -> None:
    """As process_new, for any work on a batch and any file system: each batch is the commit of its number (sinks.commit), so a batch that
    runs again after a failure replaces what it had written, and sinks.latest gives each key once."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(lambda rows, number: sinks.commit(work(rows), target, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Count and sum by window and type, for streams and tables; ts may be without zone."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return timed.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
