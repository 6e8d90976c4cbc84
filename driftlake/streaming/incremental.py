"""Incremental labelling: each run takes the genomes that came since, once.

A file stream with a checkpoint replaces the resume list; each micro-batch is
written under its own number, so a batch that is run again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_available(spark: SparkSession, source: str, schema: str, label: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_each: int = 25) -> None:
    """Labels the rows of all new Parquet files under `source`, some files a batch, into out/batch=N."""

    def write(batch: DataFrame, number: int) -> None:
        label(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def finished(spark: SparkSession, out: str, key: str) -> DataFrame:
    """Keys that are labelled, with or without rows of their own elsewhere."""
    return spark.read.parquet(out).select(key).distinct()


def event_rates(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, event_type, n: events by time window, over a stream or a table; later ones than the watermark are left out of a stream."""
    watched = events.withWatermark("ts", late) if events.isStreaming else events
    return watched.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
