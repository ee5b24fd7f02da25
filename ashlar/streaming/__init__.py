"""Micro-batch forms of continuous loads and windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema, glob: str | None = None, most_files: int = 64) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling window; on a stream, rows later than ``late`` are let go."""
    if events.isStreaming:
        # watermarks need a time with a zone
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = events.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def append_batches(stream: DataFrame, path: str, checkpoint: str, trigger_once: bool = True):
    """The bulk incremental insert: every batch is appended whole; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if trigger_once else q).start()


def scheduled(spark: SparkSession, action: Callable[[SparkSession, int], None], seconds: float, checkpoint: str):
    """A scheduled event: ``action(spark, number)`` runs every so many seconds until the query is stopped; after a restart its numbers go on."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    q = ticks.writeStream.foreachBatch(lambda batch, number: action(batch.sparkSession, number)).option("checkpointLocation", checkpoint)
    return q.trigger(processingTime=f"{seconds} seconds").start()
