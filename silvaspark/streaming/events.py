"""Structured streaming of acquisitions: events into the store as they come, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def acquisitions(events: DataFrame) -> DataFrame:
    """Events as acquisition rows ``id, acquisition_datetime, sensor_type, metrics``; works on streams and tables."""
    return events.select(F.col("event_id").alias("id"), F.col("ts").alias("acquisition_datetime"), F.col("event_type").alias("sensor_type"), F.col("props").alias("metrics"))


def counts(rows: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Acquisitions per window and sensor; on a stream, state older than the watermark is dropped."""
    marked = rows
    if rows.isStreaming:  # a watermark needs an instant, not a local time
        marked = rows.withColumn("acquisition_datetime", F.col("acquisition_datetime").cast("timestamp")).withWatermark("acquisition_datetime", late)
    grouped = marked.groupBy(F.window("acquisition_datetime", window).alias("w"), "sensor_type").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), "sensor_type", "n")


def ingest(spark: SparkSession, folder: str, schema, target: str, checkpoint: str):
    """Append files of ``folder`` to the store's table at ``target`` as they arrive; returns the running query."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return acquisitions(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
