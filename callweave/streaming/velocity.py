"""Structured Streaming over append-only histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_velocity(events: DataFrame, window: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events and their value by type over sliding windows; works on a stream
    and on a batch alike. State is bounded by the watermark."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "event_type")
    return by.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return by.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write what is there now to Parquet, and end."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def watch_changes(spark: SparkSession, folder: str, schema, handle, checkpoint: str, once: bool = True):
    """Call handle(frame, batch id) for each micro-batch of change files; used
    for incremental updates and for watching health snapshots."""
    stream = spark.readStream.schema(schema).parquet(folder)
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()
    if once:
        query.awaitTermination()
    return query
