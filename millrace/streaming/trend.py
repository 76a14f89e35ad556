"""Streaming extensions; batch inputs need none of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_trend(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Count and sum of values per window and event type of a stream (or table) of events (ts, event_type, value); events later than ``late`` are dropped from a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_events(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Events without those whose ``keys`` came before within the watermark: exact dedup of a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.dropDuplicatesWithinWatermark(keys) if events.isStreaming else timed.dropDuplicates(keys)
