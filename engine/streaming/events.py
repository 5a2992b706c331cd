"""Windows over events, the same for a batch and for a stream; on a stream a watermark bounds the state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(events: DataFrame, time: str, delay: str) -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay) if events.isStreaming else events


def tumbling(events: DataFrame, time: str = "ts", length: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """start, event_type, n, total of each window and type."""
    w = F.window(time, length)
    return _late(events, time, delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, time: str = "ts", gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """user_id, start, n of each session: events less than the gap apart."""
    w = F.session_window(time, gap)
    return _late(events, time, delay).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def distinct_events(events: DataFrame, keys: list[str], time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each key once; on a stream, once within the delay."""
    return _late(events, time, delay).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
