"""Streams: interface events and commit activity with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "type string, payload string, ts timestamp"


def parse_events(lines: DataFrame) -> DataFrame:
    """Stream of JSON lines in `value` -> (type, payload, ts); malformed lines and those without a type are dropped."""
    e = F.from_json("value", EVENT, {"mode": "PERMISSIVE"})
    return lines.select(e.alias("e")).where(F.col("e.type").isNotNull()).select("e.*")


def windowed_activity(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, events, value) in tumbling windows; rows later than the watermark are dropped."""
    stream = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = stream.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, events): runs of a user's events with no gap as long as `gap`."""
    stream = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = stream.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")
