"""Streams over the events table, as batches of the same plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.plans.tables import table
from codestrata.streaming.events import sessions, windowed_activity


def stream_daily_activity(spark, sf_dir):
    return windowed_activity(table(spark, sf_dir, "events")).select(F.unix_micros("window_start").alias("start_us"), "event_type", "events", "value")


def stream_sessions(spark, sf_dir):
    return sessions(table(spark, sf_dir, "events")).select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


QUERIES = {f.__name__: f for f in (stream_daily_activity, stream_sessions)}
SQL = {
    "stream_daily_activity": "SELECT epoch_us(date_trunc('day', ts)::TIMESTAMP) AS start_us, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "stream_sessions": """WITH g AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events),
s AS (SELECT *, sum(CASE WHEN d IS NULL OR d >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS k FROM g)
SELECT user_id, min(t) AS start_us, max(t) + 1800000000 AS end_us, count(*) AS events FROM s GROUP BY user_id, k""",
}
