"""Structured Streaming over the events table, run until its input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.events import available_now, event_stream, interval_join, late_tolerant_counts, running_tops
from .registry import query


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_tumbling_window(t):
    counts = late_tolerant_counts(event_stream(t), "1 hour", "2 hours")
    rows = available_now(counts, "complete")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1")
def batch_tumbling_window(t):
    return t.events.groupBy(F.window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


@query(
    "SELECT b.start, event_type, count(*) AS n FROM events, LATERAL (SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS start FROM range(2) r(k)) b GROUP BY 1, 2"
)
def stream_sliding_window(t):
    counts = late_tolerant_counts(event_stream(t), "2 hours", "2 hours", "1 hour")
    rows = available_now(counts, "complete")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), "
    "s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g) "
    "SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n FROM s GROUP BY user_id, k"
)
def batch_session_window(t):
    sessions = t.events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return sessions.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("began"), F.col("w.end").cast("timestamp_ntz").alias("ended"), "n")


@query(
    "SELECT e.event_id AS error, p.event_id AS purchase FROM events e JOIN events p ON e.user_id = p.user_id AND p.ts BETWEEN e.ts AND e.ts + INTERVAL 12 HOUR "
    "WHERE e.event_type = 'error' AND p.event_type = 'purchase'"
)
def stream_interval_join(t):
    kind = lambda name, to: event_stream(t).filter(F.col("event_type") == name).select("user_id", F.col("ts").alias(f"{to}_ts"), F.col("event_id").alias(to))
    joined = interval_join(kind("error", "error"), kind("purchase", "purchase"), "user_id", "error_ts", "purchase_ts", "12 hours")
    return available_now(joined.select("error", "purchase"))


@query("SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY user_id")
def stream_arbitrary_state(t):
    rows = available_now(running_tops(event_stream(t)), "update")
    # an update for each batch that brought events of the user: the last has the largest count
    return rows.groupBy("user_id").agg(F.max("n").alias("n"), F.max("top").alias("top"))
