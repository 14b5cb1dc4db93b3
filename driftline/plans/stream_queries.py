"""Queries that run a stream of finished files to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import live
from .series_queries import Query


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return rows.select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "value")


def stream_daily(spark, d):
    """Closed days of each event type: those that end an hour or more before the newest event."""
    out = live.drained(live.tumbling(_stream(spark, d), "1 day", "1 hour"), f"daily_{uuid.uuid4().hex}")
    return out.select("series_id", F.unix_micros("start").alias("start_us"), "max", "n")


def stream_sessions(spark, d):
    """Closed stretches without a gap of two hours."""
    out = live.drained(live.sessions(_stream(spark, d), "2 hours", "1 hour"), f"sessions_{uuid.uuid4().hex}")
    return out.select("series_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


STREAMS: dict[str, tuple[Query, str | None]] = {
    "stream_daily": (stream_daily, "SELECT event_type AS series_id, epoch_us(date_trunc('day', ts)) AS start_us, max(value) AS max, count(value) AS n FROM events WHERE date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL"),
    "stream_sessions": (stream_sessions, "WITH g AS (SELECT event_type AS series_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 7200000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY us) AS k FROM g), t AS (SELECT series_id, min(us) AS start_us, max(us) + 7200000000 AS end_us, count(*) AS n FROM s GROUP BY series_id, k) SELECT * FROM t WHERE end_us <= (SELECT epoch_us(max(ts)) - 3600000000 FROM events)"),
}
