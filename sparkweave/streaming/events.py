"""Structured Streaming forms over event tables.  Every row-local verb runs on a stream as
it is; these are additions for event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watermarked(events: DataFrame, time: str, late: str) -> DataFrame:
    """Event time must be a timestamp with zone; the session's is UTC."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str, late: str = "10 minutes", time: str = "ts", keys=("event_type",), value: str = "value") -> DataFrame:
    """Counts and sums by event-time windows; state older than the watermark is dropped."""
    rows = watermarked(events, time, late)
    return (
        rows.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")
    )


def sliding(events: DataFrame, width: str, step: str, late: str = "10 minutes", time: str = "ts", keys=("event_type",), value: str = "value") -> DataFrame:
    rows = watermarked(events, time, late)
    return (
        rows.groupBy(F.window(time, width, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("window_start"), *keys, "n", "total")
    )


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", time: str = "ts", key: str = "user_id") -> DataFrame:
    rows = watermarked(events, time, late)
    return rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
