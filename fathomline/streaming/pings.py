"""Structured Streaming over pings and detections as they arrive. An extension: the batch operators do not need it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, time_col: str = "ts", kind_col: str = "event_type", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """``start, end, kind, n, mean`` of each time window; events later than ``late`` are dropped with their windows' state."""
    windowed = events.withColumn("_at", F.col(time_col).cast("timestamp")).withWatermark("_at", late).groupBy(F.window("_at", width).alias("w"), F.col(kind_col).alias("kind"))
    return windowed.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select("w.start", "w.end", "kind", "n", "mean")


def sessions(events: DataFrame, key: str = "user_id", time_col: str = "ts", gap: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """``key, start, end, n`` of runs of events of one key that are never more than ``gap`` apart."""
    runs = events.withColumn("_at", F.col(time_col).cast("timestamp")).withWatermark("_at", late).groupBy(key, F.session_window("_at", gap).alias("w"))
    return runs.agg(F.count(F.lit(1)).alias("n")).select(key, "w.start", "w.end", "n")
