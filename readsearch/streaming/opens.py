"""Live use counts from a stream of opens (this library's own addition)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def open_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, entry_id, opens) of a stream (or table) of events (ts, user_id), late ones dropped."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    rows = seen.groupBy(F.window("ts", window).alias("w"), F.col("user_id").alias("entry_id")).agg(F.count("*").alias("opens"))
    return rows.select(F.col("w.start").alias("window_start"), "entry_id", "opens")
