"""Event-time progress: ascending and bounded-out-of-orderness watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_lag(events: DataFrame, lag: str = "0 seconds") -> DataFrame:
    """Time is complete up to the latest event minus ``lag``; no lag means ascending timestamps."""
    return events.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", lag)


def closed_windows(events: DataFrame, size: str, lag: str = "0 seconds") -> DataFrame:
    """Records per site and tumbling window, emitted once the watermark has passed the window."""
    counted = with_lag(events, lag).groupBy("site", F.window("ts", size)).agg(F.count(F.lit(1)).alias("records"))
    return counted.select("site", F.unix_millis(F.col("window.start")).alias("window_start_ms"), "records")
