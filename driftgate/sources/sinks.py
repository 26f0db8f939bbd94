"""Where answers and protocol logs go."""

from __future__ import annotations

from pyspark.sql import DataFrame

from driftgate.plans.gate import MonitorResult


def write_estimates(estimates: DataFrame, path: str, fmt: str = "csv") -> None:
    """Replace ``path`` by the published answers, ``timestamp,estimate`` in time order.

    One row per round, so one file is enough.
    """
    rows = estimates.orderBy("round").select("ts", "estimate").coalesce(1)
    rows.write.mode("overwrite").format(fmt).save(path)


def write_logs(result: MonitorResult, folder: str, fmt: str = "parquet") -> None:
    """Append the three metric logs of a run below ``folder``."""
    logs = {
        "throughput": result.throughput.select("realTS", "eventTS", "nodeID", "events"),
        "site": result.site_log,
        "centre": result.centre_log,
    }
    for name, log in logs.items():
        log.write.mode("append").format(fmt).save(f"{folder}/{name}")
