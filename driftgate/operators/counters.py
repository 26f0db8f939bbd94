"""Counter growth inside one subround, as a batch job over a phi series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def counter_growth(
    series: DataFrame, z: float | Column, quantum: float, so_far: Column | None = None
) -> DataFrame:
    """Per site and slot the counter ``max(trunc((z - phi)/quantum))`` so far and its growth in the slot.

    ``z`` and ``so_far``, the counter the subround goes on from, may be columns of ``series`` that are equal within a site.
    """
    by_site = Window.partitionBy("site").orderBy("slot")
    least = F.lit(0).cast("bigint") if so_far is None else so_far
    start = z if isinstance(z, Column) else F.lit(z)
    reached = F.greatest(((start - F.col("phi")) / F.lit(quantum)).cast("bigint"), least)
    counted = series.withColumn("counter", F.max(reached).over(by_site.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.coalesce(F.lag("counter").over(by_site), least)
    return counted.select("site", "slot", "counter", (F.col("counter") - before).alias("gained"))


def subround_progress(growth: DataFrame, k: int) -> DataFrame:
    """Total growth C after every slot and whether the subround is over (C > k). One row per slot."""
    slots = growth.groupBy("slot").agg(F.sum("gained").alias("gained"))
    so_far = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    total = slots.select("slot", F.sum("gained").over(so_far).alias("total"))
    return total.withColumn("over", F.col("total") > k)
