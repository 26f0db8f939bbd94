"""Synthetic event tables: random site and key, time advancing by random ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftgate.functions.keys import PRIME, SketchShape
from driftgate.operators.ordering import running_sum

BLOCK = 1 << 20


def _draw_coefficients(which: int, seed: int) -> tuple[int, ...]:
    return SketchShape(depth=which + 1, width=1, seed=seed).coefficients()[which]


def _draw(row: Column, which: int, n: int, seed: int) -> Column:
    """Number in [0, n) fixed by the row id alone, so a retried task repeats it."""
    coeff = _draw_coefficients(which, seed)
    acc = F.lit(coeff[0]).cast("bigint")
    for c in coeff[1:4]:
        acc = (acc * (row % PRIME) + F.lit(c).cast("bigint")) % F.lit(PRIME).cast("bigint")
    return acc % F.lit(n).cast("bigint")


def synthetic_events(
    ids: DataFrame,
    start_ms: int = 0,
    records: int | None = None,
    records_per_sec: int = 10,
    key_range: int = 100,
    gap: int = 5,
    sites: int = 10,
    seed: int = 512,
    block: int = BLOCK,
) -> DataFrame:
    """One event per row of ``ids (id)`` with ids 0, 1, 2, ...; a run of limited length ends after ``records`` ticks."""
    row = F.col("id").cast("bigint")
    drawn = ids.select(
        row.alias("id"),
        _draw(row, 0, sites, seed).alias("site"),
        _draw(row, 1, key_range, seed).alias("a"),
        (_draw(row, 2, gap, seed) + 1).alias("step"),
        F.expr(f"id div {block}").alias("seg"),
    )
    timed = running_sum(drawn, F.col("step"), "reached", order="id").withColumn("tick", F.col("reached") - F.col("step"))
    tick_ms = 1000 // records_per_sec
    timed = timed if records is None else timed.filter(F.col("tick") <= records)
    return timed.select(
        "id",
        "site",
        (F.lit(start_ms).cast("bigint") + F.col("tick") * tick_ms).alias("ts_ms"),
        "a",
        F.lit(1).cast("bigint").alias("b"),
        F.lit(1.0).alias("val"),
    )


def generate(spark: SparkSession, rows: int, **options) -> DataFrame:
    return synthetic_events(spark.range(rows), **options)


def stream(spark: SparkSession, records_per_sec: int = 10, key_range: int = 100, sites: int = 10, seed: int = 512):
    """Endless variant on the rate source; times are those of the source."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", records_per_sec).load()
    row = F.col("value")
    return rate.select(
        _draw(row, 0, sites, seed).alias("site"),
        F.col("timestamp").alias("ts"),
        F.unix_millis("timestamp").alias("ts_ms"),
        _draw(row, 1, key_range, seed).alias("a"),
        F.lit(1).cast("bigint").alias("b"),
        F.lit(1.0).alias("val"),
    )
