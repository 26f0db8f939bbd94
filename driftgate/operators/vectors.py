"""Exact frequency vectors in long form: one row per (group, key) with its weight ``v``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from driftgate.operators.joins import attach


def build(events: DataFrame, by: Sequence[str] = ("site",), key: str = "x", val: str = "val") -> DataFrame:
    """``v[key] += val`` per group; map-side partial sums absorb hot keys before the exchange."""
    return events.groupBy(*by, key).agg(F.sum(F.col(val).cast("double")).alias("v"))


def add(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("x",)) -> DataFrame:
    cols = [*keys, "v"]
    return a.select(*cols).unionByName(b.select(*cols)).groupBy(*keys).agg(F.sum("v").alias("v"))


def scale(a: DataFrame, c: float) -> DataFrame:
    return a.withColumn("v", F.col("v") * F.lit(float(c)))


def subtract(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("x",)) -> DataFrame:
    return add(a, scale(b, -1.0), keys)


def f2(a: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Second frequency moment per group."""
    return a.groupBy(*by).agg(F.sum(F.col("v") * F.col("v")).alias("f2"))


def norm(a: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return a.groupBy(*by).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def normalize(a: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unit vectors per group; a zero vector is an error."""
    lengths = norm(a, by)
    if by:
        joined = attach(a, lengths, by)
    else:
        joined = a.withColumn("norm", lengths.scalar())
    zero = F.raise_error(F.lit("cannot normalize a zero vector")).cast("double")
    return joined.withColumn("v", F.when(F.col("norm") == 0, zero).otherwise(F.col("v") / F.col("norm"))).drop("norm")


def dot(a: DataFrame, b: DataFrame, key: str = "x", by: Sequence[str] = ()) -> DataFrame:
    """Sparse dot product; ``by`` groups are those of ``a``."""
    joined = a.join(b.select(key, F.col("v").alias("v_other")), key)
    return joined.groupBy(*by).agg(F.sum(F.col("v") * F.col("v_other")).alias("dot"))


def mean(drifts: DataFrame, k: int, estimate: DataFrame | None = None, keys: Sequence[str] = ("x",)) -> DataFrame:
    """``E + sum_i X_i / k`` over the k sites."""
    averaged = scale(drifts.select(*keys, "v"), 1.0 / k)
    if estimate is None:
        return averaged.groupBy(*keys).agg(F.sum("v").alias("v"))
    return add(estimate, averaged, keys)
