"""Positions and running sums in a total order, without one task holding the whole table or a hot key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType, NumericType

from driftgate.operators.joins import attach
from driftgate.session import WorkArea


#: Bytes of rows, by their types, that one segment should hold.
SEGMENT_BYTES = 64 << 20
MOST_PARTS = 1 << 16


def _row_bytes(df: DataFrame) -> int:
    return sum(8 if isinstance(f.dataType, NumericType) else 64 for f in df.schema)


def _split(value: Column, low: Column, width: Column) -> Column:
    return F.call_function("div", value.cast("bigint") - low, width)


def segments(df: DataFrame, order_by: Sequence[str], rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``seg``, the number of the ordered segment a row lies in, and ``(seg, n)`` with the segments' sizes.

    Segments are value ranges found by counting: the range of the first column is cut into equal buckets, and a bucket
    with more than ``rows`` rows is cut again over the first column that varies in it, so a value with a third of all rows
    is split by the next column. Only counts are stored. ``order_by`` names whole-number columns, unique together;
    ``rows`` follows from ``SEGMENT_BYTES``.
    """
    odd = [c for c in order_by if not isinstance(df.schema[c].dataType, IntegralType)]
    if odd:
        raise TypeError(f"positions are counted over whole numbers, not over {odd}")
    limit = rows or max(SEGMENT_BYTES // _row_bytes(df), 1)
    area = WorkArea(df.sparkSession, "segments")
    kind = "array<bigint>"
    keyed = fresh = df.withColumn("_key", F.array().cast(kind))
    spans = [F.min(c).cast("bigint").alias(f"low{i}") for i, c in enumerate(order_by)]
    spans += [F.max(c).cast("bigint").alias(f"high{i}") for i, c in enumerate(order_by)]
    varies = [F.col(f"low{i}") < F.col(f"high{i}") for i in range(len(order_by))]
    light = []
    while True:
        stats = area.save(fresh.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), *spans), f"counts{len(light)}")
        heavy = (F.col("n") > limit) & reduce(Column.__or__, varies)
        light.append(stats.filter(~heavy).select("_key", "n"))
        cut = stats.filter(heavy)
        many = cut.count()
        if not many:
            break
        parts = F.least(F.ceil(F.col("n") * 4 / limit), F.lit(MOST_PARTS))
        first = reduce(lambda rest, i: F.when(varies[i], i).otherwise(rest), reversed(range(len(order_by))), F.lit(None))
        low, high = (F.array(*[F.col(f"{side}{i}") for i in range(len(order_by))]) for side in ("low", "high"))
        cut = cut.select("_key", first.alias("_which"), low.alias("_low"), high.alias("_high"), parts.alias("_parts"))
        at = F.col("_which") + 1
        reach = F.element_at("_high", at) - F.element_at("_low", at) + 1
        width = F.ceil(reach / F.col("_parts")).cast("bigint")
        cut = cut.select("_key", at.alias("_at"), F.element_at("_low", at).alias("_low"), width.alias("_width"))
        joined = attach(keyed, cut, ["_key"], "left", row_bound=many)
        value = F.element_at(F.array(*[F.col(c).cast("bigint") for c in order_by]), F.col("_at"))
        deeper = F.concat("_key", F.array(_split(value, F.col("_low"), F.col("_width"))))
        keyed = joined.withColumns({"_key": F.when(F.col("_at").isNotNull(), deeper).otherwise(F.col("_key")), "_cut": F.col("_at").isNotNull()})
        keyed = keyed.drop("_at", "_low", "_width")
        fresh, keyed = keyed.filter("_cut"), keyed.drop("_cut")
    sizes = reduce(DataFrame.unionByName, light)
    # one row for each segment
    sizes = area.save(sizes.withColumn("seg", (F.row_number().over(Window.orderBy("_key")) - 1).cast("bigint")), "segments")
    bound = sizes.count()
    return attach(keyed, sizes.select("_key", "seg"), ["_key"], row_bound=bound).drop("_key"), sizes.select("seg", "n")


def global_rank(df: DataFrame, order_by: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Add ``rn`` (1-based position), ``seg`` (ordered segment) and ``idx`` (position in the segment).

    Rows are sorted inside their segments only, and a segment's first position is the count of all rows before it;
    nothing but counts is stored. ``partitions`` asks for about as many segments.
    """
    rows = -(-df.count() // partitions) if partitions else None
    cut, sizes = segments(df, order_by, rows)
    before = Window.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("seg", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("seg").orderBy(*order_by)
    numbered = cut.withColumn("idx", (F.row_number().over(within) - 1).cast("bigint"))
    joined = attach(numbered, offsets, ["seg"], row_bound=sizes.count())
    return joined.withColumn("rn", F.col("offset") + F.col("idx") + 1).drop("offset")


def rank_within(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], name: str) -> DataFrame:
    """Add ``name``, the 1-based position of a row among those of its key.

    A key's rows are sorted segment by segment and numbered on from the count of those before.
    """
    cut, _ = segments(df, order_by)
    keys = list(keys)
    counts = cut.groupBy(*keys, "seg").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*keys).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "seg", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    nth = F.row_number().over(Window.partitionBy(*keys, "seg").orderBy(*order_by))
    joined = cut.withColumn("_nth", nth).join(offsets, [*keys, "seg"])
    return joined.withColumn(name, F.col("_offset") + F.col("_nth")).drop("seg", "_nth", "_offset")


def running_sum(
    df: DataFrame, value: Column, name: str, keys: Sequence[str] = (), seg: str = "seg", order: str = "idx"
) -> DataFrame:
    """Running sum per key in ``(seg, order)`` order.

    Window groups are (key, segment), so a key with a third of all rows is spread over the segments;
    the carry into each segment comes from pre-aggregated segment totals.
    """
    keys = list(keys)
    valued = df.withColumn("_value", value)
    totals = valued.groupBy(*keys, seg).agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy(seg).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, seg, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_carry"))
    within = Window.partitionBy(*keys, seg).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = valued.withColumn("_local", F.sum("_value").over(within))
    return (
        local.join(carry, [*keys, seg])
        .withColumn(name, F.col("_carry") + F.col("_local"))
        .drop("_value", "_local", "_carry")
    )


def f2_checkpoints(ranked: DataFrame, every: int, factor: float, key: str = "x", val: str = "val") -> DataFrame:
    """F2 of the vector of all records so far (scaled by ``factor``) at records 1, every+1, 2*every+1, ...

    Records are first summed per (block, key); a key's square then changes by ``v*(2*before + v)`` per block.
    """
    block = F.expr(f"(rn - 2 + {every}) div {every}")
    span = 4096
    work = WorkArea(ranked.sparkSession, "blocks")
    cells = (
        ranked.select(block.alias("block"), key, F.col(val).cast("double").alias(val))
        .groupBy("block", key)
        .agg(F.sum(val).alias("v"))
        .withColumn("seg", F.expr(f"block div {span}"))
    )
    # a running sum reads its input twice, so both inputs are stored aggregates
    cells = work.save(cells, "cells")
    growth = (
        running_sum(cells, F.col("v"), "after", [key], order="block")
        .groupBy("block")
        .agg(F.sum(F.col("v") * (2 * F.col("after") - F.col("v"))).alias("growth"))
        .withColumn("seg", F.expr(f"block div {span}"))
    )
    growth = work.save(growth, "growth")
    marks = ranked.filter((F.col("rn") - 1) % F.lit(every) == 0).select(
        F.expr(f"(rn - 1) div {every}").alias("block"), "rn", "ts_ms"
    )
    totals = running_sum(growth, F.col("growth"), "f2", order="block").select("block", "f2")
    return marks.join(totals, "block").select("rn", "ts_ms", (F.col("f2") * F.lit(factor * factor)).alias("f2"))
