"""Series over the monitor's protocol logs.

Inputs are tables with ``realTS`` (ms), ``nodeID``, a mark column and a unique ``seq`` that breaks ties;
row counts per node are unbounded, so every running count goes through ordered segments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftgate.operators.joins import attach
from driftgate.operators.ordering import global_rank, rank_within, segments

ORDER = ("realTS", "seq")


def for_node(log: DataFrame, node: int) -> DataFrame:
    return log.filter(F.col("nodeID") == node)


def _seconds_since(start: Column) -> Column:
    return (F.col("realTS") - start) / F.lit(1000.0)


def _with_node_start(log: DataFrame) -> DataFrame:
    starts = log.groupBy("nodeID").agg(F.min("realTS").alias("_start"))
    return attach(log, starts, ["nodeID"])


def elapsed(log: DataFrame, mark: str, column: str = "metricType") -> DataFrame:
    """Seconds since the first log row, for rows of one kind."""
    start = log.agg(F.min("realTS")).scalar()
    return log.filter(F.col(column) == mark).select("seq", _seconds_since(start).alias("elapsed"))


def events_over_time(throughput: DataFrame) -> DataFrame:
    joined = _with_node_start(throughput)
    return joined.select("nodeID", "seq", _seconds_since(F.col("_start")).alias("elapsed"), "events")


def derivative(throughput: DataFrame, h: float) -> DataFrame:
    """Growth of the cumulative count per ``h``-second bucket, divided by ``h``."""
    series = events_over_time(throughput)
    buckets = (
        series.groupBy("nodeID", F.floor(F.col("elapsed") / F.lit(float(h))).cast("bigint").alias("bucket"))
        .agg(F.max("events").alias("last"), F.min("events").alias("first"))
    )
    by_node = Window.partitionBy("nodeID").orderBy("bucket")
    growth = F.col("last") - F.coalesce(F.lag("last").over(by_node), F.col("first"))
    return buckets.select("nodeID", "bucket", (growth / F.lit(float(h))).alias("rate"))


def event_rate(log: DataFrame, h: float, by: Sequence[str] = ("nodeID",)) -> DataFrame:
    """The derivative of each group's event count, from the events themselves: rows per ``h``-second bucket since the
    group's first, divided by ``h``. The first event starts the count and is no growth."""
    starts = log.groupBy(*by).agg(F.min("realTS").alias("_start"))
    elapsed = _seconds_since(F.col("_start"))
    bucket = F.floor(elapsed / F.lit(float(h))).cast("bigint").alias("bucket")
    counted = attach(log.select(*by, "realTS"), starts, by).groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("n"))
    growth = F.col("n") - F.when(F.col("bucket") == 0, 1).otherwise(0)
    return counted.select(*by, "bucket", (growth / F.lit(float(h))).alias("rate"))


def mean_throughput(throughput: DataFrame) -> DataFrame:
    """Events per second since the node's first row; null where no time has passed."""
    series = events_over_time(throughput)
    return series.select("nodeID", "seq", "elapsed", F.try_divide("events", "elapsed").alias("rate"))


def cumulative_marks(log: DataFrame, mark: str, column: str = "metricType") -> DataFrame:
    """Ordinal of every ``mark`` row over elapsed time."""
    start = log.agg(F.min("realTS")).scalar()
    ranked = global_rank(log.filter(F.col(column) == mark).select(*ORDER), ORDER)
    return ranked.select(F.col("rn").alias("ordinal"), _seconds_since(start).alias("elapsed"))


def increments_between(log: DataFrame, marks: Sequence[str], increment: str = "SENT_INCREMENT") -> DataFrame:
    """Increments a node sent before each of its marks; rows after its last mark are dropped.

    A segment of a node's log counts its increments before its first mark, in the periods its marks close, and after its last
    mark. Neighbouring segments merge without their rows: periods are numbered on by the marks before the segment, so what is
    left open at the end of one adds to the first period of the next. Rows are sorted inside a segment only.
    """
    is_mark = F.col("eventType").isin(*marks)
    relevant = log.filter(is_mark | (F.col("eventType") == increment)).select("nodeID", "eventType", *ORDER)
    cut, _ = segments(relevant, ORDER)
    upto = Window.partitionBy("nodeID", "seg").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    passed = F.sum(F.when(is_mark, 1).otherwise(0).cast("bigint")).over(upto)
    numbered = cut.select("nodeID", "seg", is_mark.alias("mark"), F.when(is_mark, passed).otherwise(passed + 1).alias("own"))
    counted = numbered.groupBy("nodeID", "seg", "own").agg(
        F.count_if(~F.col("mark")).alias("increments"), F.count_if(F.col("mark")).alias("closed")
    )
    # one row for each segment of a node
    earlier = Window.partitionBy("nodeID").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    closed = cut.groupBy("nodeID", "seg").agg(F.count_if(is_mark).alias("marks")).withColumn("before", F.coalesce(F.sum("marks").over(earlier), F.lit(0)))
    merged = (
        counted.join(closed, ["nodeID", "seg"])
        .groupBy("nodeID", (F.col("before") + F.col("own")).alias("period"))
        .agg(F.sum("increments").alias("increments"), F.sum("closed").alias("closed"))
    )
    return merged.filter(F.col("closed") > 0).select("nodeID", "period", "increments")


def cumulative_increments(log: DataFrame, increment: str = "SENT_INCREMENT") -> DataFrame:
    timed = _with_node_start(log).filter(F.col("eventType") == increment)
    timed = timed.select("nodeID", *ORDER, _seconds_since(F.col("_start")).alias("elapsed"))
    return rank_within(timed, ["nodeID"], ORDER, "increments").select("nodeID", "seq", "elapsed", "increments")


def time_against_time(log: DataFrame) -> DataFrame:
    """Event time (hours) over processing time (seconds), both from the start; the first log row is skipped."""
    first_real = log.agg(F.min("realTS")).scalar()
    rest = log.filter(F.struct(*ORDER) > log.agg(F.min(F.struct(*ORDER))).scalar())
    first_event = rest.agg(F.min(F.struct(*ORDER, "eventTS"))["eventTS"]).scalar()
    return rest.select(
        "seq",
        _seconds_since(first_real).alias("elapsed"),
        ((F.col("eventTS") - first_event) / F.lit(3_600_000.0)).alias("event_hours"),
    )


def compare(runs: dict[int, DataFrame]) -> DataFrame:
    """Union of one series over runs with different numbers of sites."""
    tagged = [df.withColumn("k", F.lit(k).cast("bigint")) for k, df in sorted(runs.items())]
    result = tagged[0]
    for df in tagged[1:]:
        result = result.unionByName(df)
    return result
