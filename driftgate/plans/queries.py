"""The engine's operators applied to the test tables, one function per query.

``events`` plays the record stream: site = event_id mod 4, key = (user_id, code of event_type), weight 1.
The estimate of the zone queries is the mean vector of the first ten days, the drifts are those of the later days.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftgate.functions import arrays
from driftgate.functions.hyperbola import hyperbola_score
from driftgate.functions.keys import PRIME, SketchShape, pair_key, site_of
from driftgate.operators import accumulators, counters, logs, ordering, packed, profiles, sketch, vectors, windows, zones
from driftgate.plans.gate import GateConfig, monitor, slot_deltas, throughput
from driftgate.plans.spec import ExactF2, SketchF2
from driftgate.session import WorkArea
from driftgate.sources import access_log, sinks, synthetic
from driftgate.streaming.monitor import StreamMonitor, monitor_stream
from driftgate.streaming.watermarks import closed_windows
from driftgate.streaming.windows import anchored_stream

SITES = 4
EPS = 0.2
SHAPE = SketchShape()
HOUR = 3_600_000
DAY = 24 * HOUR
WARM_DAYS = 10
LATE_DAYS = (15, 22)
TYPES = ("view", "click", "purchase", "signup", "error")
KS = (2, 4, 8, 12, 20)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# -- inputs


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _type_code() -> Column:
    code = F.when(F.col("event_type") == TYPES[0], 0)
    for i, name in enumerate(TYPES[1:], 1):
        code = code.when(F.col("event_type") == name, i)
    return code.cast("bigint")


def _time_ms() -> Column:
    """Times in the files carry no zone and count as UTC, whatever the session's zone is."""
    return F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")


def events(spark: SparkSession, folder: str, k: int = SITES) -> DataFrame:
    raw = _table(spark, folder, "events")
    return raw.select(
        "event_id",
        site_of(F.col("event_id"), k).alias("site"),
        _time_ms().alias("ts_ms"),
        F.col("user_id").alias("a"),
        _type_code().alias("b"),
        pair_key(F.col("user_id"), _type_code()).alias("x"),
        F.lit(1.0).alias("val"),
        "event_type",
    )


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    """Events with their day as ``slot`` and the day's number in the table."""
    slotted = windows.with_slot(events(spark, folder), DAY)
    first = slotted.agg(F.min("slot")).first()[0]  # one number, so that no branch of a plan looks it up again
    return slotted.withColumn("day", F.col("slot") - F.lit(first).cast("bigint"))


def _before(daily: DataFrame) -> DataFrame:
    return daily.filter(F.col("day") < WARM_DAYS)


def _after(daily: DataFrame) -> DataFrame:
    return daily.filter(F.col("day") >= WARM_DAYS)


def _exact_parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    daily = _daily(spark, folder)
    estimate = _published(vectors.mean(vectors.build(_before(daily)), SITES))
    return vectors.build(_after(daily), ("site", "slot")), estimate


def _sketch_parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    daily = _daily(spark, folder)
    estimate = _published(vectors.mean(sketch.build(_before(daily), ("site",), SHAPE), SITES, keys=sketch.CELL))
    return sketch.build(_after(daily), ("site", "slot"), SHAPE), estimate


def _published(estimate: DataFrame) -> DataFrame:
    """An estimate is read by its zone and by every score, so it is a stored table as in the gate."""
    return WorkArea(estimate.sparkSession, "estimate").save(estimate, "cells")


def _r(column: str | Column, name: str | None = None) -> Column:
    """Rounded for comparison, without negative zero."""
    col = F.col(column) if isinstance(column, str) else column
    return (F.round(col, 6) + F.lit(0.0)).alias(name or column)


# -- ingest


def _log_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Events laid out as access-log fields; the event id plays the server."""
    return events(spark, folder).select(
        F.floor(F.col("ts_ms") / 1000).cast("bigint").alias("timestamp"),
        F.col("a").alias("clientID"),
        F.lit(0).alias("objectID"),
        F.lit(0).alias("size"),
        F.lit(0).alias("method"),
        F.lit(200).alias("status"),
        F.col("b").alias("type"),
        F.col("event_id").alias("server"),
    )


@query
def ingest_events(spark, folder):
    return events(spark, folder).select("event_id", "site", "ts_ms", "a", "b", "x", "val")


@query
def ingest_log_lines(spark, folder):
    """Text lines with an end mark, parsed as a topic payload."""
    lines = access_log.to_lines(_log_fields(spark, folder))
    marked = lines.unionByName(lines.limit(1).select(F.lit(access_log.END_MARK).alias("value")))
    return access_log.parse_lines(marked, SITES)


@query
def ingest_log_files(spark, folder):
    """Text files written by Spark and read back."""
    work = WorkArea(spark, "lines")
    access_log.to_lines(_log_fields(spark, folder)).write.text(f"{work.path}/log")
    return access_log.read_files(spark, f"{work.path}/log", SITES)


@query
def synthetic_events(spark, folder):
    """One synthetic event for every row of events."""
    ids = _table(spark, folder, "events").select(F.col("event_id").alias("id"))
    return synthetic.synthetic_events(ids, start_ms=1_000_000, gap=5)


@query
def site_load(spark, folder):
    return profiles.site_load(_table(spark, folder, "events"), "event_id", SITES)


@query
def site_coverage(spark, folder):
    return profiles.site_coverage(_table(spark, folder, "events"), "user_id")


# -- exact vectors


@query
def site_vectors(spark, folder):
    return vectors.build(events(spark, folder))


@query
def vector_add(spark, folder):
    v = vectors.build(events(spark, folder))
    return vectors.add(v.filter("site = 0"), v.filter("site = 1"))


@query
def vector_scale(spark, folder):
    return vectors.scale(vectors.build(events(spark, folder)), 0.25)


@query
def vector_norm(spark, folder):
    return vectors.norm(vectors.build(events(spark, folder)), ("site",)).select("site", _r("norm"))


@query
def vector_normalize(spark, folder):
    v = vectors.normalize(vectors.build(events(spark, folder)), ("site",))
    return v.select("site", "x", _r("v"))


@query
def vector_dot(spark, folder):
    v = vectors.build(events(spark, folder))
    return vectors.dot(v, v.filter("site = 0").drop("site"), by=("site",))


@query
def mean_vector(spark, folder):
    daily = _daily(spark, folder)
    estimate = vectors.mean(vectors.build(_before(daily)), SITES)
    return vectors.mean(vectors.build(_after(daily)), SITES, estimate)


@query
def f2_exact(spark, folder):
    return vectors.f2(vectors.mean(vectors.build(events(spark, folder)), SITES))


@query
def f2_checkpoints(spark, folder):
    ranked = ordering.global_rank(events(spark, folder).select("event_id", "ts_ms", "x", "val"), ("ts_ms", "event_id"))
    return ordering.f2_checkpoints(ranked, 1000, 0.1).select("rn", "ts_ms", _r("f2"))


# -- sketches


@query
def sketch_cells(spark, folder):
    return sketch.build(events(spark, folder), ("site",), SHAPE)


@query
def sketch_packed(spark, folder):
    """Built packed from spread events, day by day, and merged to one sketch a site without unpacking on the way."""
    hits = sketch.spread(windows.with_slot(events(spark, folder), DAY).select("site", "slot", "x", "val"), SHAPE)
    daily = packed.pack(hits, ("site", "slot"), SHAPE)
    return packed.unpack(packed.merge(daily.select("site", "packed"), ("site",)), ("site",), SHAPE)


@query
def sketch_add(spark, folder):
    s = sketch.build(events(spark, folder), ("site",), SHAPE)
    return sketch.add(s.filter("site = 0"), s.filter("site = 1"))


@query
def sketch_subtract(spark, folder):
    s = sketch.build(events(spark, folder), ("site",), SHAPE)
    return sketch.subtract(s.filter("site = 0"), s.filter("site = 1"))


@query
def sketch_scale(spark, folder):
    return sketch.scale(sketch.build(events(spark, folder), ("site",), SHAPE), 0.5)


@query
def sketch_row_arith(spark, folder):
    """Array form: sum, difference, product, root and scaling of the row norms of site 0 and all sites."""
    s = sketch.build(events(spark, folder), ("site",), SHAPE)
    as_array = lambda df: df.agg(arrays.by_row(F.col("d"), F.col("norm")).alias("n"))
    one = as_array(sketch.row_norms(s.filter("site = 0")))
    rows = as_array(sketch.row_norms(sketch.build(events(spark, folder), (), SHAPE))).withColumn("m", one.scalar())
    n, m = F.col("n"), F.col("m")
    parts = F.arrays_zip(
        arrays.add(n, m).alias("added"),
        arrays.subtract(n, m).alias("subtracted"),
        arrays.multiply(n, m).alias("multiplied"),
        arrays.root(n).alias("root"),
        arrays.scale(n, 0.5).alias("scaled"),
        F.transform(n, lambda _: arrays.norm(n)).alias("norm"),
    )
    flat = rows.select(F.posexplode(parts).alias("d", "p")).select(F.col("d").cast("bigint").alias("d"), "p.*")
    return flat.select("d", *[_r(c) for c in ("added", "subtracted", "multiplied", "root", "scaled", "norm")])


@query
def sketch_row_norms(spark, folder):
    s = sketch.build(events(spark, folder), ("site",), SHAPE)
    return sketch.row_norms(s, ("site",)).select("site", "d", _r("norm"))


@query
def sketch_normalize(spark, folder):
    s = sketch.build(events(spark, folder), ("site",), SHAPE)
    return sketch.normalize(s, ("site",)).select("site", "d", "w", _r("v"))


@query
def sketch_row_dot(spark, folder):
    s = sketch.build(events(spark, folder), ("site",), SHAPE)
    return sketch.row_dot(s, s.filter("site = 0"), ("site",), SHAPE)


@query
def sketch_dense_pos(spark, folder):
    """Flat positions and back."""
    s = sketch.dense_position(sketch.build(events(spark, folder), ("site",), SHAPE), SHAPE)
    return sketch.from_position(s.withColumn("flat", F.col("pos")), SHAPE).select("site", "flat", "d", "w", "v")


@query
def sketch_dense(spark, folder):
    """Zeros spelled out: every cell of every site's dense form."""
    s = sketch.dense(sketch.sparse(sketch.build(events(spark, folder), ("site",), SHAPE)), ("site",), SHAPE)
    return s.select("site", "pos", "v")


@query
def sketch_dense_arrays(spark, folder):
    """One array per site, read back at every position."""
    s = sketch.dense_arrays(sketch.build(events(spark, folder), ("site",), SHAPE), ("site",), SHAPE)
    picked = s.select("site", F.posexplode("cells").alias("pos", "v"))
    return picked.select("site", F.col("pos").cast("bigint").alias("pos"), "v")


@query
def sketch_column(spark, folder):
    """Bucket column 17 of site 0 put in the place of column 17 of site 1."""
    s = sketch.build(events(spark, folder), ("site",), SHAPE)
    donor = sketch.column_at(s.filter("site = 0"), 17).select("d", "v")
    return sketch.replace_column(s.filter("site = 1").drop("site"), 17, donor)


@query
def sketch_equal(spark, folder):
    """Is the sum of the site sketches the sketch of all events?"""
    whole = sketch.build(events(spark, folder), (), SHAPE)
    parts = sketch.build(events(spark, folder), ("site",), SHAPE)
    return sketch.equal(whole, parts.groupBy("d", "w").agg(F.sum("v").alias("v")))


@query
def sketch_empty_sites(spark, folder):
    """Sites whose sketch cancels out when site 2 is taken away from itself."""
    ev = events(spark, folder)
    mirrored = ev.filter("site = 2").withColumn("val", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    return sketch.empty_groups(sketch.build(ev.filter("site <> 2").unionByName(mirrored), ("site",), SHAPE), ("site",))


@query
def f2_sketch(spark, folder):
    s = sketch.build(events(spark, folder), ("site",), SHAPE)
    mean = vectors.mean(s, SITES, keys=sketch.CELL)
    return sketch.self_join_size(s, ("site",)).unionByName(
        sketch.self_join_size(mean).select(F.lit(-1).cast("bigint").alias("site"), "estimate")
    )


def _join_inputs(spark, folder) -> dict[str, tuple[DataFrame, DataFrame]]:
    def keys(table: str, column: str) -> DataFrame:
        key = F.pmod(F.col(column).cast("bigint"), F.lit(PRIME).cast("bigint")).alias("x")
        return _table(spark, folder, table).select(key, F.lit(1.0).alias("val"))

    return {
        "orders_lineitem": (keys("orders", "o_orderkey"), keys("lineitem", "l_orderkey")),
        "customer_supplier": (keys("customer", "c_nationkey"), keys("supplier", "s_nationkey")),
    }


@query
def join_size_exact(spark, folder):
    """Both sides are counted per key before they meet, so no pair is ever emitted."""
    parts = []
    for name, (a, b) in _join_inputs(spark, folder).items():
        size = vectors.dot(vectors.build(a, ()), vectors.build(b, ()))
        parts.append(size.select(F.lit(name).alias("pair"), F.col("dot").alias("size")))
    return parts[0].unionByName(parts[1])


@query
def join_size_sketch(spark, folder):
    parts = []
    for name, (a, b) in _join_inputs(spark, folder).items():
        size = sketch.join_size(sketch.build(a, (), SHAPE), sketch.build(b, (), SHAPE), SHAPE)
        parts.append(size.select(F.lit(name).alias("pair"), "estimate"))
    return parts[0].unionByName(parts[1])


# -- safe zones


@query
def zone_cap(spark, folder):
    return zones.cap(*_exact_parts(spark, folder), EPS, ("site", "slot")).select("site", "slot", _r("phi"))


@query
def zone_cap_neg(spark, folder):
    return zones.cap_negated(*_exact_parts(spark, folder), EPS, ("site", "slot")).select("site", "slot", _r("phi"))


def _zone_f2(spark, folder, **options) -> DataFrame:
    drift, estimate = _sketch_parts(spark, folder)
    scored = zones.zone_f2(drift, estimate, EPS, ("site", "slot"), SHAPE, **options)
    return scored.select("site", "slot", _r("phi"))


@query
def zone_f2_upper(spark, folder):
    return _zone_f2(spark, folder, side="upper")


@query
def zone_f2_lower(spark, folder):
    return _zone_f2(spark, folder, side="lower")


@query
def zone_f2(spark, folder):
    return _zone_f2(spark, folder)


def _quorum(
    spark, folder, eikonal: bool, component: Callable[[], Column] = lambda: F.col("b"), n: int = len(TYPES), k: int = 3
) -> DataFrame:
    """Quorum over plain per-type counts: five inputs, three of which must hold, or other components of events.

    Inputs per user: count minus a quarter of the user's mean; the reference is the first ten days.
    """
    daily = _daily(spark, folder)
    counts = lambda df, *by: df.groupBy(*by, component().alias("d")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    reference = counts(_before(daily)).agg(arrays.by_row(F.col("d"), F.col("v")).alias("r"))
    centred = F.transform("r", lambda c: c - F.lit(0.25) * arrays.total(F.col("r")) / F.size("r"))
    ids = F.array(*[F.lit(i).cast("bigint") for i in range(n)])
    rows = counts(_after(daily), "a").groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("d", "v"))).alias("m"))
    scored = rows.select(
        "a",
        F.transform(ids, lambda d: F.coalesce(F.col("m")[d], F.lit(0.0)) - F.lit(1.0)).alias("z"),
        reference.select(centred).scalar().alias("ref"),
    )
    return scored.select("a", _r(zones.quorum(F.col("ref"), F.col("z"), k, n, eikonal), "score"))


@query
def quorum_eikonal(spark, folder):
    return _quorum(spark, folder, True)


@query
def quorum_fast(spark, folder):
    return _quorum(spark, folder, False)


@query
def quorum_deep(spark, folder):
    """Twelve inputs, counts by two hours of the day, six of which must hold: subsets are searched, not listed."""
    return _quorum(spark, folder, True, lambda: F.pmod(windows.slot_of(F.col("ts_ms"), 2 * HOUR), F.lit(12)), 12, 6)


@query
def zone_hyperbola(spark, folder):
    """Score of (clicks, purchases) per user against x^2 - y^2 >= T around the mean user, for three T."""
    ev = events(spark, folder)
    users = ev.groupBy("a").agg(
        F.count_if(F.col("b") == 1).cast("double").alias("x"), F.count_if(F.col("b") == 2).cast("double").alias("y")
    )
    thresholds = F.explode(F.array(F.lit(4.0), F.lit(0.0), F.lit(-4.0))).alias("t")
    scored = users.select("a", "x", "y", thresholds).withColumn(
        "score", hyperbola_score(F.lit(9.0), F.lit(3.0), F.col("t"), F.col("x"), F.col("y"))
    )
    return scored.select("a", "t", _r("score"))


@query
def zone_join(spark, folder):
    """Clicks joined with purchases on the user."""
    daily = _daily(spark, folder).withColumn("x", F.col("a"))
    clicks, purchases = daily.filter("b = 1"), daily.filter("b = 2")
    mean = lambda df: _published(vectors.mean(sketch.build(_before(df), ("site",), SHAPE), SITES, keys=sketch.CELL))
    drift = lambda df: sketch.build(_after(df), ("site", "slot"), SHAPE)
    scored = zones.zone_join(
        drift(clicks), drift(purchases), mean(clicks), mean(purchases), EPS, ("site", "slot"), SHAPE
    )
    return scored.select("site", "slot", _r("phi"))


@query
def zone_rebalanced(spark, folder):
    drift, estimate = _sketch_parts(spark, folder)
    scored = zones.rebalanced_f2(drift, estimate, EPS, 0.5, ("site", "slot"), SHAPE)
    return scored.select("site", "slot", _r("phi"))


@query
def balance_term(spark, folder):
    drift, estimate = _sketch_parts(spark, folder)
    return zones.balance_term(drift, estimate, EPS, 0.5, SITES, SHAPE).select(_r("psi_beta"))


# -- windows


@query
def retract_aligned(spark, folder):
    totals = vectors.build(windows.with_slot(events(spark, folder), HOUR), ("site", "slot"))
    return windows.retract(totals, 24).select("site", "slot", "x", "v")


@query
def retract_anchored(spark, folder):
    signed = windows.retract_anchored(events(spark, folder).select("event_id", "site", "ts_ms", "x", "val"), 24 * HOUR, HOUR)
    return signed.select("event_id", "site", "ts_ms", "x", "val", "at")


@query
def retract_anchored_stream(spark, folder):
    """The same as a stream over the event files, with the slides in Spark's state store."""
    schema = _table(spark, folder, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{folder}/events*.parquet")
    records = raw.select(
        "event_id", site_of(F.col("event_id"), SITES).alias("site"), _time_ms().alias("ts_ms"),
        pair_key(F.col("user_id"), _type_code()).alias("x"), F.lit(1.0).alias("val"),
    )
    area = WorkArea(spark, "anchored-stream")
    running, out = anchored_stream(records, area.path, 24 * HOUR, HOUR)
    running.awaitTermination()
    return out.output().select("event_id", "site", "ts_ms", "x", "val", "at")


@query
def window_sliding(spark, folder):
    return windows.sliding_totals(events(spark, folder), 24 * HOUR, HOUR)


@query
def window_extremes(spark, folder):
    """Least and greatest key of every window, beside count and sum."""
    return windows.sliding_aggregates(events(spark, folder), 24 * HOUR, HOUR, val="a")


@query
def window_fine(spark, folder):
    """Windows of 1,000 s every 5 s: how many hold an event, and the fullest of each site and day."""
    found = windows.sliding_aggregates(events(spark, folder), 1_000_000, 5_000, val="a")
    day = windows.slot_of(F.col("window_start_ms"), DAY).alias("day")
    return found.groupBy("site", day).agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum("n").alias("records"),
        F.max("n").alias("most"),
        F.max("total").alias("total"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )


@query
def user_moments(spark, folder):
    """A user's own accumulator: moments of the keys in every window slot of a site."""
    found = accumulators.aggregate(
        windows.with_slot(events(spark, folder), DAY), ["site", "slot"], accumulators.Moments(), x=F.col("a")
    )
    return found.select("site", "slot", "n", _r("mean"), _r("variance"))


@query
def pane_delta(spark, folder):
    totals = vectors.build(windows.with_slot(events(spark, folder), DAY), ("site", "slot"))
    return windows.pane_delta(totals, ("site", "x"), 3)


@query
def window_estimates(spark, folder):
    slotted = windows.with_slot(events(spark, folder), DAY)
    deltas = windows.retract(sketch.build(slotted, ("site", "slot"), SHAPE), 7)
    return windows.f2_series(deltas, factor=0.1).select("site", "slot", _r("estimate"))


@query
def slide_throttle(spark, folder):
    """Instants at which each site evaluates: at most one per hour of event time."""
    return windows.anchored_starts(events(spark, folder), HOUR)


@query
def warmup_filter(spark, folder):
    slotted = windows.with_slot(events(spark, folder), HOUR)
    return windows.after_warmup(slotted, 36 * HOUR, HOUR).groupBy("site").agg(
        F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("records")
    )


@query
def late_watermark(spark, folder):
    """A stream over the event files: daily counts whose window the watermark (6 h lag) has passed."""
    schema = _table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{folder}/events*.parquet")
    records = stream.select(site_of(F.col("event_id"), SITES).alias("site"), _time_ms().alias("ts_ms"))
    closed = closed_windows(records, "1 day", "6 hours")
    work = WorkArea(spark, "windows")
    run = (
        closed.writeStream.outputMode("append")
        .option("checkpointLocation", f"{work.path}/checkpoint")
        .trigger(availableNow=True)
        .format("parquet")
        .start(f"{work.path}/closed")
    )
    run.awaitTermination()
    return work.load("closed", closed.schema)


# -- the gate


def _first_round(spark, folder):
    spec = SketchF2(EPS, SHAPE)
    daily = _daily(spark, folder)
    stored = WorkArea(spark, "round").save(slot_deltas(spec, daily.drop("day")), "deltas")
    warm = stored.agg(F.min("slot") + F.lit(WARM_DAYS)).scalar()
    early = stored.filter(F.col("slot") < warm)
    estimate = spec.scale(spec.collect_cells(early), 1.0 / SITES)
    zone = spec.zone(estimate)
    return spec.phi_series(stored.filter(F.col("slot") >= warm), estimate, zone), spec.phi_at_zero(zone)


@query
def phi_series_first_round(spark, folder):
    series, _ = _first_round(spark, folder)
    return series.select("site", "slot", _r("phi"))


@query
def gate_counters(spark, folder):
    series, start = _first_round(spark, folder)
    growth = counters.counter_growth(series, start, start / 2)
    progress = counters.subround_progress(growth, SITES)
    return growth.join(progress, "slot").select("site", "slot", "counter", "gained", "total", "over")


def _monitor(spark, folder, kind: str, **options):
    return monitor(events(spark, folder), SITES, DAY, EPS, kind, warmup_ms=WARM_DAYS * DAY, **options)


@query
def monitor_exact(spark, folder):
    return _monitor(spark, folder, "exact").estimates


@query
def monitor_exact_rebalance(spark, folder):
    return _monitor(spark, folder, "exact", rebalance=True).estimates


@query
def monitor_exact_window(spark, folder):
    return _monitor(spark, folder, "exact", window_ms=10 * DAY).estimates


@query
def monitor_f2(spark, folder):
    return _monitor(spark, folder, "f2").estimates


@query
def monitor_f2_rebalance(spark, folder):
    return _monitor(spark, folder, "f2", rebalance=True).estimates


@query
def monitor_f2_window(spark, folder):
    return _monitor(spark, folder, "f2", window_ms=10 * DAY).estimates


@query
def monitor_join(spark, folder):
    """Clicks joined with purchases on the user, kept up to date."""
    ev = events(spark, folder).filter("b in (1, 2)")
    relations = ev.select("site", "ts_ms", F.col("a").alias("x"), "val", (F.col("b") - 1).alias("rel"))
    run = monitor(relations, SITES, DAY, 0.5, "join", warmup_ms=WARM_DAYS * DAY)
    return run.estimates.select("round", "ts", _r("estimate"))


@query
def monitor_log(spark, folder):
    """Decisions of the exact run by kind and time."""
    run = _monitor(spark, folder, "exact")
    centre = run.centre_log.groupBy("eventTS", F.col("metricType").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    site = run.site_log.groupBy("eventTS", F.concat(F.lit("SITE_"), "eventType").alias("kind")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return centre.unionByName(site)


@query
def gate_compare_k(spark, folder):
    """Rounds and subrounds so far over elapsed event time, of runs with different numbers of sites."""
    runs = {}
    for k in KS:
        run = monitor(events(spark, folder, k), k, DAY, EPS, "exact", warmup_ms=WARM_DAYS * DAY)
        log = run.centre_log.withColumn("realTS", F.col("eventTS"))  # event time is the clock
        marks = [logs.cumulative_marks(log, kind).withColumn("kind", F.lit(kind)) for kind in ("ROUND", "SUBROUND")]
        runs[k] = marks[0].unionByName(marks[1])
    return logs.compare(runs).select("k", "kind", "ordinal", "elapsed")


@query
def sink_answers(spark, folder):
    """The answers of the exact run written as text and read back."""
    path = f"{WorkArea(spark, 'sink').path}/answers"
    sinks.write_estimates(_monitor(spark, folder, "exact").estimates, path)
    return spark.read.schema("ts bigint, estimate double").csv(path)


@query
def sink_logs(spark, folder):
    """The logs of the exact run, written and read back: decisions per kind, and the last count of each site."""
    path = f"{WorkArea(spark, 'sink').path}/logs"
    sinks.write_logs(_monitor(spark, folder, "exact"), path)
    parts = []
    for log, kind in (("centre", "metricType"), ("site", "eventType")):
        counted = spark.read.parquet(f"{path}/{log}").groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
        parts.append(counted.withColumn("log", F.lit(log)))
    last = spark.read.parquet(f"{path}/throughput").groupBy(F.col("nodeID").cast("string").alias("kind"))
    parts.append(last.agg(F.max("events").alias("n")).withColumn("log", F.lit("throughput")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("log", "kind", "n")


@query
def monitor_throughput(spark, folder):
    """Cumulative records per site and day."""
    counted = throughput(windows.with_slot(events(spark, folder), DAY), DAY)
    return counted.select("eventTS", "nodeID", "events")


@query
def monitor_stream_exact(spark, folder):
    """The gate over a stream of the event files, to the end."""
    schema = _table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{folder}/events*.parquet")
    records = stream.select(
        site_of(F.col("event_id"), SITES).alias("site"),
        _time_ms().alias("ts_ms"),
        pair_key(F.col("user_id"), _type_code()).alias("x"),
        F.lit(1.0).alias("val"),
    )
    root = WorkArea(spark, "stream").path
    run, outcome = monitor_stream(records, root, SITES, DAY, EPS, "exact", warmup_ms=WARM_DAYS * DAY)
    run.awaitTermination()
    outcome.finish()
    return outcome.output().select("round", "ts", "estimate")


@query
def monitor_stream_late(spark, folder):
    """Three micro-batches; one event in 50 comes a batch late and joins the first day that is still open."""
    daily = _daily(spark, folder)
    batch = F.when(F.col("day") < LATE_DAYS[0], 0).when(F.col("day") < LATE_DAYS[1], 1).otherwise(2)
    records = daily.withColumn("batch", F.least(batch + (F.col("event_id") % 50 == 0).cast("int"), F.lit(2)))
    root = WorkArea(spark, "stream").path
    config = GateConfig(SITES, DAY, WARM_DAYS * DAY)
    run = StreamMonitor(spark, root, ExactF2(EPS), config, None)
    for i in range(3):
        run.process(records.filter(F.col("batch") == i).select("site", "ts_ms", "x", "val"), i)
    run.finish()
    return run.output().select("round", "ts", "estimate")


# -- protocol logs


def _log(spark, folder) -> DataFrame:
    """Events read as a log: purchase closes a round, signup a subround, click is an increment."""
    centre = F.when(F.col("b") == 2, "ROUND").when(F.col("b") == 3, "SUBROUND").otherwise("OTHER")
    site = (
        F.when(F.col("b") == 2, "RECEIVED_ESTIMATE")
        .when(F.col("b") == 3, "RECEIVED_QUANTUM")
        .when(F.col("b") == 1, "SENT_INCREMENT")
        .otherwise("EVENT")
    )
    return events(spark, folder).select(
        F.col("event_id").alias("seq"),
        F.col("ts_ms").alias("realTS"),
        (F.col("ts_ms") + F.col("a") * 1000).alias("eventTS"),
        F.col("site").alias("nodeID"),
        site.alias("eventType"),
        centre.alias("metricType"),
    )


def _ranked_log(spark, folder) -> DataFrame:
    return ordering.global_rank(_log(spark, folder).select("seq", "realTS", "nodeID"), logs.ORDER)


def _throughput(spark, folder) -> DataFrame:
    ranked = _ranked_log(spark, folder)
    return ordering.running_sum(ranked, F.lit(1).cast("bigint"), "events", ["nodeID"])


@query
def log_node(spark, folder):
    return logs.for_node(_log(spark, folder), 1).select("seq", "realTS", "eventType")


@query
def log_elapsed(spark, folder):
    return logs.elapsed(_log(spark, folder), "ROUND").select("seq", _r("elapsed"))


@query
def log_events(spark, folder):
    return logs.events_over_time(_throughput(spark, folder)).select("nodeID", "seq", _r("elapsed"), "events")


@query
def log_derivative(spark, folder):
    return logs.derivative(_throughput(spark, folder), 3 * 3600).select("nodeID", "bucket", "rate")


@query
def log_mean_throughput(spark, folder):
    series = logs.mean_throughput(_throughput(spark, folder))
    return series.select("nodeID", "seq", _r("elapsed"), "rate")


@query
def log_rounds(spark, folder):
    return logs.cumulative_marks(_log(spark, folder), "ROUND").select("ordinal", _r("elapsed"))


@query
def log_subrounds(spark, folder):
    return logs.cumulative_marks(_log(spark, folder), "SUBROUND").select("ordinal", _r("elapsed"))


@query
def log_inc_per_round(spark, folder):
    return logs.increments_between(_log(spark, folder), ["RECEIVED_ESTIMATE"])


@query
def log_inc_per_subround(spark, folder):
    return logs.increments_between(_log(spark, folder), ["RECEIVED_ESTIMATE", "RECEIVED_QUANTUM"])


@query
def log_inc_total(spark, folder):
    series = logs.cumulative_increments(_log(spark, folder))
    return series.select("nodeID", "seq", _r("elapsed"), "increments")


@query
def log_time_vs_time(spark, folder):
    return logs.time_against_time(_log(spark, folder)).select("seq", _r("elapsed"), "event_hours")


@query
def log_compare_k(spark, folder):
    """Throughput derivative of runs with different numbers of sites, in one table."""
    ks = F.explode(F.array(*[F.lit(k).cast("bigint") for k in KS])).alias("k")
    sited = _log(spark, folder).select("seq", "realTS", ks).withColumn("nodeID", F.pmod("seq", "k"))
    return logs.event_rate(sited, 86_400, ("k", "nodeID"))
