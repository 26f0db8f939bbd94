"""Slots, signed retraction windows, anchored slides and windowed estimates."""

from __future__ import annotations

import itertools
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from driftgate.functions import arrays
from driftgate.operators.joins import attach
from driftgate.session import WorkArea

# tasks get these functions with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Width of a chunk of time: a group holds at most as many distinct milliseconds of one site.
CHUNK_MS = 1 << 22
#: Step maps that are composed in one group.
FAN = 64


def slot_of(ts_ms: Column, slide_ms: int) -> Column:
    """Whole-number division, exact for times of any size."""
    ms = F.lit(slide_ms).cast("bigint")
    whole = ts_ms.cast("bigint")
    return F.call_function("div", whole - F.pmod(whole, ms), ms)


def with_slot(events: DataFrame, slide_ms: int) -> DataFrame:
    return events.withColumn("slot", slot_of(F.col("ts_ms"), slide_ms))


def slots_per_window(size_ms: int, slide_ms: int) -> int:
    if size_ms % slide_ms:
        raise ValueError("window size must be a multiple of the slide")
    return size_ms // slide_ms


def retract(deltas: DataFrame, n_slots: int, value: str = "v") -> DataFrame:
    """Every ``(slot, +v)`` also leaves at ``(slot + n_slots, -v)``.

    Apply it to slot totals rather than to events: the retractions then number one per total.
    """
    copies = F.array(
        F.struct(F.col("slot").alias("slot"), F.col(value).alias(value)),
        F.struct((F.col("slot") + n_slots).alias("slot"), (-F.col(value)).alias(value)),
    )
    rest = [c for c in deltas.columns if c not in ("slot", value)]
    return deltas.select(*rest, F.inline(copies))


def sliding_aggregates(
    events: DataFrame, size_ms: int, slide_ms: int, keys: Sequence[str] = ("site",), val: str = "val"
) -> DataFrame:
    """Count, sum, least and greatest value of every sliding window that holds an event.

    Windows share panes without copies of them. Time is cut into blocks of one window's length; a window is the end of one
    block and the beginning of the next, so it combines a running value from the block's end with one from the next
    block's start. The work follows panes and windows and not their product, and a group holds one block. Nothing is
    subtracted, so least and greatest values work like sums.
    """
    n = slots_per_window(size_ms, slide_ms)
    width = F.lit(n).cast("bigint")
    value = F.col(val).cast("double")
    panes = with_slot(events, slide_ms).groupBy(*keys, "slot").agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high")
    )
    pos = F.pmod("slot", width)
    panes = panes.select(*keys, F.call_function("div", F.col("slot") - pos, width).alias("block"), pos.alias("pos"), *_PANE)

    # windows of a block start up to its last pane, or so late that they reach the first pane of the next block
    edges = panes.groupBy(*keys, "block").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    none = F.lit(None).cast("bigint")
    reach = edges.select(*keys, "block", "last", none.alias("first")).unionByName(
        edges.select(*keys, (F.col("block") - 1).alias("block"), none.alias("last"), "first")
    )
    reach = reach.groupBy(*keys, "block").agg(F.coalesce(F.max("last"), F.lit(-1)).alias("last"), F.coalesce(F.max("first"), width).alias("first"))
    late = F.greatest("first", "last") + 1
    starts = F.concat(
        F.when(F.col("last") >= 0, F.sequence(F.lit(0).cast("bigint"), "last")).otherwise(F.array().cast("array<bigint>")),
        F.when(late < width, F.sequence(late, width - 1)).otherwise(F.array().cast("array<bigint>")),
    )
    starts = reach.select(*keys, "block", F.explode(starts).alias("pos"))

    blank = [F.lit(None).cast(t).alias(c) for c, t in zip(_PANE, ("bigint", "double", "double", "double"), strict=True)]
    start = (F.col("block") * width + F.col("pos")).alias("start")
    ends = starts.select(*keys, "block", "pos", F.lit(1).alias("kind"), start, *blank)
    begins = starts.filter("pos > 0").select(
        *keys, (F.col("block") + 1).alias("block"), (F.col("pos") - 1).alias("pos"), F.lit(2).alias("kind"), start, *blank
    )
    rows = panes.select(*keys, "block", "pos", F.lit(0).alias("kind"), none.alias("start"), *_PANE)
    block = Window.partitionBy(*keys, "block")
    falling = block.orderBy(F.desc("pos"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    rising = block.orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    merge = {"n": F.sum, "total": F.sum, "low": F.min, "high": F.max}
    scanned = rows.unionByName(ends).unionByName(begins)
    scanned = scanned.select(
        *keys, "kind", "start", *[F.when(F.col("kind") == 1, f(c).over(falling)).otherwise(f(c).over(rising)).alias(c) for c, f in merge.items()]
    )
    both = scanned.filter("kind > 0").groupBy(*keys, "start").agg(*[f(c).alias(c) for c, f in merge.items()])
    return both.select(*keys, (F.col("start") * slide_ms).alias("window_start_ms"), *merge)


_PANE = ("n", "total", "low", "high")


def sliding_totals(
    events: DataFrame, size_ms: int, slide_ms: int, keys: Sequence[str] = ("site",), val: str = "val"
) -> DataFrame:
    """Count and sum of every sliding window that holds an event."""
    return sliding_aggregates(events, size_ms, slide_ms, keys, val).select(*keys, "window_start_ms", "n", "total")


def pane_delta(totals: DataFrame, keys: Sequence[str], n_slots: int = 1) -> DataFrame:
    """Change of each window aggregate from the window before, zero changes left out.

    ``totals (keys, slot, v)`` are slot totals; windows span ``n_slots`` slots.
    """
    moved = retract(totals.select(*keys, "slot", "v"), n_slots)
    return moved.groupBy(*keys, "slot").agg(F.sum("v").alias("v")).filter(F.col("v") != 0)


def f2_series(
    deltas: DataFrame, by: Sequence[str] = ("site",), cell: Sequence[str] = ("d", "w"), factor: float = 1.0
) -> DataFrame:
    """F2 estimate per (group, slot) of the running vector: median over rows, times ``factor`` squared.

    Only changed cells are touched: a change v on top of b moves the row's square sum by ``v*(2b+v)``.
    """
    order = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    summed = deltas.groupBy(*by, *cell, "slot").agg(F.sum("v").alias("v"))
    per_cell = order.partitionBy(*by, *cell)
    grown = summed.withColumn("after", F.sum("v").over(per_cell))
    rows = grown.groupBy(*by, cell[0], "slot").agg(
        F.sum(F.col("v") * (2 * F.col("after") - F.col("v"))).alias("growth")
    )
    per_row = order.partitionBy(*by, cell[0])
    series = rows.withColumn("f2", F.sum("growth").over(per_row))
    median = arrays.upper_median(F.collect_list("f2"))
    return series.groupBy(*by, "slot").agg((median * F.lit(factor * factor)).alias("estimate"))


def after_warmup(slotted: DataFrame, warmup_ms: int, slide_ms: int) -> DataFrame:
    """Rows from the first slot that starts once the warm-up has passed."""
    n = -(-warmup_ms // slide_ms)
    return slotted.filter(F.col("slot") >= slotted.agg(F.min("slot") + F.lit(n)).scalar())


# -- anchored slides ------------------------------------------------------------------------------
#
# A slide starts at the first event at least ``slide`` after the current start, so starts form a chain.
# A chunk of time maps the threshold it is entered with to the threshold it is left with, and that map is
# a step function. Chunks compute their maps in parallel; maps of ``FAN`` neighbours are composed in rounds up
# a tree, thresholds are handed down it again, and the chunks then list their own starts in parallel. A group
# holds one chunk's distinct timestamps or ``FAN`` maps, however many events or slides a site has. Thresholds
# from before a chunk or block end before its start + slide, so no map has steps beyond that.

_MAP_SCHEMA = "site bigint, block bigint, upto bigint, leave bigint"
_ENTRY_SCHEMA = "site bigint, block bigint, enter bigint"
_START_SCHEMA = "site bigint, start bigint"


def _bounded(upto: np.ndarray, leave: np.ndarray, begin: int, slide: int) -> tuple[np.ndarray, np.ndarray]:
    """The last step of each run with equal results, up to the last threshold that a block from ``begin`` on can meet."""
    last = np.append(leave[1:] != leave[:-1], True)
    upto, leave = upto[last], leave[last]
    keep = np.searchsorted(upto, begin - 1 + slide) + 1
    return upto[:keep], leave[:keep]


def _follow(upto: np.ndarray, leave: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """Thresholds behind a block; beyond its last event they stay."""
    i = np.searchsorted(upto, threshold)
    return np.where(i < len(upto), leave[np.minimum(i, len(leave) - 1)], threshold)


def _in_order(maps: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Block, thresholds and results of each map of a group."""
    block, upto, leave = (maps[c].to_numpy() for c in ("block", "upto", "leave"))
    order = np.lexsort((upto, block))
    block, upto, leave = block[order], upto[order], leave[order]
    edge = np.flatnonzero(np.diff(block, prepend=block[0] - 1, append=block[-1] + 1)) if len(block) else []
    return [(int(block[a]), upto[a:b], leave[a:b]) for a, b in itertools.pairwise(edge)]


def _map_rows(site: int, block: int, upto: np.ndarray, leave: np.ndarray) -> pa.Table:
    n = len(upto)
    return pa.table({"site": np.full(n, site), "block": np.full(n, block), "upto": upto, "leave": leave})


def _chunk_map(slide: int, width: int, base: int):
    def run(key, instants):
        site, block = (k.as_py() for k in key)
        t = np.sort(instants["ts_ms"].to_numpy())
        n = len(t)
        succ = np.searchsorted(t, t + slide)
        hop = np.where(succ < n, succ, np.arange(n))
        while True:
            further = hop[hop]
            if np.array_equal(further, hop):
                break
            hop = further
        return _map_rows(site, block, *_bounded(t, t[hop] + slide, (base + block) * width, slide))

    return run


def _block_map(slide: int, width: int, base: int):
    """Neighbouring maps one after the other."""

    def run(key, maps):
        site, parent = (k.as_py() for k in key)
        (_, upto, leave), *rest = _in_order(maps)
        for _, u, v in rest:
            beyond = u > upto[-1]
            upto, leave = np.append(upto, u[beyond]), np.append(_follow(u, v, leave), v[beyond])
        return _map_rows(site, parent, *_bounded(upto, leave, base + parent * width, slide))

    return run


def _entries(key, maps, above):
    """The threshold each block of a group is entered with."""
    found, threshold = [], above["enter"].to_numpy()[:1]
    for block, upto, leave in _in_order(maps):
        found.append((block, threshold[0]))
        threshold = _follow(upto, leave, threshold)
    blocks, enters = zip(*found, strict=True) if found else ((), ())
    n = len(blocks)
    columns = {"site": np.full(n, key[0].as_py()), "block": np.array(blocks, "int64"), "enter": np.array(enters, "int64")}
    return pa.table(columns)


def _starts_in_chunk(slide: int):
    def run(key, instants, entry):
        t, starts = np.sort(instants["ts_ms"].to_numpy()), []
        i = np.searchsorted(t, entry["enter"][0].as_py()) if entry.num_rows else len(t)
        while i < len(t):
            starts.append(t[i])
            i = np.searchsorted(t, t[i] + slide)
        return pa.table({"site": np.full(len(starts), key[0].as_py()), "start": np.array(starts, "int64")})

    return run


def anchored_starts(
    events: DataFrame, slide_ms: int, carry: DataFrame | None = None, chunk_ms: int = CHUNK_MS, fan: int = FAN
) -> DataFrame:
    """Starts ``(site, start)`` of the data-dependent slides.

    ``carry (site, carry)`` gives the earliest allowed first start of a site when a stream continues. Chunks are
    ``chunk_ms`` wide whatever the slide is, and at most ``fan`` of their maps meet in a group.
    """
    area = WorkArea(events.sparkSession, "chain")
    instants = events.select(F.col("site").cast("bigint").alias("site"), F.col("ts_ms").cast("bigint").alias("ts_ms"))
    if carry is not None:
        instants = attach(instants, carry, ["site"], how="left").filter("carry is null or ts_ms >= carry").drop("carry")
    # read twice below, and distinct timestamps are few against events
    instants = area.save(instants.distinct().withColumn("chunk", slot_of(F.col("ts_ms"), chunk_ms)), "instants")
    base, top = instants.agg(F.min("chunk"), F.max("chunk")).first()
    if base is None:
        return events.sparkSession.createDataFrame([], _START_SCHEMA)
    instants = instants.select("site", "ts_ms", (F.col("chunk") - base).alias("block"))
    maps = instants.groupBy("site", "block").applyInArrow(_chunk_map(slide_ms, chunk_ms, base), _MAP_SCHEMA)
    parent = F.call_function("div", F.col("block"), F.lit(fan).cast("bigint")).alias("parent")
    levels, blocks, width = [area.save(maps, "maps0")], top - base + 1, chunk_ms
    while blocks > fan:
        blocks, width = -(-blocks // fan), width * fan
        composed = levels[-1].groupBy("site", parent).applyInArrow(_block_map(slide_ms, width, base * chunk_ms), _MAP_SCHEMA)
        levels.append(area.save(composed, f"maps{len(levels)}"))
    floor = F.lit(-(2**62)).cast("bigint").alias("enter")
    enter = levels[-1].select("site", F.lit(0).cast("bigint").alias("parent"), floor).distinct()
    for i, level in enumerate(reversed(levels)):
        below = level.withColumn("parent", parent).groupBy("site", "parent").cogroup(enter.groupBy("site", "parent"))
        enter = area.save(below.applyInArrow(_entries, _ENTRY_SCHEMA), f"enter{i}").withColumnRenamed("block", "parent")
    enter = enter.withColumnRenamed("parent", "block").groupBy("site", "block")
    return instants.groupBy("site", "block").cogroup(enter).applyInArrow(_starts_in_chunk(slide_ms), _START_SCHEMA)


def anchored_label(events: DataFrame, starts: DataFrame, slide_ms: int) -> DataFrame:
    """Add the ``start`` of the slide each event falls into, and what else ``starts`` says of it.

    A slot of one slide's length holds at most one start, so an equi-join on (site, slot) finds it.
    """
    slot = slot_of(F.col("ts_ms"), slide_ms)
    slide = F.struct("start", *[c for c in starts.columns if c not in ("site", "start")])
    own = starts.select("site", slot_of(F.col("start"), slide_ms).alias("slot"), slide.alias("own"))
    slots = (
        events.select("site", slot.alias("slot"), F.lit(None).cast(own.schema["own"].dataType).alias("own"))
        .distinct()
        .unionByName(own)
        .groupBy("site", "slot")
        .agg(F.max("own").alias("own"))
    )
    earlier = Window.partitionBy("site").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("previous", F.last("own", ignorenulls=True).over(earlier))
    joined = events.withColumn("slot", slot).join(slots, ["site", "slot"])
    slide = F.when(F.col("ts_ms") >= F.col("own.start"), F.col("own")).otherwise(F.col("previous"))
    return joined.withColumn("slide", slide).select(*events.columns, "slide.*")


def with_fate(starts: DataFrame, size_ms: int, slide_ms: int) -> DataFrame:
    """Slides with the times of their release and withdrawal, null while unknown.

    A slide is released at the next slide's start and withdrawn by the clean-up of the first slide that
    starts more than one slide later.
    """
    by_site = Window.partitionBy("site").orderBy("start")
    following, second = F.lead("start").over(by_site), F.lead("start", 2).over(by_site)
    withdrawn_by = F.when(following > F.col("start") + slide_ms, following).otherwise(second)
    return starts.select("site", "start", following.alias("released"), (withdrawn_by + (size_ms - slide_ms)).alias("withdrawn"))


def retract_anchored(events: DataFrame, size_ms: int, slide_ms: int) -> DataFrame:
    """Signed stream of an anchored sliding window: rows ``(..., ts_ms = slide start, val, at)``.

    The last slide stays unreleased. ``at`` is the time of emission.
    """
    # one row per slide and site; the events are joined once, with all that is known of their slide
    slides = with_fate(anchored_starts(events, slide_ms), size_ms, slide_ms)
    labelled = anchored_label(events, WorkArea(events.sparkSession, "slides").save(slides, "slides"), slide_ms)
    signed = F.array(
        F.struct(F.col("released").alias("at"), F.col("val").alias("val")),
        F.struct(F.col("withdrawn").alias("at"), (-F.col("val")).alias("val")),
    )
    rest = [c for c in events.columns if c not in ("ts_ms", "val")]
    return labelled.select(*rest, F.col("start").alias("ts_ms"), F.inline(signed)).filter(F.col("at").isNotNull())
