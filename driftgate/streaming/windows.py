"""The anchored sliding window over a stream, on Spark's state store.

A stateful operator keeps for each site the current slide and the rows of slides that are still needed. New rows of a
slide are added as one more packed piece, so a micro-batch writes what it brings and never rewrites what is held; the
store's changelog and snapshots below the checkpoint are what a restart or a lost executor comes back to.

Withdrawals appear as soon as the slide that causes them is known and say in ``at`` when they take effect; a site then holds
its last two or three slides only. With ``lateness_ms`` they are held until the watermark has passed ``at``, by an event-time timer, so a
consumer sees the window's true content at any watermark; a site then holds one window.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from driftgate.session import WorkArea

# tasks get the processor with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class AnchoredSlides(StatefulProcessor):
    """Signed rows of one site, or of one part of its rows."""

    def __init__(self, size_ms: int, slide_ms: int, columns: list[str], timed: bool):
        self.size, self.slide, self.columns, self.timed = size_ms, slide_ms, columns, timed

    def init(self, handle) -> None:
        self.handle = handle
        # slides whose withdrawal is not known yet, and in how many pieces their rows are held
        self.open = handle.getMapState("open", "start bigint", "pieces int, released boolean")
        self.held = handle.getMapState("held", "start bigint, piece int", "rows binary")
        # withdrawals to come: when, and of which slide
        self.due = handle.getMapState("due", "at bigint, start bigint", "pieces int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)  # what one micro-batch brings of the site
        times = np.unique(batch["ts_ms"].to_numpy())
        known = {k[0]: v for k, v in self.open.iterator()}
        chain = sorted(known)
        i = np.searchsorted(times, chain[-1] + self.slide) if chain else 0
        now = chain[-1:]
        while i < len(times):
            now.append(int(times[i]))
            i = np.searchsorted(times, times[i] + self.slide)
        fresh = now[1:] if chain else now
        # a late row joins the slide that is current when its micro-batch begins
        place = np.maximum(np.searchsorted(np.array(now), batch["ts_ms"].to_numpy(), "right") - 1, 0)
        pieces = {s: known[s][0] if s in known else 0 for s in chain + fresh}
        mine = batch["mine"].to_numpy(bool)
        for n in np.unique(place[mine]).tolist():
            start = now[n]
            self.held.updateValue((start, pieces[start]), (_packed(batch.loc[mine & (place == n), self.columns]),))
            pieces[start] += 1
        chain += fresh
        for n, start in enumerate(chain):
            following, second = (chain[n + j] if n + j < len(chain) else None for j in (1, 2))
            if following is not None and not (start in known and known[start][1]):
                yield from self._signed(start, pieces[start], 1, following)
            cause = following if following is not None and following > start + self.slide else second
            if cause is None:
                self.open.updateValue((start,), (pieces[start], following is not None))
                continue
            if start in known:
                self.open.removeKey((start,))
            at = cause + self.size - self.slide
            if self.timed and at > timerValues.getCurrentWatermarkInMs():
                self.due.updateValue((at, start), (pieces[start],))
                self.handle.registerTimer(at)
            else:
                yield from self._withdrawn(start, pieces[start], at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        for (when, start), (pieces,) in list(self.due.iterator()):
            if when == at:
                yield from self._withdrawn(start, pieces, at)
                self.due.removeKey((when, start))

    def _signed(self, start: int, pieces: int, sign: int, at: int) -> Iterator[pd.DataFrame]:
        """One piece of a slide in memory at a time."""
        for piece in range(pieces):
            rows = _unpacked(self.held.getValue((start, piece))[0])
            yield rows.assign(ts_ms=start, val=sign * rows["val"], at=at)[[*self.columns, "ts_ms", "at"]]

    def _withdrawn(self, start: int, pieces: int, at: int) -> Iterator[pd.DataFrame]:
        yield from self._signed(start, pieces, -1, at)
        for piece in range(pieces):
            self.held.removeKey((start, piece))

    def close(self) -> None:
        pass


def anchored_rows(
    events: DataFrame, size_ms: int, slide_ms: int, lateness_ms: int | None = None, parts: int = 1
) -> DataFrame:
    """Signed rows ``(..., ts_ms = slide start, val, at)`` of a stream ``(site, ts_ms, val, ...)``.

    A late row joins the site's current slide. With ``lateness_ms`` withdrawals wait for the watermark, and rows
    later than that are dropped by it; without, none is dropped.

    ``parts`` splits the rows held of every site over as many keys, for sites too hot for one task: each part follows the whole
    chain of timestamps, and holds its share of the rows. Timestamps then travel ``parts`` times, rows once.
    """
    spark = events.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)
    columns = [c for c in events.columns if c != "ts_ms"]
    timed = lateness_ms is not None
    if timed:
        events = events.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", f"{lateness_ms} milliseconds")
    own = F.pmod(F.xxhash64(*columns, "ts_ms"), F.lit(parts))
    rows = events.withColumns({"part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "own": own})
    rows = rows.withColumn("mine", F.col("part") == F.col("own")).drop("own")
    if parts > 1:
        rows = rows.withColumns({c: F.when(F.col("mine"), F.col(c)) for c in columns if c != "site"})
    fields = {f.name: f for f in events.schema}
    schema = StructType([fields[c] for c in columns]).add("ts_ms", "long").add("at", "long")
    for field in schema:
        field.nullable = True
    worker = AnchoredSlides(size_ms, slide_ms, columns, timed)
    signed = rows.groupBy("site", "part").transformWithStateInPandas(
        worker, schema, "Append", "EventTime" if timed else "None"
    )
    rest = [c for c in columns if c != "val"]
    return signed.select(*rest, "ts_ms", "val", "at")


class AnchoredOutput:
    """Where a windowed stream writes, below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.work = WorkArea(spark, "window", root.rstrip("/"))

    def output(self) -> DataFrame:
        """Signed rows ``(..., ts_ms = slide start, val, at)`` written so far."""
        return self.work.load("signed")


def anchored_stream(
    events: DataFrame,
    root: str,
    size_ms: int,
    slide_ms: int,
    lateness_ms: int | None = None,
    parts: int = 1,
    **trigger,
) -> tuple[StreamingQuery, AnchoredOutput]:
    """Run ``anchored_rows`` into files; state, progress and output lie below ``root``, and a restart goes on there."""
    run = AnchoredOutput(events.sparkSession, root)
    query = (
        anchored_rows(events, size_ms, slide_ms, lateness_ms, parts)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{run.work.path}/checkpoint")
        .option("path", f"{run.work.path}/signed")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    return query, run
