"""The drift gate over a stream; no event is lost.

Each micro-batch is summed to slot totals. A slot is complete once the newest event time seen, less the allowed
lateness, lies in a later slot; complete slots are walked by the same gate as in a batch run. An event that comes later
than that joins the first open slot. ``finish`` walks the slots that are still open when the source has ended.

What a micro-batch needs from the past is a list of runs, tables that are written once: totals of slots as they came,
and the open round's drift. A micro-batch adds its own runs, and ``FAN`` runs of one size become one of the next, so a cell is
written again only as often as the logarithm of the number of batches. The list is versioned by batch id, so a
repeated batch starts from the same state and replaces its own output. If that past is missing the batch fails.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from driftgate.operators.windows import slots_per_window, with_slot
from driftgate.plans.gate import LOG_SCHEMAS, Gate, GateConfig, GateState, stored_log, withdrawals
from driftgate.plans.spec import MonitorSpec, named_spec
from driftgate.session import WorkArea


FAN = 4


class _StreamGate(Gate):
    """Keeps replaced estimates until the batch that replaced them has been committed."""

    def __init__(self, *args):
        super().__init__(*args)
        self.replaced: list[int] = []

    def _obsolete(self, round_: int) -> None:
        if round_:
            self.replaced.append(round_)


class StreamMonitor:
    """State and output tables of one gated stream under ``root``.

    Runs are named by the batch that wrote them: ``pending`` has totals of slots that may be open, ``drift`` the open round's
    changes, ``window`` the totals of the slots a batch walked. Window tables are read again only when their slots leave.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        spec: MonitorSpec,
        config: GateConfig,
        n_slots: int | None,
        lateness_ms: int = 0,
    ):
        self.work = WorkArea(spark, "stream", root.rstrip("/"))
        self.spec, self.config, self.n_slots, self.lateness_ms = spec, config, n_slots, lateness_ms
        self.cells_written = 0  # by the last micro-batch, into runs

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of events ``(site, ts_ms, x, val)``."""
        if self.work.complete(f"state/{batch_id}"):
            return
        if self.work.complete("finished"):
            raise RuntimeError("this stream has been finished")
        past, self.cells_written = self._past(batch_id - 1), 0
        slotted = with_slot(batch, self.config.slide_ms)
        if past["walked"] is not None:
            slotted = slotted.withColumn("slot", F.greatest("slot", F.lit(past["walked"] + 1).cast("bigint")))
        batch.persist()
        try:
            newest = batch.agg(F.max("ts_ms")).first()[0]
            fresh = self.spec.collect_cells(self.spec.contributions(slotted), ("site", "slot"))
            fresh = self._write(fresh, f"pending/{batch_id}")
            low, high = fresh.agg(F.min("slot"), F.max("slot")).first()
        finally:
            batch.unpersist()
        if newest is not None:
            past["newest"] = max(newest, past["newest"] if past["newest"] is not None else newest)
            past["pending"] = [*past["pending"], {"name": f"pending/{batch_id}", "level": 0, "low": low, "high": high}]
        upto = None
        if past["newest"] is not None:
            upto = (past["newest"] - self.lateness_ms) // self.config.slide_ms - 1
        self._step(past, upto, batch_id)

    def finish(self) -> None:
        """The source has ended: walk the slots that are still open. The stream can't be continued afterwards."""
        if self.work.complete("finished"):
            return
        done = [int(n) for n in self.work.names("state") if self.work.complete(f"state/{n}")]
        if not done:
            return
        past = self._past(max(done))
        if past["pending"]:
            self.cells_written = 0
            self._step(past, max(run["high"] for run in past["pending"]), max(done) + 1)
        self.work.save_text("done", "finished")

    @property
    def _columns(self) -> list[str]:
        return ["site", "slot", *self.spec.keys, *self.spec.values]

    def _write(self, cells: DataFrame, name: str) -> DataFrame:
        """Store a run and count its cells."""
        seen = Observation()
        observed = cells.select(*self._columns).observe(seen, F.count(F.lit(1)).alias("n"))
        stored = self.work.save(observed, name)
        self.cells_written += seen.get["n"]
        return stored

    def _past(self, batch_id: int) -> dict:
        if batch_id < 0:
            return {"gate": GateState(), "walked": None, "newest": None, "windows": [], "drift": [], "pending": []}
        if not self.work.complete(f"state/{batch_id}"):
            raise RuntimeError(f"the state of micro-batch {batch_id} is missing below {self.work.path}")
        past = json.loads(self.work.load_text(f"state/{batch_id}"))
        return past | {"gate": GateState(**past["gate"])}

    def _read(self, runs: list[dict]) -> DataFrame | None:
        """All rows of runs; totals of one cell in several of them are not added up yet."""
        tables = [self.work.load(run["name"]) for run in runs]
        return reduce(DataFrame.unionByName, tables) if tables else None

    def _merged(self, runs: list[dict], name: str, of_slot: Column | None = None) -> list[dict]:
        """Runs after merges: as long as the last ``FAN`` are of one size they become one."""
        n = 0
        while len(runs) >= FAN and len({run["level"] for run in runs[-FAN:]}) == 1:
            last, runs, n = runs[-FAN:], runs[:-FAN], n + 1
            rows = self._read(last)
            if of_slot is not None:
                rows = rows.withColumn("slot", of_slot)
            self._write(self.spec.collect_cells(rows, ("site", "slot")), f"{name}m{n}")
            made = {"name": f"{name}m{n}", "level": last[0]["level"] + 1}
            runs = [*runs, made | {"low": min(r["low"] for r in last), "high": max(r["high"] for r in last)}]
        return runs

    def _step(self, past: dict, upto: int | None, batch_id: int) -> None:
        """Walk the slots up to ``upto`` and write everything the next batch needs, the state last."""
        work, spec, state, walked = self.work, self.spec, past["gate"], past["walked"]
        for name in LOG_SCHEMAS:  # what a failed attempt left
            work.drop(f"{name}/batch={batch_id}")
        gate = _StreamGate(spec, self.config, work, state)
        gate.batch = batch_id
        pending, drift, windows = past["pending"], past["drift"], past["windows"]
        known = {run["name"] for run in (*pending, *drift)}
        if upto is not None and (walked is None or upto > walked):
            moved = self._ready(pending, walked, upto)
            if self.n_slots:
                moved, windows = self._windowed(moved, windows, walked, upto, batch_id)
            # read by every job of the walk and by the new run
            moved = work.save(moved.select(*self._columns), f"walk/{batch_id}")
            closed, open_ = state.closed, self._read(drift)
            gate.advance(moved if open_ is None else open_.unionByName(moved), upto)
            if state.closed != closed:
                drift = []  # all of it lies in the estimate
            drift = self._with_run(drift, moved, state, upto, batch_id)
            pending, walked = [run for run in pending if run["high"] > upto], upto
            work.drop(f"walk/{batch_id}")
        pending = self._merged(pending, f"pending/{batch_id}")
        gate.flush()
        gone = [w for w in windows if walked is not None and w[2] <= walked - (self.n_slots or 0)]
        record = {
            "gate": json.loads(state.to_json()),
            "walked": walked,
            "newest": past["newest"],
            "windows": [w for w in windows if w not in gone],
            "drift": drift,
            "pending": pending,
        }
        work.save_text(json.dumps(record), f"state/{batch_id}")
        # the batch is committed: free what no repetition needs
        for round_ in gate.replaced:
            work.drop(f"estimate-{round_}")
        work.drop(f"state/{batch_id - 2}")
        for name in known - {run["name"] for run in (*pending, *drift)}:
            work.drop(name)
        for b, *_ in gone:
            work.drop(f"window/{b}")

    def _ready(self, pending: list[dict], walked: int | None, upto: int) -> DataFrame:
        """Totals of the slots to walk now."""
        rows = self._read([run for run in pending if run["low"] <= upto])
        if rows is None:
            return self.work.load(pending[0]["name"]).limit(0) if pending else self._nothing()
        rows = rows.filter(F.col("slot") <= upto)
        rows = rows if walked is None else rows.filter(F.col("slot") > walked)
        return self.spec.collect_cells(rows, ("site", "slot"))

    def _nothing(self) -> DataFrame:
        """An empty table of cells; no run is left to take the types from."""
        names = [int(n) for n in self.work.names("window") if self.work.complete(f"window/{n}")]
        if names:
            return self.work.load(f"window/{max(names)}").limit(0)
        kinds = {"site": "bigint", "slot": "bigint"} | dict.fromkeys(self.spec.values, "double")
        return self.work.spark.createDataFrame([], ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in self._columns))

    def _windowed(self, ready: DataFrame, windows: list, walked: int | None, upto: int, batch_id: int):
        """The totals with the withdrawals due now, and the list of window tables."""
        ready = self.work.save(ready.select(*self._columns), f"window/{batch_id}")
        low, high = ready.agg(F.min("slot"), F.max("slot")).first()
        if low is not None:
            windows = [*windows, [batch_id, low, high]]
        # a slot leaves n_slots later; windows apart from that range are not read
        first = None if walked is None else walked - self.n_slots
        moved = ready
        for b, low, high in windows:
            if low <= upto - self.n_slots and (first is None or high > first):
                gone = withdrawals(self.spec, self.work.load(f"window/{b}", ready.schema), self.n_slots)
                gone = gone.filter(F.col("slot") <= upto)
                moved = moved.unionByName(gone if walked is None else gone.filter(F.col("slot") > walked))
        return self.spec.collect_cells(moved, ("site", "slot")), windows

    def _with_run(self, drift: list[dict], moved: DataFrame, state: GateState, upto: int, batch_id: int) -> list[dict]:
        """The open round's runs with this batch's: one total per cell and site, split where a rebalance cut it.

        During warm-up totals sit at the last slot that has data, where the first answer will be published.
        """
        if state.closed is None:
            at = moved.agg(F.max("slot")).first()[0]
            if at is None:
                return drift
            at = max([at, *[run["high"] for run in drift]])
            slot = F.lit(at).cast("bigint")
        else:
            at, cut = upto, F.lit(state.drift_from).cast("bigint")
            slot = F.when(F.col("slot") <= cut, cut).otherwise(F.lit(upto).cast("bigint"))
            moved = moved.filter(F.col("slot") > state.closed)
            if state.closed == upto:
                return drift
        self._write(self.spec.collect_cells(moved.withColumn("slot", slot), ("site", "slot")), f"drift/{batch_id}")
        run = {"name": f"drift/{batch_id}", "level": 0, "low": at, "high": at}
        return self._merged([*drift, run], f"drift/{batch_id}", slot)

    def output(self, name: str = "estimates") -> DataFrame:
        """Everything written so far: ``estimates``, ``centre`` or ``site``."""
        return stored_log(self.work, name)


def monitor_stream(
    events: DataFrame,
    root: str,
    k: int,
    slide_ms: int,
    eps: float = 0.2,
    query: str | MonitorSpec = "f2",
    window_ms: int | None = None,
    warmup_ms: int = 60_000,
    rebalance: bool = False,
    mqf: float = 0.01,
    shape=None,
    lateness_ms: int = 0,
    lookahead: int = 32,
    **trigger,
) -> tuple[StreamingQuery, StreamMonitor]:
    """Start the gated query on a stream of events ``(site, ts_ms, x, val)``.

    ``root`` is a folder all executors reach; it holds checkpoint, state and output. The default trigger
    drains what is available and stops; call ``finish`` when nothing more will come.
    """
    config = GateConfig(k, slide_ms, warmup_ms, mqf, rebalance, lookahead)
    n_slots = slots_per_window(window_ms, slide_ms) if window_ms else None
    run = StreamMonitor(events.sparkSession, root, named_spec(query, eps, shape), config, n_slots, lateness_ms)
    query_ = (
        events.writeStream.option("checkpointLocation", f"{run.work.path}/checkpoint")
        .foreachBatch(run.process)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    return query_, run
