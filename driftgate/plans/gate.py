"""The drift gate: publish a new answer only when local drift could have broken the error bound.

Within a round the estimate is fixed, so one job gives phi for every site and slot of a look-ahead range, and
one more for each subround finds the first slot in which the counters pass the budget. Increments up to there and the
last phi of each site reach the driver, a few numbers a site, whatever the range's length; a look-ahead of at most
``SCALARS_HELD`` numbers is replayed on the driver instead. At a round's end a job folds its drift into the estimate.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from driftgate.operators.counters import counter_growth, subround_progress
from driftgate.operators.joins import attach
from driftgate.operators.windows import slots_per_window, with_slot
from driftgate.plans.spec import MonitorSpec, Zone, named_spec
from driftgate.session import WorkArea

LAMBDA = 0.5
BLOCK_SLOTS = 256
#: Up to so many blocks are written by the tasks that summed them, each task a file a block; more are gathered by block first.
BLOCKS_SPREAD = 16
#: Rows of a look-ahead's series: sites times slots.
SERIES_ROWS = 1_000_000
#: Up to so many the driver replays them itself.
SCALARS_HELD = 512
LOG_ROWS_HELD = 200_000

ESTIMATE_SCHEMA = "round bigint, ts bigint, estimate double"
CENTRE_SCHEMA = "seq bigint, realTS bigint, eventTS bigint, metricType string"
SITE_SCHEMA = "seq bigint, realTS bigint, eventTS bigint, nodeID bigint, eventType string, gained bigint"
LOG_SCHEMAS = {"estimates": ESTIMATE_SCHEMA, "centre": CENTRE_SCHEMA, "site": SITE_SCHEMA}


@dataclass(frozen=True)
class GateConfig:
    k: int
    slide_ms: int
    warmup_ms: int = 60_000
    mqf: float = 0.01
    rebalance: bool = False
    lookahead: int = 32


@dataclass
class GateState:
    """Everything the driver knows: O(k) scalars. Site ids in the maps are text, so that it survives JSON."""

    round: int = 0
    closed: int | None = None  # last slot inside the estimate
    drift_from: int | None = None  # drifts count slots after this one
    pos: int | None = None  # last slot walked
    until_warm: int | None = None
    last_ts: int = 0
    zone: Zone | None = None
    quantum: float = 0.0
    growth: int = 0
    lam: float = 1.0
    psi_beta: float = 0.0
    span: int = 0
    seq: int = 0  # of the last log row
    start_z: float = 0.0
    z: dict[str, float] = field(default_factory=dict)
    phi: dict[str, float] = field(default_factory=dict)
    counter: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "GateState":
        return GateState(**json.loads(text))


@dataclass
class Log:
    """Decisions of the gate: answers, ends of rounds and subrounds, and growing counters of sites."""

    estimates: list[tuple] = field(default_factory=list)
    centre: list[tuple] = field(default_factory=list)
    site: list[tuple] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.estimates) + len(self.centre) + len(self.site)


class Gate:
    """Walks slot deltas ``(site, slot, keys, values)`` forward from a state."""

    def __init__(self, spec: MonitorSpec, config: GateConfig, work: WorkArea, state: GateState | None = None):
        self.spec, self.config, self.work = spec, config, work
        self.state = state or GateState()
        self.log = Log()
        self.scalars = 0
        self.batch = 0  # of a stream; log parts of different micro-batches never meet
        self.parts = 0
        self._estimate: DataFrame | None = None
        self._drift: str | None = None  # table of the open round's drift up to pos, once the round is long

    # -- tables

    def _range(self, deltas: DataFrame, after: int | None, upto: int) -> DataFrame:
        within = [f"slot <= {upto}"] + ([] if after is None else [f"slot > {after}"])
        if "block" in deltas.columns:  # prunes files
            within += [f"block <= {upto // BLOCK_SLOTS}"]
            within += [] if after is None else [f"block >= {after // BLOCK_SLOTS}"]
        return deltas.filter(" and ".join(within)).select("site", "slot", *self.spec.keys, *self.spec.values)

    def estimate(self) -> DataFrame:
        if self._estimate is None:
            self._estimate = self.work.load(f"estimate-{self.state.round}")
        return self._estimate

    def _open_drift(self, deltas: DataFrame, upto: int) -> DataFrame:
        """Changes since the sites last started from zero; a folded part sits at the last walked slot."""
        if self._drift is None:
            return self._range(deltas, self.state.drift_from, upto)
        return self.work.load(self._drift).unionByName(self._range(deltas, self.state.pos, upto))

    def _fold(self, deltas: DataFrame, upto: int) -> None:
        """Sum a long round's changes per cell, so that the next job does not read them again."""
        at = F.lit(upto).cast("bigint")
        folded = self.spec.collect_cells(self._open_drift(deltas, upto).withColumn("slot", at), ("site", "slot"))
        name = f"drift-{self.state.round}-{upto}"
        self.work.save(folded, name)
        self._forget_drift()
        self._drift = name

    def _forget_drift(self) -> None:
        if self._drift is not None:
            self.work.drop(self._drift)
            self._drift = None

    def _at_centre(self, metric: str) -> None:
        self.state.seq += 1
        self.log.centre.append((self.state.seq, int(time.time() * 1000), self.state.last_ts, metric))

    def _at_site(self, node: int, event: str, gained: int) -> None:
        self.state.seq += 1
        self.log.site.append((self.state.seq, int(time.time() * 1000), self.state.last_ts, node, event, gained))

    def flush(self, least: int = 1) -> None:
        """Move the log out of the driver once it has ``least`` rows."""
        if len(self.log) < least:
            return
        for name, schema in LOG_SCHEMAS.items():
            rows = getattr(self.log, name)
            if rows:
                table = self.work.spark.createDataFrame(rows, schema)
                self.work.save(table, f"{name}/batch={self.batch}/part={self.parts}")
                rows.clear()
        self.parts += 1

    def log_table(self, name: str) -> DataFrame:
        rest = self.work.spark.createDataFrame(getattr(self.log, name), LOG_SCHEMAS[name])
        return stored_log(self.work, name).unionByName(rest) if self.parts else rest

    # -- rounds

    def _close(self, deltas: DataFrame, slot: int) -> None:
        """Fold the drifts up to ``slot`` into the estimate, publish, and start the next round."""
        st, k = self.state, self.config.k
        drift = self._range(deltas, st.closed, slot)
        previous = st.round
        if previous:
            merged = self.spec.add(self.estimate(), drift)
        else:
            merged = self.spec.collect_cells(drift)
        st.round += 1
        self._estimate = self.work.save(merged, f"estimate-{st.round}")
        self._obsolete(previous)
        zone = self.spec.zone(self._estimate, k)
        st.zone = zone
        st.closed = st.drift_from = st.pos = slot
        st.last_ts = slot * self.config.slide_ms
        st.lam, st.psi_beta, st.growth = 1.0, 0.0, 0
        st.z, st.phi, st.counter = {}, {}, {}
        ts = st.last_ts
        self._at_centre("ROUND")
        self.log.estimates.append((st.round, ts, self.spec.answer(zone) if zone else 0.0))
        if zone:
            st.start_z = self.spec.phi_at_zero(zone)
            st.quantum = st.start_z / 2

    def _obsolete(self, round_: int) -> None:
        """An estimate that no later step reads."""
        if round_:
            self.work.drop(f"estimate-{round_}")

    def _rebalance(self, deltas: DataFrame, slot: int) -> bool:
        """Keep the summed drift at the centre and give the sites a fresh start; False if that is unsafe."""
        st, k = self.state, self.config.k
        mu = (1 - LAMBDA) * k
        summed = self._range(deltas, st.closed, slot).withColumns(
            {"site": F.lit(0).cast("bigint"), "slot": F.lit(slot).cast("bigint")}
        )
        balance = self.spec.collect_cells(summed, ("site", "slot"))
        scored = self.spec.phi_series(balance, self.estimate(), st.zone, k=k, weight=1.0 / mu).first()
        st.psi_beta = mu * (scored["phi"] if scored else st.start_z)
        st.lam, st.drift_from = LAMBDA, slot
        st.z, st.phi, st.counter, st.growth = {}, {}, {}, 0
        self._at_centre("REBALANCED_ROUND")
        return self._next_subround(k * LAMBDA * st.start_z)

    def _next_subround(self, psi: float) -> bool:
        """Compare the summed phi with the threshold; start a subround if the total is still safe."""
        st, k = self.state, self.config.k
        budget = psi + st.psi_beta
        if budget < self.config.mqf * k * st.start_z:
            return False
        st.quantum = budget / (2 * k)
        st.growth = 0
        fresh = st.lam * st.start_z
        st.z = {str(i): st.phi.get(str(i), fresh) for i in range(k)}
        st.counter = {}
        return True

    def _walk(self, rows: Iterator) -> int | None:
        """Replay counters over ``(slot, site, phi)`` in slot order; the slot at which the round is over."""
        st, k = self.state, self.config.k
        current = None
        for row in rows:
            if current is not None and row["slot"] != current and self._end_of_slot():
                return current
            current = row["slot"]
            st.last_ts = current * self.config.slide_ms
            site = str(row["site"])
            phi = st.phi[site] = row["phi"]
            z = st.z.get(site, st.lam * st.start_z)
            gained = int((z - phi) / st.quantum) - st.counter.get(site, 0)
            if gained > 0:
                st.counter[site] = st.counter.get(site, 0) + gained
                st.growth += gained
                self._at_site(row["site"], "SENT_INCREMENT", gained)
        if current is not None and self._end_of_slot():
            return current
        return None

    def _search(self, series: DataFrame) -> int | None:
        """The same as ``_walk`` for a stored series of any length, one job a subround."""
        after = self.state.pos
        while True:
            slot = self._first_crossing(series, after)
            if slot is None:
                return None
            if self._end_of_slot():
                return slot
            after = slot

    def _first_crossing(self, series: DataFrame, after: int) -> int | None:
        """Apply a subround's increments behind ``after`` up to the slot that passes the budget, or all if none does.

        The job returns at most one increment for each unit of the budget, one for each site of the last slot, and one
        phi for each site.
        """
        st, k = self.state, self.config.k
        fresh = st.lam * st.start_z
        sites = [(i, st.z.get(str(i), fresh), st.counter.get(str(i), 0)) for i in range(k)]
        known = self.work.spark.createDataFrame(sites, "site bigint, z double, so_far bigint")
        rest = attach(series.filter(F.col("slot") > after), known, ["site"], row_bound=k)
        growth = counter_growth(rest, F.col("z"), st.quantum, F.col("so_far")).filter("gained > 0")
        crossed = subround_progress(growth, k - st.growth).filter("over").agg(F.min("slot"))
        upto = F.coalesce(crossed.scalar(), F.lit(2**62).cast("bigint"))
        none = F.lit(None)
        gains = growth.filter(F.col("slot") <= upto).select("site", "slot", "gained", none.cast("double").alias("phi"))
        last = rest.filter(F.col("slot") <= upto).groupBy("site").agg(
            F.max("slot").alias("slot"), none.cast("bigint").alias("gained"), F.max_by("phi", "slot").alias("phi")
        )
        rows = sorted(gains.unionByName(last).collect(), key=lambda r: (r["slot"], r["site"]))
        self.scalars += len(rows)
        for row in rows:
            st.last_ts = max(st.last_ts, row["slot"] * self.config.slide_ms)
            site = str(row["site"])
            if row["gained"] is None:
                st.phi[site] = row["phi"]
                continue
            st.counter[site] = st.counter.get(site, 0) + row["gained"]
            st.growth += row["gained"]
            self._at_site(row["site"], "SENT_INCREMENT", row["gained"])
        return rows[-1]["slot"] if st.growth > k else None

    def _end_of_slot(self) -> bool:
        """True if the subround ended in this slot and the drifts are needed."""
        st, k = self.state, self.config.k
        if st.growth <= k:
            return False
        self._at_centre("SUBROUND")
        fresh = st.lam * st.start_z
        return not self._next_subround(sum(st.phi.get(str(i), fresh) for i in range(k)))

    # -- driver

    def advance(self, deltas: DataFrame, last: int) -> GateState:
        """Walk all slots up to ``last``."""
        st, cfg = self.state, self.config
        if st.until_warm is None:
            first = deltas.agg(F.min("slot")).first()[0]
            if first is None:
                return st
            st.until_warm = first + max(-(-cfg.warmup_ms // cfg.slide_ms), 1) - 1
        if st.round == 0 and st.until_warm <= last:
            filled = self._range(deltas, None, st.until_warm).agg(F.max("slot")).first()[0]
            self._close(deltas, filled)
            st.pos = max(st.pos, st.until_warm)
        if st.round == 0:
            return st
        most = max(SERIES_ROWS // cfg.k, 1)
        reach = min(st.span or cfg.lookahead, most)
        while st.pos < last:
            if st.zone is None:  # an empty vector has no zone: publish again with the next data
                nxt = self._range(deltas, st.pos, last).agg(F.min("slot")).first()[0]
                if nxt is None:
                    st.pos = last
                else:
                    self._close(deltas, nxt)
                    self.flush(LOG_ROWS_HELD)
                continue
            hi = min(st.pos + reach, last)
            series = self.spec.phi_series(
                self._open_drift(deltas, hi), self.estimate(), st.zone, st.lam, cfg.k
            ).filter(F.col("slot") > st.pos)
            if (hi - st.pos) * cfg.k <= SCALARS_HELD:
                rows = sorted(series.collect(), key=lambda r: (r["slot"], r["site"]))
                self.scalars += len(rows)
                over = self._walk(iter(rows))
            else:
                over = self._search(self.work.save(series, "phi"))
                self.work.drop("phi")
            self.flush(LOG_ROWS_HELD)
            if over is None:
                if 2 * reach > most and hi < last:
                    self._fold(deltas, hi)
                st.pos = hi
                reach = min(2 * reach, most)
                continue
            length = over - st.drift_from
            st.pos = over
            self._forget_drift()
            if cfg.rebalance and st.lam == 1.0 and self._rebalance(deltas, over):
                pass
            else:
                self._close(deltas, over)
            reach = st.span = min(max(2 * length, 8), most)
            self.flush(LOG_ROWS_HELD)
        self._forget_drift()
        return st


def stored_log(work: WorkArea, name: str) -> DataFrame:
    """All flushed parts of a log."""
    schema = StructType.fromDDL(f"{LOG_SCHEMAS[name]}, batch bigint, part bigint")
    if not work.exists(name):
        return work.spark.createDataFrame([], LOG_SCHEMAS[name])
    return work.load(name, schema).drop("batch", "part")


def slot_deltas(spec: MonitorSpec, slotted: DataFrame, n_slots: int | None = None) -> DataFrame:
    """Cell changes per (site, slot); a window of ``n_slots`` slots adds the withdrawals."""
    deltas = spec.collect_cells(spec.contributions(slotted), ("site", "slot"))
    if n_slots is None:
        return deltas
    return spec.collect_cells(withdrawals(spec, deltas, n_slots, keep=True), ("site", "slot"))


def withdrawals(spec: MonitorSpec, deltas: DataFrame, n_slots: int, keep: bool = False) -> DataFrame:
    """Slot totals leaving the window ``n_slots`` later, with or without the totals themselves."""
    kept = F.struct("slot", *spec.values)
    gone = F.struct((F.col("slot") + n_slots).alias("slot"), *[(-F.col(v)).alias(v) for v in spec.values])
    copies = F.array(kept, gone) if keep else F.array(gone)
    return deltas.select("site", *spec.keys, F.inline(copies)).select("site", "slot", *spec.keys, *spec.values)


@dataclass
class MonitorResult:
    estimates: DataFrame
    centre_log: DataFrame
    site_log: DataFrame
    throughput: DataFrame
    state: GateState
    cells: int  # slot deltas held as a table
    scalars: int  # numbers that reached the driver


def by_block(deltas: DataFrame, slotted: DataFrame) -> DataFrame:
    """Deltas with their ``block`` of slots, to be written by block.

    A task sorts what it writes, so few blocks stay dealt by cell; gathering them by block would leave all to a few tasks.
    """
    first, last = slotted.agg(F.min("slot"), F.max("slot")).first()
    blocks = 0 if first is None else last // BLOCK_SLOTS - first // BLOCK_SLOTS + 1
    named = deltas.withColumn("block", F.expr(f"floor(slot / {BLOCK_SLOTS})"))
    return named if blocks <= BLOCKS_SPREAD else named.hint("rebalance", "block")


def throughput(slotted: DataFrame, slide_ms: int, clock: Column | None = None) -> DataFrame:
    """Cumulative source events per site and slot, at most one row per slot of a site.

    ``realTS`` is the time of the query, or ``clock``, an expression of ``slot`` and ``site``.
    """
    counts = slotted.groupBy("site", "slot").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        (F.unix_millis(F.current_timestamp()) if clock is None else clock).alias("realTS"),
        (F.col("slot") * slide_ms).alias("eventTS"),
        F.col("site").alias("nodeID"),
        F.expr("sum(n) over (partition by site order by slot)").alias("events"),
    )


def monitor(
    events: DataFrame,
    k: int,
    slide_ms: int,
    eps: float = 0.2,
    query: str | MonitorSpec = "f2",
    window_ms: int | None = None,
    warmup_ms: int = 60_000,
    rebalance: bool = False,
    mqf: float = 0.01,
    shape=None,
    total: bool = False,
    lookahead: int = 32,
) -> MonitorResult:
    """Gated run over a table of events ``(site, ts_ms, x, val)``; the join query also needs ``rel``.

    Answers are those of the mean vector over the k sites, or of the sum with ``total``.
    """
    spec = named_spec(query, eps, shape)
    spark = events.sparkSession
    work = WorkArea(spark, "gate")
    slotted = with_slot(events, slide_ms)
    n_slots = slots_per_window(window_ms, slide_ms) if window_ms else None
    stored = work.save(by_block(slot_deltas(spec, slotted, n_slots), slotted), "deltas", partition_by="block")
    last, cells = stored.agg(F.max("slot"), F.count(F.lit(1))).first()
    gate = Gate(spec, GateConfig(k, slide_ms, warmup_ms, mqf, rebalance, lookahead), work)
    if last is not None:
        gate.advance(stored, last - (n_slots or 0))  # withdrawals after the last event are not walked
    gate._obsolete(gate.state.round)
    work.drop("deltas")
    answers = gate.log_table("estimates")
    return MonitorResult(
        answers.withColumn("estimate", F.col("estimate") * F.lit(float(k * k))) if total else answers,
        gate.log_table("centre"),
        gate.log_table("site"),
        throughput(slotted, slide_ms),
        gate.state,
        cells,
        gate.scalars,
    )
