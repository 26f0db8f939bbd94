import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgate import ExactF2, GateConfig, MonitorSpec, SketchJoin, SketchShape, WorkArea, monitor, monitor_stream
from driftgate.operators.counters import counter_growth, subround_progress
from driftgate.plans.gate import Gate, GateState
from protocol import Cap, Join, walk

K, SLIDE = 3, 1000


@pytest.fixture(scope="module")
def rows():
    """Three sites; one key makes up a third of the records and the mix shifts half way."""
    rng = np.random.default_rng(17)
    out = []
    for i in range(2000):
        t = int(i * 13 + rng.integers(0, 13))
        x = 1 if rng.random() < 0.34 else int(rng.integers(0, 25) + (25 if i > 1000 else 0))
        out.append((int(rng.choice(K, p=[0.6, 0.3, 0.1])), t, x, 1.0, int(rng.integers(0, 2))))
    return out


@pytest.fixture(scope="module")
def events(spark, rows):
    return spark.createDataFrame(rows, "site bigint, ts_ms bigint, x bigint, val double, rel bigint")


def exact_deltas(rows, window=None):
    deltas = {}
    for site, t, x, v, _ in rows:
        for slot, sgn in ((t // SLIDE, 1), (t // SLIDE + window, -1)) if window else ((t // SLIDE, 1),):
            deltas.setdefault(slot, {}).setdefault(site, np.zeros(60))[x] += sgn * v
    return deltas


def outcome(result):
    return [(r["round"], r["ts"] // SLIDE, r["estimate"]) for r in result.estimates.orderBy("round").collect()]


@pytest.mark.parametrize("eps", [0.15, 0.4])
@pytest.mark.parametrize("rebalance", [False, True])
def test_exact_run_equals_plain_walk(events, rows, eps, rebalance):
    deltas = exact_deltas(rows)
    expected, subrounds = walk(Cap(eps), deltas, K, 2, max(deltas), rebalance=rebalance)
    result = monitor(events, K, SLIDE, eps, "exact", warmup_ms=3000, rebalance=rebalance, lookahead=4)
    got = outcome(result)
    assert [g[:2] for g in got] == [e[:2] for e in expected] and len(got) > 3
    assert [g[2] for g in got] == pytest.approx([e[2] for e in expected])
    kinds = {r["metricType"]: r["count"] for r in result.centre_log.groupBy("metricType").count().collect()}
    assert kinds["ROUND"] == len(expected) and kinds["SUBROUND"] == subrounds


def test_long_rounds_and_logs_leave_the_driver(events, rows, monkeypatch):
    """With room for four slots per job and few log rows, drifts are folded and logs spilled; nothing changes."""
    from driftgate.plans import gate

    deltas = exact_deltas(rows)
    expected, subrounds = walk(Cap(0.5), deltas, K, 2, max(deltas), rebalance=True)
    monkeypatch.setattr(gate, "SERIES_ROWS", 4 * K)
    monkeypatch.setattr(gate, "LOG_ROWS_HELD", 10)
    result = monitor(events, K, SLIDE, 0.5, "exact", warmup_ms=3000, rebalance=True)
    assert [g[:2] for g in outcome(result)] == [e[:2] for e in expected]
    assert result.centre_log.filter("metricType = 'SUBROUND'").count() == subrounds
    assert result.site_log.select("seq").unionByName(result.centre_log.select("seq")).distinct().count() == (
        result.site_log.count() + result.centre_log.count()
    )


def test_windowed_run_equals_plain_walk(events, rows):
    last = max(t for _, t, *_ in rows) // SLIDE
    expected, _ = walk(Cap(0.2), exact_deltas(rows, 8), K, 2, last)
    got = outcome(monitor(events, K, SLIDE, 0.2, "exact", window_ms=8 * SLIDE, warmup_ms=3000))
    assert [g[:2] for g in got] == [e[:2] for e in expected] and len(got) > 3
    assert [g[2] for g in got] == pytest.approx([e[2] for e in expected])


def test_join_run_equals_plain_walk(events, rows):
    shape = SketchShape(3, 40)
    prime = 2**31 - 1
    deltas = {}
    for site, t, x, v, rel in rows:
        sk = deltas.setdefault(t // SLIDE, {}).setdefault(site, np.zeros((2, 3, 40)))
        for d, (b1, b0, s3, s2, s1, s0) in enumerate(shape.coefficients()):
            sgn = 1 - 2 * ((((s3 * x + s2) * x + s1) * x + s0) % prime % 2)
            sk[rel, d, (b1 * x + b0) % prime % 40] += v * sgn
    expected, _ = walk(Join(0.4), deltas, K, 4, max(deltas))
    got = outcome(monitor(events, K, SLIDE, 0.4, SketchJoin(0.4, shape), warmup_ms=5000))
    assert [g[:2] for g in got] == [e[:2] for e in expected] and len(got) > 2
    assert [g[2] for g in got] == pytest.approx([e[2] for e in expected])


def test_published_answers_stay_within_the_bound(events, rows):
    """Between rounds the true F2 of the mean vector never leaves the zone by more than one slot's worth."""
    eps = 0.3
    got = outcome(monitor(events, K, SLIDE, eps, "exact", warmup_ms=3000))
    deltas = exact_deltas(rows)
    truth, v = {}, np.zeros(60)
    for s in range(max(deltas) + 1):
        v = v + sum(deltas.get(s, {}).values()) / K
        truth[s] = float(v @ v)
    for (_, start, q), (_, end, _) in zip(got, got[1:]):
        assert q == pytest.approx(truth[start])
        for s in range(start, end):
            assert (1 - eps) ** 2 * q <= truth[s] <= (1 + eps) ** 2 * q


def test_total_scales_the_answer(events):
    mean = outcome(monitor(events, K, SLIDE, 0.3, "exact", warmup_ms=3000))
    total = outcome(monitor(events, K, SLIDE, 0.3, "exact", warmup_ms=3000, total=True))
    assert [t[2] for t in total] == pytest.approx([9 * m[2] for m in mean])


def test_no_events_no_rounds(events):
    assert monitor(events.limit(0), K, SLIDE, 0.3, "exact").estimates.count() == 0


def test_warmup_lasts_until_there_is_something_to_monitor(spark):
    """The first slots cancel out, so the first real answer comes later."""
    rows = [(0, 100, 1, 1.0), (1, 200, 1, -1.0), (0, 1100, 2, 4.0), (1, 2500, 2, 4.0), (0, 5100, 3, 9.0)]
    df = spark.createDataFrame(rows, "site bigint, ts_ms bigint, x bigint, val double")
    got = outcome(monitor(df, 2, SLIDE, 0.2, "exact", warmup_ms=1000))
    assert got[0][2] == 0.0 and got[1][1:] == (1, 4.0)


def fresh_gate(spark, k=4, **state):
    base = dict(round=1, closed=0, drift_from=0, pos=0, zone={"norm": 10.0, "f2": 100.0}, start_z=2.0, quantum=1.0)
    return Gate(ExactF2(0.2), GateConfig(k, SLIDE), WorkArea(spark, "t"), GateState(**{**base, **state}))


def test_round_budget_and_increment(spark):
    assert ExactF2(0.2).phi_at_zero({"norm": 10.0, "f2": 100.0}) == 2.0
    gate = fresh_gate(spark, start_z=3.0)
    assert gate._walk(iter([{"slot": 1, "site": 0, "phi": 1.5}])) is None
    assert gate.state.counter == {"0": 1} and gate.state.growth == 1


def test_subround_ends_only_above_k(spark):
    gate = fresh_gate(spark)
    gate.state.growth = 4
    assert not gate._end_of_slot() and gate.state.growth == 4
    gate.state.growth = 5
    assert not gate._end_of_slot()  # still safe: a new subround starts
    assert gate.state.growth == 0 and gate.state.quantum == 1.0


def test_round_test(spark):
    gate = fresh_gate(spark)
    assert not gate._next_subround(-4.0)
    assert gate._next_subround(4.0) and gate.state.quantum == 0.5


def test_state_survives_json():
    state = GateState(round=3, closed=5, zone={"norm": 1.5, "f2": 2.25}, phi={"1": 0.5}, counter={"1": 2})
    assert GateState.from_json(state.to_json()) == state


def test_counter_growth(spark):
    series = spark.createDataFrame(
        [(0, 1, 1.9), (0, 2, 0.4), (0, 3, 1.2), (1, 2, -2.0), (1, 3, -2.6)], "site bigint, slot bigint, phi double"
    )
    growth = counter_growth(series, 2.0, 0.5)
    assert {(r["site"], r["slot"]): (r["counter"], r["gained"]) for r in growth.collect()} == {
        (0, 1): (0, 0), (0, 2): (3, 3), (0, 3): (3, 0), (1, 2): (8, 8), (1, 3): (9, 1)
    }
    progress = {r["slot"]: (r["total"], r["over"]) for r in subround_progress(growth, 11).collect()}
    assert progress == {1: (0, False), 2: (11, False), 3: (12, True)}


class WeightSum(MonitorSpec):
    """A user-defined query: the total weight W, kept within eps by the linear zone eps*W - |X|."""

    eps = 0.25

    def contributions(self, events):
        return events.select("site", "slot", F.lit(0).cast("bigint").alias("x"), F.col("val").alias("v"))

    def zone(self, estimate, k=1):
        w = estimate.agg(F.sum("v")).first()[0]
        return {"w": w / k} if w else None

    def answer(self, zone):
        return zone["w"]

    def phi_at_zero(self, zone):
        return self.eps * zone["w"]

    def score(self, sums, zone):
        drift = F.col("along_v") / zone["w"]  # one cell with e = W
        return sums.select("site", "slot", (F.lit(self.eps * zone["w"]) - F.abs(drift)).alias("phi"))


@pytest.mark.parametrize("query, options", [("exact", {}), ("f2", {"rebalance": True}), ("exact", {"window_ms": 8 * SLIDE})])
def test_crossings_found_in_the_job(events, monkeypatch, query, options):
    """The same decisions and logs, and scalars that follow subrounds instead of slots."""
    from driftgate.plans import gate

    shape = SketchShape(3, 30) if query == "f2" else None
    runs = []
    for held in (10**9, 0):
        monkeypatch.setattr(gate, "SCALARS_HELD", held)
        runs.append(monitor(events, K, SLIDE, 0.3, query, warmup_ms=3000, shape=shape, lookahead=32, **options))
    whole, found = runs
    assert outcome(found) == outcome(whole) and len(outcome(whole)) > 2
    for name, column in (("centre_log", "metricType"), ("site_log", "gained")):
        logs = [sorted(tuple(r) for r in getattr(run, name).select("seq", "eventTS", column).collect()) for run in runs]
        assert logs[0] == logs[1]


def test_scalars_follow_subrounds(spark, monkeypatch):
    """Many slots without a decision: the driver gets a few numbers a look-ahead, not one for each slot."""
    from driftgate.plans import gate

    monkeypatch.setattr(gate, "SCALARS_HELD", 0)
    rows = [(i % K, i * 100, i % 5, 1.0) for i in range(3000)]
    calm = spark.createDataFrame(rows, "site bigint, ts_ms bigint, x bigint, val double")
    run = monitor(calm, K, 100, 3.0, "exact", warmup_ms=100_000, lookahead=2048)
    subrounds = run.centre_log.count()
    assert run.scalars <= 4 * K * (subrounds + 4) < 3000


def test_user_defined_query(events, rows):
    got = outcome(monitor(events, K, SLIDE, query=WeightSum(), warmup_ms=3000))
    counts = {s: sum(1 for r in rows if r[1] // SLIDE <= s) / K for s in range(50)}
    assert len(got) > 3 and all(q == pytest.approx(counts[s]) for _, s, q in got)


@pytest.mark.parametrize("options", [{}, {"rebalance": True, "window_ms": 8 * SLIDE}])
def test_stream_equals_batch(spark, events, tmp_path, options):
    """Three files, one per micro-batch; finishing walks the open slots."""
    source = str(tmp_path / "in")
    for i in range(3):
        part = events.filter(f"ts_ms div 9000 = {i}" if i < 2 else "ts_ms >= 18000")
        part.coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query, run = monitor_stream(stream, str(tmp_path / "root"), K, SLIDE, 0.3, "exact", warmup_ms=3000, **options)
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 2
    run.finish()
    run.finish()
    got = [(r["round"], r["ts"] // SLIDE, r["estimate"]) for r in run.output().orderBy("round").collect()]
    expected = outcome(monitor(events, K, SLIDE, 0.3, "exact", warmup_ms=3000, **options))
    assert got == expected and len(got) > 3


def stream_run(spark, path, n_slots=None, **options):
    from driftgate.streaming.monitor import StreamMonitor

    return StreamMonitor(spark, str(path), ExactF2(0.3), GateConfig(K, SLIDE, 3000), n_slots, **options)


def test_logs_of_micro_batches_stay_apart(spark, events, tmp_path, monkeypatch):
    """A tiny limit makes parts within each of four batches; every row is read back, numbers are unique."""
    from driftgate.plans import gate

    whole = monitor(events, K, SLIDE, 0.3, "exact", warmup_ms=3000)
    monkeypatch.setattr(gate, "LOG_ROWS_HELD", 3)
    run = stream_run(spark, tmp_path)
    for i in range(3):
        run.process(events.filter(f"ts_ms div 9000 = {i}" if i < 2 else "ts_ms >= 18000"), i)
    run.finish()
    for name, log in (("centre", whole.centre_log), ("site", whole.site_log)):
        cols = ["seq", "eventTS", "metricType" if name == "centre" else "eventType"]
        assert sorted(run.output(name).select(cols).collect()) == sorted(log.select(cols).collect())
    seq = run.output("centre").select("seq").unionByName(run.output("site").select("seq"))
    assert seq.count() == seq.distinct().count() > 10
    assert len(run.work.names("centre/batch=1")) > 1


def test_late_events_join_the_first_open_slot(spark, events, tmp_path):
    late = F.col("ts_ms") % 7 == 0
    part = F.least(F.floor(F.col("ts_ms") / 9000), F.lit(2))
    moved = events.withColumn("part", F.least(part + late.cast("int"), F.lit(2)))
    run, open_ = stream_run(spark, tmp_path), None
    expected = []
    for i in range(3):
        batch = moved.filter(F.col("part") == i).drop("part")
        run.process(batch, i)
        at = F.col("ts_ms") if open_ is None else F.greatest("ts_ms", F.lit(open_ * SLIDE))
        expected.append(batch.withColumn("ts_ms", at))
        newest = max(batch.agg(F.max("ts_ms")).first()[0], (open_ or 0) * SLIDE)
        open_ = newest // SLIDE
    run.finish()
    whole = expected[0].unionByName(expected[1]).unionByName(expected[2])
    assert whole.count() == events.count()
    got = [(r["round"], r["ts"] // SLIDE, r["estimate"]) for r in run.output().orderBy("round").collect()]
    assert got == outcome(monitor(whole, K, SLIDE, 0.3, "exact", warmup_ms=3000))


def test_allowed_lateness_keeps_slots_open(spark, events, tmp_path):
    run = stream_run(spark, tmp_path, lateness_ms=30 * 60_000)
    for i in (1, 0):  # out of order, within the allowed lateness
        run.process(events.filter(f"ts_ms div 12000 = {i}" if i else "ts_ms div 12000 <> 1"), 1 - i)
    run.finish()
    got = [(r["round"], r["ts"] // SLIDE, r["estimate"]) for r in run.output().orderBy("round").collect()]
    assert got == outcome(monitor(events, K, SLIDE, 0.3, "exact", warmup_ms=3000))


def test_bytes_written_follow_the_batch(spark, tmp_path):
    """Ever new keys in one open round: a micro-batch writes its own cells, and merges add a logarithm of them."""
    run = stream_run(spark, tmp_path)
    n, rounds, written = 200, None, []
    first = spark.createDataFrame([(i % K, i, -1, 5_000.0) for i in range(8 * SLIDE)], "site bigint, ts_ms bigint, x bigint, val double")
    run.process(first, 0)
    for i in range(1, 10):
        rows = [(j % K, (8 + i) * SLIDE + j, i * n + j, 1.0) for j in range(n)]
        run.process(spark.createDataFrame(rows, "site bigint, ts_ms bigint, x bigint, val double"), i)
        written.append(run.cells_written)
        rounds = run.output().count() if i == 1 else rounds
    assert run.output().count() == rounds  # the last one is still open
    plain = written[2:]
    assert sorted(plain)[len(plain) // 2] <= 2 * n and sum(plain) <= n * len(plain) * 4
    assert len(run.work.names("drift")) <= 6


def test_missing_state_fails(spark, events, tmp_path):
    with pytest.raises(RuntimeError, match="micro-batch 6"):
        stream_run(spark, tmp_path).process(events, 7)


def test_repeated_micro_batch_changes_nothing(spark, events, tmp_path, monkeypatch):
    run = stream_run(spark, tmp_path / "root", 8)
    early, late = events.filter("ts_ms < 12000"), events.filter("ts_ms >= 12000")
    run.process(early, 0)
    before = run.output().orderBy("round").collect()
    run.process(early, 0)
    assert run.output().orderBy("round").collect() == before
    commit = run.work.save_text
    monkeypatch.setattr(run.work, "save_text", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):  # fails after its output, before its state
        run.process(late, 1)
    first = run.output().orderBy("round").collect()
    monkeypatch.setattr(run.work, "save_text", commit)
    run.process(late, 1)
    assert run.output().orderBy("round").collect() == first
    assert [r["round"] for r in first] == list(range(1, len(first) + 1)) and len(first) >= len(before) > 0
    run.finish()
    got = [(r["round"], r["ts"] // SLIDE, r["estimate"]) for r in run.output().orderBy("round").collect()]
    assert got == outcome(monitor(events, K, SLIDE, 0.3, "exact", window_ms=8 * SLIDE, warmup_ms=3000))


@pytest.mark.parametrize("k", [3, 10])
def test_same_bits_under_any_partitioning(spark, events, k):
    runs = []
    for parts in ("3", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        resited = events.withColumn("site", F.col("site") % k)
        runs.append(outcome(monitor(resited, k, SLIDE, 0.3, "f2", warmup_ms=3000, shape=SketchShape(5, 40))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert runs[0] == runs[1] and len(runs[0]) > 1


def test_few_blocks_stay_dealt_by_cell(spark):
    """Deltas of one block are not gathered in one task, which would sort them all."""
    from driftgate.plans import gate

    slotted = spark.range(4000).selectExpr("id % 4 as site", "id % 20 as slot", "id as x", "1.0D as v")
    deltas = gate.slot_deltas(ExactF2(0.2), slotted.withColumnRenamed("v", "val"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = gate.by_block(deltas, slotted)
        rows = dealt.groupBy("block", F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in rows) == 4000 and {r.block for r in rows} == {0}
    assert len(rows) == 4 and max(r["count"] for r in rows) < 2000
    wide = slotted.withColumn("slot", F.col("x") * gate.BLOCK_SLOTS)  # 4,000 blocks: no block is cut
    dealt = gate.by_block(gate.slot_deltas(ExactF2(0.2), wide.withColumnRenamed("v", "val")), wide)
    assert dealt.select("block", F.spark_partition_id().alias("task")).distinct().count() == 4000
