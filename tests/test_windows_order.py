import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgate.operators import ordering, windows


def chain(times, slide):
    starts = []
    for t in sorted(times):
        if not starts or t >= starts[-1] + slide:
            starts.append(t)
    return starts


def events(spark, per_site):
    rows = [(s, int(t), i % 7, 1.0 + i % 3) for s, ts in per_site.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "site bigint, ts_ms bigint, x bigint, val double")


def random_times(seed, n, span):
    return np.random.default_rng(seed).integers(0, span, n).tolist()


@pytest.mark.parametrize("slide, span", [(700, 50_000), (700, 8 * windows.CHUNK_MS), (300_000, 12 * windows.CHUNK_MS), (1_500_000, 40 * windows.CHUNK_MS)])
def test_anchored_starts(spark, slide, span):
    """Slides shorter and longer than a chunk, gaps of empty chunks, and two sites of very different size."""
    per_site = {0: random_times(1, 900, span), 1: random_times(2, 15, span), 2: [5, 5, span * 3]}
    got = {}
    for r in windows.anchored_starts(events(spark, per_site), slide).collect():
        got.setdefault(r["site"], []).append(r["start"])
    assert {s: sorted(v) for s, v in got.items()} == {s: chain(v, slide) for s, v in per_site.items()}


def test_anchored_starts_continue_a_stream(spark):
    times = random_times(3, 300, 100_000)
    early, late = [t for t in times if t < 40_000], [t for t in times if t >= 40_000]
    last = chain(early, 900)[-1]
    carry = spark.createDataFrame([(0, last + 900)], "site bigint, carry bigint")
    got = sorted(r["start"] for r in windows.anchored_starts(events(spark, {0: late}), 900, carry).collect())
    assert chain(early, 900) + got == chain(times, 900)


@pytest.mark.parametrize("slide, span", [(40, 30_000), (2_500, 60_000), (20_000, 200_000)])
def test_anchored_starts_over_several_levels(spark, slide, span):
    """Narrow chunks, two maps a group, times on both sides of zero; one site has nearly all rows."""
    per_site = {0: [t - span // 2 for t in random_times(21, 1500, span)], 1: random_times(22, 5, span), 2: [-7]}
    found = windows.anchored_starts(events(spark, per_site), slide, chunk_ms=512, fan=2).collect()
    for site, times in per_site.items():
        assert sorted(r["start"] for r in found if r["site"] == site) == chain(times, slide)


def test_step_maps_stay_small():
    """A map has no steps beyond what can be met, and one where all ways have come together."""
    times = np.unique(random_times(23, 5_000, 100_000))
    import pyarrow as pa

    maps = []
    for block in range(10):
        own = times[(times >= block * 10_000) & (times < (block + 1) * 10_000)]
        maps.append(windows._chunk_map(300, 10_000, 0)((pa.scalar(0), pa.scalar(block)), pa.table({"ts_ms": own})))
    whole = windows._block_map(300, 100_000, 0)((pa.scalar(0), pa.scalar(0)), pa.concat_tables(maps))
    assert whole.num_rows <= (times < 300).sum() + 1
    for enter in range(0, 299, 7):
        last = chain([t for t in times if t >= enter], 300)[-1]
        assert windows._follow(whole["upto"].to_numpy(), whole["leave"].to_numpy(), np.array([enter]))[0] == last + 300


def test_anchored_starts_behind_a_late_carry(spark):
    """Rows far before the carried threshold don't start a slide, nor do they hide it."""
    df = events(spark, {0: [5, 900, 41_000, 41_500, 60_000]})
    carry = spark.createDataFrame([(0, 40_900)], "site bigint, carry bigint")
    assert sorted(r["start"] for r in windows.anchored_starts(df, 900, carry).collect()) == [41_000, 60_000]
    assert windows.anchored_starts(df.limit(0), 900).collect() == []


def test_retract_anchored(spark):
    size, slide = 5_000, 1_000
    times = sorted(random_times(4, 120, 60_000))
    df = events(spark, {0: times})
    starts = chain(times, slide)
    label = {t: max(s for s in starts if s <= t) for t in times}
    expected = []
    for i, t in enumerate(times):
        s = label[t]
        after = [n for n in starts if n > s]
        if after:
            expected.append((s, i % 7, 1.0 + i % 3, after[0]))
        withdraw = [n for n in starts if n > s + slide]
        if withdraw:
            expected.append((s, i % 7, -(1.0 + i % 3), withdraw[0] + size - slide))
    got = [(r["ts_ms"], r["x"], r["val"], r["at"]) for r in windows.retract_anchored(df, size, slide).collect()]
    assert sorted(got) == sorted(expected)


def test_aligned_retraction_keeps_the_window_sum(spark):
    df = windows.with_slot(events(spark, {0: random_times(5, 200, 20_000)}), 1_000)
    totals = df.groupBy("site", "slot").agg(F.sum("val").alias("v"))
    moved = {r["slot"]: r["v"] for r in windows.retract(totals, 4).groupBy("slot").agg(F.sum("v").alias("v")).collect()}
    by_slot = {r["slot"]: r["v"] for r in totals.collect()}
    for s in range(0, 30):
        assert sum(v for k, v in moved.items() if k <= s) == pytest.approx(sum(by_slot.get(k, 0) for k in range(s - 3, s + 1)))


def test_pane_delta_reports_disappearing_keys(spark):
    totals = spark.createDataFrame([(0, 1, 5, 2.0), (0, 1, 6, 2.0), (0, 2, 5, 1.0)], "site bigint, x bigint, slot bigint, v double")
    got = {(r["x"], r["slot"]): r["v"] for r in windows.pane_delta(totals, ("site", "x")).collect()}
    assert got == {(1, 5): 2.0, (1, 7): -2.0, (2, 5): 1.0, (2, 6): -1.0}


def test_window_size_must_fit(spark):
    with pytest.raises(ValueError):
        windows.slots_per_window(1000, 300)


def test_sliding_totals(spark):
    df = events(spark, {0: [0, 10, 25], 1: [31]})
    got = {(r["site"], r["window_start_ms"]): r["n"] for r in windows.sliding_totals(df, 20, 10).collect()}
    assert got == {(0, -10): 1, (0, 0): 2, (0, 10): 2, (0, 20): 1, (1, 20): 1, (1, 30): 1}


@pytest.mark.parametrize("size, slide, span", [(1_000, 5, 9_000), (60, 20, 5_000), (50, 50, 3_000), (40, 5, 200)])
def test_sliding_aggregates(spark, size, slide, span):
    """Many windows a pane, few, one, and times on both sides of zero."""
    rng = np.random.default_rng(span)
    rows = [(int(s), int(t) - span // 2, 0, float(v)) for s, t, v in zip(rng.integers(0, 2, 60), rng.integers(0, span, 60), rng.integers(-9, 9, 60))]
    want = {}
    for s, t, _, v in rows:
        for w in range((t // slide) - size // slide + 1, t // slide + 1):
            want.setdefault((s, w * slide), []).append(v)
    df = spark.createDataFrame(rows, "site bigint, ts_ms bigint, x bigint, val double")
    got = {(r[0], r[1]): tuple(r)[2:] for r in windows.sliding_aggregates(df, size, slide).collect()}
    assert got == {k: (len(v), sum(v), min(v), max(v)) for k, v in want.items()}


def test_global_rank_with_one_dominant_value(spark):
    """A third of the rows share one timestamp."""
    rng = np.random.default_rng(6)
    ts = np.where(rng.random(3000) < 0.34, 777, rng.integers(0, 1000, 3000))
    df = spark.createDataFrame([(int(t), i) for i, t in enumerate(ts)], "t bigint, id bigint")
    ranked = ordering.global_rank(df, ("t", "id"), partitions=6)
    rows = ranked.orderBy("rn").select("rn", "t", "id", "seg").collect()
    assert [r["rn"] for r in rows] == list(range(1, 3001))
    assert [(r["t"], r["id"]) for r in rows] == sorted((int(t), i) for i, t in enumerate(ts))
    largest = ranked.groupBy("seg").count().agg(F.max("count")).first()[0]
    assert largest < 1000


def test_segments_split_what_one_column_cannot(spark):
    """All rows share a time and most share the next column; only the third tells them apart. Nothing else is stored."""
    rows = [(5, 1 if i % 10 else i, i) for i in range(2000)] + [(-(10**12), 3, 1), (10**12, 3, 1)]
    df = spark.createDataFrame(rows, "t bigint, u int, id bigint")
    cut, sizes = ordering.segments(df, ("t", "u", "id"), rows=100)
    found = cut.collect()
    seg = {r.seg: r.n for r in sizes.collect()}
    assert max(seg.values()) <= 100 and sum(seg.values()) == len(rows) and sorted(seg) == list(range(len(seg)))
    assert [tuple(r)[:3] for r in sorted(found, key=lambda r: (r.seg, r.t, r.u, r.id))] == sorted(rows)
    assert ordering.segments(df.limit(0), ("t", "u", "id"))[0].count() == 0
    with pytest.raises(TypeError):
        ordering.segments(df.withColumn("t", F.lit("x")), ("t", "id"))


def test_rank_within_a_dominant_key(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SEGMENT_BYTES", 2_000)
    rng = np.random.default_rng(8)
    rows = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 9, 1500) // 6, rng.integers(0, 50, 1500)))]
    df = spark.createDataFrame(rows, "k bigint, t bigint, id bigint")
    got = {r.id: r.nth for r in ordering.rank_within(df, ["k"], ("t", "id"), "nth").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        want |= {i: n + 1 for n, (_, i) in enumerate(sorted((t, i) for x, t, i in rows if x == k))}
    assert got == want


def test_running_sum_of_a_dominant_key(spark):
    rng = np.random.default_rng(7)
    rows = [(i, int(k), int(v)) for i, (k, v) in enumerate(zip(np.where(rng.random(2000) < 0.4, 1, rng.integers(2, 50, 2000)), rng.integers(1, 9, 2000)))]
    df = spark.createDataFrame(rows, "id bigint, k bigint, v bigint")
    got = ordering.running_sum(ordering.global_rank(df, ("id",)), F.col("v"), "total", ["k"])
    seen, expected = {}, {}
    for i, k, v in rows:
        seen[k] = expected[i] = seen.get(k, 0) + v
    assert {r["id"]: r["total"] for r in got.collect()} == expected


def test_f2_checkpoints(spark):
    rng = np.random.default_rng(8)
    xs = np.where(rng.random(1203) < 0.4, 1, rng.integers(2, 90, 1203)).tolist()
    df = spark.createDataFrame([(i, i * 10, x, 1.0) for i, x in enumerate(xs)], "id bigint, ts_ms bigint, x bigint, val double")
    got = {r["rn"]: r["f2"] for r in ordering.f2_checkpoints(ordering.global_rank(df, ("ts_ms", "id")), 100, 0.5).collect()}
    expected = {}
    for rn in range(1, 1204, 100):
        _, n = np.unique(xs[:rn], return_counts=True)
        expected[rn] = float((n * n).sum()) / 4
    assert got == expected


COLUMNS = ("site", "ts_ms", "x", "val", "at")


def add_file(df, source):
    """One more file of a stream, later than those before."""
    df.coalesce(1).write.mode("append").parquet(source)
    time.sleep(1.1)


def files_stream(spark, df, source):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)


@pytest.mark.parametrize("parts", [1, 3])
def test_anchored_stream_equals_batch(spark, tmp_path, parts):
    """Three files, one micro-batch each."""
    from driftgate.streaming.windows import anchored_stream

    times = sorted(random_times(9, 150, 60_000))
    df, source = events(spark, {0: times, 1: times[::3]}), str(tmp_path / "in")
    for part in ("ts_ms < 15000", "ts_ms >= 15000 and ts_ms < 15500", "ts_ms >= 15500"):
        add_file(df.filter(part), source)
    query, run = anchored_stream(files_stream(spark, df, source), str(tmp_path / "root"), 5_000, 1_000, parts=parts)
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 2
    expected = windows.retract_anchored(df, 5_000, 1_000).select(*COLUMNS).collect()
    assert sorted(run.output().select(*COLUMNS).collect()) == sorted(expected)


def test_anchored_stream_goes_on_after_a_stop(spark, tmp_path):
    """The second query has nothing but the checkpoint of the first."""
    from driftgate.streaming.windows import anchored_stream

    times = sorted(random_times(12, 90, 40_000))
    df, source = events(spark, {0: times, 1: times[::2]}), str(tmp_path / "in")
    for part in ("ts_ms < 20000", "ts_ms >= 20000"):
        add_file(df.filter(part), source)
        query, run = anchored_stream(files_stream(spark, df, source), str(tmp_path / "root"), 5_000, 1_000)
        query.awaitTermination()
    expected = windows.retract_anchored(df, 5_000, 1_000).select(*COLUMNS).collect()
    assert sorted(run.output().select(*COLUMNS).collect()) == sorted(expected)


def test_late_event_joins_the_current_slide(spark, tmp_path):
    from driftgate.streaming.windows import anchored_stream

    source = str(tmp_path / "in")
    for times in ([100, 3000], [200], [4100]):
        add_file(events(spark, {0: times}), source)
    query, run = anchored_stream(files_stream(spark, events(spark, {0: [1]}), source), str(tmp_path / "root"), 5_000, 1_000)
    query.awaitTermination()
    got = sorted((r["ts_ms"], r["val"], r["at"]) for r in run.output().collect())
    first = [(100, -1.0, 7000), (100, 1.0, 3000)]
    second = [(3000, -2.0, 8100), (3000, -1.0, 8100), (3000, 1.0, 4100), (3000, 2.0, 4100)]
    assert got == first + second


def test_withdrawals_wait_for_the_watermark(spark, tmp_path):
    """With timers a withdrawal appears once the watermark has passed its time, and never before."""
    from driftgate.streaming.windows import anchored_stream

    times = sorted(random_times(13, 120, 60_000))
    df, source = events(spark, {0: times, 1: times[::4]}), str(tmp_path / "in")
    expected = windows.retract_anchored(df, 5_000, 1_000).select(*COLUMNS).collect()
    seen = 0
    for low in range(0, 60_000, 20_000):
        add_file(df.filter(f"ts_ms >= {low} and ts_ms < {low + 20_000}"), source)
        query, run = anchored_stream(files_stream(spark, df, source), str(tmp_path / "root"), 5_000, 1_000, lateness_ms=0)
        query.awaitTermination()
        newest = max(t for t in times if t < low + 20_000)
        got = run.output().select(*COLUMNS).collect()
        # the batch's rows up to the watermark; releases are told at once
        batch = windows.retract_anchored(df.filter(f"ts_ms < {low + 20_000}"), 5_000, 1_000).select(*COLUMNS).collect()
        assert sorted(got) == sorted(r for r in batch if r["val"] > 0 or r["at"] <= newest)
        assert len(got) > seen
        seen = len(got)
    assert sorted(got) == sorted(r for r in expected if r["val"] > 0 or r["at"] <= times[-1])


def test_state_written_follows_the_batch(spark, tmp_path):
    """A micro-batch adds to the state what it brings: rows updated in the store don't follow what is held."""
    from driftgate.streaming.windows import anchored_stream

    df, source = events(spark, {0: range(0, 900)}), str(tmp_path / "in")  # one slide, held throughout
    for low in range(0, 900, 100):
        df.filter(f"ts_ms >= {low} and ts_ms < {low + 100}").coalesce(1).write.mode("append").parquet(source)
    query, _ = anchored_stream(files_stream(spark, df, source), str(tmp_path / "root"), 5_000, 1_000)
    query.awaitTermination()
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]]
    assert len(updated) == 9 and len(set(updated[1:])) == 1
