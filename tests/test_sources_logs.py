import pytest
from pyspark.sql import functions as F

from driftgate import monitor
from driftgate.operators import logs, profiles
from driftgate.sources import access_log, sinks, synthetic
from driftgate.streaming.watermarks import closed_windows

LINES = ["897429601;7;11;500;GET;200;2;5", "897429603;8;12;70;GET;404;4;-1", "EOF"]


def text(spark, lines):
    return spark.createDataFrame([(v,) for v in lines], "value string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_lines_become_events(spark):
    got = rows(access_log.parse_lines(text(spark, LINES), 4), "site", "ts_ms", "a", "b", "x", "val")
    assert got == [(1, 897429601000, 7, 2, 219, 1.0), (3, 897429603000, 8, 4, 252, 1.0)]


@pytest.mark.parametrize("bad", ["897429601;seven;11;500;GET;200;2;5", "897429601;7;11", "a;7;11;500;GET;200;2;5"])
def test_malformed_lines(spark, bad):
    lines = text(spark, [LINES[0], bad])
    with pytest.raises(Exception, match="(?i)malformed"):
        access_log.parse_lines(lines, 4).collect()
    assert access_log.parse_lines(lines, 4, "PERMISSIVE").count() == 1


def test_files_batch_and_stream(spark, tmp_path):
    for i in range(2):
        text(spark, LINES).coalesce(1).write.mode("append").text(str(tmp_path / "log"))
    batch = access_log.read_files(spark, str(tmp_path / "log"), 4)
    query = (
        access_log.stream_files(spark, str(tmp_path / "log"), 4)
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "*") == rows(batch, "*") and batch.count() == 4


def test_lines_round_trip(spark):
    fields = spark.sql("select 5L timestamp, 1 clientID, 'o' objectID, '9' size, 'GET' method, '200' status, 3 type, 6 server")
    assert access_log.to_lines(fields).first()["value"] == "5;1;o;9;GET;200;3;6"


def test_synthetic_events(spark):
    df = synthetic.generate(spark, 20_000, start_ms=1000, records=30_000, records_per_sec=10, key_range=50, gap=5, sites=8, block=1000)
    stats = df.agg(F.max("a"), F.min("a"), F.max("site"), F.count_distinct("site"), F.min("ts_ms"), F.max("ts_ms")).first()
    assert list(stats)[:5] == [49, 0, 7, 8, 1000] and stats[5] <= 1000 + 30_000 * 100
    times = [r["ts_ms"] for r in df.orderBy("id").collect()]
    steps = {(b - a) // 100 for a, b in zip(times, times[1:])}
    assert steps == {1, 2, 3, 4, 5} and 9_500 < len(times) < 10_500
    again = synthetic.generate(spark.newSession(), 20_000, start_ms=1000, records=30_000, key_range=50, sites=8)
    assert again.agg(F.sum("ts_ms")).first() == df.agg(F.sum("ts_ms")).first()


def test_synthetic_stream_schema(spark):
    df = synthetic.stream(spark)
    assert df.isStreaming and df.columns == ["site", "ts", "ts_ms", "a", "b", "val"]


def test_sinks(spark, tmp_path):
    data = [(i % 2, i * 100, i % 5, 1.0) for i in range(100)]
    result = monitor(spark.createDataFrame(data, "site bigint, ts_ms bigint, x bigint, val double"), 2, 1000, 0.3, "exact", warmup_ms=1000)
    sinks.write_estimates(result.estimates, str(tmp_path / "est"))
    sinks.write_estimates(result.estimates, str(tmp_path / "est"))
    back = spark.read.schema("ts bigint, estimate double").csv(str(tmp_path / "est"))
    assert rows(back, "*") == rows(result.estimates, "ts", "estimate")
    for n in (1, 2):
        sinks.write_logs(result, str(tmp_path / "logs"))
        assert spark.read.parquet(str(tmp_path / "logs" / "centre")).count() == n * result.centre_log.count()
    last = spark.read.parquet(str(tmp_path / "logs" / "throughput")).groupBy("nodeID").agg(F.max("events").alias("n"))
    assert rows(last, "*") == [(0, 50), (1, 50)]


def test_text_hash(spark):
    """Known values of the 31-polynomial with 32-bit wrap-around."""
    got = text(spark, ["99", "Aa", "BB", "polygenelubricants", ""]).select("value", profiles.text_hash(F.col("value")).alias("h"))
    assert dict(rows(got, "*")) == {"99": 1824, "Aa": 2112, "BB": 2112, "polygenelubricants": -2147483648, "": 0}


def test_site_profiles(spark):
    servers = "99 98 66 67 0 2 64 33 1 4 71 73 5 72 68 65 3 38 34 37 69 36 35 40 39 70".split()
    df = spark.createDataFrame([(int(s),) for s in servers], "server bigint")
    cover = {(r["hash"], r["k"]): r["sites_hit"] for r in profiles.site_coverage(df, "server").collect()}
    assert all(cover["raw", k] == len({int(s) % k for s in servers}) for k in range(2, 28))
    assert {h for h, _ in cover} == {"raw", "text_hash", "double_text_hash", "md5", "sha"}
    assert sum(r["records"] for r in profiles.site_load(df, "server", 5).collect()) == 26


def test_increments_over_many_segments(spark, monkeypatch):
    """One node has most rows, and periods run over several segments."""
    import random

    from driftgate.operators import ordering

    monkeypatch.setattr(ordering, "SEGMENT_BYTES", 3_000)
    rng, kinds = random.Random(4), ["SENT_INCREMENT"] * 12 + ["RECEIVED_ESTIMATE", "RECEIVED_QUANTUM", "OTHER"]
    log = [(i, rng.randrange(300), rng.choice([0, 0, 0, 0, 1, 2]), rng.choice(kinds)) for i in range(1200)]
    df = spark.createDataFrame(log, "seq bigint, realTS bigint, nodeID bigint, eventType string")
    for marks in (["RECEIVED_ESTIMATE"], ["RECEIVED_ESTIMATE", "RECEIVED_QUANTUM"]):
        want = set()
        for node in range(3):
            open_ = period = 0
            for _, _, kind in sorted((t, i, e) for i, t, n, e in log if n == node):
                if kind in marks:
                    period += 1
                    want.add((node, period, open_))
                    open_ = 0
                open_ += kind == "SENT_INCREMENT"
        assert {tuple(r) for r in logs.increments_between(df, marks).collect()} == want


def test_increments_between_marks(spark):
    kinds = ["SENT_INCREMENT", "SENT_INCREMENT", "RECEIVED_ESTIMATE", "EVENT", "RECEIVED_ESTIMATE", "SENT_INCREMENT", "RECEIVED_QUANTUM", "SENT_INCREMENT"]
    log = spark.createDataFrame([(i, i * 10, 0, k) for i, k in enumerate(kinds)], "seq bigint, realTS bigint, nodeID bigint, eventType string")
    per_round = logs.increments_between(log, ["RECEIVED_ESTIMATE"])
    assert rows(per_round, "nodeID", "period", "increments") == [(0, 1, 2), (0, 2, 0)]
    per_subround = logs.increments_between(log, ["RECEIVED_ESTIMATE", "RECEIVED_QUANTUM"])
    assert rows(per_subround, "period", "increments") == [(1, 2), (2, 0), (3, 1)]
    assert [r[1] for r in rows(logs.cumulative_increments(log), "seq", "increments")] == [1, 2, 3, 4]


def test_throughput_series(spark):
    log = spark.createDataFrame(
        [(1, 0, 0, 1), (2, 500, 0, 4), (3, 2100, 0, 10), (4, 7000, 0, 13)], "seq bigint, realTS bigint, nodeID bigint, events bigint"
    )
    assert rows(logs.derivative(log, 2), "bucket", "rate") == [(0, 1.5), (1, 3.0), (3, 1.5)]
    assert [r[1] for r in rows(logs.mean_throughput(log), "seq", "rate")] == [None, 8.0, 10 / 2.1, 13 / 7]


def test_marks_and_times(spark):
    log = spark.createDataFrame(
        [(1, 1000, -(2**63), "SENT_REQ_DRIFT"), (2, 2000, 7_200_000, "ROUND"), (3, 4500, 10_800_000, "ROUND")],
        "seq bigint, realTS bigint, eventTS bigint, metricType string",
    )
    assert rows(logs.elapsed(log, "ROUND"), "elapsed") == [(1.0,), (3.5,)]
    assert rows(logs.cumulative_marks(log, "ROUND"), "ordinal", "elapsed") == [(1, 1.0), (2, 3.5)]
    assert rows(logs.time_against_time(log), "seq", "elapsed", "event_hours") == [(2, 1.0, 0.0), (3, 3.5, 1.0)]
    both = logs.compare({4: logs.elapsed(log, "ROUND"), 2: logs.elapsed(log, "ROUND")})
    assert rows(both.groupBy("k").count(), "*") == [(2, 2), (4, 2)]


def test_watermark_decides_which_windows_are_closed(spark, tmp_path):
    data = [(0, h * 3_600_000) for h in range(50)]
    spark.createDataFrame(data, "site bigint, ts_ms bigint").coalesce(1).write.parquet(str(tmp_path / "in"))
    for lag, closed in (("0 seconds", 2), ("2 hours", 1)):
        stream = spark.readStream.schema("site bigint, ts_ms bigint").parquet(str(tmp_path / "in"))
        out = tmp_path / f"out{closed}"
        query = (
            closed_windows(stream, "1 day", lag)
            .writeStream.format("parquet")
            .option("checkpointLocation", str(out) + "-cp")
            .trigger(availableNow=True)
            .start(str(out))
        )
        query.awaitTermination()
        assert spark.read.parquet(str(out)).count() == closed


def test_event_rate_equals_derivative_of_the_count(spark):
    stamps = [(k, i * i * 37 % 9000 + k) for k in (0, 1) for i in range(60)]
    log = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(stamps)], "seq bigint, realTS bigint, nodeID bigint")
    counted = log.selectExpr("*", "count(*) over (partition by nodeID order by realTS, seq) as events")
    mine, theirs = logs.event_rate(log, 1.5), logs.derivative(counted, 1.5)
    assert sorted(mine.collect()) == sorted(theirs.select(mine.columns).collect())


def test_work_area_is_freed(spark, tmp_path):
    from pathlib import Path

    from driftgate.session import WorkArea

    with WorkArea(spark, "freed") as area:
        area.save(spark.range(3), "rows")
        folder = Path(area.path.removeprefix("file:"))
        assert folder.exists() and area.names(".") == ["rows"]
    assert not folder.exists()


def test_throughput_log_feeds_the_analytics(spark):
    from driftgate.operators.windows import with_slot
    from driftgate.plans.gate import throughput

    events = spark.createDataFrame([(i % 2, i * 100) for i in range(100)], "site bigint, ts_ms bigint")
    log = throughput(with_slot(events, 1000), 1000, clock=F.col("slot") * 1000).withColumn("seq", F.col("eventTS") * 2 + F.col("nodeID"))
    rates = logs.derivative(log, 2.0).filter("bucket > 0")
    assert {r["rate"] for r in rates.collect()} == {5.0}
    assert logs.mean_throughput(log).filter("elapsed > 0").count() == 18
