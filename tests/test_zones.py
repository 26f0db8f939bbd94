import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftgate import SketchShape
from driftgate.functions import arrays, hyperbola
from driftgate.operators import zones
from protocol import hyperbola as plain_hyperbola, quorum as plain_quorum


def numbers(spark, matrix):
    return spark.createDataFrame([([float(v) for v in row],) for row in matrix], "z array<double>")


def literal(values):
    return F.array(*[F.lit(float(v)) for v in values])


def both_quorums(spark, ref, rows, k):
    df = numbers(spark, rows).select(
        "z",
        arrays.quorum_eikonal(literal(ref), F.col("z"), k, len(ref)).alias("e"),
        arrays.quorum_fast(literal(ref), F.col("z"), k).alias("f"),
    )
    known = df.selectExpr(
        "*", f"{arrays.quorum_sql(list(ref), 'z', k)} as e2", f"{arrays.quorum_sql(list(ref), 'z', k, False)} as f2"
    )
    return known.collect()


def test_quorum_majority(spark):
    ref = [13.0, 17.0, 26.0, 11.0, -33.0, 31.0, 52.0]
    rng = np.random.default_rng(1)
    for r in both_quorums(spark, ref, 100 * rng.random((2000, 7)) - 50, 4):
        assert (r["e"] >= 0) == (r["f"] >= 0)
        assert r["e"] == pytest.approx(plain_quorum(ref, r["z"], 4), abs=1e-9)
        assert r["e2"] == pytest.approx(r["e"], abs=1e-9) and r["f2"] == pytest.approx(r["f"], abs=1e-9)


def test_quorum_all_and_any(spark):
    rng = np.random.default_rng(2)
    ref = (9.9 * rng.random(7) + 0.1).tolist()
    rows = 40 * rng.random((200, 7)) - 20
    for r in both_quorums(spark, ref, rows, 7):
        assert r["e"] == pytest.approx(min(r["z"]), abs=1e-10)
    for r in both_quorums(spark, ref, rows, 1):
        dot = float(np.dot(r["z"], ref))
        assert r["e"] == pytest.approx(dot / math.sqrt(np.dot(ref, ref)), abs=1e-10)
        assert r["f"] == pytest.approx(dot, abs=1e-9)


def test_quorum_needs_enough_legal_inputs(spark):
    with pytest.raises(PySparkException, match="not admissible"):
        both = numbers(spark, [[1, 1, 1]])
        both.select(arrays.quorum_fast(literal([1, -1, -1]), F.col("z"), 2)).collect()
    with pytest.raises(ValueError, match="not admissible"):
        arrays.quorum_sql([1.0, -1.0, -1.0], "z", 2)


@pytest.mark.parametrize(
    "p, q, expected",
    [(0, 0, 0), (1, -3, 0), (1, -1, 0), (1, -0.9, 0.05), (1, 0, 0.5), (1, 1, 1), (1, 2, 1.5), (-1, -3, 0), (-1, -1, 0)]
    + [(-1, -0.9, -0.05), (-1, 0, -0.5), (-1, 1, -1), (-1, 2, -1.5), (0, 1, 0.5), (0, 10, 5), (0, -1, 0)],
)
def test_nearest_on_the_cone(p, q, expected):
    assert hyperbola.nearest(p, q, 0.0) == pytest.approx(expected, abs=1e-9)


def test_nearest_recovers_the_foot_at_any_scale():
    xi = np.arange(-10, 10, 0.11)
    psi = np.sqrt(xi * xi + 1)
    steps = np.concatenate([np.arange(0.49, -1, -0.01), [-2.0, -4.0, -8.0, -16.0, -32.0, -64.0]])
    for t in steps:
        p, q = xi - 2 * t * xi, psi + 2 * t * psi
        for scale in (1.0, 1e-5, 1e-2, 1e3, 1e5):
            root = math.sqrt(scale)
            np.testing.assert_allclose(hyperbola.nearest(p * root, q * root, scale) / root, xi, atol=1e-9)


def one(xi, psi, t, x, y):
    return float(hyperbola.score(*[np.array([float(v)]) for v in (xi, psi, t, x, y)])[0])


def test_score_threshold_zero():
    h = 1 / math.sqrt(2)
    for ref in ((1, 0), (0, 0), (1, 1)):
        assert [one(*ref, 0, *p) for p in ((1, 0), (1, 1), (0, 1), (-1, 0))] == pytest.approx([h, 0, -h, -h], abs=1e-12)
    for ref in ((-1, 1), (-1, 0.5), (-1, -0.5)):
        got = [one(*ref, 0, *p) for p in ((1, 0), (1, 1), (0, 1), (-1, 0))]
        assert got == pytest.approx([-h, -math.sqrt(2), -h, h], abs=1e-12)


def test_score_threshold_positive():
    for side, ref in ((1, (1, 0)), (-1, (-1.5, -0.5))):
        assert one(*ref, 1, side * math.sqrt(2), 1) == pytest.approx(0, abs=1e-12)
        assert one(*ref, 1, side * math.sqrt(5), 2) == pytest.approx(0, abs=1e-12)
        for a in np.arange(0.1, 10, 0.1):
            d = math.sqrt(2 * a * a + 1)
            assert one(*ref, 1, 0, 2 * a) == pytest.approx(-d, abs=1e-12)
            assert one(*ref, 1, side * 2 * math.sqrt(a * a + 1), 0) == pytest.approx(d, abs=1e-12)


def test_score_threshold_negative():
    length = math.hypot(0.5, math.sqrt(1.25))
    assert one(1, 0, -1, 0, math.sqrt(5)) == pytest.approx(-math.sqrt(1.5), abs=1e-12)
    assert one(1, 0, -1, 0, -math.sqrt(5)) == pytest.approx(-math.sqrt(1.5), abs=1e-12)
    assert one(1, 0, -1, 0, 0) == pytest.approx(1 / length, abs=1e-12)
    for x, y, expected in ((0, 0, 1), (10, 0, 1), (-100, 0, 1), (1e6, 1, 0), (-1e6, -2, -1)):
        assert one(0, -0.5, -1, x, y) == pytest.approx(expected, abs=1e-15)


def test_score_column_equals_plain(spark):
    rng = np.random.default_rng(9)
    rows = [tuple(map(float, (*rng.uniform(-5, 5, 2), rng.choice([-3, 0, 2]), *rng.uniform(-5, 5, 2)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "xi double, psi double, t double, x double, y double")
    scored = df.withColumn("s", hyperbola.hyperbola_score(*[F.col(c) for c in df.columns]))
    for r in scored.collect():
        assert r["s"] == pytest.approx(plain_hyperbola(r["xi"], r["psi"], r["t"], r["x"], r["y"]), abs=1e-9)


def long(spark, tensors, shape, name="v"):
    rows = [
        (i, d, w, float(t[d, w])) for i, t in enumerate(tensors) for d in range(shape.depth) for w in range(shape.width)
    ]
    return spark.createDataFrame(rows, f"id bigint, d bigint, w bigint, {name} double")


def test_cap_budget(spark):
    estimate = spark.sql("select 0L x, 10D v")
    drift = spark.sql("select * from values (0L, 0L, 0D), (1L, 0L, 0.5D), (2L, 1L, 5D) as t(site, x, v)")
    phi = {r["site"]: r["phi"] for r in zones.cap(drift, estimate, 0.2).collect()}
    assert phi == pytest.approx({0: 2.0, 1: 1.5, 2: min(12 - math.sqrt(125), 2.0)})
    negated = {r["site"]: r["phi"] for r in zones.cap_negated(drift, estimate, 0.2).collect()}
    assert negated == pytest.approx({s: -p for s, p in phi.items()})


def test_f2_zone_is_sound(spark):
    shape, eps, n = SketchShape(5, 10), 0.1, 600
    rng = np.random.default_rng(21)
    e = rng.uniform(-10, 10, (5, 10))
    answer = lambda m: float(np.sort((m * m).sum(axis=1))[2])
    at_e = zones.zone_f2(long(spark, [e * 0], shape), long(spark, [e], shape).drop("id"), eps, ("id",), shape)
    start = at_e.first()["phi"]
    assert start > 0
    drifts = [rng.uniform(-1, 1, (5, 10)) * start * rng.uniform(0, 2) for _ in range(n)]
    for eikonal in (True, False):
        scored = zones.zone_f2(long(spark, drifts, shape), long(spark, [e], shape).drop("id"), eps, ("id",), shape, eikonal)
        safe = {r["id"]: r["phi"] >= 0 for r in scored.collect()}
        admissible = [(1 - eps) * answer(e) <= answer(e + x) <= (1 + eps) * answer(e) for x in drifts]
        assert len(safe) == n and 0 < sum(safe.values()) < n
        assert all(admissible[i] for i, s in safe.items() if s)


def test_lower_bound_is_free_when_the_error_covers_zero(spark):
    shape = SketchShape(3, 4)
    e = np.arange(12.0).reshape(3, 4) + 1
    scored = zones.zone_f2(long(spark, [-e], shape), long(spark, [e], shape).drop("id"), 1.0, ("id",), shape, side="lower")
    assert scored.first()["phi"] == math.inf


def test_rebalanced_and_balance_term(spark):
    shape = SketchShape(3, 4)
    rng = np.random.default_rng(4)
    e, x = rng.uniform(1, 5, (3, 4)), rng.uniform(-0.2, 0.2, (3, 4))
    estimate = long(spark, [e], shape).drop("id")
    plain = zones.zone_f2(long(spark, [2 * x], shape), estimate, 0.3, ("id",), shape).first()["phi"]
    assert zones.rebalanced_f2(long(spark, [x], shape), estimate, 0.3, 0.5, ("id",), shape).first()["phi"] == pytest.approx(plain / 2)
    # two sites with drift 2x each: B = 4x, mu = 2, so phi is taken at 2x
    term = zones.balance_term(long(spark, [2 * x, 2 * x], shape), estimate, 0.3, 0.5, 4, shape).first()["psi_beta"]
    assert term == pytest.approx(2 * plain)


def test_join_zone_is_sound(spark):
    shape, eps = SketchShape(3, 4), 0.1
    rng = np.random.default_rng(8)
    e = rng.uniform(-10, 10, (2, 3, 4))
    answer = lambda m: float(np.sort((m[0] * m[1]).sum(axis=1))[1])
    size = answer(e)

    def score(drifts):
        tables = [long(spark, [x[i] for x in drifts], shape) for i in (0, 1)]
        refs = [long(spark, [e[i]], shape).drop("id") for i in (0, 1)]
        return {r["id"]: r["phi"] for r in zones.zone_join(*tables, *refs, eps, ("id",), shape).collect()}

    ends = score([e * 0, e])
    assert ends[0] >= 0 >= ends[1]
    rho = ends[0] / math.sqrt(24)
    drifts = [rng.uniform(-10, 10, (2, 3, 4)) * rho * rng.uniform(0, 1) for _ in range(500)]
    phi = score(drifts)
    assert len(phi) == 500 and 0 < sum(p >= 0 for p in phi.values()) < 500
    for i, p in phi.items():
        if p >= 0:
            assert size - eps * abs(size) <= answer(e + drifts[i]) <= size + eps * abs(size)


@pytest.mark.parametrize("depth, rows", [(5, 40), (15, 25), (21, 4)])
def test_least_ratio_equals_all_subsets(depth, rows):
    """Positive, mixed and negative products, equal components, and components that hardly count."""
    from itertools import combinations

    from driftgate.functions.quorum import least_ratio

    rng = np.random.default_rng(depth)
    for shift in (0.0, 1.5, -1.5):
        e, x = rng.random((rows, depth)) + 0.01, rng.standard_normal((rows, depth)) + shift
        e[::3, : depth // 2] = 0.5
        x[::3, : depth // 2] = 0.25
        m = depth - (depth + 1) // 2 + 1
        picks = np.array(list(combinations(range(depth), m)))
        p, q = e * x, e * e
        want = [(a[picks].sum(1) / np.sqrt(b[picks].sum(1))).min() for a, b in zip(p, q)]
        assert least_ratio(p, q, m) == pytest.approx(want, rel=1e-12)


def test_front_in_halves(monkeypatch):
    from driftgate.functions import quorum

    rng = np.random.default_rng(2)
    p, q = rng.standard_normal((30, 13)) + 1, rng.random((30, 13)) + 0.1
    whole = quorum.least_ratio(p, q, 7)
    monkeypatch.setattr(quorum, "FRONT", 16)
    monkeypatch.setattr(quorum, "ROWS", 7)
    assert quorum.least_ratio(p, q, 7) == pytest.approx(whole, rel=1e-12)


def test_deep_quorum_column(spark):
    """Fifteen rows: searched instead of 6,435 literals; the plan does not grow with the subsets, and both forms agree."""
    rng = np.random.default_rng(4)
    ref, rows = (rng.random(15) - 0.1).tolist(), rng.standard_normal((20, 15)).tolist()
    k = 8
    df = spark.createDataFrame([(i, z) for i, z in enumerate(rows)], "id int, z array<double>")
    literal = F.array(*map(F.lit, ref))
    out = df.select("id", arrays.quorum_eikonal(literal, F.col("z"), k, 15).alias("a"), arrays.quorum_known(ref, "z", k).alias("b"))
    want = [plain_quorum(np.array(ref), np.array(z), k) for z in rows]
    got = out.orderBy("id").collect()
    assert [r.a for r in got] == pytest.approx(want) and [r.b for r in got] == pytest.approx(want)
    assert len(out._jdf.queryExecution().toString()) < 40_000
    short = F.array(*[F.lit(1.0)] * 7 + [F.lit(-1.0)] * 8)
    with pytest.raises(Exception, match="admissible"):
        df.select(arrays.quorum_eikonal(short, F.col("z"), k, 15)).collect()
