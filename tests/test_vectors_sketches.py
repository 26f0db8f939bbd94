import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftgate import SketchShape
from driftgate.functions import arrays
from driftgate.functions.keys import PRIME, hashed_key, pair_key, site_of
from driftgate.operators import sketch, vectors

SHAPE = SketchShape(depth=5, width=10, seed=3)


def cells(spark, *rows):
    return spark.createDataFrame([(d, w, float(v)) for d, w, v in rows], "d bigint, w bigint, v double")


def as_map(df, *keys):
    return {tuple(r[k] for k in keys): r["v"] for r in df.collect() if r["v"]}


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(5)
    rows = [(int(s), int(x), float(v)) for s, x, v in zip(rng.integers(0, 3, 400), rng.integers(0, 60, 400), rng.integers(1, 5, 400))]
    return spark.createDataFrame(rows, "site bigint, x bigint, val double")


def test_keys_and_sites(spark):
    row = spark.sql("select 3L a, 2L b, -1L s").select(
        pair_key(F.col("a"), F.col("b")).alias("x"), site_of(F.col("s"), 4).alias("site"), hashed_key(F.col("a"), F.col("b")).alias("h")
    ).first()
    assert row["x"] == 95 and row["site"] == 3 and 0 <= row["h"] < PRIME


def test_mean_of_equal_drifts_is_the_drift(spark):
    rows = [(site, i, float(i)) for site in range(4) for i in range(10)]
    drifts = spark.createDataFrame(rows, "site bigint, x bigint, v double")
    assert as_map(vectors.mean(drifts, 4), "x") == {(i,): float(i) for i in range(1, 10)}


def test_vector_algebra(spark):
    a = spark.createDataFrame([(i, float(i)) for i in range(5)], "x bigint, v double")
    b = spark.createDataFrame([(i, 2.0) for i in range(3, 8)], "x bigint, v double")
    assert as_map(vectors.add(a, b), "x") == {(1,): 1, (2,): 2, (3,): 5, (4,): 6, (5,): 2, (6,): 2, (7,): 2}
    assert vectors.dot(a, b).first()["dot"] == 14
    assert vectors.norm(a).first()["norm"] == pytest.approx(math.sqrt(30))
    assert vectors.norm(vectors.normalize(a)).first()["norm"] == pytest.approx(1)
    assert as_map(vectors.subtract(a, a), "x") == {}


def test_normalizing_a_zero_vector_fails(spark):
    with pytest.raises(PySparkException, match="zero vector"):
        vectors.normalize(spark.sql("select 1L as x, 0D as v")).collect()


def test_sketch_against_direct_hashing(spark, items):
    expected = {}
    for site, x, v in items.collect():
        for d, (b1, b0, s3, s2, s1, s0) in enumerate(SHAPE.coefficients()):
            w = (b1 * x + b0) % PRIME % SHAPE.width
            sgn = 1 - 2 * ((((s3 * x + s2) * x + s1) * x + s0) % PRIME % 2)
            expected[site, d, w] = expected.get((site, d, w), 0) + v * sgn
    assert as_map(sketch.build(items, ("site",), SHAPE), "site", "d", "w") == {k: v for k, v in expected.items() if v}


def test_sketch_is_linear(spark, items):
    whole = sketch.build(items, (), SHAPE)
    halves = [sketch.build(items.filter(c), (), SHAPE) for c in ("x < 30", "x >= 30")]
    assert sketch.equal(whole, sketch.add(*halves)).first()["equal"]
    assert not sketch.equal(whole, halves[0]).first()["equal"]
    assert sketch.equal(sketch.subtract(whole, halves[1]), halves[0]).first()["equal"]
    assert as_map(sketch.add(whole, sketch.scale(whole, -1.0)), "d", "w") == {}


def test_seeds_are_fixed():
    assert SketchShape().coefficients() == SketchShape().coefficients()
    assert SketchShape(seed=1).coefficients() != SketchShape(seed=2).coefficients()


def test_rows(spark):
    a = cells(spark, (0, 0, 3), (0, 1, 4), (1, 0, 0))
    b = cells(spark, (0, 0, 2), (0, 1, 1), (1, 3, 7))
    assert {r["d"]: r["norm"] for r in sketch.row_norms(a).collect()} == {0: 5.0, 1: 0.0}
    assert as_map(sketch.normalize(a), "d", "w") == {(0, 0): 0.6, (0, 1): 0.8}
    assert {r["d"]: r["dot"] for r in sketch.row_dot(a, b, shape=SketchShape(2, 10)).collect()} == {0: 10.0}


@pytest.mark.parametrize("values, expected", [([5, 2, 13, 4, -2], 4), ([10, 2, -5, 4], 4)])
def test_median(spark, values, expected):
    array = F.array(*[F.lit(float(v)) for v in values])
    assert spark.range(1).select(arrays.upper_median(array).alias("m")).first()["m"] == expected


def test_array_arithmetic(spark):
    df = spark.sql("select array(1D, 4D) a, array(3D, 2D) b")
    a, b = F.col("a"), F.col("b")
    row = df.select(
        arrays.add(a, b), arrays.subtract(a, b), arrays.multiply(a, b), arrays.root(a), arrays.scale(a, 2), arrays.norm(b)
    ).first()
    assert list(row) == [[4, 6], [-2, 2], [3, 8], [1, 2], [2, 8], pytest.approx(math.sqrt(13))]


def test_estimates_are_close(spark):
    rng = np.random.default_rng(11)
    keys = (rng.zipf(1.3, 5000) % 2000).tolist()
    df = spark.createDataFrame([(int(x), 1.0) for x in keys], "x bigint, val double")
    exact = vectors.f2(vectors.build(df, ())).first()["f2"]
    shape = SketchShape(7, 500)
    assert sketch.self_join_size(sketch.build(df, (), shape)).first()["estimate"] == pytest.approx(exact, rel=0.2)
    other = df.filter("x % 2 = 0")
    size = vectors.dot(vectors.build(df, ()), vectors.build(other, ())).first()["dot"]
    estimate = sketch.join_size(sketch.build(df, (), shape), sketch.build(other, (), shape), shape).first()["estimate"]
    assert estimate == pytest.approx(size, rel=0.2)


def test_layouts(spark, items):
    s = sketch.build(items, ("site",), SHAPE)
    flat = sketch.dense_position(s, SHAPE)
    assert as_map(sketch.from_position(flat, SHAPE), "site", "d", "w") == as_map(s, "site", "d", "w")
    full = sketch.dense(s, ("site",), SHAPE)
    assert full.count() == 3 * SHAPE.cells
    arrays_ = {r["site"]: r["cells"] for r in sketch.dense_arrays(s, ("site",), SHAPE).collect()}
    for (site, d, w), v in as_map(s, "site", "d", "w").items():
        assert arrays_[site][d * SHAPE.width + w] == v
    assert all(len(a) == SHAPE.cells for a in arrays_.values())


def test_columns_and_emptiness(spark):
    a = cells(spark, (0, 0, 1), (0, 1, 2), (1, 1, 3))
    fresh = spark.createDataFrame([(0, 9.0)], "d bigint, v double")
    assert as_map(sketch.column_at(a, 1), "d", "w") == {(0, 1): 2, (1, 1): 3}
    assert as_map(sketch.replace_column(a, 1, fresh), "d", "w") == {(0, 0): 1, (0, 1): 9}
    tagged = a.withColumn("site", F.lit(1)).unionByName(cells(spark, (0, 0, 0)).withColumn("site", F.lit(2)))
    assert [r["site"] for r in sketch.empty_groups(tagged, ("site",)).collect()] == [2]
