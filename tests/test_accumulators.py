"""User-defined accumulators against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgate.operators import accumulators
from driftgate.operators.accumulators import Accumulator, Moments, aggregate


class Extremes(Accumulator):
    """Rows, and the least value with the label it came with."""

    inputs = {"x": "double", "label": "bigint"}
    state = {"n": "bigint", "least": "double", "label": "bigint"}
    result = {"n": "bigint", "label": "bigint"}

    def create(self, n):
        return {"n": np.zeros(n, np.int64), "least": np.full(n, np.inf), "label": np.full(n, -1, np.int64)}

    def add(self, state, group, rows):
        self.merge(state, group, {"n": np.ones(len(group), np.int64), "least": rows["x"], "label": rows["label"]})

    def merge(self, state, group, other):
        np.add.at(state["n"], group, other["n"])
        order = np.lexsort((other["label"], other["least"], group))
        first = np.unique(group[order], return_index=True)[1]
        for i in order[first]:
            g = group[i]
            if (other["least"][i], other["label"][i]) < (state["least"][g], state["label"][g]):
                state["least"][g], state["label"][g] = other["least"][i], other["label"][i]

    def finish(self, state):
        return {"n": state["n"], "label": state["label"]}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    keys = np.where(rng.random(6000) < 0.34, 1, rng.integers(2, 400, 6000))
    return [(int(k) if k != 5 else None, f"p{i % 3}", float(x), i) for i, (k, x) in enumerate(zip(keys, rng.normal(1e6, 2.0, 6000)))]


def grouped(rows):
    out = {}
    for k, part, x, i in rows:
        out.setdefault((k, part), []).append((x, i))
    return out


@pytest.mark.parametrize("combine", [100, 200_000])
def test_moments(spark, rows, monkeypatch, combine):
    """A mean far from zero, null keys, a key with a third of all rows, many states a key and one."""
    monkeypatch.setattr(accumulators, "COMBINE_ROWS", combine)
    df = spark.createDataFrame(rows, "k bigint, part string, x double, i bigint").repartition(4)
    got = {(r.k, r.part): r for r in aggregate(df, ["k", "part"], Moments(), x=F.col("x")).collect()}
    want = grouped(rows)
    assert set(got) == set(want)
    for key, values in want.items():
        x = np.array([v for v, _ in values])
        r = got[key]
        assert r.n == len(x) and r.mean == pytest.approx(x.mean(), rel=1e-12)
        assert r.variance == pytest.approx(x.var(), rel=1e-6, abs=1e-9)


def test_a_user_defined_one(spark, rows):
    df = spark.createDataFrame(rows, "k bigint, part string, x double, i bigint").repartition(3)
    got = {(r.k, r.part): (r.n, r.label) for r in aggregate(df, ["k", "part"], Extremes(), x=F.col("x"), label=F.col("i")).collect()}
    assert got == {key: (len(v), min(v)[1]) for key, v in grouped(rows).items()}


def test_states_meet_before_the_shuffle(spark):
    df = spark.range(40_000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("x")).coalesce(2)
    out = aggregate(df, ["k"], Moments(), x=F.col("x"))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") >= 2 and plan.index("MapInArrow") < plan.index("Exchange") < plan.rindex("MapInArrow")


def test_null_inputs_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (2, None)], "k bigint, x double")
    got = {r.k: (r.n, r.mean) for r in aggregate(df, ["k"], Moments(), x=F.col("x")).collect()}
    assert got[1] == (1, 2.0) and got[2][0] == 0 and np.isnan(got[2][1])
    assert aggregate(df.limit(0), ["k"], Moments(), x=F.col("x")).count() == 0
