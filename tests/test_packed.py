"""Packed sketches: round trips, merges, and how much smaller they are."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from driftgate import SketchShape
from driftgate.operators import packed, sketch

SHAPE = SketchShape(5, 400)


@given(st.lists(st.tuples(st.integers(0, 2**31), st.one_of(st.integers(-(2**33), 2**33), st.floats(allow_nan=False, allow_infinity=False, width=32))), max_size=60))
@settings(max_examples=200, deadline=None)
def test_round_trip(cells):
    want = {}
    for p, v in cells:
        want[p] = want.get(p, 0.0) + float(v)
    position, value = packed.decompress(packed.compress(np.array([p for p, _ in cells], np.int64), np.array([float(v) for _, v in cells])))
    assert dict(zip(position.tolist(), value.tolist())) == {p: v for p, v in want.items() if v != 0}
    assert (np.diff(position) > 0).all()


@pytest.mark.parametrize("top, size", [(100, 1), (30_000, 2), (2**30, 4), (0.5, 8)])
def test_values_take_what_they_need(top, size):
    raw = packed.compress(np.arange(0, 1000, 10), np.full(100, top))
    assert len(raw) == 6 + 100 * (1 + size)


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(5)
    rows = [(int(s), int(x), float(v)) for s, x, v in zip(rng.integers(0, 3, 4000), rng.integers(0, 90, 4000), rng.integers(-3, 4, 4000))]
    return spark.createDataFrame(rows, "site bigint, x bigint, val double").repartition(4)


def cells(df):
    return {tuple(r)[:-1]: r.v for r in df.collect() if r.v}


def test_packing_equals_building(events):
    built = sketch.build(events, ("site",), SHAPE)
    raw = packed.pack(sketch.spread(events, SHAPE), ("site",), SHAPE)
    assert raw.count() == 3
    assert cells(packed.unpack(raw, ("site",), SHAPE).select("site", "d", "w", "v")) == cells(built.select("site", "d", "w", "v"))


def test_merge_equals_sketch_add(events):
    halves = [sketch.build(events.filter(F.col("x") % 2 == i), ("site",), SHAPE) for i in (0, 1)]
    a, b = (packed.pack(h, ("site",), SHAPE) for h in halves)
    got = packed.unpack(packed.add(a, b, ("site",)), ("site",), SHAPE)
    assert cells(got.select("site", "d", "w", "v")) == cells(sketch.add(*halves, ("site",)).select("site", "d", "w", "v"))


def test_sums_that_cancel_leave_an_empty_sketch(events):
    raw = packed.pack(sketch.spread(events, SHAPE), ("site",), SHAPE)
    back = packed.pack(sketch.spread(events.withColumn("val", -F.col("val")), SHAPE), ("site",), SHAPE)
    total = packed.add(raw, back, ("site",))
    assert all(bytes(r.packed) == packed.EMPTY for r in total.collect())
    assert packed.unpack(total, ("site",), SHAPE).count() == 0


def test_packed_rows_are_smaller(events):
    """Bytes of what a merge shuffles: packed sketches against rows of key, row, bucket and value."""
    built = sketch.build(events, ("site",), SHAPE)
    n = built.count()
    size = packed.pack(built, ("site",), SHAPE).agg(F.sum(F.octet_length("packed"))).first()[0]
    assert size * 6 < n * 4 * 8
