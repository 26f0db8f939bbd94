"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgate.llm import negatives
from driftgate.llm.queries import all_queries
from driftgate.session import WorkArea

VEC = "vec_id bigint, label int, vector array<bigint>"


def brute(rows, asked, positives=5, k=10):
    """Anchor, positive, rank, negative and both scores of every result."""
    width = max((len(v) for _, _, v in rows), default=0)
    x = np.array([v + [0] * (width - len(v)) for _, _, v in rows], object).reshape(len(rows), width)
    out = []
    for i, label, v in dict.fromkeys((i, c, tuple(v)) for i, c, v in rows if asked(i)):
        score = x @ np.array(list(v) + [0] * (width - len(v)), object)
        ranked = sorted((-int(s), j, c) for s, (j, c, _) in zip(score, rows) if j != i)
        for s, j, _ in [r for r in ranked if r[2] == label][:positives]:
            hits = [r for r in ranked if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s][:k]
            out += [(i, j, n + 1, r[1], -s, -r[0]) for n, r in enumerate(hits)]
    return sorted(out)


def mined(spark, rows, modulus, **limits):
    df = spark.createDataFrame(rows, VEC).repartition(3)
    got = negatives.mine(df, F.col("vec_id") % modulus == 0, WorkArea(spark, "t"), **limits).collect()
    return sorted(tuple(r) for r in got)


def random_rows(seed, n, labels, spread, width=6):
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(labels)), rng.integers(-spread, spread + 1, width).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread", [2, 40, 100_000, 10**8])
def test_random_rows(spark, spread):
    """Many ties, and scores in single precision, double precision and integers."""
    rows = random_rows(spread, 500, 4, spread)
    assert mined(spark, rows, 10) == brute(rows, lambda i: i % 10 == 0)


def test_overlapping_windows_from_few_slots(spark):
    rows = random_rows(9, 400, 2, 12)
    assert mined(spark, rows, 8, positives=9, k=3) == brute(rows, lambda i: i % 8 == 0, 9, 3)


def test_many_tiles(spark):
    """One label with most rows, labels of few rows, several tiles of rows and of anchors."""
    rows = [(i, 1 if i % 3 else i % 50, v) for i, _, v in random_rows(3, 9_000, 1, 9)]
    assert mined(spark, rows, 2_000) == brute(rows, lambda i: i % 2_000 == 0)


def test_tiles_hold_no_more_than_their_size(spark):
    rows = spark.createDataFrame(random_rows(4, 3_000, 7, 9), VEC)
    tiles = negatives._tiles(rows, 256, 6, "f4").select(F.octet_length("ids").alias("n"), "kinds").collect()
    assert max(t.n for t in tiles) <= 256 * 8 and sum(t.n for t in tiles) == 3_000 * 8 and len({tuple(t.kinds) for t in tiles}) >= 7


def test_cases(spark):
    rows = [(0, 1, [5, 5]), (0, 1, [5, 5]), (0, 2, [1]), (1, 1, [4, 4]), (1, 1, [4, 4]), (2, 2, [2, 3]), (3, 3, [3, 2]), (4, 3, []), (10, 9, [7, 7])]
    odd = [(None, 1, [9, 9]), (20, None, [9, 9]), (30, 1, None)]
    got = mined(spark, rows + odd, 10)
    assert got == brute(rows, lambda i: i % 10 == 0) and got
    assert mined(spark, [], 10) == [] and mined(spark, [(0, 1, [1])], 10) == []
    wide = spark.createDataFrame([(*r, 5, 6, "x") for r in rows], f"{VEC}, tile int, slot int, anchor string")
    again = negatives.mine(wide, F.col("vec_id") % 10 == 0, WorkArea(spark, "t"))
    assert sorted(map(tuple, again.collect())) == got
    with pytest.raises(ValueError):
        mined(spark, [(0, 1, [2**40] * 9)], 10)


def test_query_on_the_table(spark):
    folder, rows = "/root/testdata/sf0.01", []
    for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect():
        label = (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
        rows.append((r.vec_id, label, [math.floor(256 * x) for x in r.embedding]))
    got = all_queries()["op12_hard_negatives"](spark, folder).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, lambda i: i % 100 == 0)
