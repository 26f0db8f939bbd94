"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgate.llm import neighbours
from driftgate.llm.queries import all_queries
from driftgate.session import WorkArea

VEC = "vec_id bigint, embedding array<float>, score int"


def brute(rows, k, asked):
    """All candidates of each query, best first."""
    good = {i: np.array(v, np.float64) for i, v in rows}
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    out = {}
    for i in ids[[asked(i) for i in ids]]:
        score = (x * good[i]).sum(1)
        order = np.lexsort((ids, -score))
        out[i] = [(int(ids[j]), score[j]) for j in order if ids[j] != i][:k]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        scores = dict(best)
        assert len(got[q]) == len(best)
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        hits += sum(i in scores for i, _ in got[q])
        for i, s in got[q]:
            assert i not in scores or s == pytest.approx(scores[i], abs=1e-12)
    return hits / sum(map(len, want.values()))


def test_recall_of_the_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = collected(all_queries()["op9_nearest_vectors"](spark, folder))
    assert recall(got, brute(rows, 20, lambda i: i % 20 == 0)) >= 0.95


@pytest.mark.parametrize("cell_rows", [64, 8192])
def test_recall_over_many_cells(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(neighbours, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 24)) * 3
    x = (centres[rng.integers(0, 12, 2000)] + rng.standard_normal((2000, 24))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*r, 0) for r in rows], VEC)
    got = collected(neighbours.search(df, F.col("vec_id") % 7 == 0, 10, WorkArea(spark, "t")))
    assert recall(got, brute(rows, 10, lambda i: i % 7 == 0)) >= 0.95


def test_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 2.0]) for i in range(500)] + [(1000 + i, [float(i), 1.0, -1.0]) for i in range(40)]
    df = spark.createDataFrame([(*r, 0) for r in rows] + [(*rows[0], 0)] * 3, VEC)
    got = collected(neighbours.search(df, F.col("vec_id") % 10 == 0, 20, WorkArea(spark, "t")))
    assert got == brute(rows, 20, lambda i: i % 10 == 0)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 3.0]), (3, [2.0])]
    odd = [(40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [inf, 1.0]), (120, [None, 1.0]), (140, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows + odd], VEC)
    got = collected(neighbours.search(df, F.col("vec_id") % 20 == 0, 20, WorkArea(spark, "t")))
    full = [(i, v + [0.0] * (2 - len(v))) for i, v in rows]
    assert got == brute(full, 20, lambda i: i % 20 == 0)
    empty = neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0, 20, WorkArea(spark, "t"))
    assert empty.count() == 0 and empty.columns == ["query_id", "rank", "vec_id", "score"]


def test_chi_square_quantile():
    assert neighbours.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


def share_verified(x, k=20, step=20):
    """Share of the rows verified for a query, and recall, in one cell without a bound from elsewhere."""
    ids, longest = np.arange(len(x)), float((x * x).sum(1).max())
    tree = neighbours.Tree(x.shape[1], longest, 0)
    p, asked, rows, hits = tree.project(x), range(0, len(x), step), 0, 0
    for i in asked:
        away = ((p - tree.project(x[i : i + 1], True)) ** 2).sum(1)
        found, _, count = neighbours.verified(x, x.astype(np.float32), ids, away, x[i], k, longest, -np.inf)
        rows += count
        hits += len(set(found.tolist()) & set(np.argsort(-(x @ x[i]), kind="stable")[:k].tolist()))
    return rows / len(x) / len(asked), hits / k / len(asked)


def test_the_stopping_test_prunes(spark):
    """The table's vectors of 64 components are hard to tell apart by 16 projections; clustered ones are not."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").collect()
    share, recall = share_verified(np.array([r[0] for r in table], np.float64))
    assert share < 0.8 and recall >= 0.95
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 24)) * 3
    share, recall = share_verified(centres[rng.integers(0, 12, 4000)] + rng.standard_normal((4000, 24)))
    assert share < 0.6 and recall >= 0.95


def test_a_cell_beyond_its_size(spark, monkeypatch):
    """No further cells, so chunks keep the groups small."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 100)
    monkeypatch.setattr(neighbours, "MAX_DEPTH", 1)
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((900, 8)).astype(np.float32))]
    df = spark.createDataFrame([(*r, 0) for r in rows], VEC)
    got = collected(neighbours.search(df, F.col("vec_id") % 9 == 0, 10, WorkArea(spark, "t")))
    assert recall(got, brute(rows, 10, lambda i: i % 9 == 0)) >= 0.95
