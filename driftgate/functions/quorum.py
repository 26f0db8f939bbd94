"""Least ratio over subsets by branch and bound, for sketches too deep to list all subsets.

The k-of-n score with unit gradient is the least ``sum(p) / sqrt(sum(q))`` over the subsets of m components, and their number
grows exponentially with the depth. Here rows are searched side by side: partial choices of all rows of a batch form one
front, which takes or leaves one component at a time. A partial choice goes on only if its bound, the smallest products it can
still get over the most helpful root it can still get, beats the best ratio its row has seen. Rows start with
the best of a family of simple choices (the m least ``p - u q`` for several u), so most of the front dies at once.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

# tasks get these functions with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Partial choices held at a time; a bigger front is worked off in halves.
FRONT = 1 << 20
ROWS = 2048


def _ratio(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return p / np.sqrt(q)


def _first_best(p: np.ndarray, q: np.ndarray, m: int) -> np.ndarray:
    """The best simple choice of each row."""
    scale = np.abs(p).max(1) / q.max(1)
    best = np.full(len(p), np.inf)
    for u in (0.0, 0.1, 0.3, 0.6, 1.0, 2.0, -0.3, -1.0):
        pick = np.argpartition(p - (u * scale)[:, None] * q, m - 1, axis=1)[:, :m]
        best = np.minimum(best, _ratio(np.take_along_axis(p, pick, 1).sum(1), np.take_along_axis(q, pick, 1).sum(1)))
    return best


def least_ratio(p: np.ndarray, q: np.ndarray, m: int) -> np.ndarray:
    """For each row the least ``sum(p) / sqrt(sum(q))`` over its subsets of ``m`` components; ``q`` is positive."""
    if len(p) > ROWS:
        return np.concatenate([least_ratio(p[at : at + ROWS], q[at : at + ROWS], m) for at in range(0, len(p), ROWS)])
    n, size = p.shape
    order = np.argsort(p, axis=1)
    p, q = np.take_along_axis(p, order, 1), np.take_along_axis(q, order, 1)
    best = _first_best(p, q, m)
    # behind each component: sums of the r least products, and of the r least and greatest squares
    products = np.concatenate([np.zeros((n, 1)), np.cumsum(p, axis=1)], axis=1)
    low, high = np.zeros((size + 1, n, m + 1)), np.zeros((size + 1, n, m + 1))
    for i in range(size):
        rest = np.sort(q[:, i:], axis=1)
        r = min(m, size - i)
        low[i, :, 1 : r + 1] = np.cumsum(rest, axis=1)[:, :r]
        high[i, :, 1 : r + 1] = np.cumsum(rest[:, ::-1], axis=1)[:, :r]

    def go_on(i: int, row: np.ndarray, need: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        while len(row):
            done = need == 0
            if done.any():
                np.minimum.at(best, row[done], _ratio(a[done], b[done]))
                row, need, a, b = (x[~done] for x in (row, need, a, b))
            if not len(row) or i == size:
                return
            reach = a + products[row, np.minimum(i + need, size)] - products[row, i]
            helpful = b + np.where(reach >= 0, high[i, row, need], low[i, row, need])
            alive = (need <= size - i) & (_ratio(reach, np.maximum(helpful, 1e-300)) < best[row])
            row, need, a, b = (x[alive] for x in (row, need, a, b))
            if len(row) > FRONT:
                half = len(row) // 2
                go_on(i, *(x[:half] for x in (row, need, a, b)))
                row, need, a, b = (x[half:] for x in (row, need, a, b))
                continue
            taken = (row, need - 1, a + p[row, i], b + q[row, i])
            row, need, a, b = (np.concatenate(x) for x in zip(taken, (row, need, a, b), strict=True))
            i += 1

    start = np.arange(n)
    go_on(0, start, np.full(n, m), np.zeros(n), np.zeros(n))
    return best


def _batch(products: pd.Series, squares: pd.Series, k: pd.Series) -> pd.Series:
    """Rows by their number of legal components; a row with too few, or a null one, has no ratio."""
    sizes = np.array([-1 if p is None else len(p) for p in products])
    out = np.full(len(sizes), np.nan)
    wanted = k.to_numpy()
    for size, need in {(s, w) for s, w in zip(sizes.tolist(), wanted.tolist()) if s >= w}:
        at = np.flatnonzero((sizes == size) & (wanted == need))
        p, q = (np.stack([x.iloc[i] for i in at]).astype(np.float64) for x in (products, squares))
        whole = np.isfinite(p).all(1) & np.isfinite(q).all(1)
        out[at[whole]] = least_ratio(p[whole], q[whole], size - need + 1) if whole.any() else np.nan
    return pd.Series(out)


def least_ratio_column(products: Column, squares: Column, k: int) -> Column:
    return F.pandas_udf(_batch, "double")(products, squares, F.lit(k))
