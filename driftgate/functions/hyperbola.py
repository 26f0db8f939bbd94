"""Score of a point against the region ``x^2 - y^2 >= T`` as a vectorised column function."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

# tasks get these functions with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_STEPS = 100


def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hyperbolic angle u >= 0 of the point ``(sinh u, cosh u)`` nearest to ``(a, b)``, for a >= 0.

    The squared distance is stationary where ``g(u) = sinh 2u - a cosh u - b sinh u`` vanishes. Right of its last zero
    g is convex, as ``g'' = g + 3 sinh 2u``, so Newton's method falls towards that zero from any point beyond it. One
    such point follows from ``sinh 2u <= (a + max(b, 0)) cosh u`` at the zero.
    """
    u = np.arcsinh(0.5 * (a + np.maximum(b, 0.0)))
    for _ in range(MOST_STEPS):
        s, c = np.sinh(u), np.cosh(u)
        slope = 2.0 * (s * s + c * c) - a * s - b * c
        step = np.divide(2.0 * s * c - a * c - b * s, slope, out=np.zeros_like(u), where=slope > 0)
        nxt = np.maximum(u - np.maximum(step, 0.0), 0.0)
        if np.all(u - nxt <= 1e-16 * u):
            break
        u = nxt
    return u


def nearest(p: np.ndarray, q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """x-coordinate of the point of ``y = sqrt(x^2 + t)`` nearest to (p, q), for t >= 0.

    For t > 0 the curve is ``sqrt(t) (sinh u, cosh u)``; for t = 0 it is the cone ``y = |x|``.
    """
    p, q, t = (np.asarray(a, dtype=float) for a in np.broadcast_arrays(p, q, t))
    root = np.sqrt(np.where(t > 0, t, 1.0))
    curved = root * np.sinh(angle(np.abs(p) / root, q / root))
    flat = np.maximum(0.5 * (np.abs(p) + q), 0.0)  # foot on the ray of the cone on the point's side
    return np.copysign(np.where(t > 0, curved, flat), p)


def _signed_distance(x, y, t):
    """Distance of (y, x) to the curve ``x = sqrt(y^2 + t)``, t > 0; positive beyond it."""
    foot = nearest(y, x, t)
    away = np.hypot(x - np.sqrt(foot * foot + t), y - foot)
    return np.copysign(away, x - np.sqrt(y * y + t))


def _tangent_planes(xi, psi, t, x, y):
    """The lower of the distances to the tangents of ``|y| = sqrt(x^2 + t)`` where it is nearest to (xi, psi)."""
    u = nearest(xi, np.abs(psi), t)
    v = np.sqrt(u * u + t)
    return (u * x - v * np.abs(y) + t) / np.hypot(u, v)


def score(xi: np.ndarray, psi: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Zone with reference (xi, psi) and threshold t, evaluated at (x, y); positive inside.

    The region ``x^2 - y^2 >= t`` has two branches for t > 0, of which the reference's side counts, two cones for t = 0,
    and is what lies between the branches of its conjugate for t < 0.
    """
    xi, psi, t, x, y = np.broadcast_arrays(*(np.asarray(a, dtype=float) for a in (xi, psi, t, x, y)))
    out = np.empty(t.shape)
    x_own = np.where(xi >= 0, x, -x)
    two, between, cone = t > 0, t < 0, t == 0
    out[two] = _signed_distance(x_own[two], y[two], t[two])
    out[between] = _tangent_planes(xi[between], psi[between], -t[between], x[between], y[between])
    out[cone] = (x_own[cone] - np.abs(y[cone])) / np.sqrt(2.0)
    out[np.isnan(t)] = np.nan
    return out


@F.pandas_udf(DoubleType())
def _score_udf(xi: pd.Series, psi: pd.Series, t: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series(score(xi.to_numpy(), psi.to_numpy(), t.to_numpy(), x.to_numpy(), y.to_numpy()))


def hyperbola_score(xi: Column, psi: Column, t: Column, x: Column, y: Column) -> Column:
    return _score_udf(xi.cast("double"), psi.cast("double"), t.cast("double"), x.cast("double"), y.cast("double"))
