"""The gate in plain Python over dense numpy vectors: every vector is added up in full at every slot."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np


def quorum(ref, z, k):
    legal = [i for i in range(len(ref)) if ref[i] > 0]
    assert len(legal) >= k
    m = len(legal) - k + 1
    return min(
        sum(ref[i] * z[i] for i in s) / math.sqrt(sum(ref[i] ** 2 for i in s)) for s in combinations(legal, m)
    )


def foot(p, q, t):
    """x of the nearest point of y = sqrt(x^2+t): the best real root of the quartic of the normal through (p, q)."""
    roots = np.roots([4.0, -4 * p, p * p + 4 * t - q * q, -4 * p * t, p * p * t])
    real = {r.real for r in roots if abs(r.imag) < 1e-6 * (1 + abs(r))} | {0.0}

    def polished(x):  # two Newton steps on the quartic itself
        for _ in range(3):
            f = (((4 * x - 4 * p) * x + p * p + 4 * t - q * q) * x - 4 * p * t) * x + p * p * t
            d = ((16 * x - 12 * p) * x + 2 * (p * p + 4 * t - q * q)) * x - 4 * p * t
            x = x - f / d if d else x
        return x

    best = min(real, key=lambda x: (x - p) ** 2 + (math.sqrt(x * x + t) - q) ** 2)
    return min((best, polished(best)), key=lambda x: (x - p) ** 2 + (math.sqrt(x * x + t) - q) ** 2)


def hyperbola(xi, psi, t, x, y):
    side = 1 if xi >= 0 else -1
    if t > 0:
        x *= side
        v = foot(y, x, t)
        inside = 1 if x >= math.sqrt(y * y + t) else -1
        return inside * math.hypot(x - math.sqrt(v * v + t), y - v)
    if t == 0:
        return (side * x - abs(y)) / math.sqrt(2)
    u = foot(xi, abs(psi), -t)
    v = math.sqrt(u * u - t)
    return (u * x - v * abs(y) - t) / math.hypot(u, v)


class Cap:
    def __init__(self, eps):
        self.eps = eps

    def answer(self, e):
        return float(e @ e)

    def phi(self, e, x):
        n = math.sqrt(e @ e)
        return min((1 + self.eps) * n - math.sqrt((e + x) @ (e + x)), x @ e / n + self.eps * n)


class Join:
    """Vectors have shape (2, depth, width): the sketches of the two relations."""

    def __init__(self, eps):
        self.eps = eps

    def answer(self, e):
        rows = (e[0] * e[1]).sum(axis=1)
        return float(np.sort(rows)[len(rows) // 2])

    def phi(self, e, x):
        size = self.answer(e)
        t_low, t_high = 4 * (size - self.eps * abs(size)), -4 * (size + self.eps * abs(size))
        both = e + x
        k = (e.shape[1] + 1) // 2
        scores = []
        for flip, t in ((1, t_low), (-1, t_high)):
            a, b = e[0] + flip * e[1], e[0] - flip * e[1]
            p, q = both[0] + flip * both[1], both[0] - flip * both[1]
            na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
            along, across = (p * a).sum(axis=1) / na, np.sqrt((q * q).sum(axis=1))
            depth = range(e.shape[1])
            ref = [hyperbola(na[d], nb[d], t, na[d], nb[d]) * math.sqrt(0.5) for d in depth]
            z = [hyperbola(na[d], nb[d], t, along[d], across[d]) * math.sqrt(0.5) for d in depth]
            scores.append(quorum(ref, z, k))
        return min(scores)


def walk(query, deltas, k, warm, last, mqf=0.01, rebalance=False):
    """``deltas[slot][site]`` are dense changes. Returns [(round, slot, answer)] and the subround count."""
    zero = sum(deltas[min(deltas)].values()) * 0.0
    change = lambda s, i: deltas.get(s, {}).get(i, zero)
    first = min(deltas)
    e = sum(change(s, i) for s in range(first, warm + 1) for i in range(k)) / k
    out, subrounds = [(1, warm, query.answer(e))], 0

    def fresh():
        return query.phi(e, zero)

    lam, beta, kept = 1.0, 0.0, zero
    x = [zero] * k
    phi = [fresh()] * k
    z, c, q, grown = list(phi), [0] * k, phi[0] / 2, 0
    for s in range(warm + 1, last + 1):
        for i in range(k):
            x[i] = x[i] + change(s, i)
            if not x[i].any():
                continue
            phi[i] = lam * query.phi(e, x[i] / lam)
            new = int((z[i] - phi[i]) / q)
            if new > c[i]:
                grown += new - c[i]
                c[i] = new
        if grown <= k:
            continue
        subrounds += 1
        budget = sum(phi) + beta
        limit = mqf * k * fresh()
        if budget < limit and rebalance and lam == 1.0:
            kept, lam = sum(x), 0.5
            beta = 0.5 * k * query.phi(e, kept / (0.5 * k))
            x, phi = [zero] * k, [lam * fresh()] * k
            budget = sum(phi) + beta
        if budget < limit:
            e = e + (sum(x) + kept) / k
            out.append((len(out) + 1, s, query.answer(e)))
            lam, beta, kept = 1.0, 0.0, zero
            x, phi = [zero] * k, [fresh()] * k
            q = phi[0] / 2
        else:
            q = budget / (2 * k)
        z, c, grown = list(phi), [0] * k, 0
    return out, subrounds
