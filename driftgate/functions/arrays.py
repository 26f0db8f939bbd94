"""Small per-row arrays: medians, row arithmetic and the quorum rules.

The arrays hold one number per sketch row, so their length is the sketch depth.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, functions as F

from driftgate.functions.quorum import least_ratio_column

#: Subsets that are written into a plan; 35 of them for seven rows.
MOST_LITERALS = 126


def upper_median(values: Column) -> Column:
    """Element n/2 of the sorted array; the upper one of the two middle values when n is even."""
    return F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1)


def by_row(d: Column, value: Column) -> Column:
    """Aggregate: the values of a group ordered by sketch row."""
    return F.transform(F.array_sort(F.collect_list(F.struct(d.alias("d"), value.alias("v")))), lambda s: s["v"])


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def root(a: Column) -> Column:
    return F.transform(a, lambda x: F.sqrt(x))


def scale(a: Column, c: float) -> Column:
    return F.transform(a, lambda x: x * F.lit(float(c)))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def majority(n: int) -> int:
    return (n + 1) // 2


def _legal_products(z_ref: Column, z_row: Column) -> tuple[Column, Column]:
    pairs = F.filter(F.arrays_zip(z_ref.alias("e"), z_row.alias("x")), lambda p: p["e"] > 0)
    return F.transform(pairs, lambda p: p["e"] * p["x"]), F.transform(pairs, lambda p: p["e"] * p["e"])


def _checked(legal: Column, k: int, result: Column) -> Column:
    message = F.lit(f"reference is not admissible: fewer than {k} positive components")
    return F.when(F.size(legal) < k, F.raise_error(message).cast("double")).otherwise(result)


def quorum_fast(z_ref: Column, z_row: Column, k: int) -> Column:
    """k-of-n score without unit gradient: sum of the |L|-k+1 smallest products."""
    products, _ = _legal_products(z_ref, z_row)
    return _checked(products, k, total(F.slice(F.array_sort(products), 1, F.size(products) - (k - 1))))


def quorum_eikonal(z_ref: Column, z_row: Column, k: int, depth: int) -> Column:
    """k-of-n score with unit gradient: the least ``sum(zE*zX)/sqrt(sum(zE^2))`` over the subsets of size |L|-k+1.

    Which subsets there are depends only on how many components are legal, so they are literals as long as they are
    few; for deeper sketches they are searched.
    """
    products, squares = _legal_products(z_ref, z_row)
    if not few_subsets(depth, k):
        return _checked(products, k, least_ratio_column(products, squares, k))
    legal = F.struct(products.alias("p"), squares.alias("q"))

    def added(values: Column, pick: Column) -> Column:
        return F.aggregate(pick, F.lit(0.0), lambda acc, i: acc + F.element_at(values, i))

    def least(pair: Column) -> Column:
        scores = F.transform(
            _subsets(F.size(pair["p"]), k, depth), lambda pick: added(pair["p"], pick) / F.sqrt(added(pair["q"], pick))
        )
        return _checked(pair["p"], k, F.array_min(scores))

    # the one-element array binds the products once instead of once per subset
    return F.element_at(F.transform(F.array(legal), least), 1)


def few_subsets(depth: int, k: int) -> bool:
    return max(comb(legal, legal - k + 1) for legal in range(k, depth + 1)) <= MOST_LITERALS


def quorum_known(reference: list[float], z: str, k: int, eikonal: bool = True) -> Column:
    """The k-of-n score of the array column ``z`` for a known reference."""
    legal, m = _legal_subsets(reference, k)
    if not eikonal or comb(len(legal), m) <= MOST_LITERALS:
        return F.expr(quorum_sql(reference, z, k, eikonal))
    weights = sql_array([reference[i] for i in legal])
    picked = ", ".join(f"{z}[{i}]" for i in legal)
    products = F.expr(f"zip_with({weights}, array({picked}), (a, b) -> a * b)")
    return least_ratio_column(products, F.expr(f"transform({weights}, a -> a * a)"), k)


def _subsets(size: Column, k: int, depth: int) -> Column:
    """All index sets of size ``size-k+1`` out of 1..size."""
    result = None
    for legal in range(k, depth + 1):
        picks = ", ".join(f"array({', '.join(map(str, p))})" for p in combinations(range(1, legal + 1), legal - k + 1))
        literal = F.expr(f"array({picks})")
        result = F.when(size == legal, literal) if result is None else result.when(size == legal, literal)
    return result


def _legal_subsets(reference: list[float], k: int) -> tuple[list[int], int]:
    legal = [i for i, z in enumerate(reference) if z > 0]
    if len(legal) < k:
        raise ValueError(f"reference is not admissible: {reference}")
    return legal, len(legal) - k + 1


def quorum_sql(reference: list[float], z: str, k: int, eikonal: bool = True) -> str:
    """The same two rules for a known reference, as SQL over the array ``z`` of row scores.

    The weights are array literals inside higher-order functions, so the generated code is the same for
    every reference and compiled once.
    """
    legal, m = _legal_subsets(reference, k)
    dot = f"aggregate(zip_with(w, {z}, (a, b) -> a * b), 0.0D, (acc, p) -> acc + p)"
    if not eikonal:
        legal_only = sql_array([r if r > 0 else None for r in reference])
        products = f"filter(zip_with({legal_only}, {z}, (a, b) -> a * b), p -> p is not null)"
        return f"aggregate(slice(array_sort({products}), 1, {m}), 0.0D, (acc, p) -> acc + p)"
    weights = []
    for pick in combinations(legal, m):
        length = sum(reference[i] ** 2 for i in pick) ** 0.5
        weights.append(sql_array([reference[i] / length if i in pick else 0.0 for i in range(len(reference))]))
    return f"array_min(transform(array({', '.join(weights)}), w -> {dot}))"


def sql_array(values: list[float | None]) -> str:
    return "array(" + ", ".join("cast(null as double)" if v is None else f"{float(v)!r}D" for v in values) + ")"


def quorum_at_reference(reference: list[float], k: int, eikonal: bool = True) -> float:
    """Score of the reference itself, that is of a zero drift."""
    legal, m = _legal_subsets(reference, k)
    smallest = sum(sorted(reference[i] ** 2 for i in legal)[:m])
    return smallest**0.5 if eikonal else smallest
