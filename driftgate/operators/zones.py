"""Safe-zone scores phi of drifts against an estimate; phi > 0 means the drift is safe.

Drifts are tables ``(by..., cell keys, v)``, estimates ``(cell keys, v)``. A score needs, per group and
sketch row, only two sums over the drift's own cells,

    grown = sum(x * (2*e + x))     so that |E+X|^2 = |E|^2 + grown
    along = sum(x * e)             so that (E+X).E/|E| = |E| + along/|E|

so cells that only E holds are never touched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from driftgate.functions import arrays
from driftgate.functions.hyperbola import hyperbola_score
from driftgate.functions.keys import SketchShape
from driftgate.operators.joins import attach
from driftgate.operators.sketch import CELL

INF = float("inf")


def _growth(x: Column, e: Column) -> Column:
    return F.sum(x * (2 * e + x))


def cap(drift: DataFrame, estimate: DataFrame, eps: float, by: Sequence[str] = ("site",), key: str = "x") -> DataFrame:
    """Spherical cap on exact vectors: ``min((1+eps)|E| - |X+E|, X.E/|E| + eps|E|)``."""
    length = estimate.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).scalar()
    joined = drift.join(estimate.select(key, F.col("v").alias("e")), key, "left")
    x, e = F.col("v"), F.coalesce("e", F.lit(0.0))
    sums = joined.groupBy(*by).agg(_growth(x, e).alias("grown"), F.sum(x * e).alias("along"))
    sums = sums.withColumn("n", length)
    return sums.select(*by, cap_score(F.col("n"), F.col("grown"), F.col("along"), eps).alias("phi"))


def cap_score(norm: Column, grown: Column, along: Column, eps: float) -> Column:
    outer = F.lit(1.0 + eps) * norm - F.sqrt(F.greatest(norm * norm + grown, F.lit(0.0)))
    return F.least(outer, along / norm + F.lit(eps) * norm)


def cap_negated(drift: DataFrame, estimate: DataFrame, eps: float, by: Sequence[str] = ("site",)) -> DataFrame:
    """The older sign convention, in which a violation is positive."""
    return cap(drift, estimate, eps, by).withColumn("phi", -F.col("phi"))


def _rows_array(column: str, field: str, depth: int) -> Column:
    """Per-row numbers from a map keyed by row; rows without a cell count as 0."""
    ids = F.array(*[F.lit(d).cast("bigint") for d in range(depth)])
    return F.transform(ids, lambda d: F.coalesce(F.col(column)[d][field], F.lit(0.0)))


def f2_zone(estimate: DataFrame, eps: float, shape: SketchShape) -> DataFrame:
    """The zone ``(1-eps)F2(E) <= F2 <= (1+eps)F2(E)`` as one row of per-row numbers."""
    rows = estimate.groupBy("d").agg(F.sum(F.col("v") * F.col("v")).alias("n2"))
    packed = rows.agg(F.map_from_entries(F.collect_list(F.struct("d", F.struct("n2")))).alias("m"))
    n2 = packed.select(_rows_array("m", "n2", shape.depth).alias("n2"))
    full = n2.withColumn("norm", arrays.root(F.col("n2"))).withColumn("f2", arrays.upper_median(F.col("n2")))
    low, high = F.col("f2") * F.lit(1.0 - eps), F.col("f2") * F.lit(1.0 + eps)
    return full.select(
        "norm",
        "f2",
        F.sqrt(F.greatest(low, F.lit(0.0))).alias("root_low"),
        F.sqrt(high).alias("root_high"),
    ).select(
        "*",
        F.transform("norm", lambda n: F.col("root_high") - n).alias("ref_upper"),
        F.transform("norm", lambda n: n - F.col("root_low")).alias("ref_lower"),
    )


def f2_rows(
    drift: DataFrame, estimate: DataFrame, eps: float, by: Sequence[str], shape: SketchShape
) -> DataFrame:
    """Per group: the row scores ``z_upper`` and ``z_lower`` of ``E+X`` next to the zone."""
    # an estimate has at most depth*width cells
    joined = attach(drift, estimate.select(*CELL, F.col("v").alias("e")), CELL, "left", row_bound=shape.cells)
    x, e = F.col("v"), F.coalesce("e", F.lit(0.0))
    sums = joined.groupBy(*by, "d").agg(_growth(x, e).alias("grown"), F.sum(x * e).alias("along"))
    packed = sums.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("d", F.struct("grown", "along")))).alias("m")
    )
    zone = f2_zone(estimate, eps, shape)
    scored = packed.select(
        *by,
        _rows_array("m", "grown", shape.depth).alias("grown"),
        _rows_array("m", "along", shape.depth).alias("along"),
        zone.select(F.struct(*zone.columns)).scalar().alias("zone"),
    )
    pairs = F.arrays_zip(F.col("zone.norm").alias("n"), F.col("grown").alias("g"), F.col("along").alias("a"))
    length = F.transform(pairs, lambda p: F.sqrt(F.greatest(p["n"] * p["n"] + p["g"], F.lit(0.0))))
    along = F.transform(pairs, lambda p: F.when(p["n"] > 0, p["n"] + p["a"] / p["n"]).otherwise(F.lit(0.0)))
    return scored.select(
        *by,
        "zone",
        F.transform(length, lambda n: F.col("zone.root_high") - n).alias("z_upper"),
        F.transform(along, lambda n: n - F.col("zone.root_low")).alias("z_lower"),
    )


def quorum(reference: Column, rows: Column, k: int, depth: int, eikonal: bool = True) -> Column:
    return arrays.quorum_eikonal(reference, rows, k, depth) if eikonal else arrays.quorum_fast(reference, rows, k)


def f2_upper(rows: DataFrame, shape: SketchShape, eikonal: bool = True) -> Column:
    return quorum(rows["zone.ref_upper"], rows["z_upper"], arrays.majority(shape.depth), shape.depth, eikonal)


def f2_lower(rows: DataFrame, shape: SketchShape, eikonal: bool = True) -> Column:
    inner = quorum(rows["zone.ref_lower"], rows["z_lower"], arrays.majority(shape.depth), shape.depth, eikonal)
    return F.when(rows["zone.root_low"] <= 0, F.lit(INF)).otherwise(inner)


def zone_f2(
    drift: DataFrame,
    estimate: DataFrame,
    eps: float,
    by: Sequence[str] = ("site",),
    shape: SketchShape = SketchShape(),
    eikonal: bool = True,
    side: str = "both",
) -> DataFrame:
    """phi per group for the F2 query on sketches; ``side`` picks the upper, the lower or both bounds."""
    rows = f2_rows(drift, estimate, eps, by, shape)
    sides = {"upper": f2_upper, "lower": f2_lower}
    scores = [sides[s](rows, shape, eikonal) for s in (("lower", "upper") if side == "both" else (side,))]
    return rows.select(*by, (F.least(*scores) if len(scores) > 1 else scores[0]).alias("phi"))


def rebalanced_f2(
    drift: DataFrame, estimate: DataFrame, eps: float, lam: float, by=("site",), shape: SketchShape = SketchShape()
) -> DataFrame:
    """``lam * phi(X / lam)``."""
    scaled = drift.withColumn("v", F.col("v") / F.lit(lam))
    return zone_f2(scaled, estimate, eps, by, shape).withColumn("phi", F.col("phi") * F.lit(lam))


def balance_term(
    drift: DataFrame, estimate: DataFrame, eps: float, lam: float, k: int, shape: SketchShape = SketchShape()
) -> DataFrame:
    """``(1-lam)k * phi(B / ((1-lam)k))`` of the summed drift B."""
    mu = (1.0 - lam) * k
    summed = drift.groupBy(*CELL).agg((F.sum("v") / F.lit(mu)).alias("v")).withColumn("one", F.lit(1))
    scored = zone_f2(summed, estimate, eps, ("one",), shape)
    return scored.select((F.col("phi") * F.lit(mu)).alias("psi_beta"))


# -- join size ------------------------------------------------------------------------------------

HALF_ROOT = 0.5**0.5


def polarise(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``x = a+b`` and ``y = a-b`` per cell, as one signed sum instead of an outer join."""
    left = a.select(*keys, F.col("v").alias("x"), F.col("v").alias("y"))
    right = b.select(*keys, F.col("v").alias("x"), (-F.col("v")).alias("y"))
    return left.unionByName(right).groupBy(*keys).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


def _bounds(product: Column, eps: float) -> tuple[Column, Column]:
    return product - F.lit(eps) * F.abs(product), product + F.lit(eps) * F.abs(product)


def join_zone(reference: DataFrame, eps: float, shape: SketchShape) -> DataFrame:
    """One row per sketch row ``d``: lengths of the polarised reference, bounds and reference scores.

    ``reference`` holds polarised cells ``(d, w, x, y)``; a.b = (x^2 - y^2) / 4 in every row.
    """
    rows = reference.groupBy("d").agg(
        F.sum(F.col("x") * F.col("x")).alias("x2"), F.sum(F.col("y") * F.col("y")).alias("y2")
    )
    product = rows.select(arrays.upper_median(F.collect_list((F.col("x2") - F.col("y2")) / 4.0))).scalar()
    return join_zone_scores(rows.withColumn("product", product), eps)


def join_zone_scores(rows: DataFrame, eps: float) -> DataFrame:
    low, high = _bounds(F.col("product"), eps)
    bounded = rows.select(
        "d", F.sqrt("x2").alias("nx"), F.sqrt("y2").alias("ny"), (4.0 * low).alias("t_low"), (-4.0 * high).alias("t_high")
    )
    nx, ny = F.col("nx"), F.col("ny")
    return bounded.select(
        "*",
        (hyperbola_score(nx, ny, F.col("t_low"), nx, ny) * F.lit(HALF_ROOT)).alias("ref_lower"),
        (hyperbola_score(ny, nx, F.col("t_high"), ny, nx) * F.lit(HALF_ROOT)).alias("ref_upper"),
    )


def join_row_scores(rows: DataFrame) -> DataFrame:
    """Hyperbola scores of drift sums per (group, d): both bounds of the join size.

    Expects ``nx ny t_low t_high`` of the zone and ``along_x grown_x along_y grown_y`` of the drift.
    """
    nx, ny = F.col("nx"), F.col("ny")
    x_hat = F.when(nx > 0, nx + F.col("along_x") / nx).otherwise(F.lit(0.0))
    y_hat = F.when(ny > 0, ny + F.col("along_y") / ny).otherwise(F.lit(0.0))
    x_len = F.sqrt(F.greatest(nx * nx + F.col("grown_x"), F.lit(0.0)))
    y_len = F.sqrt(F.greatest(ny * ny + F.col("grown_y"), F.lit(0.0)))
    return rows.withColumn(
        "z_lower", hyperbola_score(nx, ny, F.col("t_low"), x_hat, y_len) * F.lit(HALF_ROOT)
    ).withColumn("z_upper", hyperbola_score(ny, nx, F.col("t_high"), y_hat, x_len) * F.lit(HALF_ROOT))


def join_phi(rows: DataFrame, by: Sequence[str], shape: SketchShape, eikonal: bool = True) -> DataFrame:
    """Quorum over the row scores, both bounds, per group."""
    k = arrays.majority(shape.depth)
    columns = ("ref_lower", "ref_upper", "z_lower", "z_upper")
    grouped = rows.groupBy(*by).agg(*[arrays.by_row(F.col("d"), F.col(c)).alias(c) for c in columns])
    return grouped.select(
        *by,
        F.least(
            quorum(F.col("ref_lower"), F.col("z_lower"), k, shape.depth, eikonal),
            quorum(F.col("ref_upper"), F.col("z_upper"), k, shape.depth, eikonal),
        ).alias("phi"),
    )


def zone_join(
    drift_a: DataFrame,
    drift_b: DataFrame,
    ref_a: DataFrame,
    ref_b: DataFrame,
    eps: float,
    by: Sequence[str] = ("site",),
    shape: SketchShape = SketchShape(),
    eikonal: bool = True,
) -> DataFrame:
    """phi per group for the join-size query; drifts are per group, references one sketch per relation."""
    reference = polarise(ref_a, ref_b, CELL)
    moved = polarise(drift_a, drift_b, (*by, *CELL))
    cells = reference.select(*CELL, F.col("x").alias("ex"), F.col("y").alias("ey"))
    joined = attach(moved, cells, CELL, "left", row_bound=shape.cells).fillna(0.0, ["ex", "ey"])
    x, y, ex, ey = (F.col(c) for c in ("x", "y", "ex", "ey"))
    sums = joined.groupBy(*by, "d").agg(
        F.sum(x * ex).alias("along_x"),
        _growth(x, ex).alias("grown_x"),
        F.sum(y * ey).alias("along_y"),
        _growth(y, ey).alias("grown_y"),
    )
    zone = join_zone(reference, eps, shape)
    # one row per sketch row
    rows = join_row_scores(attach(sums, zone, ["d"], row_bound=shape.depth))
    return join_phi(rows, by, shape, eikonal)
