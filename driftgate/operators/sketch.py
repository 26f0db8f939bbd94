"""Linear (fast-AGMS) sketches in long form: one row per (group, d, w) with the cell value ``v``.

Cells that no key hits are absent. A sketch has at most depth*width cells, which is the proven bound
behind every broadcast of one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from driftgate.functions import arrays
from driftgate.functions.keys import SketchShape, bucket_sql, sign_sql
from driftgate.operators import vectors
from driftgate.operators.joins import attach

CELL = ("d", "w")


def spread(df: DataFrame, shape: SketchShape, key: str = "x", val: str = "val") -> DataFrame:
    """Each row becomes ``depth`` signed cell contributions ``(d, w, v)``; the seeds are literals, so no join."""
    x = f"cast({key} as bigint)"
    hits = ", ".join(
        f"named_struct('d', {d}L, 'w', {bucket_sql(x, coeff, shape.width)}, "
        f"'v', cast({val} as double) * {sign_sql(x, coeff)})"
        for d, coeff in enumerate(shape.coefficients())
    )
    rest = [c for c in df.columns if c not in (key, val)]
    return df.selectExpr(*rest, f"inline(array({hits}))")


def build(
    df: DataFrame, by: Sequence[str] = ("site",), shape: SketchShape = SketchShape(), key: str = "x", val: str = "val"
) -> DataFrame:
    """Sketch per group in one exchange; partial sums shrink the input to cells before it."""
    return spread(df.select(*by, key, val), shape, key, val).groupBy(*by, *CELL).agg(F.sum("v").alias("v"))


def add(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return vectors.add(a, b, (*by, *CELL))


def subtract(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return vectors.subtract(a, b, (*by, *CELL))


scale = vectors.scale


def row_norms(a: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return vectors.norm(a, (*by, "d"))


def normalize(a: DataFrame, by: Sequence[str] = (), shape: SketchShape | None = None) -> DataFrame:
    """Divide every sketch row by its length; zero rows stay zero. A single sketch has as many rows as ``shape``."""
    bound = shape.depth if shape and not by else None
    joined = attach(a, row_norms(a, by), (*by, "d"), row_bound=bound)
    unit = F.when(F.col("norm") > 0, F.col("v") / F.col("norm")).otherwise(F.lit(0.0))
    return joined.withColumn("v", unit).drop("norm")


def row_dot(a: DataFrame, b: DataFrame, by: Sequence[str] = (), shape: SketchShape = SketchShape()) -> DataFrame:
    """Row-wise dot product of the grouped sketches ``a`` with the single sketch ``b``."""
    joined = attach(a, b.select(*CELL, F.col("v").alias("v_other")), CELL, row_bound=shape.cells)
    return joined.groupBy(*by, "d").agg(F.sum(F.col("v") * F.col("v_other")).alias("dot"))


def median_of_rows(rows: DataFrame, value: str, by: Sequence[str] = (), name: str = "estimate") -> DataFrame:
    """Upper median over the sketch rows of each group."""
    return rows.groupBy(*by).agg(arrays.upper_median(F.collect_list(value)).alias(name))


def self_join_size(a: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """F2 estimate: median over rows of the squared row length."""
    return median_of_rows(vectors.f2(a, (*by, "d")), "f2", by)


def join_size(a: DataFrame, b: DataFrame, shape: SketchShape = SketchShape()) -> DataFrame:
    """Size of the equi-join of the two sketched relations. Rows without a common cell count as 0."""
    rows = row_dot(a, b, shape=shape)
    dots = F.map_from_entries(F.collect_list(F.struct("d", "dot")))
    return rows.agg(dots.alias("m")).select(
        arrays.upper_median(F.transform(_row_ids(shape), lambda d: F.coalesce(F.col("m")[d], F.lit(0.0)))).alias(
            "estimate"
        )
    )


def _row_ids(shape: SketchShape) -> Column:
    return F.array(*[F.lit(d).cast("bigint") for d in range(shape.depth)])


def dense_position(a: DataFrame, shape: SketchShape) -> DataFrame:
    """Two-dimensional cells to positions of the flat vector."""
    return a.withColumn("pos", F.col("d") * F.lit(shape.width).cast("bigint") + F.col("w")).drop(*CELL)


def from_position(a: DataFrame, shape: SketchShape) -> DataFrame:
    width = F.lit(shape.width).cast("bigint")
    return a.select("*", F.expr(f"pos div {shape.width}").alias("d"), (F.col("pos") % width).alias("w")).drop("pos")


def column_at(a: DataFrame, w: int) -> DataFrame:
    """One bucket column of the sketch: its cells over all rows."""
    return a.filter(F.col("w") == w)


def replace_column(a: DataFrame, w: int, cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketch with bucket column ``w`` taken from ``cells (by..., d, v)``."""
    fresh = cells.select(*by, "d", F.lit(w).cast("bigint").alias("w"), "v")
    return a.filter(F.col("w") != w).select(*by, *CELL, "v").unionByName(fresh)


def sparse(a: DataFrame) -> DataFrame:
    return a.filter(F.col("v") != 0)


def dense(a: DataFrame, by: Sequence[str], shape: SketchShape) -> DataFrame:
    """Every cell of every group, zeros included, as flat positions."""
    grid = a.select(*by).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(shape.cells - 1))).alias("p"))
    grid = grid.select(*by, F.col("p").cast("bigint").alias("pos"))
    cells = dense_position(a, shape).select(*by, "pos", "v")
    return grid.join(cells, [*by, "pos"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def dense_arrays(a: DataFrame, by: Sequence[str], shape: SketchShape) -> DataFrame:
    """One array of depth*width doubles per group; the array length bounds the group."""
    packed = dense(a, by, shape).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("cells"))
    return packed.select(*by, F.col("cells.v").alias("cells"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: do both sketches agree in every cell?"""
    return subtract(a, b).agg((F.count_if(F.col("v") != 0) == 0).alias("equal"))


def empty_groups(a: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups whose sketch has no nonzero cell."""
    return a.groupBy(*by).agg(F.count_if(F.col("v") != 0).alias("n")).filter(F.col("n") == 0).drop("n")
