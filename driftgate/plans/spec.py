"""What a monitored query has to define, and the three built-in ones.

A query lives on a linear vector: cells with key columns ``keys`` and value columns ``values``. Everything
else about a round is a handful of numbers, the zone, that the driver may hold.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from driftgate.functions import arrays, hyperbola
from driftgate.functions.keys import SketchShape
from driftgate.operators import sketch
from driftgate.operators.joins import attach
from driftgate.operators.zones import HALF_ROOT, cap_score, join_row_scores

Zone = dict[str, Any]


class MonitorSpec:
    """Subclass to monitor another function of the mean vector.

    ``keys`` name a cell, ``rows`` the key columns that number sketch rows (none for exact vectors),
    ``depth`` the number of such rows, ``cell_bound`` a proven bound on the cells of one vector or None.
    """

    keys: tuple[str, ...] = ("x",)
    rows: tuple[str, ...] = ()
    values: tuple[str, ...] = ("v",)
    depth: int = 1
    cell_bound: int | None = None

    def contributions(self, events: DataFrame) -> DataFrame:
        """Events ``(site, slot, ...)`` to signed cell rows ``(site, slot, keys, values)``."""
        raise NotImplementedError

    def zone(self, estimate: DataFrame, k: int = 1) -> Zone | None:
        """Numbers of the safe zone around ``estimate / k``; None where it has no interior.

        Estimates stay undivided sums over the k sites: sums of whole weights are exact in any order, so batch runs,
        streams and retries agree to the last bit. Dividing is left to the few numbers of the zone.
        """
        raise NotImplementedError

    def answer(self, zone: Zone) -> float:
        raise NotImplementedError

    def phi_at_zero(self, zone: Zone) -> float:
        raise NotImplementedError

    def score(self, sums: DataFrame, zone: Zone) -> DataFrame:
        """Running drift sums ``(site, slot, rows, grown_*, along_*)`` to ``(site, slot, phi)``."""
        raise NotImplementedError

    # -- linear algebra, shared by all linear vectors

    def collect_cells(self, rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        return rows.groupBy(*by, *self.keys).agg(*[F.sum(v).alias(v) for v in self.values])

    def add(self, a: DataFrame, b: DataFrame) -> DataFrame:
        cols = [*self.keys, *self.values]
        return self.collect_cells(a.select(*cols).unionByName(b.select(*cols)))

    def scale(self, a: DataFrame, c: float) -> DataFrame:
        return a.withColumns({v: F.col(v) * F.lit(float(c)) for v in self.values})

    def phi_series(
        self,
        deltas: DataFrame,
        estimate: DataFrame,
        zone: Zone,
        lam: float = 1.0,
        k: int = 1,
        weight: float = 1.0,
    ) -> DataFrame:
        """phi of every site's drift, times ``weight``, after every slot in which it changed.

        ``estimate`` is a sum over k sites, of which the mean counts.

        ``deltas (site, slot, keys, values)`` start from a zero drift. Square sums and projections of
        ``E + X`` are running sums over the changed cells, so the cost does not depend on the vector size,
        and one site's cells spread over all tasks. Every event touches all rows of a sketch, hence a
        (site, slot) with any change has a sum for each row.
        """
        named = [F.col(v).alias(f"e_{v}") for v in self.values]
        joined = attach(deltas, estimate.select(*self.keys, *named), self.keys, "left", row_bound=self.cell_bound)
        history = (
            Window.partitionBy("site", *self.keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
        )
        joined = joined.fillna(0.0, [f"e_{v}" for v in self.values]).withColumns(
            {f"after_{v}": F.sum(v).over(history) for v in self.values}
        )
        # without E and with it; both stay whole for whole weights
        sums = [F.expr(f"sum({v} * (2 * after_{v} - {v}))").alias(f"grown_{v}") for v in self.values]
        sums += [F.expr(f"sum({v} * e_{v})").alias(f"along_{v}") for v in self.values]
        changes = joined.groupBy("site", "slot", *self.rows).agg(*sums)
        parts = ", ".join(("site", *self.rows))
        up_to_here = f"over (partition by {parts} order by slot rows between unbounded preceding and current row)"
        names = [c for c in changes.columns if c.startswith(("grown_", "along_"))]
        # at most one row per slot and sketch row of a site; this partitioning also serves the scoring
        running = changes.repartition("site").selectExpr("site", "slot", *self.rows, *[f"sum({n}) {up_to_here} as {n}" for n in names])
        c = weight / lam
        running = running.withColumns(
            {f"along_{v}": F.col(f"along_{v}") * F.lit(c / k) for v in self.values}
            | {
                f"grown_{v}": F.col(f"along_{v}") * F.lit(2 * c / k) + F.col(f"grown_{v}") * F.lit(c * c)
                for v in self.values
            }
        )
        scored = self.score(running, zone)
        return scored.withColumn("phi", F.col("phi") * F.lit(lam)) if lam != 1.0 else scored


@dataclass
class ExactF2(MonitorSpec):
    """F2 of exact key frequencies with the spherical-cap zone."""

    eps: float = 0.2

    def contributions(self, events: DataFrame) -> DataFrame:
        return events.select("site", "slot", "x", F.col("val").cast("double").alias("v"))

    def zone(self, estimate: DataFrame, k: int = 1) -> Zone | None:
        f2 = (estimate.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0) / (k * k)
        return {"norm": f2**0.5, "f2": f2} if f2 else None

    def answer(self, zone: Zone) -> float:
        return zone["f2"]

    def phi_at_zero(self, zone: Zone) -> float:
        return self.eps * zone["norm"]

    def score(self, sums: DataFrame, zone: Zone) -> DataFrame:
        phi = cap_score(F.lit(zone["norm"]), F.col("grown_v"), F.col("along_v"), self.eps)
        return sums.select("site", "slot", phi.alias("phi"))


@dataclass
class SketchF2(MonitorSpec):
    """F2 estimated from sketches with the two-sided median zone."""

    eps: float = 0.2
    shape: SketchShape = field(default_factory=SketchShape)
    eikonal: bool = True

    keys = sketch.CELL
    rows = ("d",)

    def __post_init__(self):
        self.depth = self.shape.depth
        self.cell_bound = self.shape.cells

    def contributions(self, events: DataFrame) -> DataFrame:
        # repeated keys of a slot meet before each becomes one row per sketch row
        summed = events.groupBy("site", "slot", "x").agg(F.sum(F.col("val").cast("double")).alias("val"))
        return sketch.spread(summed, self.shape)

    def zone(self, estimate: DataFrame, k: int = 1) -> Zone | None:
        lengths = estimate.groupBy("d").agg(F.sum(F.col("v") * F.col("v")).alias("n2")).collect()
        n2 = [0.0] * self.depth
        for row in lengths:
            n2[row["d"]] = row["n2"] / (k * k)
        f2 = sorted(n2)[self.depth // 2]
        if f2 <= 0:
            return None
        norms = [n**0.5 for n in n2]
        low, high = max((1 - self.eps) * f2, 0.0) ** 0.5, ((1 + self.eps) * f2) ** 0.5
        return {
            "f2": f2,
            "norm": norms,
            "low": low,
            "high": high,
            "ref_lower": [n - low for n in norms],
            "ref_upper": [high - n for n in norms],
        }

    def answer(self, zone: Zone) -> float:
        return zone["f2"]

    def _sides(self, zone: Zone) -> list[str]:
        return ["ref_upper"] + (["ref_lower"] if zone["low"] > 0 else [])

    def phi_at_zero(self, zone: Zone) -> float:
        k = arrays.majority(self.depth)
        return min(arrays.quorum_at_reference(zone[s], k, self.eikonal) for s in self._sides(zone))

    def score(self, sums: DataFrame, zone: Zone) -> DataFrame:
        # one entry per sketch row
        by_row = F.expr("array_sort(collect_list(struct(d, grown_v, along_v)))")
        packed = sums.groupBy("site", "slot").agg(by_row.alias("m"))
        norms = arrays.sql_array(zone["norm"])
        high, low = (arrays.sql_array([zone[side]] * self.depth) for side in ("high", "low"))
        length = f"zip_with(m, {norms}, (s, n) -> sqrt(greatest(n * n + s.grown_v, 0.0D)))"
        along = f"zip_with(m, {norms}, (s, n) -> if(n > 0, n + s.along_v / n, 0.0D))"
        rows = packed.selectExpr(
            "site",
            "slot",
            f"zip_with({high}, {length}, (t, n) -> t - n) as ref_upper",
            f"zip_with({along}, {low}, (n, t) -> n - t) as ref_lower",
        )
        k = arrays.majority(self.depth)
        sides = [arrays.quorum_known(zone[s], s, k, self.eikonal) for s in self._sides(zone)]
        phi = F.least(*sides) if len(sides) > 1 else sides[0]
        return rows.select("site", "slot", phi.alias("phi"))


@dataclass
class SketchJoin(MonitorSpec):
    """Size of the equi-join of two event relations, told apart by the column ``rel`` (0 or 1).

    Cells are polarised, ``x = a+b`` and ``y = a-b``, which keeps the vector linear.
    """

    eps: float = 0.2
    shape: SketchShape = field(default_factory=SketchShape)
    eikonal: bool = True

    keys = sketch.CELL
    rows = ("d",)
    values = ("x", "y")

    def __post_init__(self):
        self.depth = self.shape.depth
        self.cell_bound = self.shape.cells

    def contributions(self, events: DataFrame) -> DataFrame:
        summed = events.groupBy("site", "slot", "rel", "x").agg(F.sum(F.col("val").cast("double")).alias("val"))
        cells = sketch.spread(summed, self.shape)
        y = F.when(F.col("rel") == 0, F.col("v")).otherwise(-F.col("v"))
        return cells.select("site", "slot", *self.keys, F.col("v").alias("x"), y.alias("y"))

    def zone(self, estimate: DataFrame, k: int = 1) -> Zone | None:
        lengths = estimate.groupBy("d").agg(F.expr("sum(x * x)").alias("x2"), F.expr("sum(y * y)").alias("y2"))
        x2, y2 = np.zeros(self.depth), np.zeros(self.depth)
        for row in lengths.collect():
            x2[row["d"]], y2[row["d"]] = row["x2"] / (k * k), row["y2"] / (k * k)
        size = float(np.sort((x2 - y2) / 4.0)[self.depth // 2])
        if size == 0:
            return None
        nx, ny = np.sqrt(x2), np.sqrt(y2)
        t_low, t_high = 4.0 * (size - self.eps * abs(size)), -4.0 * (size + self.eps * abs(size))
        return {
            "size": size,
            "nx": nx.tolist(),
            "ny": ny.tolist(),
            "t_low": t_low,
            "t_high": t_high,
            "ref_lower": (hyperbola.score(nx, ny, np.full_like(nx, t_low), nx, ny) * HALF_ROOT).tolist(),
            "ref_upper": (hyperbola.score(ny, nx, np.full_like(nx, t_high), ny, nx) * HALF_ROOT).tolist(),
        }

    def answer(self, zone: Zone) -> float:
        return zone["size"]

    def phi_at_zero(self, zone: Zone) -> float:
        k = arrays.majority(self.depth)
        return min(arrays.quorum_at_reference(zone[s], k, self.eikonal) for s in ("ref_lower", "ref_upper"))

    def score(self, sums: DataFrame, zone: Zone) -> DataFrame:
        rows = sums.selectExpr(
            "*",
            f"{arrays.sql_array(zone['nx'])}[cast(d as int)] as nx",
            f"{arrays.sql_array(zone['ny'])}[cast(d as int)] as ny",
            f"{zone['t_low']!r}D as t_low",
            f"{zone['t_high']!r}D as t_high",
        )
        packed = join_row_scores(rows).groupBy("site", "slot").agg(
            arrays.by_row(F.col("d"), F.col("z_lower")).alias("lower"),
            arrays.by_row(F.col("d"), F.col("z_upper")).alias("upper"),
        )
        k = arrays.majority(self.depth)
        sides = [arrays.quorum_known(zone[f"ref_{s}"], s, k, self.eikonal) for s in ("lower", "upper")]
        return packed.select("site", "slot", F.least(*sides).alias("phi"))


def named_spec(query: str | MonitorSpec, eps: float, shape: SketchShape | None = None) -> MonitorSpec:
    if isinstance(query, MonitorSpec):
        return query
    shape = shape or SketchShape()
    kinds = {
        "exact": lambda: ExactF2(eps),
        "f2": lambda: SketchF2(eps, shape),
        "join": lambda: SketchJoin(eps, shape),
    }
    return kinds[query]()
