"""Keys, sites and the seeded hash family, all as BIGINT column expressions.

Every intermediate stays below 2**63, so nothing overflows under ANSI mode and any SQL engine
gives the same numbers.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

PRIME = 2**31 - 1


def site_of(server: Column, k: int) -> Column:
    """Sub-stream a server belongs to; negative ids wrap around."""
    return F.pmod(server.cast("bigint"), F.lit(k).cast("bigint"))


def pair_key(a: Column, b: Column) -> Column:
    """``31*a + b`` reduced to the hash domain. Distinct pairs collide once ``b`` reaches 31."""
    return F.pmod(F.lit(31).cast("bigint") * a.cast("bigint") + b.cast("bigint"), F.lit(PRIME).cast("bigint"))


def hashed_key(*cols: Column) -> Column:
    """Key of any column types, free of the systematic collisions of :func:`pair_key`."""
    return F.pmod(F.xxhash64(*cols), F.lit(PRIME).cast("bigint"))


@dataclass(frozen=True)
class SketchShape:
    """Rows, buckets per row and the seed their hash functions derive from."""

    depth: int = 7
    width: int = 3000
    seed: int = 46

    def coefficients(self) -> list[tuple[int, ...]]:
        """Six numbers in [1, PRIME) per row: two for the bucket line, four for the sign cubic."""

        def draw(d: int, i: int) -> int:
            digest = hashlib.sha256(f"{self.seed}/{d}/{i}".encode()).digest()
            return 1 + int.from_bytes(digest[:8], "big") % (PRIME - 1)

        return [tuple(draw(d, i) for i in range(6)) for d in range(self.depth)]

    @property
    def cells(self) -> int:
        return self.depth * self.width


def bucket_sql(x: str, coeff: tuple[int, ...], width: int) -> str:
    """Pairwise independent bucket in [0, width) of the BIGINT column ``x``."""
    return f"(({x} * {coeff[0]}L + {coeff[1]}L) % {PRIME}L) % {width}L"


def sign_sql(x: str, coeff: tuple[int, ...]) -> str:
    """Four-wise independent +1/-1: low bit of a cubic modulo PRIME."""
    acc = f"{coeff[2]}L"
    for c in coeff[3:6]:
        acc = f"(({acc} * {x} + {c}L) % {PRIME}L)"
    return f"(1L - 2L * ({acc} % 2L))"
