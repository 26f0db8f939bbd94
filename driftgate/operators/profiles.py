"""How evenly servers and records fall on the sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from driftgate.functions.keys import site_of


def site_load(events: DataFrame, server: str, k: int) -> DataFrame:
    return events.groupBy(site_of(F.col(server), k).alias("site")).agg(F.count(F.lit(1)).alias("records"))


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def text_hash(text: Column, base: int = 31) -> Column:
    """Polynomial hash over the characters with 32-bit signed wrap-around."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    wrap = lambda h: F.pmod(h + _long(2**31), _long(2**32)) - _long(2**31)
    return F.aggregate(F.filter(codes, lambda c: c > 0), _long(0), lambda h, c: wrap(h * _long(base) + c))


def site_hashes(server: Column) -> dict[str, Column]:
    """Ways to turn a server id into the number that is reduced modulo k."""
    text = server.cast("string")
    once = text_hash(text)
    return {
        "raw": server.cast("bigint"),
        "text_hash": once,
        "double_text_hash": text_hash(once.cast("string")),
        "md5": F.conv(F.substring(F.md5(text), 9, 8), 16, 10).cast("bigint"),
        "sha": F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint"),
    }


def site_coverage(events: DataFrame, server: str, ks: Sequence[int] = range(2, 28)) -> DataFrame:
    """Per hash choice and k, how many of the k sites receive at least one distinct server."""
    hashed = events.select(server).distinct().select(
        F.explode(
            F.array(
                *[F.struct(F.lit(n).alias("hash"), h.alias("h")) for n, h in site_hashes(F.col(server)).items()]
            )
        ).alias("s")
    )
    sizes = F.explode(F.array(*[_long(k) for k in ks])).alias("k")
    placed = hashed.select("s.hash", "s.h", sizes).select("hash", "k", F.pmod("h", "k").alias("site")).distinct()
    return placed.groupBy("hash", "k").agg(F.count(F.lit(1)).alias("sites_hit"))
