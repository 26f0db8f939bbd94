"""Connected components of a link table, without bringing links or nodes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftgate.session import WorkArea


def components(links: DataFrame, area: WorkArea, name: str = "stars") -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``); the root is the component's smallest node.

    Rounds of large and small stars: each node hands its larger neighbours, then its smaller ones, to its smallest
    neighbour. Every round is a written table, so lineage stays short; their number grows with the logarithm of the
    longest chain. Minima are pre-aggregated, so a node with very many links does not gather them in one task.
    """
    now = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now, seen, turn = area.save(now, f"{name}0"), None, 0
    while True:
        # order-free fingerprint of the links; equal after a round that changed nothing
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(state) == seen:
            break
        seen, turn = tuple(state), turn + 1
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        now = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = area.save(now.distinct(), f"{name}{turn}a")
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        small = now.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = small.unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        last = now
        now = area.save(last, f"{name}{turn}b")
        area.drop(f"{name}{turn}a")
        area.drop(f"{name}{turn - 1}b" if turn > 1 else f"{name}0")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
