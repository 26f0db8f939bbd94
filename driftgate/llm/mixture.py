"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Every document falls into one of its source's blocks by a seeded hash. A source takes part with whole epochs of all
   its blocks and one partial epoch: a prefix of its blocks in permuted order, cut exactly at the target.
2. The numbers of drawn blocks per stratum (a stratum is one source, or several when there are very many) go down a
   binary tree over the output shards. A node deals its counts to its two halves by a multivariate hypergeometric
   draw, so each shard is a uniform sample without replacement and the quotas add up exactly.
3. Drawn blocks in permuted order fill the shards' quotas; documents are shuffled by hash inside a shard.

Running sums go over blocks (a bounded number for each source) and then over the documents of one block, so a source
with a third of all rows is spread over all tasks. Only strata counts (at most ``STRATA`` numbers) reach the driver.

Defined cases: null or wordless texts have size 0 and take 0 words; a null source is a source of its own, ordered last;
repeated rows are documents of their own; an empty table gives an empty mix; ``mix`` carries further columns, whatever
their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from driftgate.llm.columns import free_name
from driftgate.llm.text import WORD
from driftgate.session import WorkArea

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0
SHARDS = 64
STRATA = 1024
BLOCK_DOCS = 64
MAX_BLOCKS = 65_536


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD + "+")), F.lit(0)).cast("bigint")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """One row per source: its size, weight and target.

    Weights share ``share`` of all words; a source stops at ``limit`` times its size and the excess goes to the others
    by weight. Sources sorted by limit/weight reach their limits in that order, so the common level follows from
    running sums over the sources.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = sources.withColumn("place", rank).withColumn("weight", F.get(cycle, F.col("place") % len(weights)))
    every = W.partitionBy()
    rising = W.orderBy("ratio", "place")
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    after = rising.rowsBetween(0, W.unboundedFollowing)
    top = F.col("source_size") * limit
    level = (F.col("total") - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        sources.withColumn("top", top)
        .withColumn("ratio", F.col("top") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every) * share)
        .withColumn("level", level)
        .withColumn("full", F.col("level") >= F.col("ratio"))
        .withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(every))
        .withColumn("target", F.when(F.col("full"), F.col("top")).otherwise(F.col("level") * F.col("weight")))
        .select("source", "place", "source_size", "docs", "target")
    )


def split(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Quotas per shard and stratum: ``counts`` dealt down a binary tree; shards differ by at most one block."""
    counts = np.asarray(counts, np.int64)
    out = np.zeros((shards, len(counts)), np.int64)
    total = int(counts.sum())
    sizes = np.diff(np.arange(shards + 1) * total // shards)

    def deal(have: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = have
            return
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left, rest, pool = np.zeros_like(have), int(sizes[low:middle].sum()), int(have.sum())
        for i, own in enumerate(have):  # the draw, one stratum after the other
            pool -= int(own)
            left[i] = rng.hypergeometric(int(own), pool, rest) if own + pool and rest else 0
            rest -= int(left[i])
        deal(left, low, middle)
        deal(have - left, middle, high)

    deal(counts, 0, shards)
    return out


def plan(docs: DataFrame, area: WorkArea, seed: int = 7, shards: int = SHARDS) -> DataFrame:
    """What the mix takes of each document: ``source_size, target, taken`` and ``shards``, one entry for each copy.

    ``docs`` needs ``doc_id, source, size``.
    """
    key = F.xxhash64(F.lit(seed), "doc_id", "source", "size")
    sized = docs.select("doc_id", "source", "size", key.alias("key"))
    goal = targets(sized)
    whole = F.floor(F.col("target") / F.col("source_size"))
    wanted = F.round("target").cast("bigint")
    goal = (
        goal.withColumn("epochs", F.when(F.col("source_size") > 0, whole).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("rest", F.greatest(wanted - F.col("epochs") * F.col("source_size"), F.lit(0)))
        .withColumn("blocks", F.least(F.ceil(F.col("docs") / BLOCK_DOCS), F.lit(MAX_BLOCKS)).cast("bigint"))
        .withColumn("stratum", F.col("place") % STRATA)
    )
    goal = area.save(goal, "goal")
    same_source = F.col("d.source").eqNullSafe(F.col("g.source"))
    placed = (
        sized.alias("d")
        .join(goal.alias("g"), same_source)
        .select(
            "d.doc_id", F.col("g.place").alias("place"), "d.size", "d.key", F.pmod("d.key", "g.blocks").alias("block")
        )
    )
    # blocks in permuted order with the words before each
    block = placed.groupBy("place", "block").agg(F.sum("size").alias("words"))
    turn = F.xxhash64(F.lit(seed + 1), "place", "block")
    permuted = W.partitionBy("place").orderBy(turn, "block").rowsBetween(W.unboundedPreceding, -1)
    block = block.withColumn("before", F.coalesce(F.sum("words").over(permuted), F.lit(0)))
    block = block.join(goal.drop("source"), "place")
    copies = F.col("epochs") + F.when((F.col("before") < F.col("rest")) & (F.col("words") > 0), 1).otherwise(0)
    block = area.save(block.withColumn("copies", copies), "blocks")

    drawn = block.filter("copies > 0").select(
        "stratum", "place", "block", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    )
    counts = {r.stratum: r.n for r in drawn.groupBy("stratum").agg(F.count("*").alias("n")).collect()}  # <= STRATA
    strata = sorted(counts)
    quotas = split(np.array([counts[s] for s in strata], np.int64), shards, seed) if strata else np.zeros((shards, 0))
    edges = [(int(s), [int(x) for x in np.cumsum(quotas[:, i])]) for i, s in enumerate(strata)]
    edges = docs.sparkSession.createDataFrame(edges, "stratum bigint, edges array<bigint>")
    order = W.partitionBy("stratum").orderBy(F.xxhash64(F.lit(seed + 2), "place", "block", "copy"), "place", "block")
    dealt = drawn.withColumn("draw", F.row_number().over(order)).join(F.broadcast(edges), "stratum")
    shard = F.size(F.filter("edges", lambda e: e < F.col("draw")))
    dealt = (
        dealt.withColumn("shard", shard.cast("int"))
        .groupBy("place", "block")
        .agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("dealt"))
        .withColumn("shards", F.col("dealt.shard"))
        .select("place", "block", "shards")
    )
    block = block.join(dealt, ["place", "block"], "left")
    inside = W.partitionBy("place", "block").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.least(left, F.col("size")), F.lit(0))
    taken = F.col("epochs") * F.col("size") + part
    own = F.col("epochs") + F.when(part > 0, 1).otherwise(0)
    return (
        placed.join(block.drop("words", "docs"), ["place", "block"])
        .withColumn("left", left)
        .withColumn("taken", taken)
        .withColumn("copies", own)
        .withColumn("shards", F.slice(F.coalesce("shards", F.array().cast("array<int>")), F.lit(1), own.cast("int")))
        .select("doc_id", "size", "key", "source_size", "target", "taken", "epochs", "shards")
    )


def mix(spark: SparkSession, docs: DataFrame, area: WorkArea, seed: int = 7, shards: int = SHARDS) -> DataFrame:
    """The mix itself: the documents' columns, then ``copy, words`` (the first so many words of this copy belong to
    the mix), ``shard`` and ``turn`` (order by it inside a shard); where a document column has one of these names, the
    mix's own is named ``mix_copy`` and so on.

    A row is known by a 128-bit hash of all its columns; equal rows share it, and each takes its own part.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    known = F.concat(F.hex(F.xxhash64(*columns)), F.hex(F.xxhash64(F.lit(seed), *columns)))
    base = docs.select(known.alias("row"), F.struct(*columns).alias("own"))
    sized = base.select(F.col("row").alias("doc_id"), F.col("own.source").alias("source"), size_of(F.col("own.text")).alias("size"))
    taken = plan(area.save(sized, "sized"), area, seed, shards)
    rest = F.col("taken") - F.col("epochs") * F.col("size")
    copies = (
        taken.select("doc_id", "size", "epochs", "taken", F.posexplode("shards").alias("copy", "shard"))
        .withColumn("words", F.when(F.col("copy") < F.col("epochs"), F.col("size")).otherwise(rest))
        .withColumn("turn", F.xxhash64(F.lit(seed + 3), "doc_id", "copy"))
        .select(F.col("doc_id").alias("row"), "copy", "words", "shard", "turn")
    )
    # equal rows meet before the shuffle
    one = base.dropDuplicates(["row"])
    names = {c: free_name(c, docs.columns, "mix_") for c in ("copy", "words", "shard", "turn")}
    return one.join(area.save(copies, "copies"), "row").select(
        *[F.col("own")[c].alias(c) for c in docs.columns], *[F.col(c).alias(name) for c, name in names.items()]
    )
