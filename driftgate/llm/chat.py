"""Multi-party perspective rotation: every participant's view of a dialogue, built from DataFrame functions only.

For each participant the whole dialogue is rendered with that speaker as the assistant and everyone else as a named
user. ``mask`` lists the character ranges that a loss should cover: the speaker's own text with its end mark.

A dialogue of any length comes in parts of at most ``PART_TURNS`` turns: concatenated in order of ``part`` they are the
dialogue, and mask ranges count from its beginning. Where a part begins follows from the lengths of the parts before it, so
texts meet a part at a time and only lengths go through a view's whole order; rows of one dialogue with null or equal turn
numbers are ordered together.

Defined cases: turns are ordered by number, then name and text, null numbers last; repeated rows stay; a null role is
named ``unknown``; a null text is empty; rows with a null ``conv_id`` form one dialogue; the mark ``<|`` inside texts
and names becomes ``< |`` so that content can't forge a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

PART_TURNS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _safe(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _head(name: Column, own: bool) -> Column:
    return F.lit(f"{OPEN}assistant\n") if own else F.concat(F.lit(f"{OPEN}user name="), name, F.lit("\n"))


def rotate(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """``conv_id, speaker, part, n_turns, start, rendered, mask`` for every participant and part."""
    turns = conversations.select(
        "conv_id",
        "turn",
        _safe(F.coalesce("role", F.lit("unknown"))).alias("name"),
        _safe(F.coalesce("text", F.lit(""))).alias("body"),
    ).withColumn("stretch", F.floor(F.col("turn") / part_turns))
    order = W.partitionBy("conv_id", "stretch").orderBy(F.col("turn").asc_nulls_last(), "name", "body")
    piece = F.floor((F.row_number().over(order) - 1) / part_turns)
    parts = (
        turns.withColumn("nth", F.row_number().over(order))
        .withColumn("piece", piece)
        .groupBy("conv_id", "stretch", "piece")
        .agg(
            F.sort_array(F.collect_list(F.struct("nth", "name", "body"))).alias("turns"),
            F.sum(F.length(_head(F.col("name"), False)) + F.length("body") + len(CLOSE)).alias("length"),
        )
    )
    speakers = turns.select("conv_id", F.col("name").alias("speaker")).distinct()

    def own(t):
        return t["name"] == F.col("speaker")

    # where each part of each view begins, from lengths alone: no text goes through this window
    lead = len(f"{OPEN}assistant\n")
    shorter = F.length(_head(F.col("speaker"), False)) - lead
    lengths = parts.join(speakers.withColumnRenamed("conv_id", "whose"), F.col("conv_id").eqNullSafe(F.col("whose"))).select(
        "conv_id", "speaker", "stretch", "piece", (F.col("length") - F.size(F.filter("turns", own)) * shorter).alias("length")
    )
    running = W.partitionBy("conv_id", "speaker").orderBy(F.col("stretch").asc_nulls_last(), "piece")
    before = F.sum("length").over(running.rowsBetween(W.unboundedPreceding, -1))
    places = lengths.select(
        F.col("conv_id").alias("whose"),
        "speaker",
        F.col("stretch").alias("at_stretch"),
        F.col("piece").alias("at_piece"),
        F.coalesce(before, F.lit(0)).alias("start"),
        (F.row_number().over(running) - 1).alias("part"),
    )
    same = [("conv_id", "whose"), ("stretch", "at_stretch"), ("piece", "at_piece")]
    views = parts.join(places, [F.col(x).eqNullSafe(F.col(y)) for x, y in same])

    segments = F.transform(
        "turns",
        lambda t: F.struct(
            own(t).alias("own"),
            F.concat(
                F.when(own(t), _head(t["name"], True)).otherwise(_head(t["name"], False)), t["body"], F.lit(CLOSE)
            ).alias("segment"),
        ),
    )
    views = views.withColumn("segments", segments).withColumn(
        "rendered", F.array_join(F.transform("segments", lambda x: x["segment"]), "")
    )
    walked = F.aggregate(
        "segments",
        F.struct(F.col("start").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["segment"])).alias("at"),
            F.when(
                x["own"],
                F.concat(
                    a["mask"],
                    F.array(
                        F.struct(
                            (a["at"] + lead).alias("start"), (a["at"] + F.length(x["segment"]) - 1).alias("end")
                        )
                    ),
                ),
            )
            .otherwise(a["mask"])
            .alias("mask"),
        ),
    )
    return views.select(
        "conv_id",
        "speaker",
        "part",
        F.size("turns").alias("n_turns"),
        "start",
        "rendered",
        walked["mask"].alias("mask"),
    )


def mask_text(mask: Column) -> Column:
    """``start-end`` pairs in one string."""
    return F.array_join(F.transform(mask, lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
