"""Hard negatives by slots: for each positive of an anchor the best rows of other labels inside the positive's window.

A window of a positive reaches from a lower to an upper share of its score. The upper limits of an anchor's windows split
the scores into disjoint slots; a score belongs to the least limit that it doesn't pass. Each tile of rows keeps its best
k of each slot, those of all tiles are merged for each slot, and from any slot downwards the first k are the best k at or below its
limit; what lies below a window's lower limit is cut off at last. So overlapping windows share all scoring and
sorting, and a row is scored once for each anchor.

Anchors are a stated set of rows, scored against all rows in blocks: both are sorted by label and packed into tiles of at
most ``ANCHORS`` and ``ROWS`` vectors, tiles meet by a key, and a group multiplies one tile of each; rows of an anchor's
own label (for the positives) or of other labels (for the negatives) are picked from the product. The positives need tiles that
share a label only. A label with most of the rows is just more tiles. What leaves a group is k rows for each anchor and slot.

Scores are exact: products of whole numbers in single precision while no sum can pass 2^24, in double precision up to 2^53,
else in 64-bit integers; sums that might pass those are an error.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; missing
components of a shorter vector count as 0; rows with the anchor's own id are never its positives or negatives; repeated
candidate rows count each, repeated anchor rows (same id, label and vector) once; an empty table gives no rows; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from driftgate.session import WorkArea

ROWS = 4096
ANCHORS = 4096
#: Anchors whose scores a task holds at a time.
STRIP = 256
_TILE = "tile bigint, ids binary, labels binary, vectors binary, kinds array<int>"
_HIT = "anchor bigint, slot int, vec_id bigint, score bigint"


def whole(vector: Column, scale: int = 256) -> Column:
    """Components as whole numbers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


def _kind(largest: int, width: int) -> str:
    """The narrowest type in which all sums of products are exact."""
    most = largest * largest * max(width, 1)
    for bits, kind in ((24, "f4"), (53, "f8"), (63, "i8")):
        if most < 1 << bits:
            return kind
    raise ValueError("components are too large for scores of 64 bits")


def _matrix(column: pa.ListArray, width: int, kind: str) -> np.ndarray:
    flat, size = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), width), kind)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _tiles(rows: DataFrame, size: int, width: int, kind: str) -> DataFrame:
    """Tiles of up to ``size`` neighbours in the order of labels."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, n = TaskContext.get().partitionId() << 32, [], 0

        def tile_of() -> pa.RecordBatch:
            ids, labels, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
            values = [[tile], [ids.tobytes()], [labels.tobytes()], [vectors.tobytes()], [np.unique(labels).tolist()]]
            types = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()))
            names = ("tile", "ids", "labels", "vectors", "kinds")
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - n)
                held.append((part["vec_id"].to_numpy(), part["label"].to_numpy(), _matrix(part["vector"], width, kind)))
                at, n = at + part.num_rows, n + part.num_rows
                if n == size:
                    yield tile_of()
                    tile, n = tile + 1, 0
                    held.clear()
        if held:
            yield tile_of()

    hashed = F.xxhash64("vec_id", "vector")
    placed = rows.select("vec_id", "label", "vector").repartitionByRange("label", hashed).sortWithinPartitions("label")
    return placed.mapInArrow(pack, _TILE)


def _read(table: pa.Table, kind: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels, vectors = (table[c][0].as_buffer() for c in ("ids", "labels", "vectors"))
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(labels, np.int32), np.frombuffer(vectors, kind).reshape(len(ids), width)


def _best(score: np.ndarray, fits: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the first ``k`` fitting scores of each row, ties by smaller id."""
    if score.shape[1] > k:
        least = np.iinfo(np.int64).min if score.dtype.kind == "i" else -np.inf
        held = np.where(fits, score, least)
        fits &= score >= np.partition(held, score.shape[1] - k, axis=1)[:, -k, None]
    row, column = np.nonzero(fits)
    order = np.lexsort((ids[column], -score[row, column], row))
    row, column = row[order], column[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], column[nth < k]


def _hits(found: list[tuple]) -> pa.Table:
    columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0)] * 4
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
    names = ("anchor", "slot", "vec_id", "score")
    return pa.table([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, types, strict=True)], names=names)


def _positives(k: int, kind: str, width: int) -> Callable:
    """Best rows of the anchor's label, from one tile of rows and one of anchors."""

    def apply(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        ids, labels, x = _read(rows, kind, width)
        own, own_label, a = _read(anchors, kind, width)
        first, found = anchors["tile"][0].as_py() * ANCHORS, []
        for at in range(0, len(own), STRIP):
            part = slice(at, at + STRIP)
            score = a[part] @ x.T
            fits = (own_label[part, None] == labels) & (own[part, None] != ids)
            row, column = _best(score, fits, ids, k)
            found.append((first + at + row, np.zeros(len(row)), ids[column], score[row, column]))
        return _hits(found)

    return apply


def _negatives(k: int, kind: str, width: int) -> Callable:
    """Best rows of other labels in each slot of each anchor. ``limits``: upper limits, falling; ``floor``: no window
    reaches below."""

    def apply(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        ids, labels, x = _read(rows, kind, width)
        own, own_label, a = _read(anchors, kind, width)
        places, found = anchors["places"][0].as_py(), []
        limits, floors = anchors["limits"][0].as_py(), anchors["floors"][0].as_py()
        first = anchors["tile"][0].as_py() * ANCHORS
        order = np.argsort(places)
        place = np.array(places, np.int64)[order]
        most = max(map(len, limits), default=0)
        # behind the last limit of an anchor its floor closes the last slot
        upper = np.array([[*limits[i], *[floors[i] - 1] * (most + 1 - len(limits[i]))] for i in order]).reshape(-1, most + 1)
        for at in range(0, len(place), STRIP):
            part = place[at : at + STRIP]
            score = a[part] @ x.T
            other = (own_label[part, None] != labels) & (own[part, None] != ids)
            for slot in range(most):
                high, low = (upper[at : at + STRIP, s, None] for s in (slot, slot + 1))
                row, column = _best(score, other & (score <= high) & (score > low), ids, k)
                found.append((first + part[row], np.full(len(row), slot), ids[column], score[row, column]))
        return _hits(found)

    return apply


def _meet(pairs: DataFrame, rows: DataFrame, anchors: DataFrame, fn: Callable) -> DataFrame:
    """``fn`` of the two tiles of each pair ``(row_tile, anchor_tile)``."""
    keys = ("row_tile", "anchor_tile")
    left = rows.withColumn("row_tile", F.col("tile")).join(pairs, "row_tile").drop("kinds")
    right = anchors.withColumn("anchor_tile", F.col("tile")).join(pairs, "anchor_tile").drop("kinds")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(fn, _HIT)


def _first(hits: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each anchor and slot; every tile's are limited before the shuffle."""
    best = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k)


def _share(score: str, percent: int, up: bool = False) -> Column:
    """Whole-number share of a score, rounded down or up."""
    part = F.col(score) * (-percent if up else percent)
    down = F.call_function("div", part - F.pmod(part, F.lit(100).cast("bigint")), F.lit(100).cast("bigint"))
    return -down if up else down


def mine(
    vectors: DataFrame, is_anchor: Column, area: WorkArea, positives: int = 5, k: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors (vec_id, label, vector)``, whole-number vectors; ``is_anchor`` is a condition on ``vec_id``. Of the first
    ``positives`` rows of an anchor's label each gets the first ``k`` rows of other labels with a score of ``low`` to
    ``high`` percent of the positive's.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("int").alias("label"), "vector")
    rows = area.save(rows.dropna(), "rows")
    size = F.max(F.array_max(F.transform("vector", F.abs)))
    largest, width = rows.agg(F.coalesce(size, F.lit(0)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    kind = _kind(largest, width)
    tiles = area.save(_tiles(rows, ROWS, width, kind), "tiles")
    anchors = area.save(_tiles(rows.filter(is_anchor).distinct(), ANCHORS, width, kind), "anchors")

    kinds = [t.select(F.col("tile").alias(n), F.explode("kinds").alias("label")) for t, n in ((tiles, "row_tile"), (anchors, "anchor_tile"))]
    alike = kinds[0].join(kinds[1], "label").select("row_tile", "anchor_tile").distinct()
    near = _first(_meet(alike, tiles, anchors, _positives(positives, kind, width)), positives)
    windows = near.select(
        "anchor",
        F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
        F.col("nth").alias("place"),
        _share("score", low, up=True).alias("floor"),
        _share("score", high).alias("ceiling"),
    ).filter("floor <= ceiling")
    windows = area.save(windows, "windows")

    edges = windows.groupBy("anchor").agg(
        F.sort_array(F.collect_set("ceiling"), asc=False).alias("limits"), F.min("floor").alias("floor")
    )
    asked = edges.groupBy(F.call_function("div", F.col("anchor"), F.lit(ANCHORS).cast("bigint")).alias("tile")).agg(
        *[F.collect_list(F.struct((F.col("anchor") % ANCHORS).alias("place"), "limits", "floor")).alias("all")]
    )  # at most one entry for each anchor of a tile
    asked = asked.select("tile", *[F.col(f"all.{c}").alias(n) for c, n in (("place", "places"), ("limits", "limits"), ("floor", "floors"))])
    asked = area.save(anchors.join(asked, "tile"), "asked")
    # one number for each ANCHORS anchors
    numbers = [r.tile for r in asked.select("tile").collect()]
    all_rows = tiles.select(F.col("tile").alias("row_tile"), F.explode(F.array(*map(F.lit, numbers)).cast("array<bigint>")).alias("anchor_tile"))
    hits = _first(_meet(all_rows, tiles, asked, _negatives(k, kind, width)), k)

    # falling slots, falling scores in each: from a limit's slot on the list is sorted as a whole
    merged = hits.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", (-F.col("score")).alias("minus"), "vec_id"))).alias("all"))
    limits = edges.select("anchor", F.posexplode("limits").alias("slot_of", "ceiling"))
    below = F.slice(F.filter("all", lambda x: x["slot"] >= F.col("slot_of")), 1, k)
    inside = F.filter(below, lambda x: -x["minus"] >= F.col("floor"))
    names = anchors.select("tile", "ids").mapInArrow(_names, "anchor bigint, anchor_id bigint")
    return (
        windows.join(limits, ["anchor", "ceiling"])
        .join(merged, "anchor")
        .select("anchor", "positive_id", "positive_score", F.posexplode(inside).alias("at", "hit"))
        .join(names, "anchor")
        .select(
            "anchor_id",
            "positive_id",
            (F.col("at") + 1).cast("int").alias("rank"),
            F.col("hit.vec_id").alias("negative_id"),
            "positive_score",
            (-F.col("hit.minus")).alias("negative_score"),
        )
    )


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The id of each anchor."""
    for batch in batches:
        for tile, ids in zip(batch["tile"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            ids = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tile * ANCHORS + np.arange(len(ids))), pa.array(ids)], names=["anchor", "anchor_id"]
            )
