"""Nearest neighbours by inner product: low-dimensional stable projections under a kd-tree, with a chi-square stop.

Largest inner product becomes least distance by one more coordinate (``sqrt(M^2 - |x|^2)`` for a vector of the table, 0
for a query; M is the largest length). Vectors are projected on ``DIMENSIONS`` Gaussian directions. For a vector at
distance d, projected distance squared over d squared follows a chi-square law, so once the next projected distance
squared exceeds the law's ``CONFIDENCE`` quantile times the squared distance of the k-th neighbour found, a better
vector is still unseen with probability 1 - CONFIDENCE at most, and the search stops.

The upper levels of the kd-tree are fitted to a bounded sample and cut the table into cells; each cell sorts its own
rows by leaves, and one that has outgrown ``CELL_ROWS`` is searched in chunks. A query first searches the cell it falls in, then every cell that its
stopping test doesn't rule out; in a cell single vectors are verified in shells of growing projected distance until the
test holds. All scores returned are inner products of the original vectors in double precision.

Equal vectors could fill a cell: of each vector only the ``k + 1`` smallest ids take part, as no other can be among a
query's k nearest. Equal queries are searched once.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, take
no part; of rows that share an id the one with the smallest vector stays; shorter vectors count as filled up with
zeros; with fewer candidates than k all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from driftgate.session import WorkArea

DIMENSIONS = 16
CONFIDENCE = 0.93
#: Parts of the largest squared distance that can matter, after which the k-th best score is looked at again.
SHELLS = (0.5, 0.7, 0.85, 1)
CELL_ROWS = 8192
MAX_DEPTH = 16
LEAF_ROWS = 128
SAMPLE_BYTES = 8 << 20
QUERIES_PER_GROUP = 20_000


def chi_square_quantile(p: float, even: int = DIMENSIONS) -> float:
    """Quantile for an even number of degrees of freedom, by halving."""
    low, high = 0.0, 10.0 * even + 200
    for _ in range(200):
        x = (low + high) / 2
        above = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(even // 2))
        low, high = (low, x) if 1 - above > p else (x, high)
    return high


STOP = chi_square_quantile(CONFIDENCE)


def dense(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column as one matrix of doubles, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.concatenate([np.arange(n) for n in size])] = flat
    return out


class Tree:
    """Projection, and the upper levels of the kd-tree as a complete binary tree."""

    def __init__(self, width: int, longest: float, depth: int, seed: int = 5):
        self.width, self.longest, self.depth = width, longest, depth
        self.axes = np.random.default_rng(seed).standard_normal((width + 1, DIMENSIONS))
        self.axis = np.zeros(1 << depth, np.int64)
        self.value = np.zeros(1 << depth)

    def project(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        out = x @ self.axes[:-1]
        if not query:
            rest = np.sqrt(np.maximum(self.longest - np.einsum("ij,ij->i", x, x), 0))
            out += rest[:, None] * self.axes[-1]
        return out

    def fit(self, sample: np.ndarray) -> None:
        p = self.project(sample)
        node = np.ones(len(p), np.int64)
        for level in range(self.depth):
            for n in range(1 << level, 2 << level):
                own = p[node == n]
                self.axis[n] = int(np.argmax(own.max(0) - own.min(0))) if len(own) else 0
                self.value[n] = np.median(own[:, self.axis[n]]) if len(own) else 0.0
            node = node * 2 + (p[np.arange(len(p)), self.axis[node]] > self.value[node])

    def cell(self, p: np.ndarray) -> np.ndarray:
        node = np.ones(len(p), np.int64)
        for _ in range(self.depth):
            node = node * 2 + (p[np.arange(len(p)), self.axis[node]] > self.value[node])
        return node - (1 << self.depth)

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper corners of the cells."""
        low = np.full((2 << self.depth, DIMENSIONS), -np.inf)
        high = np.full((2 << self.depth, DIMENSIONS), np.inf)
        for n in range(1, 1 << self.depth):
            for child in (2 * n, 2 * n + 1):
                low[child], high[child] = low[n], high[n]
            high[2 * n, self.axis[n]] = low[2 * n + 1, self.axis[n]] = self.value[n]
        return low[1 << self.depth :], high[1 << self.depth :]


def _gap2(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(p), len(low)))
    for i in range(p.shape[1]):
        away = np.maximum(np.maximum(low[None, :, i] - p[:, None, i], p[:, None, i] - high[None, :, i]), 0)
        out += away * away
    return out


def _leaves(p: np.ndarray) -> list[np.ndarray]:
    """Rows of a part of a cell cut at medians of the widest axis down to leaves."""
    todo, out = [np.arange(len(p))], []
    while todo:
        rows = todo.pop()
        spread = p[rows].max(0) - p[rows].min(0)
        if len(rows) <= LEAF_ROWS or not spread.max():
            out.append(rows)
            continue
        order = rows[np.argsort(p[rows, int(np.argmax(spread))], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return out


def verified(x: np.ndarray, x32: np.ndarray, ids: np.ndarray, away: np.ndarray, q: np.ndarray, k: int, ceiling: float, bound: float):
    """Best ``k`` of the rows for one query, and how many rows were verified.

    ``away`` is each row's projected squared distance. Rows are verified in shells of growing distance; after each shell
    the k-th best score gives the distance beyond which the chi-square test rules a row out. Scores are first taken in
    single precision; those that may be among the best are then taken in double precision, row by row, so that equal
    vectors get equal scores.
    """
    own, slack = float(q @ q), 1e-5 * math.sqrt(max(float(q @ q) * ceiling, 0.0))
    short, least = q.astype(np.float32), bound

    def limit() -> float:
        return STOP * max(own + ceiling - 2 * (least - slack), 0.0)

    near = min(len(ids), 4 * k)
    rows = np.argpartition(away, near - 1)[:near] if near < len(ids) else np.arange(len(ids))
    score = x32[rows] @ short
    reached = float(away[rows].max())
    for share in SHELLS:
        if len(score) >= k:
            least = max(least, float(np.partition(score, -k)[-k]))
        upto = limit() if share == 1 else max(reached, share * limit())
        more = np.flatnonzero((away > reached) & (away <= upto))
        reached = max(reached, upto)
        rows, score = np.append(rows, more), np.append(score, x32[more] @ short)
    count = len(rows)
    if len(score) > k:
        best = score >= np.partition(score, -k)[-k] - 2 * slack
        rows = rows[best]
    exact = (x[rows] * q).sum(1)
    order = np.lexsort((ids[rows], -exact))[:k]
    return ids[rows[order]], exact[order], count


def _search(tree: Tree, k: int):
    """Best ``k`` of a part of a cell for each of its queries."""

    def apply(data: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"query": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not (data.num_rows and queries.num_rows):
            return empty
        x, ids = dense(data["vector"], tree.width), data["vec_id"].to_numpy()
        q, key, bound = dense(queries["vector"], tree.width), queries["query"].to_numpy(), queries["bound"].to_numpy()
        p, pq = tree.project(x), tree.project(q, query=True)
        order = np.concatenate(_leaves(p))  # neighbours lie together
        x, ids, p = x[order], ids[order], p[order]
        x32, length, out = x.astype(np.float32), (p * p).sum(1), []
        for at in range(0, len(q), 64):
            part = pq[at : at + 64]
            away = (part * part).sum(1)[:, None] + length - 2 * (part @ p.T)
            for i, row in enumerate(away, at):
                found_id, found, _ = verified(x, x32, ids, row, q[i], k, tree.longest, bound[i])
                out.append((np.full(len(found), key[i]), found_id, found))
        return pa.table(dict(zip(("query", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return apply


def _usable(v: Column) -> Column:
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return v.isNotNull() & ~F.coalesce(odd, F.lit(False)) & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, k: int, area: WorkArea) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found for each query among all other rows.

    ``vectors`` has ``vec_id, embedding``; ``is_query`` is a condition on ``vec_id``.
    """
    own = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("vector"))
    own = own.filter(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    own = own.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    key = F.xxhash64("vector")
    own = area.save(own.withColumn("query", key), "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, width, longest = own.agg(F.count("*"), F.max(F.size("vector")), F.max(square)).first()
    schema = "query bigint, vec_id bigint, score double"
    if not n:
        nothing = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
        return nothing
    # of equal vectors the smallest ids stand for all
    nth = F.row_number().over(W.partitionBy("query").orderBy("vec_id"))
    kept = own.withColumn("nth", nth).filter(F.col("nth") <= k + 1).select("vec_id", "vector")
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(n / CELL_ROWS))))
    tree = Tree(width, longest, depth)
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1000, SAMPLE_BYTES // (8 * width)))
    tree.fit(dense(sample.select("vector").toArrow()["vector"], width))

    def placed(query: bool):
        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = tree.cell(tree.project(dense(batch.column(1), width), query))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

        return apply

    kind = own.schema["vector"].dataType.simpleString()
    data = area.save(kept.mapInArrow(placed(False), f"vec_id bigint, vector {kind}, cell bigint"), "cells")
    # a cell that has grown beyond its size is searched in chunks
    chunks = data.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("bigint").alias("chunks"))
    chunks = area.save(chunks, "chunks")
    data = data.join(chunks, "cell").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks"))).drop("chunks")
    asked = own.filter(is_query)
    queries = asked.groupBy("query").agg(F.min("vector").alias("vector"))
    queries = area.save(queries.mapInArrow(placed(True), f"query bigint, vector {kind}, cell bigint"), "queries")

    def found(routed: DataFrame, name: str) -> DataFrame:
        routed = area.save(routed, f"{name}_routes")
        busy = routed.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES_PER_GROUP).cast("bigint").alias("parts"))
        parted = routed.join(busy, "cell").withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")))
        copies = data.join(busy, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk")
        parted = parted.join(chunks, "cell").select("cell", "part", each, "query", "vector", "bound")
        group = ("cell", "part", "chunk")
        left = copies.select(*group, "vec_id", "vector").groupBy(*group)
        hits = left.cogroup(parted.groupBy(*group)).applyInArrow(_search(tree, k + 1), schema)
        nearest = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        first = hits.withColumn("nth", F.row_number().over(nearest)).filter(F.col("nth") <= k + 1).drop("nth")
        return area.save(first, name)

    home = found(queries.withColumn("bound", F.lit(float("-inf"))), "home")
    bound = home.groupBy("query").agg(F.when(F.count("*") > k, F.min("score")).alias("bound"))
    low, high = tree.boxes()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                q, bound_ = dense(part["vector"], width), part["bound"].to_numpy(zero_copy_only=False).astype(np.float64)
                bound_ = np.where(np.isnan(bound_), -np.inf, bound_)
                reach = STOP * np.maximum(np.einsum("ij,ij->i", q, q) + longest - 2 * bound_, 0)
                go = _gap2(tree.project(q, True), low, high) <= reach[:, None]
                go[np.arange(len(q)), part["cell"].to_numpy()] = False
                row, cell = np.nonzero(go)
                yield pa.RecordBatch.from_arrays(
                    [part["query"].take(pa.array(row)), part["vector"].take(pa.array(row)), pa.array(cell), pa.array(bound_[row])],
                    names=["query", "vector", "cell", "bound"],
                )

    routed = queries.join(bound, "query", "left").select("query", "vector", "cell", "bound")
    away = found(routed.mapInArrow(spread, f"query bigint, vector {kind}, cell bigint, bound double"), "away")
    nearest = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = home.unionAll(away).withColumn("nth", F.row_number().over(nearest)).filter(F.col("nth") <= k + 1)
    listed = best.groupBy("query").agg(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id")).alias("all"))
    each = asked.select(F.col("vec_id").alias("query_id"), "query").join(listed, "query")
    others = F.filter(F.array_sort("all"), lambda x: x["vec_id"] != F.col("query_id"))
    return each.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "hit")).select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("hit.vec_id").alias("vec_id"),
        (-F.col("hit.minus")).alias("score"),
    )
