"""User-defined mergeable aggregates, written in Python over numpy columns.

An accumulator says how states are created, how rows are added to them, how two states merge and what comes out in the
end. It runs in two Arrow steps like a built-in aggregate: every task folds its rows to one state a key, some ``COMBINE_ROWS``
rows at a time, before anything is shuffled; the states meet sorted by key and are merged as a stream. So a key with a third of
all rows sends a few states a task, and no task holds more than a batch of them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

# tasks get these classes with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COMBINE_ROWS = 200_000

Columns = dict[str, np.ndarray]


class Accumulator:
    """Subclass with the types of its ``inputs``, of its ``state`` and of its ``result``.

    States of many groups are held as columns; ``group`` has the group of each row (or of each other state). Rows with a
    null input are left out; a group without any other rows has the result of a fresh state.
    """

    inputs: dict[str, str]
    state: dict[str, str]
    result: dict[str, str]

    def create(self, n: int) -> Columns:
        raise NotImplementedError

    def add(self, state: Columns, group: np.ndarray, rows: Columns) -> None:
        """Add rows to the states of their groups, in place."""
        raise NotImplementedError

    def merge(self, state: Columns, group: np.ndarray, other: Columns) -> None:
        """Merge other states into those of their groups, in place; any order, any grouping."""
        raise NotImplementedError

    def finish(self, state: Columns) -> Columns:
        raise NotImplementedError


class Moments(Accumulator):
    """Count, mean and variance of one column, by pairwise merges that don't cancel."""

    inputs = {"x": "double"}
    state = {"n": "bigint", "mean": "double", "spread": "double"}
    result = {"n": "bigint", "mean": "double", "variance": "double"}

    def create(self, n):
        return {"n": np.zeros(n, np.int64), "mean": np.zeros(n), "spread": np.zeros(n)}

    def add(self, state, group, rows):
        groups, x = len(state["n"]), rows["x"]
        n = np.bincount(group, minlength=groups)
        mean = np.divide(np.bincount(group, x, groups), n, out=np.zeros(groups), where=n > 0)
        spread = np.bincount(group, (x - mean[group]) ** 2, groups)
        self._join(state, {"n": n, "mean": mean, "spread": spread})

    def merge(self, state, group, other):
        # a weighted mean around the groups' own, then the spread around it
        groups, n = len(state["n"]), other["n"]
        total = np.bincount(group, n, groups)
        mean = np.divide(np.bincount(group, n * other["mean"], groups), total, out=np.zeros(groups), where=total > 0)
        spread = np.bincount(group, other["spread"] + n * (other["mean"] - mean[group]) ** 2, groups)
        self._join(state, {"n": total.astype(np.int64), "mean": mean, "spread": spread})

    def _join(self, state, more):
        total = state["n"] + more["n"]
        apart = more["mean"] - state["mean"]
        share = np.divide(more["n"], total, out=np.zeros(len(total)), where=total > 0)
        state["spread"] += more["spread"] + apart * apart * state["n"] * share
        state["mean"] += apart * share
        state["n"] += more["n"]

    def finish(self, state):
        variance = np.divide(state["spread"], state["n"], out=np.full(len(state["n"]), np.nan), where=state["n"] > 0)
        return {"n": state["n"], "mean": np.where(state["n"] > 0, state["mean"], np.nan), "variance": variance}


def _groups(columns: Sequence[pa.ChunkedArray]) -> tuple[np.ndarray, np.ndarray]:
    """The group of each row, numbered in the order of first rows, and those rows; nulls are values like others."""
    n = len(columns[0]) if columns else 0
    code = np.zeros(n, np.int64)
    for column in columns:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        own = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
    _, first, back = np.unique(code, return_index=True, return_inverse=True)
    rank = np.argsort(np.argsort(first))
    return rank[back], np.sort(first)


def _table(schema: pa.Schema, keys: Sequence[pa.Array], columns: Columns) -> Iterator[pa.RecordBatch]:
    kinds = schema.types[len(keys) :]
    values = [pa.array(columns[schema.names[len(keys) + i]], t) for i, t in enumerate(kinds)]
    table = pa.Table.from_arrays([*keys, *values], schema=schema)
    yield from table.to_batches()


def _numpy(table: pa.Table, names: Sequence[str]) -> Columns:
    return {c: table[c].to_numpy() for c in names}


def _partial(spec: Accumulator, by: int, schema: pa.Schema):
    """Rows to one state a key for every ``COMBINE_ROWS`` rows."""

    def fold(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        group, first = _groups(table.columns[:by])
        state = spec.create(len(first))
        whole = np.ones(table.num_rows, bool)
        for c in spec.inputs:
            whole &= table[c].is_valid().to_numpy()
        spec.add(state, group[whole], _numpy(table.filter(pa.array(whole)), list(spec.inputs)))
        keys = [c.combine_chunks().take(pa.array(first)) for c in table.columns[:by]]
        yield from _table(schema, keys, state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= COMBINE_ROWS:
                yield from fold(held)
                held, rows = [], 0
        if rows:
            yield from fold(held)

    return run


def _final(spec: Accumulator, by: int, states: pa.Schema, schema: pa.Schema):
    """States sorted by key to results; the last key of a batch waits for the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*([] if waiting is None else [waiting]), batch.cast(states)])
            group, first = _groups(table.columns[:by])
            state = spec.create(len(first))
            spec.merge(state, group, _numpy(table, list(spec.state)))
            keys = [c.combine_chunks().take(pa.array(first)) for c in table.columns[:by]]
            last = len(first) - 1
            waiting = next(_table(states, [k[last:] for k in keys], {c: v[last:] for c, v in state.items()}))
            if last:
                done = spec.finish({c: v[:last] for c, v in state.items()})
                yield from _table(schema, [k[:last] for k in keys], done)
        if waiting is not None:
            state = _numpy(pa.Table.from_batches([waiting]), list(spec.state))
            yield from _table(schema, waiting.columns[:by], spec.finish(state))

    return run


def aggregate(df: DataFrame, by: Sequence[str], spec: Accumulator, **inputs: Column) -> DataFrame:
    """``by`` and the results of the accumulator for each group; ``inputs`` are columns for its inputs' names.

    The accumulator's class travels with the job, so its module need not be installed on the executors.
    """
    if type(spec).__module__ != "__main__":
        cloudpickle.register_pickle_by_value(sys.modules[type(spec).__module__])
    rows = df.select(*by, *[inputs[c].cast(kind).alias(c) for c, kind in spec.inputs.items()])
    keys = list(rows.schema)[: len(by)]

    def shaped(columns: dict[str, str]) -> tuple[StructType, pa.Schema]:
        schema = StructType([*keys, *StructType.fromDDL(", ".join(f"{c} {kind}" for c, kind in columns.items()))])
        return schema, df.sparkSession.createDataFrame([], schema).toArrow().schema

    (state, state_arrow), (result, result_arrow) = shaped(spec.state), shaped(spec.result)
    partial = rows.mapInArrow(_partial(spec, len(by), state_arrow), state)
    met = partial.repartition(*[F.col(c) for c in by]).sortWithinPartitions(*by)
    return met.mapInArrow(_final(spec, len(by), state_arrow, result_arrow), result)
