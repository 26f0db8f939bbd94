"""Sketches as one packed column: sorted positions of the cells that are not zero, as steps, and their values.

A sketch of depth x width cells is one binary value of bounded size. Steps take one, two or four bytes, and whole values as many as the
largest needs; other values are doubles, so nothing is lost. Packed sketches of one key merge by adding cells, so they are
built and added like any mergeable aggregate: what crosses a shuffle is packed.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from driftgate.functions.keys import SketchShape
from driftgate.operators.accumulators import Accumulator, aggregate

# tasks get these functions with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STEPS = ("<u1", "<u2", "<u4")
_VALUES = ("<i1", "<i2", "<i4", "<f8")
#: Cells, and which types steps and values have.
_HEAD, _HEAD_BYTES = "<IBB", 6


def _narrowest(values: np.ndarray, kinds: Sequence[str]) -> int:
    """The first type that holds all values unchanged."""
    for i, kind in enumerate(kinds[:-1]):
        limits = np.iinfo(kind)
        if not len(values) or limits.min <= values.min() and values.max() <= limits.max and (values == np.trunc(values)).all():
            return i
    return len(kinds) - 1


def compress(position: np.ndarray, value: np.ndarray) -> bytes:
    """Cells in any order, several of one position added up."""
    position, back = np.unique(position, return_inverse=True)
    value = np.bincount(back, value, len(position)).astype(np.float64)
    position, value = position[value != 0], value[value != 0]
    step = np.diff(position, prepend=0)
    a, b = _narrowest(step, _STEPS), _narrowest(value, _VALUES)
    return struct.pack(_HEAD, len(position), a, b) + step.astype(_STEPS[a]).tobytes() + value.astype(_VALUES[b]).tobytes()


def decompress(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions and values."""
    n, a, b = struct.unpack_from(_HEAD, packed)
    step = np.frombuffer(packed, _STEPS[a], n, _HEAD_BYTES)
    value = np.frombuffer(packed, _VALUES[b], n, _HEAD_BYTES + step.nbytes)
    return np.cumsum(step.astype(np.int64)), value.astype(np.float64)


def merged(packed: Sequence[bytes]) -> bytes:
    cells = [decompress(x) for x in packed]
    return compress(*(np.concatenate(x) for x in zip(*cells, strict=True))) if cells else EMPTY


EMPTY = compress(np.zeros(0, np.int64), np.zeros(0))


class _Packed(Accumulator):
    state = {"packed": "binary"}
    result = {"packed": "binary"}

    def create(self, n):
        return {"packed": np.array([EMPTY] * n, object)}

    def merge(self, state, group, other):
        order = np.argsort(group, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            if len(own):
                at = group[own[0]]
                state["packed"][at] = merged([state["packed"][at], *other["packed"][own]])

    def finish(self, state):
        return state


class PackCells(_Packed):
    """Cells to packed sketches."""

    inputs = {"pos": "bigint", "v": "double"}

    def add(self, state, group, rows):
        order = np.argsort(group, kind="stable")
        edges = np.flatnonzero(np.diff(group[order], prepend=-1))
        parts = np.split(order, edges[1:]) if len(order) else []
        packed = np.array([compress(rows["pos"][own], rows["v"][own]) for own in parts], object)
        self.merge(state, group[order][edges], {"packed": packed})


class MergePacked(_Packed):
    """Packed sketches to their sum."""

    inputs = {"packed": "binary"}

    def add(self, state, group, rows):
        self.merge(state, group, rows)


def pack(cells: DataFrame, by: Sequence[str], shape: SketchShape = SketchShape()) -> DataFrame:
    """``(by, packed)`` from cells ``(by, d, w, v)``, which need not be added up; zeros vanish."""
    return aggregate(cells, by, PackCells(), pos=F.col("d") * shape.width + F.col("w"), v=F.col("v"))


def unpack(packed: DataFrame, by: Sequence[str], shape: SketchShape = SketchShape()) -> DataFrame:
    """Cells ``(by, d, w, v)`` that are not zero."""
    opened = packed.select(*by, F.inline(F.pandas_udf(_opened, "array<struct<pos:bigint,v:double>>")("packed")))
    width = F.lit(shape.width).cast("bigint")
    return opened.select(*by, F.call_function("div", F.col("pos"), width).alias("d"), F.pmod("pos", width).alias("w"), "v")


def _opened(column: pd.Series) -> pd.Series:
    out = []
    for packed in column:
        position, value = decompress(packed) if packed is not None else decompress(EMPTY)
        out.append([{"pos": p, "v": v} for p, v in zip(position.tolist(), value.tolist())])
    return pd.Series(out)


def add(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums of packed sketches of equal keys."""
    return merge(a.select(*by, "packed").unionByName(b.select(*by, "packed")), by)


def merge(packed: DataFrame, by: Sequence[str]) -> DataFrame:
    """One packed sketch for each key."""
    return aggregate(packed, by, MergePacked(), packed=F.col("packed"))
