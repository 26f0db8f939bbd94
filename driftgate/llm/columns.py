"""A caller's further columns past an operator, whatever their names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

PACKED = "_carried"


def aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``needed`` columns with all others packed into one, and a function that brings back the caller's columns in
    their order; its keyword arguments replace some of them."""
    others = [c for c in docs.columns if c not in needed]
    packed = [F.struct(*[F.col(f"`{c}`") for c in others]).alias(PACKED)] if others else []

    def restore(df: DataFrame, **new: Column) -> DataFrame:
        own = {c: F.col(c) if c in needed else F.col(PACKED)[c] for c in docs.columns} | new
        return df.select(*[own[c].alias(c) for c in docs.columns])

    return docs.select(*needed, *packed), restore


def free_name(name: str, taken: list[str], prefix: str) -> str:
    """``name``, or with prefixes until no taken one equals it."""
    while name in taken:
        name = prefix + name
    return name
