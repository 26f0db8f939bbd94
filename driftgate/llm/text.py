"""Words of whole texts as numpy arrays: positions and 64-bit hashes straight from Arrow's UTF-8 buffers.

A word is a run of ``[^\\x20\\x09-\\x0D]+``. All separators are single bytes that never occur inside a multi-byte
character, so words can be cut on bytes. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words as Spark, Java, Python and DuckDB's regular expressions write them.
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 2 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Also cuts words at ASCII signs.
SIGNS = _SEPARATOR.copy()
SIGNS[[b for b in range(128) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins and ends."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; other bytes stay."""
    return _LOWER[data]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches with about ``limit`` bytes of text each; a longer text comes alone."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """Words of several texts in order. ``first[i]:first[i + 1]`` are those of text ``i``."""

    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray | None

    def __len__(self) -> int:
        return len(self.begin)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """The text each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word; words never run over the end of a text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~separator[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | cut[1:-1]
    ends[:-1] &= ~word[1:] | cut[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(
    data: np.ndarray,
    offsets: np.ndarray,
    hashed: bool = True,
    separator: np.ndarray = _SEPARATOR,
    block: int = SLICE_BYTES,
) -> Words:
    begin, end = spans(data, offsets, separator)
    first = np.searchsorted(begin, offsets)
    if not hashed:
        return Words(begin, end, first, None)
    out = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(begin):  # blocks of whole words keep the sums below small for texts of any length
        to = max(at + 1, int(np.searchsorted(end, begin[at] + block, "right")))
        out[at:to] = _hashes(data[begin[at] : end[to - 1]], begin[at:to] - begin[at], end[at:to] - begin[at])
        at = to
    return Words(begin, end, first, out)


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of byte ranges from prefix sums, with the place in the buffer divided out."""
    power = np.full(len(data) + 1, _BASE, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:-1], out=total[1:])
    undo = np.full(len(data) + 1, _INVERSE, np.uint64)
    undo[0] = 1
    np.cumprod(undo, out=undo)
    return mix((total[end] - total[begin]) * undo[begin] + (end - begin).astype(np.uint64))


def shingles(w: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of ``width`` words; a shorter text is one run, one without words has none."""
    count = w.counts
    runs = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(runs)), runs)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    start = w.first[:-1][owner] + place
    long = np.minimum(count, width)[owner]
    value = np.zeros(len(owner), np.uint64)
    for i in range(width):
        here = i < long
        if here.all():
            value = mix(value + w.hash[start + i] * _BASE)
        else:
            value[here] = mix(value[here] + w.hash[start[here] + i] * _BASE)
    return mix(value + long.astype(np.uint64)), owner


def distinct_per_owner(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each owner; owners come in order."""
    value = value.copy()
    bounds = np.flatnonzero(np.diff(owner, prepend=-1, append=-1)).tolist() if len(owner) else []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        value[a:b].sort()
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[keep], owner[keep]
