"""SentencePiece (BPE) encoding that keeps source offsets, and decoding.

* Normalisation: the compiled character map is a double-array trie over bytes. All positions of a slice of texts walk
  the trie side by side, one byte a round, and note their longest match; matches are then taken from left to right.
  Each normalised byte knows the source byte its match began at.
* Pieces: two neighbouring characters that are neighbours in no piece are never merged, so the normalised text falls
  apart there into units, mostly words, which are merged on their own. A unit seen before is not merged again.
* Offsets: the ends of the pieces in their unit, shifted to the unit's place, are looked up in the alignment, so every
  piece has a span of bytes of the source text. Of a character spelled in byte pieces the last one has the span.

Texts never leave their task: no shuffle, no prefix of a text, no truncation. A unit is merged by a heap, so a very long
text without white space takes n log n steps.

Defined cases: a null or empty text has only the begin and end ids and decodes to an empty text; bytes that are no
UTF-8 become U+FFFD as in the library; repeated rows count alike; further columns are carried, columns named like the
added ones are replaced.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator, Sequence
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from driftgate.llm.text import slices, utf8

SPACE = "▁"
_SPACE = np.frombuffer(SPACE.encode(), np.uint8)
_LOST = "�"
#: Bytes of text that are normalised at a time (a longer text comes alone); each takes about 200 bytes of memory.
SLICE = 256 << 10
#: Characters of a unit up to which its pieces are joined without a heap.
FEW = 48
#: Bytes of units whose pieces a worker keeps.
KEPT_BYTES = 48 << 20
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces in model files
BPE = 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """Longest-prefix replacement through a compiled map: the trie's size, its units, then the replacements."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        unit = np.frombuffer(compiled, "<u4", size // 4, 4) if size else np.zeros(0, np.uint32)
        self.texts = compiled[4 + size :] if size else b""
        self.leaf = (unit >> 8 & 1).astype(bool)
        self.value = (unit & 0x7FFFFFFF).astype(np.int64)
        self.label = unit & 0x800000FF
        self.offset = ((unit >> 10) << ((unit & 0x200) >> 6)).astype(np.int64)

    def longest(self, data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length and replacement (its place in ``texts``) of the longest match at each of ``at``; 0 if there is none."""
        length, found = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        if not len(self.label):
            return length, found
        alive, node, depth = np.arange(len(at)), np.full(len(at), self.offset[0]), 0
        while len(alive):
            inside = at[alive] + depth < stop[alive]
            alive, node = alive[inside], node[inside]
            byte = data[at[alive] + depth]
            node = node ^ byte
            fits = node < len(self.label)
            fits[fits] = self.label[node[fits]] == byte[fits]
            alive, node = alive[fits], node[fits]
            leaf, node = self.leaf[node], node ^ self.offset[node]
            depth += 1
            length[alive[leaf]] = depth
            found[alive[leaf]] = self.value[node[leaf]]
        return length, found

    def text(self, place: int) -> bytes:
        return self.texts[place : self.texts.index(b"\0", place)]


class Model:
    """What a model file says: pieces with scores and kinds, normalisation, special ids."""

    def __init__(self, file: bytes):
        self.cost: dict[str, float] = {}  # less a piece's score; the least is joined first
        self.ids: dict[str, int] = {}
        self.reserved: dict[str, int] = {}
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.unknown, self.begin, self.end, self.byte_fallback = 0, 1, 2, False
        self.unknown_text, self.suffix, kind = " ⁇ ", False, 1
        self.prefix, self.squeeze, self.escape, compiled, back = True, True, True, b"", b""
        for number, value in _fields(file):
            if number == 1:
                self._piece(dict(_fields(value)))
            elif number == 2:
                trained = dict(_fields(value))
                kind = trained.get(3, 1)
                self.suffix, self.byte_fallback = bool(trained.get(24)), bool(trained.get(35))
                self.unknown, self.begin, self.end = trained.get(40, 0), trained.get(41, 1), trained.get(42, 2)
                self.unknown_text = trained.get(44, self.unknown_text.encode()).decode()
            elif number == 3:
                rules = dict(_fields(value))
                compiled = rules.get(2, b"")
                self.prefix, self.squeeze, self.escape = (bool(rules.get(n, 1)) for n in (3, 4, 5))
            elif number == 5:
                back = dict(_fields(value)).get(2, b"")
        if kind != BPE or back or USER in self.kinds or self.suffix:
            raise ValueError("only BPE models without user-defined pieces, white-space suffixes and a map for decoding")
        self.map = CharacterMap(compiled)
        self.unused = any(k == UNUSED for k in self.kinds)
        self.bytes = {p: int(p[3:5], 16) for p, k in zip(self.pieces, self.kinds, strict=True) if k == BYTE}
        self.spelled = {b: self.reserved[p] for p, b in self.bytes.items()}
        #: Id and bytes of each piece; special ones first, as in the library.
        self.coded = {p: (self.reserved.get(p, n), len(p.encode())) for p, n in self.ids.items()}
        self._neighbours()

    def _piece(self, fields: dict) -> None:
        piece, n = fields[1].decode(), len(self.pieces)
        score = struct.unpack("<f", fields[2])[0] if 2 in fields else 0.0
        kind = fields.get(3, NORMAL)
        self.pieces.append(piece)
        self.kinds.append(kind)
        if kind in (NORMAL, USER, UNUSED):
            self.ids[piece], self.cost[piece] = n, -score
        else:
            self.reserved[piece] = n

    def _neighbours(self) -> None:
        """Which characters are neighbours in some piece. Kind 0: those in pieces of their own only, or in none."""
        several = [p for p in self.ids if len(p) > 1]
        letters = sorted(set("".join(several)))
        self.kind_of = np.zeros(0x110000, np.int16)
        self.kind_of[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joins = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        pairs = {p[i : i + 2] for p in several for i in range(len(p) - 1)}
        a, b = (self.kind_of[[ord(p[i]) for p in pairs]] for i in (0, 1))
        self.joins[a, b] = True
        if not self.byte_fallback:  # unknown neighbours become one id, so only white space parts units
            space = self.joins[:, self.kind_of[ord(SPACE)]].copy()
            self.joins[:] = True
            self.joins[:, self.kind_of[ord(SPACE)]] = space | (SPACE not in self.ids)


def normalise(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Normalised bytes of the texts ``data[offsets[i]:offsets[i + 1]]``, for each of them the place in ``data`` its match
    began at (one more entry behind the last), where each text begins in them, and where it ends in ``data``."""
    data, offsets, odd = _valid(data, offsets)
    if not len(model.map.label) and not model.squeeze:
        out, source, first, tail = _white_space(model, data, np.arange(len(data) + 1), offsets, offsets, offsets[:-1])
        return (out, source, first, tail) if odd is None else (out, odd[source], first, odd[tail])
    head = (data & 0xC0) != 0x80
    at = np.flatnonzero(head)
    border = np.append(at, len(data))
    stop = offsets[np.searchsorted(offsets, at, "right")] if len(at) else at
    length, found = model.map.longest(data, at, stop)
    plain = np.diff(border)
    # a match longer than its character hides those it covers; such matches are few
    hidden = np.zeros(len(at), bool)
    reach = -1
    for i in np.flatnonzero(length > plain).tolist():
        if at[i] >= reach:
            reach = int(at[i] + length[i])
            hidden[i + 1 : int(np.searchsorted(at, reach))] = True
    mapped = np.flatnonzero((length > 0) & ~hidden)
    places, which = np.unique(found[mapped], return_inverse=True)
    texts = [model.map.text(p) for p in places.tolist()]
    size = np.where(hidden, 0, plain)
    size[mapped] = np.array([len(t) for t in texts], np.int64)[which] if len(texts) else 0
    out_at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(out_at[-1], np.uint8)
    kept = np.ones(len(at), bool)
    kept[mapped] = False
    kept &= ~hidden
    # unchanged characters byte by byte, replaced ones from the map's texts
    n = size[kept]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(out_at[:-1][kept], n) + step] = data[np.repeat(at[kept], n) + step]
    for i, w in zip(mapped.tolist(), which.tolist(), strict=True):
        out[out_at[i] : out_at[i + 1]] = np.frombuffer(texts[w], np.uint8)
    source = np.append(np.repeat(at, size), len(data))
    first = out_at[np.searchsorted(at, offsets)]
    lead_at = offsets[:-1]
    if model.squeeze:
        blank = kept & (data[at] == 0x20)
        blank[mapped] = np.array([t == b" " for t in texts], bool)[which] if texts else False
        solid = np.append(at[~blank & ~hidden], len(data))
        lead_at = solid[np.searchsorted(solid, lead_at)]
    out, source, first, tail = _white_space(model, out, source, first, offsets, lead_at)
    return (out, source, first, tail) if odd is None else (out, odd[source], first, odd[tail])


def _valid(data: np.ndarray, offsets: np.ndarray):
    """Bytes that are no UTF-8 as U+FFFD, with the way back to the source; the texts as they are where all is well."""
    raw = data.tobytes()
    try:
        raw.decode("utf-8")
        return data, offsets, None
    except UnicodeDecodeError:
        pass
    parts, back, edge, size = [], [], [0], 0
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        while a < b:
            try:
                raw[a:b].decode("utf-8")
                good = b
            except UnicodeDecodeError as wrong:
                good = a + wrong.start
            parts.append(raw[a:good])
            back.append(np.arange(a, good))
            size += good - a
            a = good
            if a < b:  # one replacement for each byte
                parts.append(_LOST.encode())
                back.append(np.full(3, a))
                size += 3
                a += 1
        edge.append(size)
    odd = np.concatenate([*back, [len(data)]]).astype(np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.array(edge, np.int64), odd


def _signs(out: np.ndarray) -> np.ndarray:
    """Bytes of white-space signs."""
    first = np.flatnonzero((out[:-2] == _SPACE[0]) & (out[1:-1] == _SPACE[1]) & (out[2:] == _SPACE[2]))
    found = np.zeros(len(out), bool)
    for k in range(3):
        found[first + k] = True
    return found


def _white_space(model: Model, out, source, first, offsets, lead_at):
    """White space squeezed, escaped and led by one sign (``lead_at`` in the source), as the model wants it; also where
    each text ends in the source without the white space cut off."""
    blank = out == 0x20
    text_of = np.searchsorted(first, np.arange(len(out)), "right") - 1
    stays, tail = np.ones(len(out), bool), offsets[1:]
    led = np.diff(offsets) > 0
    if model.squeeze:
        here = np.arange(len(out))
        stays[1:] = ~(blank[1:] & blank[:-1])  # of a run the first one, and none at a text's beginning
        solid = np.append(np.flatnonzero(~blank), len(out))
        stays &= here >= solid[np.searchsorted(solid, first[:-1])][text_of]
        # at the end white-space signs of the text itself go as well
        solid = np.flatnonzero(~blank & ~_signs(out))
        n = np.searchsorted(solid, first)
        led = n[1:] > n[:-1]
        to = np.where(led, np.append(solid, 0)[n[1:] - 1] + 1, first[:-1])
        stays &= here < to[text_of]
        tail = np.where(to < first[1:], source[to], tail)
    escaped = blank & model.escape
    sign = _SPACE if model.escape else np.array([0x20], np.uint8)
    lead = np.where(led & model.prefix, len(sign), 0)
    size = np.concatenate([[0], np.cumsum(np.where(stays, np.where(escaped, 3, 1), 0))])
    shift = np.concatenate([[0], np.cumsum(lead)])
    starts = size[first] + shift
    result, align = np.empty(starts[-1], np.uint8), np.empty(starts[-1] + 1, np.int64)
    place = size[:-1] + shift[1:][text_of]
    one, many, front = np.flatnonzero(stays & ~escaped), np.flatnonzero(stays & escaped), np.flatnonzero(lead)
    result[place[one]], align[place[one]] = out[one], source[one]
    for k, byte in enumerate(_SPACE):
        result[place[many] + k], align[place[many] + k] = byte, source[many]
    for k, byte in enumerate(sign):
        result[starts[:-1][front] + k], align[starts[:-1][front] + k] = byte, lead_at[front]
    align[-1] = source[-1]
    return result, align, starts, tail


class Grown:
    """An array that grows by lists, which are emptied."""

    def __init__(self, kind):
        self.values, self.n = np.zeros(1024, kind), 0

    def add(self, more: list[int]) -> np.ndarray:
        n = self.n + len(more)
        if n > len(self.values):
            self.values = np.resize(self.values, 2 * n)
        self.values[self.n : n] = more
        self.n = n
        more.clear()
        return self.values[:n]


class Encoder:
    """Encodes and decodes columns of texts; keeps the pieces of frequent units."""

    def __init__(self, file: bytes):
        self.model = Model(file)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        # what the known units have become, and what has been added since the last slice
        self.kept_ids, self.kept_ends = Grown(np.int32), Grown(np.int32)
        self.first = Grown(np.int64)
        self.flat_ids: list[int] = []
        self.flat_ends: list[int] = []
        self.edges: list[int] = [0]
        self.size = 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, first byte and end of their source spans (in their text), and where each text's
        ids begin."""
        data, offsets = utf8(texts)
        out, source, first, tail = normalise(self.model, data, offsets)
        begin = self._units(out, first)
        end = np.append(begin, len(out))[1:]
        if self.held > KEPT_BYTES:
            self._forget()
        raw = out.tobytes()
        units = [raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        known = list(map(self.known.get, units))
        for i, code in enumerate(known):
            if code is None:
                code = self.known.get(units[i])
                known[i] = self._merge(units[i]) if code is None else code
        codes = np.array(known, np.int64)
        start = self.first.add(self.edges)
        flat_ids, flat_ends = self.kept_ids.add(self.flat_ids), self.kept_ends.add(self.flat_ends)
        count = start[codes + 1] - start[codes]
        where = np.repeat(start[codes], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        ids = flat_ids[where]
        ends = np.repeat(begin, count) + flat_ends[where]
        edge = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(begin, first)]
        # a piece begins where the one before it ends, a text's first one where the text begins
        begins = np.concatenate([[0], ends[:-1]])
        fresh = edge[:-1][np.diff(edge) > 0]
        begins[fresh] = first[:-1][np.diff(edge) > 0]
        text_of = np.repeat(np.arange(len(first) - 1), np.diff(edge))
        base = offsets[text_of]
        to = np.where(ends == first[text_of + 1], tail[text_of], source[ends])
        return ids, (source[begins] - base).astype(np.int32), (to - base).astype(np.int32), edge

    def _units(self, out: np.ndarray, first: np.ndarray) -> np.ndarray:
        at = np.flatnonzero((out & 0xC0) != 0x80)
        points = np.frombuffer(out.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = self.model.kind_of[points]
        cut = np.ones(len(at), bool)
        cut[1:] = ~self.model.joins[kind[:-1], kind[1:]]
        cut[np.searchsorted(at, first[:-1][np.diff(first) > 0])] = True
        return at[cut]

    def _merge(self, unit: bytes) -> int:
        code = self.known[unit] = len(self.known)
        self.held += len(unit) + 100
        at, lost, size, coded = 0, False, len(self.flat_ids), self.model.coded
        for piece in self._pieces(unit.decode("utf-8")):
            n, length = coded.get(piece, (-1, 0))
            if n >= 0:
                at, lost = at + length, False
                self.flat_ids.append(n)
                self.flat_ends.append(at)
                continue
            raw = piece.encode()
            at += len(raw)
            if self.model.byte_fallback:
                self.flat_ids += [self.model.spelled[b] for b in raw]
                self.flat_ends += [at - len(raw)] * (len(raw) - 1) + [at]
            elif lost:  # unknown neighbours are one
                self.flat_ends[-1] = at
            else:
                self.flat_ids.append(self.model.unknown)
                self.flat_ends.append(at)
            lost = True
        self.size += len(self.flat_ids) - size
        self.edges.append(self.size)
        return code

    def _pieces(self, text: str) -> list[str]:
        """Neighbours are joined while they form a piece, best score first, then leftmost."""
        part, halves = list(text), {}
        part = self._few(part, halves) if len(part) <= FEW else self._many(part, halves)
        return self._without_unused(part, halves) if self.model.unused else part

    def _few(self, part: list[str], halves: dict[str, tuple[str, str]]) -> list[str]:
        cost = self.model.cost.get
        none = float("inf")
        costs = [cost(a + b, none) for a, b in zip(part, part[1:])]
        while costs:
            least = min(costs)
            if least == none:
                break
            i = costs.index(least)
            joined = part[i] + part[i + 1]
            if self.model.unused:
                halves[joined] = part[i], part[i + 1]
            part[i : i + 2] = [joined]
            del costs[i]
            if i:
                costs[i - 1] = cost(part[i - 1] + joined, none)
            if i < len(costs):
                costs[i] = cost(joined + part[i + 1], none)
        return part

    def _many(self, part: list[str], halves: dict[str, tuple[str, str]]) -> list[str]:
        cost = self.model.cost
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            price = cost.get(part[i] + part[i + 1])
            if price is not None:
                heap.append((price, i, part[i] + part[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if not part[i] or j >= n or part[i] + part[j] != joined:
                continue  # one of the two has been joined with another since
            if self.model.unused:
                halves[joined] = part[i], part[j]
            part[i], part[j] = joined, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n:
                    price = cost.get(part[left] + part[right])
                    if price is not None:
                        heapq.heappush(heap, (price, left, part[left] + part[right]))
        return [p for p in part if p]

    def _without_unused(self, pieces: list[str], halves: dict[str, tuple[str, str]]) -> list[str]:
        out, todo = [], pieces[::-1]
        while todo:
            piece = todo.pop()
            n = self.model.ids.get(piece)
            if n is not None and self.model.kinds[n] == UNUSED and piece in halves:
                todo += halves[piece][::-1]
            else:
                out.append(piece)
        return out

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """The texts of rows of ids ``ids[first[i]:first[i + 1]]``."""
        if not hasattr(self, "shown"):
            self._show()
        flat = ids.tolist()
        return [self._text(flat[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]

    def _text(self, row: list[int]) -> str:
        texts = [self.shown[n] for n in row]
        if not self.byte_of.keys().isdisjoint(row):
            spelled = bytearray()
            for i, n in enumerate([*row, -1]):
                if n in self.byte_of:
                    spelled.append(self.byte_of[n])
                elif spelled:
                    texts[i - 1] = _spelled(bytes(spelled))
                    spelled.clear()
        if self.model.prefix or self.model.squeeze:
            for i, n in enumerate(row):
                if n in self.spaced and texts[i]:
                    texts[i] = texts[i][1:]
                    if not self.model.squeeze:
                        break
                if texts[i]:
                    break
        return "".join(texts)

    def _show(self) -> None:
        m = self.model
        self.byte_of = {m.reserved[p]: b for p, b in m.bytes.items()}
        self.spaced = {i for i, p in enumerate(m.pieces) if p.startswith(SPACE)}
        self.shown = [p.replace(SPACE, " ") for p in m.pieces]
        for i, kind in enumerate(m.kinds):
            if kind in (CONTROL, BYTE):
                self.shown[i] = ""
        self.shown[m.unknown] = m.unknown_text


def _spelled(raw: bytes) -> str:
    """UTF-8, with U+FFFD for each byte that belongs to no character."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append(_LOST)
            at += 1
    return "".join(out)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(file: bytes) -> Encoder:
    """One model for each worker process, kept between tasks."""
    key = hash(file)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(file)
    return _ENCODERS[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _lists(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(values, pa.int32()))


_INTS = ArrayType(IntegerType(), False)
#: What ``encode`` can return for each text, and its type.
COLUMNS = {
    "ids": _INTS, "begins": _INTS, "ends": _INTS, "n_tokens": LongType(), "ids_sha256": StringType(), "decoded": StringType(),
    "decoded_sha256": StringType(),
}


def encode(
    docs: DataFrame, path: str, frame: bool = True, columns: Sequence[str] = ("ids", "begins", "ends")
) -> DataFrame:
    """The documents with ``ids`` and the byte spans ``begins, ends`` of each id in ``text``, or other ``COLUMNS``.

    ``path``: a model file, read on the driver only. ``frame``: begin and end ids frame every text; their spans are empty.
    The digests are those of the ids as little-endian 32-bit numbers and of the text that the ids decode to.
    """
    file = _read(path)
    kept = docs.select([c for c in docs.columns if c not in columns])
    place = kept.columns.index("text")
    schema = StructType(list(kept.schema))
    for name in columns:
        schema = schema.add(name, COLUMNS[name])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(file)
        for batch in slices(batches, limit=SLICE):
            ids, begin, end, edge = encoder.encode(batch.column(place))
            if frame:
                total, none = np.diff(utf8(batch.column(place))[1]), np.zeros(len(edge) - 1, np.int64)
                ids = _framed(ids, edge, none + encoder.model.begin, none + encoder.model.end)
                begin, end = (_framed(x, edge, none, total) for x in (begin, end))
                edge = edge + 2 * np.arange(len(edge))
            made = _columns(encoder, ids, begin, end, edge, columns)
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return kept.mapInArrow(apply, schema)


def _columns(encoder: Encoder, ids, begin, end, edge, columns: Sequence[str]) -> list[pa.Array]:
    texts = encoder.decode(ids, edge) if {"decoded", "decoded_sha256"} & set(columns) else []
    make = {
        "ids": lambda: _lists(ids, edge),
        "begins": lambda: _lists(begin, edge),
        "ends": lambda: _lists(end, edge),
        "n_tokens": lambda: pa.array(np.diff(edge), pa.int64()),
        "ids_sha256": lambda: pa.array([sha256(ids[a:b].astype("<u4")).hexdigest() for a, b in pairwise(edge.tolist())], pa.string()),
        "decoded": lambda: pa.array(texts, pa.string()),
        "decoded_sha256": lambda: pa.array([sha256(t.encode()).hexdigest() for t in texts], pa.string()),
    }
    return [make[c]() for c in columns]


def _framed(values: np.ndarray, edge: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Each row of ``values`` with one more value before and behind it."""
    out = np.empty(len(values) + 2 * len(head), np.int32)
    n = np.arange(len(head))
    first, last = edge[:-1] + 2 * n, edge[1:] + 2 * n + 1
    inner = np.ones(len(out), bool)
    inner[first] = inner[last] = False
    out[first], out[last], out[inner] = head, tail, values
    return out


def decode(rows: DataFrame, path: str) -> DataFrame:
    """The rows with ``decoded``, the text of their ``ids``; null ids give an empty text."""
    file = _read(path)
    kept = rows.select([c for c in rows.columns if c != "decoded"])
    place = kept.columns.index("ids")
    schema = StructType(list(kept.schema)).add("decoded", StringType())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(file)
        for batch in batches:
            column = batch.column(place)
            size = np.diff(column.offsets.to_numpy())
            if column.null_count:
                size = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, size)
            first = np.concatenate([[0], np.cumsum(size)])
            texts = encoder.decode(column.flatten().to_numpy(zero_copy_only=False), first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return kept.mapInArrow(apply, schema)
