"""Token counts of a byte-level BPE tokenizer by compiled finite-state transducers.

Two deterministic transducers stand for the tokenizer:

* The cutter reads character classes and marks where pre-tokens begin. It has few states, so the effect of a chunk of
  text is a map from the state before it to the state after it. The maps of all chunks of a batch are made side by
  side and composed by a parallel prefix scan (log-many rounds); then every chunk knows its first state and all chunks
  emit their marks side by side. A single very long text is cut into chunks like any other.
* The counter reads the bytes of a pre-token. Its transitions carry the change of the number of tokens: the encoding of
  a prefix ends in one token that, with the token before it, would be left as it is by the merges, so a state needs only
  the last tokens over the longest suffix that could still become part of a token. Transitions are compiled when first
  used and kept; a pre-token seen before is not read again.

Texts never leave their task: no shuffle, no prefix of a text, no truncation. The special token's string inside a text
counts as that one token, as the library has it by default.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows count alike; further columns are carried, and
those named like an added one are replaced.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from driftgate.llm.text import _hashes, slices, utf8

CHUNK = 256
KEPT_WORDS = 300_000
KEPT_TRANSITIONS = 600_000

# character classes; END separates texts
LETTER, STMD, R, V, L, E, NUMBER, OTHER, QUOTE, SPACE, BLANK, END = range(12)
# states of the cutter: what the open pre-token is
START, WORD, DIGITS, SIGNS, QUOTED, Q_R, Q_V, Q_L, DONE, ONE_SPACE, ONE_BLANK, MORE_SPACE, MORE_BLANK = range(13)
STATES = 13
CUT, CUT_BEFORE = 1, 2  # a pre-token begins at this character, or at the one before


def _cutter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks by ``state * 16 + class``, for
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    """
    letters = (LETTER, STMD, R, V, L, E)
    opened = dict.fromkeys(letters, WORD) | {NUMBER: DIGITS, OTHER: SIGNS, QUOTE: QUOTED, SPACE: ONE_SPACE, BLANK: ONE_BLANK}
    joined = dict.fromkeys(letters, WORD) | {NUMBER: DIGITS, OTHER: SIGNS, QUOTE: SIGNS}  # behind a space
    blanks = {SPACE: MORE_SPACE, BLANK: MORE_BLANK}
    step = np.zeros((STATES, 16), np.uint8)
    mark = np.zeros((STATES, 16), np.uint8)
    for state in range(STATES):
        for c in range(END):
            go, out = opened[c], CUT
            if state == WORD and c in letters or state == DIGITS and c == NUMBER:
                go, out = state, 0
            elif state == SIGNS and c in (OTHER, QUOTE):
                go, out = SIGNS, 0
            elif state == QUOTED and c in (STMD, R, V, L):
                go, out = {STMD: DONE, R: Q_R, V: Q_V, L: Q_L}[c], 0
            elif state == QUOTED and c in (OTHER, QUOTE):
                go, out = SIGNS, 0
            elif state in (Q_R, Q_V, Q_L):
                if c == (L if state == Q_L else E):
                    go, out = DONE, 0
                else:  # no contraction: the letter after the quote begins a word
                    go, out = (WORD, CUT_BEFORE) if c in letters else (opened[c], CUT | CUT_BEFORE)
            elif state in (ONE_SPACE, ONE_BLANK, MORE_SPACE, MORE_BLANK) and c in blanks:
                go, out = blanks[c], 0
            elif state == ONE_SPACE:
                go, out = joined[c], 0
            elif state == MORE_SPACE:
                go, out = joined[c], CUT_BEFORE
            elif state == MORE_BLANK:
                go, out = opened[c], CUT | CUT_BEFORE
            step[state, c], mark[state, c] = go, out
        mark[state, END] = CUT_BEFORE if state in (Q_R, Q_V, Q_L) else 0
    return step.reshape(-1), mark.reshape(-1)


@cache
def _classes() -> np.ndarray:
    """The class of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    out[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    for c, kind in {" ": SPACE, "'": QUOTE, "r": R, "v": V, "l": L, "e": E}.items():
        out[ord(c)] = kind
    out[[ord(c) for c in "stmd"]] = STMD
    return out


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Compose maps ``[chunk, state]`` in order: row i becomes the effect of chunks 0 to i. Log-many rounds."""
    out, reach = maps.copy(), 1
    while reach < len(out):
        out[reach:] = np.take_along_axis(out[reach:], out[:-reach].astype(np.intp), axis=1)
        reach *= 2
    return out


def cut_marks(classes: np.ndarray) -> np.ndarray:
    """For each character whether a pre-token begins at it. ``classes`` ends in END."""
    step, mark = _cutter()
    chunks = -(-len(classes) // CHUNK)
    padded = np.full(chunks * CHUNK, END, np.uint8)
    padded[: len(classes)] = classes
    by_step = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    state = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], chunks, 1)
    for c in by_step:
        state = step[(state << 4) | c]
    after = scan_maps(np.ascontiguousarray(state.T))
    now = np.zeros(chunks, np.uint8)  # the first chunk begins in START
    now[1:] = after[:-1, START]
    marks = np.empty((CHUNK, chunks), np.uint8)
    for i, c in enumerate(by_step):
        at = (now << 4) | c
        marks[i] = mark[at]
        now = step[at]
    flat = np.ascontiguousarray(marks.T).reshape(-1)[: len(classes)]
    begins = (flat & CUT).astype(bool)
    begins[:-1] |= (flat[1:] & CUT_BEFORE).astype(bool)
    return begins


class Counter:
    """The compiled counting transducer of one vocabulary."""

    def __init__(self, spec: dict):
        signs = {c: b for b, c in _byte_signs().items()}
        self.ids = {bytes(signs[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in signs for c in token)}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for i, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[bytes(signs[c] for c in a), bytes(signs[c] for c in b)] = i
        self.starts = {token[:i] for token in self.ids for i in range(1, len(token))}
        self.stable: dict[tuple[bytes, bytes], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.known: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: dict[int, int] = {}
        self.first = self._state((b"", (b"",), (0,)))

    def _state(self, key: tuple) -> int:
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(key)
        return self.known[key]

    def merge(self, word: bytes) -> list[bytes]:
        """The encoding itself, by applying merges; used for single tokens and pairs of tokens."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def stays(self, a: bytes, b: bytes) -> bool:
        """Would the merges leave these two tokens as they are, one behind the other?"""
        pair = (a, b)
        if pair not in self.stable:
            if len(self.stable) > KEPT_TRANSITIONS:
                self.stable.clear()
            self.stable[pair] = self.merge(a + b) == ([a, b] if a else [b])
        return self.stable[pair]

    def move(self, state: int, byte: int) -> int:
        """Compile one transition: ``next << 16 | (change of the number of tokens + 32768)``."""
        suffix, last, count = self.states[state]
        suffix += bytes([byte])
        # the token that ends here begins at suffix[i:]; the token before it ends where it begins
        found = next(i for i in range(len(suffix)) if suffix[i:] in self.ids and self.stays(last[i], suffix[i:]))
        last, count = (*last, suffix[found:]), (*count, count[found] + 1)
        keep = next((i for i in range(len(suffix)) if suffix[i:] in self.starts), len(suffix))
        suffix, last, count = suffix[keep:], last[keep:], count[keep:]
        change = count[-1]
        to = self._state((suffix, last, tuple(n - change for n in count)))
        self.moves[state << 8 | byte] = to << 16 | (change + 32768)
        return self.moves[state << 8 | byte]

    def count(self, word: bytes) -> int:
        if len(self.moves) > KEPT_TRANSITIONS:
            self.clear()
        moves, state, total = self.moves, self.first, 0
        for byte in word:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self.move(state, byte)
            state = move >> 16
            total += (move & 0xFFFF) - 32768
        return total


@cache
def _byte_signs() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


class TokenCounter:
    """Counts tokens of columns of texts; keeps compiled transitions and counts of frequent pre-tokens."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        cut = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without prefix space and normaliser is compiled")
        self.counter = Counter(spec)
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.seen: dict[int, int] = {}

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of each text."""
        data, offsets = utf8(texts)
        size = np.diff(offsets)
        # one END behind each text
        at = offsets[1:] + np.arange(len(size))
        lead = np.zeros(len(data) + len(size), bool)
        lead[at] = True
        stream = np.empty(len(lead), np.uint8)
        stream[~lead], stream[lead] = data, 0
        head = (stream & 0xC0) != 0x80  # first bytes of characters
        place = np.flatnonzero(head)
        points = np.frombuffer(stream.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = _classes()[points]
        classes[np.searchsorted(place, at)] = END
        extra = np.zeros(len(size), np.int64)
        whole = stream.tobytes() if self.special else b""
        for token in self.special:
            found = whole.find(token)
            while found >= 0:
                text = int(np.searchsorted(at, found))
                a, b = np.searchsorted(place, [found, found + len(token)])
                classes[a:b] = END
                extra[text] += 1
                found = whole.find(token, found + len(token))
        begins = cut_marks(classes)
        begin = place[begins]
        # a pre-token ends where the next begins or at an END
        border = np.sort(np.concatenate([begin, place[classes == END]]))
        end = border[np.searchsorted(border, begin, "right")]
        counts = self._words(stream, begin, end)
        return size, np.bincount(np.searchsorted(at, begin), counts, len(size)).astype(np.int64) + extra

    def _words(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(begin):
            return np.zeros(0, np.int64)
        name, first, back = np.unique(_hashes(data, begin, end), return_index=True, return_inverse=True)
        if len(self.seen) > KEPT_WORDS:
            self.seen.clear()
        out, seen, count = [], self.seen, self.counter.count
        raw = data.tobytes()
        for key, a, b in zip(name.tolist(), begin[first].tolist(), end[first].tolist(), strict=True):
            n = seen.get(key)
            if n is None:
                n = seen[key] = count(raw[a:b])
            out.append(n)
        return np.array(out, np.int64)[back]


_COUNTERS: dict[int, TokenCounter] = {}


def _counter(definition: str) -> TokenCounter:
    """One compiled tokenizer for each worker process, kept between tasks."""
    key = hash(definition)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = TokenCounter(definition)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """The documents with ``n_bytes, n_tokens, over_limit``. ``path``: a tokenizers file, read on the driver only."""
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    added = ["n_bytes", "n_tokens", "over_limit"]
    kept = docs.select([c for c in docs.columns if c not in added])
    place = kept.columns.index("text")
    schema = StructType(list(kept.schema)).add("n_bytes", "long").add("n_tokens", "long")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(definition)
        for batch in slices(batches):
            size, tokens = counter.column(batch.column(place))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(tokens)], names=schema.names)

    return kept.mapInArrow(apply, schema).withColumn("over_limit", F.col("n_tokens") > limit)
