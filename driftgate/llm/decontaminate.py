"""Benchmark decontamination: passages of benchmark items in documents, up to a share of edited words.

Texts are sequences of lower-cased words cut at signs. A document holds an item if some window of it is within
``floor(SHARE * words of the item)`` word edits.

0. Items of more than ``PART`` words are cut into equal parts of at most that many. If a window is within the allowed
   edits of the item, one part at least has no more than its share of them, so a part within its share leads to it. In
   what follows a shorter item is its only part. The agreement of walks falls with the number of edits, so only short
   texts may be walked.
1. Parts of similar length form a band. A window start is looked at only if enough of the words behind it occur in some
   part of the band; a window within the allowed edits always has that many, so nothing is lost.
2. The CGK walk maps the words from a start on to a sequence in which few edits leave few differences: at each step the
   current word is written, and a random bit of (step, word) decides whether to go on to the next word. It reads about
   as many words as the parts of the band have.
3. LSH samples ``SAMPLED`` steps of the walk for each table; tables over several walks are repeated until the target
   recall is reached for ``AGREE``, the share of equal steps that is assumed of a window at the edit limit.
4. Candidates are verified by their exact edit distances, many of one length at a time; around the parts found of a longer item, all windows are.

Documents stay in their tasks. Items go to the tasks in blocks of at most ``BLOCK_BYTES`` of text, one pass over the
documents for each block, so what is sent is bounded however many items there are.

Defined cases: null or wordless texts hold nothing and null or wordless items are in nothing; equal items are reported
each under its id; repeated documents are reported each; empty tables give no rows; other columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftgate.llm.text import SIGNS, lower, mix, slices, utf8, words

SHARE = 0.2
PART = 20
BAND = 1.25
WALKS = 4
SAMPLED = 3
AGREE = 0.42  # measured: parts of 5 to PART words at the edit limit are then found as often as RECALL says
RECALL = 0.99
BLOCK_BYTES = 8 << 20
BITS = 16  # of a key, looked at before the key is searched
TOGETHER = 4096  # candidates verified at a time
GAP = np.uint64(0)  # stands behind the end of a text


def tables_for(recall: float = RECALL, agree: float = AGREE, sampled: int = SAMPLED) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - agree**sampled))


def walk(stream: np.ndarray, starts: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """What the CGK walk writes from each start, ``[step, start]``."""
    at, out = starts.copy(), np.empty((steps, len(starts)), np.uint64)
    for j in range(steps):
        word = stream[at]
        out[j] = word
        at += (mix(word + np.uint64(seed * 1_000_003 + j + 1)) & np.uint64(1)).astype(at.dtype) * (word != GAP)
    return out


def edit_distances(items: np.ndarray, windows: np.ndarray, most: int) -> np.ndarray:
    """Row by row the least word edits between an item and any beginning of its window; ``most + 1`` if there are more."""
    out = np.full(len(items), most + 1)
    alive = np.arange(len(items))
    place = np.arange(windows.shape[1] + 1, dtype=np.int16)
    row = np.broadcast_to(place, (len(items), len(place)))
    for i in range(items.shape[1]):
        best = np.empty(row.shape, np.int16)
        best[:, 0] = i + 1
        np.minimum(row[:, :-1] + (windows != items[:, i, None]), row[:, 1:] + 1, out=best[:, 1:])
        row = np.minimum.accumulate(best - place, axis=1) + place  # insertions run to the right
        near = row.min(1) <= most
        if not near.all():
            alive, row, items, windows = alive[near], row[near], items[near], windows[near]
    out[alive] = row.min(1) if len(alive) else 0
    return out


def shared(items: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Row by row how many words of an item occur in its window."""
    out = np.zeros(len(items), np.int16)
    for i in range(items.shape[1]):
        out += (windows == items[:, i, None]).any(1)
    return out


def best_window(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int]:
    """Least word edits between the item and any window of the text, and its first start; ``most + 1`` if there are more."""
    text = text[::-1]
    place = np.arange(len(text) + 1)
    row = np.zeros_like(place)  # a window may end anywhere
    for i, word in enumerate(item[::-1], 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(best - place) + place
        if row.min() > most:
            return most + 1, 0
    return int(row.min()), len(text) - int(np.flatnonzero(row == row.min())[-1])


@dataclass
class Part:
    """Consecutive words of an item and their share of its edits."""

    item: int
    offset: int
    words: np.ndarray
    edits: int


def parts_of(item: int, words_: np.ndarray, edits: int) -> list[Part]:
    n = len(words_)
    count = -(-n // PART)
    cuts = [n * i // count for i in range(count + 1)] if count else []
    return [Part(item, a, words_[a:b], edits * (b - a) // n) for a, b in zip(cuts, cuts[1:])]


@dataclass
class Band:
    """Parts of similar length with their tables."""

    shortest: int
    edits: int
    vocabulary: np.ndarray
    steps: int
    samples: list[np.ndarray]  # for each table the steps it reads
    keys: list[np.ndarray]
    parts: list[np.ndarray]  # part numbers in the order of the keys
    bits: list[np.ndarray]  # for each table which first bits its keys have


def _key(written: np.ndarray, sample: np.ndarray) -> np.ndarray:
    out = np.zeros(written.shape[1], np.uint64)
    for j in sample:
        out = mix(out * np.uint64(3) + written[j])
    return out


class Items:
    """Benchmark items compiled for matching."""

    def __init__(self, ids: list, texts: list, share: float = SHARE, seed: int = 11):
        raw, offsets = utf8(pa.array(texts, pa.string()))
        w = words(lower(raw), offsets, separator=SIGNS)
        self.ids = ids
        self.words = [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(ids))]
        self.edits = [math.floor(share * len(x)) for x in self.words]
        self.parts = [x for i, own in enumerate(self.words) for x in parts_of(i, own, self.edits[i])]
        self.gap = max((len(x.words) + x.edits for x in self.parts), default=0) + 2
        self.sizes = np.array([len(x.words) for x in self.parts], np.int64)
        self.most = np.array([x.edits for x in self.parts], np.int64)
        #: The parts of each length as a matrix, and the row of each part.
        self.rows = {n: np.stack([x.words for x in self.parts if len(x.words) == n]) for n in set(self.sizes.tolist())}
        self.row_of = np.array([np.count_nonzero(self.sizes[:i] == n) for i, n in enumerate(self.sizes)], np.int64)
        self.bands: list[Band] = []
        rng = np.random.default_rng(seed)
        size = [len(x.words) for x in self.parts]
        order = sorted(range(len(size)), key=size.__getitem__)
        while order:
            shortest = size[order[0]]
            own = [i for i in order if size[i] <= max(shortest, int(shortest * BAND))]
            order = order[len(own) :]
            steps = max(1, math.ceil(1.7 * shortest))
            stream = np.concatenate([np.concatenate([self.parts[i].words, np.full(self.gap, GAP)]) for i in own])
            starts = np.cumsum([0, *(size[i] + self.gap for i in own[:-1])])
            edits = max(self.parts[i].edits for i in own)
            band = Band(shortest, edits, np.unique(np.concatenate([self.parts[i].words for i in own])), steps, [], [], [], [])
            tables = -(-tables_for() // WALKS) if edits else 1
            for seed_ in range(WALKS if edits else 1):
                written = walk(stream, starts, steps, seed_)
                for _ in range(tables):
                    sample = np.sort(rng.choice(steps, min(SAMPLED, steps), replace=False))
                    key = _key(written, sample)
                    by = np.argsort(key, kind="stable")
                    band.samples.append(sample)
                    band.keys.append(key[by])
                    band.parts.append(np.array(own)[by])
                    bits = np.zeros(1 << BITS, bool)
                    bits[key >> np.uint64(64 - BITS)] = True
                    band.bits.append(bits)
            self.bands.append(band)

    def find(self, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, edits, first word) for each text that holds an item, the best window of each pair."""
        raw, offsets = utf8(column)
        w = words(lower(raw), offsets, separator=SIGNS)
        if not len(w) or not self.bands:
            return
        owner = w.owner
        stream = np.full(len(w) + (len(w.first) - 1) * self.gap, GAP)
        place = np.arange(len(w)) + owner * self.gap
        stream[place] = w.hash
        best: dict[tuple[int, int], tuple[int, int]] = {}
        anchors: dict[tuple[int, int], set[int]] = {}
        for start, number, distance in self._verified(stream, place):
            part = self.parts[number]
            text, item = owner[start], part.item
            if len(part.words) != len(self.words[item]):
                anchors.setdefault((text, item), set()).add(start - part.offset)
            elif (distance, start) < best.get((text, item), (part.edits + 1, 0)):
                best[text, item] = (distance, start)
        for (text, item), at in anchors.items():
            own, edits = self.words[item], self.edits[item]
            at = np.array(sorted(at))
            for near in np.split(at, np.flatnonzero(np.diff(at) > edits) + 1):
                # a window that holds the part begins within the edits of where the part puts it
                low = max(w.first[text], near[0] - edits)
                around = w.hash[low : max(low, min(w.first[text + 1], near[-1] + len(own) + 2 * edits))]
                if np.isin(own, around).sum() < len(own) - edits:
                    continue
                distance, start = best_window(own, around, edits)
                if distance <= edits and (distance, low + start) < best.get((text, item), (edits + 1, 0)):
                    best[text, item] = (distance, low + start)
        for (text, item), (distance, start) in sorted(best.items()):
            yield int(text), item, distance, int(start - w.first[text])

    def _verified(self, stream: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Word, part and distance of all candidates within the part's edits; parts of one length are verified together."""
        for starts, numbers in self._candidates(stream, place):
            for length in np.unique(self.sizes[numbers]).tolist():
                alike = np.flatnonzero(self.sizes[numbers] == length)
                rows = self.rows[length]
                for most in np.unique(self.most[numbers[alike]]).tolist():
                    own = alike[self.most[numbers[alike]] == most]
                    for at in range(0, len(own), TOGETHER):
                        some = own[at : at + TOGETHER]
                        items = rows[self.row_of[numbers[some]]]
                        windows = stream[place[starts[some]][:, None] + np.arange(length + most)]
                        some_fit = np.flatnonzero(shared(items, windows) >= length - most)
                        some, items, windows = some[some_fit], items[some_fit], windows[some_fit]
                        distance = edit_distances(items, windows, most)
                        hit = distance <= most
                        yield from zip(starts[some[hit]].tolist(), numbers[some[hit]].tolist(), distance[hit].tolist(), strict=True)

    def _candidates(self, stream: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words and part numbers of the candidates of each band."""
        for band in self.bands:
            at = np.minimum(np.searchsorted(band.vocabulary, stream), len(band.vocabulary) - 1)
            known = np.concatenate([[0], np.cumsum((band.vocabulary[at] == stream) & (stream != GAP))])
            reach = np.minimum(place + band.shortest, len(stream))
            starts = np.flatnonzero(known[reach] - known[place] >= band.shortest - band.edits)
            if not len(starts):
                continue
            found = []
            tables = len(band.samples) // (WALKS if band.edits else 1)
            for t, (sample, keys, parts) in enumerate(zip(band.samples, band.keys, band.parts, strict=True)):
                if t % tables == 0:
                    written = walk(stream, place[starts], band.steps, t // tables)
                key = _key(written, sample)
                # most keys are none of the parts', which a look at their first bits tells
                maybe = np.flatnonzero(band.bits[t][key >> np.uint64(64 - BITS)])
                key = key[maybe]
                low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                hit = np.flatnonzero(high > low)
                count = (high - low)[hit]
                part = parts[np.repeat(low[hit] - np.cumsum(count) + count, count) + np.arange(count.sum())]
                found.append(np.repeat(starts[maybe[hit]], count) * len(self.parts) + part)
            pairs = np.unique(np.concatenate(found))
            yield pairs // len(self.parts), pairs % len(self.parts)


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list, list]]:
    """Ids and texts of the items, about ``BLOCK_BYTES`` at a time."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()
        own = own.sort_by([("item_id", "ascending"), ("text", "ascending")])
        yield own["item_id"].to_pylist(), own["text"].to_pylist()


def matches(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """``doc_id, item_id, edits, first_word``: which documents hold which items."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = [own.mapInArrow(_finder(*block, share), _FOUND) for block in _blocks(benchmark)]
    return reduce(DataFrame.unionAll, found)


_FOUND = "doc_id bigint, item_id bigint, edits int, first_word bigint"


def _finder(ids: list, texts: list, share: float):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(ids, texts, share)
        for batch in slices(batches):
            rows = list(items.find(batch.column(1)))
            text, item, edits, first = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(text, pa.int64())),
                    pa.array([ids[i] for i in item], pa.int64()),
                    pa.array(edits, pa.int32()),
                    pa.array(first, pa.int64()),
                ],
                names=["doc_id", "item_id", "edits", "first_word"],
            )

    return apply


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents that hold no item, with their columns; neither join nor shuffle."""
    place = docs.columns.index("text")

    def dropper(ids: list, texts: list):
        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(ids, texts, share)
            for batch in slices(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[text for text, *_ in items.find(batch.column(place))]] = False
                yield batch.filter(pa.array(keep))

        return apply

    for block in _blocks(benchmark):
        docs = docs.mapInArrow(dropper(*block), docs.schema)
    return docs
