"""Quality classifier: ordinal cumulative-link regression on graded ratings of hashed texts.

A text is the set of its distinct lower-cased words, as they are and cut at signs, hashed, with a few hashed marks of its form (share of capitals,
of symbols, of repeated words and lines). One weight vector gives its level f; grades are cut by ordered thresholds:
``P(grade <= j) = sigmoid(t_j - f)``. Scores are the expected grade and the tail probabilities ``P(grade >= j)``.

Grades: 0 toxic, 1 of low quality, 2 good. Weights are fitted by proximal AdaGrad (L1, so that words seen by chance get
weight 0) on at most ``SAMPLE`` labelled documents, those with the lowest hash of their id; that bound is a parameter.
Every document is scored.

Defined cases: null and empty texts are texts without words and are scored as such; labels with a null id, null values
or no document are left out; repeated labels of an id count once, the worst one; without any labels every document has
level 0 and is kept. Repeated documents score alike; further columns are carried, and
those named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from driftgate.llm.text import SIGNS, lower, mix, slices, utf8, words

BITS = 18
SAMPLE = 20_000
EPOCHS = 12
BATCH = 64
RATE = 0.2
L1 = 5e-4
KEEP = 0.5
GRADES = 3

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def _per_text(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag)])
    return total[offsets[1:]] - total[offsets[:-1]]


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text and the text they belong to, in order of texts."""
    raw, offsets = utf8(column)
    low, slots = lower(raw), np.uint64(1 << BITS)
    w, bare = words(low, offsets), words(low, offsets, separator=SIGNS)
    pair = np.unique(w.owner.astype(np.uint64) * slots + w.hash % slots)
    size = np.diff(offsets)
    plain = np.maximum(size - _per_text(_BLANK[raw], offsets), 1)
    letters = _per_text(_ALPHA[raw], offsets)
    unlike = np.bincount((pair // slots).astype(np.int64), minlength=len(size))
    form = (
        _per_text(_UPPER[raw], offsets) / np.maximum(letters, 1),
        (plain - letters - _per_text(_DIGIT[raw], offsets)) / plain,
        _per_text(_DIGIT[raw], offsets) / plain,
        unlike / np.maximum(w.counts, 1),
        np.log2(w.counts + 1) / 16,
    )
    own = np.arange(len(size), dtype=np.uint64)
    marks = [
        own * slots + mix(np.minimum(share * 20, 20).astype(np.uint64) + np.uint64(1000 * (i + 1))) % slots
        for i, share in enumerate(form)
    ]
    bared = bare.owner.astype(np.uint64) * slots + mix(bare.hash) % slots
    pair = np.unique(np.concatenate([pair, bared, *marks]))
    return (pair % slots).astype(np.int64), (pair // slots).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    cuts: np.ndarray

    def level(self, column: pa.Array) -> np.ndarray:
        slot, owner = features(column)
        return np.bincount(owner, self.weights[slot], len(column))

    def tails(self, level: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - level[:, None], -500, 500)))


def fit(slots: list[np.ndarray], grades: np.ndarray, seed: int = 3) -> Model:
    """Proximal AdaGrad on the cumulative-link loss; cuts are a first cut and positive gaps."""
    weights, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    share = np.cumsum(np.bincount(grades, minlength=GRADES)[:-1] + 1.0) / (len(grades) + GRADES)
    cuts, cut_seen = np.log(share / (1 - share)), np.full(GRADES - 1, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(grades))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            slot = np.concatenate([slots[i] for i in rows])
            owner = np.repeat(np.arange(len(rows)), [len(slots[i]) for i in rows])
            level, y = np.bincount(owner, weights[slot], len(rows)), grades[rows]
            edge = np.concatenate([[-np.inf], cuts, [np.inf]])
            high = 1 / (1 + np.exp(np.clip(level - edge[y + 1], -500, 500)))
            low = 1 / (1 + np.exp(np.clip(level - edge[y], -500, 500)))
            p = np.maximum(high - low, 1e-9)
            up, down = high * (1 - high) / p, low * (1 - low) / p
            slope = (up - down) / len(rows)  # of the loss in the level
            grad = np.bincount(slot, slope[owner], len(weights))
            seen += grad * grad
            step = RATE / np.sqrt(seen)
            touched = np.flatnonzero(grad)
            moved = weights[touched] - step[touched] * grad[touched]
            weights[touched] = np.sign(moved) * np.maximum(np.abs(moved) - step[touched] * L1, 0)
            g = np.zeros(GRADES - 1)
            np.add.at(g, np.minimum(y, GRADES - 2), np.where(y < GRADES - 1, -up, 0) / len(rows))
            np.add.at(g, np.maximum(y - 1, 0), np.where(y > 0, down, 0) / len(rows))
            cut_seen += g * g
            cuts = np.maximum.accumulate(cuts - RATE * g / np.sqrt(cut_seen) + np.arange(GRADES - 1) * 1e-9)
    return Model(weights.astype(np.float32), cuts)


def graded(labels: DataFrame) -> DataFrame:
    """One grade for each labelled id."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return (
        labels.select("doc_id", grade.alias("grade"))
        .filter("doc_id IS NOT NULL AND grade IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("grade").alias("grade"))
    )


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model fitted to all rows of a task, in order of their ids; nothing without rows."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    slots = [np.frombuffer(x.as_buffer(), np.int32) for x in rows["slots"]]
    model = fit([slots[i] for i in order], rows["grade"].to_numpy()[order])
    out = [pa.array([x.tobytes()], pa.binary()) for x in (model.weights, model.cuts)]
    yield pa.RecordBatch.from_arrays(out, names=["weights", "cuts"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` labelled documents; None without any."""
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            slot, owner = features(batch.column(0))
            parts = np.split(slot.astype(np.int32), np.searchsorted(owner, np.arange(1, batch.num_rows)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes() for x in parts], pa.binary()), batch.column(1), batch.column(2)],
                names=["slots", "grade", "doc_id"],
            )

    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most ``sample`` ids
        .select("text", F.col("grade").cast("int").alias("grade"), F.col("doc_id").cast("bigint").alias("doc_id"))
        .mapInArrow(sparse, "slots binary, grade int, doc_id bigint")
        .groupBy("doc_id")
        .agg(F.min("slots").alias("slots"), F.min("grade").alias("grade"))
        .coalesce(1)  # the bounded sample, as numbers, meets in a task; the driver gets the model only
        .mapInArrow(_learn, "weights binary, cuts binary")
        .collect()
    )
    if not rows:
        return None
    return Model(np.frombuffer(rows[0]["weights"], np.float32), np.frombuffer(rows[0]["cuts"], np.float64))


def score(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """The documents with ``level, expected_grade, p_good`` (the best grade), ``p_safe`` (not the worst) and ``keep``."""
    names = ["level", "expected_grade", "p_safe", "p_good"]
    own = [c for c in docs.columns if c not in (*names, "keep")]
    place = own.index("text")
    model = model or Model(np.zeros(1 << BITS, np.float32), np.full(GRADES - 1, -50.0))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            level = model.level(batch.column(place))
            tails = model.tails(level)
            out = [level, tails.sum(1), tails[:, 0], tails[:, 1]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], names=[*own, *names])

    kept = docs.select(own)
    schema = StructType(list(kept.schema))
    for n in names:
        schema = schema.add(n, "double")
    return kept.mapInArrow(apply, schema).withColumn("keep", F.col("p_good") >= keep)
