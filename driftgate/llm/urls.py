"""URL filter by host and path rules, and by the ratio of two character language models where no rule fits.

Both models are smoothed variable-order Markov chains over bytes: the estimate for a byte after its ``order`` preceding
bytes falls back on the shorter context, in proportion to how seldom the longer one was seen. All orders count at every
size of the input: contexts and their continuations are counted one by one, known by 64-bit hashes, in a table that stays
distributed. A chunk of URLs asks it for the distinct counts that its bytes need, so nothing is gathered or broadcast.
The models learn from the URLs that the rules accept and reject; the threshold on the length-normalised log-likelihood
difference is the one that best separates a held-out fold (one URL in ten by hash).

``_count``, ``sound`` and ``_scores`` are the same model in hashed tables of a fixed size, which is an approximation: an
order with more contexts than its table can tell apart takes no part. The query does not use them.

Defined cases: a null URL, or one without ``://``, has an empty host and path and scores as an empty string; with no
accepted or no rejected URL to learn from every unruled URL is allowed; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from driftgate.llm.text import mix, slices, utf8
from driftgate.session import WorkArea, ship_package

#: verdict, host, path
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 5
SLOTS = 1 << 17
ROWS = 2  # each count is the least of so many hashed ones
FULL = 0.5
STRENGTH = 2.0
FOLDS = 10
BINS = 2000
REACH = 10.0  # scores are binned for the threshold between -REACH and REACH
CHUNK = 1 << 18  # bytes of URLs that ask for counts together
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as ``struct<rule, verdict>``, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Symbols with an end mark for each text, the text of each symbol, and a hash of each context by order."""
    data, offsets = utf8(column)
    n = np.diff(offsets) + 1
    owner = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    place = np.arange(len(owner)) - first[owner]
    symbol = np.full(len(owner), 256, np.uint64)
    symbol[place < (n - 1)[owner]] = data
    context, out = np.zeros(len(symbol), np.uint64), []
    for k in range(ORDER + 1):
        if k:
            back = np.full(len(symbol), 257, np.uint64)
            back[k:] = np.where(place[k:] >= k, symbol[:-k], np.uint64(257))
            context = mix(context * np.uint64(259) + back + np.uint64(1))
        out.append(context)
    return symbol, owner, out


def _keys(symbol: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What (context, symbol) and the context alone are known by."""
    return mix(context * np.uint64(263) + symbol), mix(context + np.uint64(77))


def _slots(symbol: np.ndarray, contexts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the table cells of (context, symbol) and of the context, one for each row of the table."""
    for context in contexts:
        yield tuple(
            [(mix(key + np.uint64(row + 1)) % np.uint64(SLOTS)).astype(np.int64) + row * SLOTS for row in range(ROWS)]
            for key in _keys(symbol, context)
        )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, ORDER + 1, 2, ROWS * SLOTS), np.int32)
    for batch in slices(batches, "url"):
        symbol, owner, contexts = _codes(batch.column(0))
        accepted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)[owner]
        for k, cells in enumerate(_slots(symbol, contexts)):
            for kind in (0, 1):
                for side in (0, 1):
                    chosen = np.concatenate([c[accepted == bool(side)] for c in cells[kind]])
                    np.add.at(total[side, k, kind], chosen, 1)
    flat = total.reshape(-1)
    cell = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(flat[cell].astype(np.int64))], names=["cell", "n"])


def _scores(table: np.ndarray, column: pa.Array) -> np.ndarray:
    """Mean log-likelihood difference per symbol of each text."""
    symbol, owner, contexts = _codes(column)
    p = np.full((2, len(symbol)), 1 / 257)
    for k, (pair, alone) in enumerate(_slots(symbol, contexts)):
        both, context = (
            np.minimum.reduce([table[:, k, kind][:, c] for c in cells]) for kind, cells in enumerate((pair, alone))
        )
        p = (both + STRENGTH * p) / (context + STRENGTH)
    gain = np.log(p[1]) - np.log(p[0])
    return np.bincount(owner, gain, len(column)) / np.bincount(owner, minlength=len(column))


def sound(table: np.ndarray) -> np.ndarray:
    """The tables without the orders that have more distinct contexts and symbols than they can tell apart.

    In a table more than ``FULL`` full, counts of different contexts run into each other. Such an order is emptied for
    both sides, and estimates fall back on the longest order that is still told apart.
    """
    filled = (table[:, :, 0] > 0).mean(axis=2).max(axis=0)
    table[:, filled > FULL] = 0
    return table


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each context and each continuation occurs in the rejected and the accepted URLs of a slice."""
    for batch in slices(batches, "url"):
        symbol, owner, contexts = _codes(batch.column(0))
        accepted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)[owner]
        seen = np.concatenate([key for context in contexts for key in _keys(symbol, context)])
        key, at = np.unique(seen, return_inverse=True)
        side = np.tile(accepted, 2 * len(contexts))
        counts = [np.bincount(at, side == bool(s), len(key)).astype(np.int64) for s in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *map(pa.array, counts)], names=["key", "n0", "n1"])


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 32
    for i, batch in enumerate(slices(batches, "url", CHUNK)):
        chunk = pa.array(np.full(batch.num_rows, first + i, np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns, chunk], names=[*batch.schema.names, "chunk"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct keys each chunk needs; a chunk may come in several batches and a batch may hold several chunks."""
    for batch in batches:
        chunk = batch.column(1).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            symbol, _, contexts = _codes(batch.column(0).slice(a, b - a))
            key = np.unique(np.concatenate([key for context in contexts for key in _keys(symbol, context)]))
            own = pa.array(np.full(len(key), chunk[a], np.int64))
            yield pa.RecordBatch.from_arrays([own, pa.array(key.view(np.int64))], names=["chunk", "key"])


def _gain(column: pa.Array, key: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean log-likelihood difference per symbol of each text; ``counts`` has a row for each side, ``key`` is sorted."""
    symbol, owner, contexts = _codes(column)
    key, counts = np.append(key, np.uint64(2**64 - 1)), np.append(counts, np.zeros((2, 1)), axis=1)
    p = np.full((2, len(symbol)), 1 / 257)
    for context in contexts:
        both, alone = (
            np.where(key[at] == wanted, counts[:, at], 0.0)
            for wanted in _keys(symbol, context)
            for at in (np.searchsorted(key[:-1], wanted),)
        )
        p = (both + STRENGTH * p) / (alone + STRENGTH)
    gain = np.log(p[1]) - np.log(p[0])
    return np.bincount(owner, gain, len(column)) / np.bincount(owner, minlength=len(column))


def scored(rows: DataFrame, model: DataFrame, area: WorkArea, name: str) -> DataFrame:
    """``rows`` with a column ``score`` in the place of ``url``."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    stored = area.save(rows.mapInArrow(_chunked, f"{fields}, chunk bigint"), name)
    # a key is asked for at most once by a chunk and batch
    asked = stored.select("url", "chunk").mapInArrow(_asked, "chunk bigint, key bigint")
    # sorted and merged: sizes are guessed from the stored URLs, which are far smaller than their keys, and a broadcast passes the driver
    answers = asked.join(model.hint("merge"), "key")
    kept = [c for c in rows.columns if c != "url"]

    def judge_chunk(texts: pa.Table, found: pa.Table) -> pa.Table:
        key = found["key"].to_numpy().view(np.uint64)
        key, first = np.unique(key, return_index=True)
        counts = np.stack([found[n].to_numpy()[first] for n in ("n0", "n1")]).astype(np.float64)
        score = _gain(texts["url"].combine_chunks(), key, counts)
        return texts.select(kept).append_column("score", pa.array(score, pa.float64()))

    wanted = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(kept).schema)
    return stored.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(judge_chunk, f"{wanted}, score double")


def _ruled(pages: DataFrame, rules) -> DataFrame:
    url = F.col("url")
    judged = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    return judged.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))


def train(pages: DataFrame, rules=RULES, area: WorkArea | None = None) -> tuple[DataFrame, float] | None:
    """Counts ``key, n0, n1`` of both models and the calibrated threshold; None if a side has no URLs."""
    ship_package(pages.sparkSession)
    area = area or WorkArea(pages.sparkSession, "urls")
    sides = (
        _ruled(pages, rules)
        .filter("hit IS NOT NULL")
        .select("url", (F.col("hit.verdict") == "allow").alias("accepted"), F.pmod(F.xxhash64("url"), FOLDS).alias("fold"))
    )
    counted = sides.filter("fold > 0").select("url", "accepted").mapInArrow(_grams, "key bigint, n0 bigint, n1 bigint")
    model = area.save(counted.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "counts")
    whole = int(_keys(np.zeros(1, np.uint64), np.zeros(1, np.uint64))[1].view(np.int64)[0])  # the empty context
    total = model.filter(F.col("key") == whole).first()
    if total is None or not (total["n0"] and total["n1"]):
        return None
    held = scored(sides.filter("fold = 0").select("url", "accepted"), model, area, "held")
    place = F.floor((F.col("score") + REACH) / (2 * REACH) * BINS)
    binned = held.select(F.col("accepted").cast("int").alias("side"), F.greatest(F.least(place, F.lit(BINS - 1)), F.lit(0)).alias("at"))
    seen = np.zeros((2, BINS))
    for r in binned.groupBy("side", "at").agg(F.count(F.lit(1)).alias("n")).collect():  # at most 2 x BINS rows
        seen[r.side, r.at] = r.n
    if not seen.sum(1).all():
        return model, 0.0
    share = seen / seen.sum(1, keepdims=True)
    # accept at or above a cut: what is kept of the accepted and dropped of the rejected
    gain = np.concatenate([[0], np.cumsum(share[0])]) - np.concatenate([[0], np.cumsum(share[1])])
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return model, float((best[0] + best[-1]) / 2 / BINS * 2 * REACH - REACH)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score``: the rule's verdict, else that of the models."""
    area = WorkArea(pages.sparkSession, "urls")
    model = train(pages, rules, area)
    kept = _ruled(pages, rules).select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", "host", "path", "hit.rule", "hit.verdict"
    )
    if model is None:
        return kept.drop("url").withColumns({"score": F.lit(0.0), "verdict": F.coalesce("verdict", F.lit("allow"))})
    counts, threshold = model
    own = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored(kept, counts, area, "pages").withColumn("verdict", F.coalesce("verdict", own))
