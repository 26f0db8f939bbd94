"""Benchmark passages in documents against all windows and exact edit distances."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from driftgate.llm import decontaminate
from driftgate.llm.queries import all_queries

SMALL = "/root/testdata/sf0.001"
DOC, ITEM = "doc_id bigint, text string, edits int", "item_id bigint, text string"


def split(text):
    """Words cut at ASCII signs; A-Z lowered."""
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def least_edits(item, text):
    """Least edits between the item and any window of the text (plain dynamic program with a free start and end)."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def plain(docs, items):
    out = {}
    for d, text in docs:
        for i, passage in items:
            own = split(passage)
            if own and (n := least_edits(own, split(text))) <= int(decontaminate.SHARE * len(own)):
                out[d, i] = n
    return out


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"new{rng.randrange(999)}"
        elif kind == 1 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, f"new{rng.randrange(999)}")
    return words


def test_recall_at_every_edit_count(spark):
    rng = random.Random(2)
    pool = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    items = [(i, " ".join(rng.sample(pool, n))) for i, n in enumerate([5, 12, 16, 20, 24, 30, 37, 45, 60, 90])]
    docs = []
    for i, text in items:
        own = text.split()
        for n in range(int(0.25 * len(own)) + 1):
            for _ in range(3):
                pad = rng.sample(pool, 40)
                docs.append((len(docs), " ".join(pad[:17] + edited(rng, own, n) + pad[17:])))
    docs += [(len(docs) + i, " ".join(rng.sample(pool, 200))) for i in range(20)]
    want = plain(docs, items)
    out = decontaminate.matches(
        spark.createDataFrame([(*d, 1) for d in docs], DOC), spark.createDataFrame(items, ITEM)
    ).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in out}
    assert set(got) <= set(want)
    assert len(got) >= 0.97 * len(want)
    for low in (0, 0.1, 0.15):  # also near the limit
        near = [k for k, n in want.items() if n >= low * len(split(items[k[1]][1]))]
        assert np.mean([k in got for k in near]) >= 0.95
    assert all(got[k] >= want[k] for k in got)


def test_table_equals_plain(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if len(r.text) < 3000]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    out = all_queries()["op3_benchmark_leaks"](spark, SMALL).collect()
    ids = {d for d, _ in docs}
    assert {(r.doc_id, r.item_id) for r in out if r.doc_id in ids} == set(plain(docs[:80], items)) | {
        (r.doc_id, r.item_id) for r in out if r.doc_id in {d for d, _ in docs[80:]}
    }
    texts = dict(docs)
    for r in out:
        if r.doc_id in ids and r.edits == 0:
            own = split(dict(items)[r.item_id])
            assert split(texts[r.doc_id])[r.first_word : r.first_word + len(own)] == own


@pytest.mark.parametrize("n", [20, 40, 59, 90, 300, 600, 1200])
def test_recall_of_long_items(n):
    rng = random.Random(n)
    found, runs = 0, 0
    for edits in {int(n * share) for share in (0, 0.05, 0.1, 0.15, 0.2)}:
        for _ in range(max(6, 600 // n)):
            own = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            text = rng.choices(own, k=30) + edited(rng, own, edits) + [f"x{i}" for i in range(30)]
            items = decontaminate.Items([0], [" ".join(own)])
            rows = list(items.find(pa.array(["no copy", " ".join(text)])))
            runs += 1
            found += len(rows) == 1 and rows[0][:2] == (1, 0) and rows[0][2] <= edits
            if rows and edits == 0:
                assert rows == [(1, 0, 0, 30)]
    assert found >= 0.98 * runs


def test_edits_dealt_evenly_over_all_parts():
    rng = random.Random(8)
    found = 0
    for _ in range(20):
        own = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        text = [f"new{i}" if i % 5 == 2 else x for i, x in enumerate(own)]
        found += list(decontaminate.Items([0], [" ".join(own)]).find(pa.array([" ".join(text)]))) == [(0, 0, 80, 0)]
    assert found == 20


def test_best_window_equals_plain():
    rng = random.Random(4)
    for _ in range(200):
        item, text = ([rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        n, start = decontaminate.best_window(np.array(item), np.array(text), len(item))
        assert n == least_edits(item, text)
        assert n == min(least_edits(item, text[start:b]) for b in range(start, len(text) + 1))


def test_every_document_equals_plain(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    owns = {i: split(text) for i, text in items}
    want = set()
    for d, text in docs:
        text = split(text)
        have = set(text)
        for i, own in owns.items():
            most = int(decontaminate.SHARE * len(own))
            if own and sum(w in have for w in own) >= len(own) - most and least_edits(own, text) <= most:
                want.add((d, i))
    out = all_queries()["op3_benchmark_leaks"](spark, SMALL).collect()
    assert {(r.doc_id, r.item_id) for r in out} == want


def test_cases(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = [(1, None, 1), (2, "", 1), (3, f"so {passage.upper()}!", 1), (3, f"so {passage.upper()}!", 1), (None, passage, 1), (5, "x " * 50_000 + passage, 1)]
    items = [(1, passage), (2, passage), (3, None), (None, "!!!"), (4, "")]
    d, b = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    got = sorted((r.doc_id or 0, r.item_id, r.edits, r.first_word) for r in decontaminate.matches(d, b).collect())
    assert got == [(0, 1, 0, 0), (0, 2, 0, 0), *[(3, i, 0, 1) for i in (1, 1, 2, 2)], (5, 1, 0, 50_000), (5, 2, 0, 50_000)]
    kept = decontaminate.clean(d, b)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and kept.columns == d.columns
    assert decontaminate.matches(d.limit(0), b).count() == 0
    assert decontaminate.clean(d, b.limit(0)).count() == len(docs)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(12))) for i in range(6)]
    d = spark.createDataFrame([(i, text, 1) for i, text in items] + [(9, "clean", 1)], DOC)
    b = spark.createDataFrame(items, ITEM)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.matches(d, b).collect()) == [(i, i) for i in range(6)]
    assert [r.doc_id for r in decontaminate.clean(d, b).collect()] == [9]


@pytest.mark.parametrize("n", [0, 1, 2])
def test_edit_distance(n):
    a = np.arange(1, 11, dtype=np.uint64)
    assert decontaminate.edit_distances(a[None], np.delete(a, range(3, 3 + n))[None], 2).tolist() == [n]


def test_batched_distances():
    """Each row against the plain table, with ends of texts inside windows."""
    rng = np.random.default_rng(6)
    items, windows = rng.integers(1, 5, (300, 8)).astype(np.uint64), rng.integers(1, 5, (300, 11)).astype(np.uint64)
    windows[::7, 6:] = decontaminate.GAP
    windows[::3, :8] = items[::3]
    for most in (0, 2, 3):
        got = decontaminate.edit_distances(items, windows, most)
        for item, window, found in zip(items.tolist(), windows.tolist(), got.tolist()):
            row = list(range(len(window) + 1))
            for i, a in enumerate(item, 1):
                last, row = row, [i]
                for j, b in enumerate(window):
                    row.append(min(last[j] + (a != b), last[j + 1] + 1, row[j] + 1))
            assert found == min(min(row), most + 1)
