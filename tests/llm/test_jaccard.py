"""The n-gram Jaccard join against all pairs of sets."""

import random
import re

import numpy as np
import pytest

from driftgate.llm import jaccard
from driftgate.llm.components import components
from driftgate.llm.queries import all_queries
from driftgate.session import WorkArea

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, component_id int"


def shingle_set(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(docs):
    """Sizes and components by comparing all pairs."""
    sets = [(d, shingle_set(t)) for d, t in docs]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, x) in enumerate(sets):
        for j in range(i):
            y = sets[j][1]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(x), least.get(top(i))) for i, (d, x) in enumerate(sets)), key=str)


def mine(spark, docs):
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], DOC).repartition(3)
    out = jaccard.cluster(df, WorkArea(spark, "t")).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)


def corpus(rng, groups, sizes, copies, change):
    docs, passage = [], [f"p{i}" for i in range(60)]
    for g in range(groups):
        n = rng.choice(sizes)
        base = [f"w{rng.randrange(400)}" for _ in range(n)]
        if rng.random() < 0.3:
            base[n // 2 : n // 2] = passage
        for _ in range(rng.choice(copies)):
            own = list(base)
            for _ in range(int(rng.random() * change * n)):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = [f"w{rng.randrange(400)}"] * rng.randrange(2)
            docs.append((len(docs) * 7 % 1009 + g, " ".join(own)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    docs = corpus(rng, 60, [1, 2, 4, 5, 6, 8, 10, 12, 15, 30, 60, 100, 300], [1, 2, 3, 6], 0.06)
    docs += corpus(rng, 3, [40, 80], [40], 0.05)  # groups that many signatures are shared by
    assert mine(spark, docs) == plain(docs)


def test_all_tiny_sets(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(4, 16)))) for i in range(250)]
    assert mine(spark, docs) == plain(docs)


def test_without_reserved_segments(spark, monkeypatch):
    """Sets that lack segments are compared directly, in blocks."""
    jaccard.scheme.cache_clear()
    monkeypatch.setattr(jaccard, "scheme", lambda band: (int(jaccard._EDGES[band + 1]) * 2 // 7 + 1, 0))
    monkeypatch.setattr(jaccard, "DIRECT_BYTES", 2000)
    rng = random.Random(4)
    docs = corpus(rng, 25, [5, 8, 12, 30, 60], [1, 3], 0.06)
    assert mine(spark, docs) == plain(docs)


def test_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    out = all_queries()["op10_jaccard_components"](spark, SMALL).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == plain(docs)


def test_cases(spark):
    long = " ".join(f"x{i % 5000}" for i in range(60_000))
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (5, "one"), (6, "Eins zwei"), (None, "a b c d e f"), (None, None), (8, long), (9, long + " y")]
    assert mine(spark, docs) == plain(docs)
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], DOC)
    assert jaccard.cluster(df.limit(0), WorkArea(spark, "t")).count() == 0
    kept = jaccard.distinct_documents(df, WorkArea(spark, "t"))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 6, 8] and kept.columns == df.columns
    again = spark.createDataFrame([(5, "a b c d e f", 0)] * 4 + [(5, "other words", 0), (7, "", 0), (7, "", 0)], DOC)
    kept = jaccard.distinct_documents(again, WorkArea(spark, "t")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(5, "a b c d e f"), (5, "other words"), (7, ""), (7, "")]


def test_parity_is_a_lower_bound():
    rng = np.random.default_rng(0)
    for n in (3, 50, 200, 900):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        y = np.concatenate([x[: n - n // 4], rng.integers(0, 1 << 63, n // 8, dtype=np.uint64)])
        gap = jaccard.parity_gap(jaccard.parity_of(x)[None], jaccard.parity_of(y)[None])[0]
        assert gap <= n // 4 + n // 8


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 60)] + [(500, 400), (7, 7)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.node: r.root for r in components(df, WorkArea(spark, "t")).collect()}
    want = dict.fromkeys(range(100, 141), 100) | dict.fromkeys(range(1, 60), 1) | {400: 400, 500: 400}
    assert got == want
