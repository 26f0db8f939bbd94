"""Token counts against the tokenizer library itself."""

import random

import numpy as np
import pyarrow as pa
import pytest

from driftgate.llm import tokens
from driftgate.llm.queries import all_queries

P = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer
PATH = P.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"
PARTS = [
    "'s", "'re", "'r", "'v", "'l", "'ll", "'", "''", " ", "  ", "\n", "\t", "\n\n", "a", "Ab", "the", " the", "1", "٣", "é", "日本",
    "!", "?!", "-", "<|endoftext|>", "<|endof", " ", "\u0085", "\x1c", "aaaaaaaaaa", "zqxjk", "😀", "don't", "e", "r", "ve",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as f:
        return tokens.TokenCounter(f.read())


def lengths(library, texts):
    return [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_random_texts(library, counter):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(5_000)]
    assert counter.column(pa.array(texts))[1].tolist() == lengths(library, texts)


def test_long_texts_over_many_chunks(library, counter):
    rng = random.Random(6)
    texts = ["".join(rng.choice(PARTS) for _ in range(50_000)), "a" * 30_000, " " * 5_000 + "x", "=" * 3_000, ""]
    assert counter.column(pa.array(texts))[1].tolist() == lengths(library, texts)


def test_scan_equals_loop():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, tokens.STATES, (37, tokens.STATES)).astype(np.uint8)
    now, want = np.arange(tokens.STATES), []
    for m in maps:
        now = m[now]
        want.append(now)
    assert (tokens.scan_maps(maps) == np.array(want)).all()


def test_forgetting_changes_nothing(library, counter, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_TRANSITIONS", 50)
    monkeypatch.setattr(tokens, "KEPT_WORDS", 5)
    texts = ["one two three four five six seven eight nine ten"] * 3
    for _ in range(3):
        assert counter.column(pa.array(texts))[1].tolist() == lengths(library, texts)


def test_query_counts_whole_texts(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = dict(zip([d.doc_id for d in docs], lengths(library, [d.text for d in docs]), strict=True))
    size = {d.doc_id: len(d.text.encode()) for d in docs}
    out = all_queries()["op2_token_counts"](spark, SMALL).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in out} == {
        i: (size[i], n, n > 512) for i, n in want.items()
    }


def test_cases(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "two words", 7), (3, "two words", 7), (None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    out = tokens.count_tokens(df, PATH)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in out.collect()) == [(0, 1, 1), (1, 0, 0), (2, 0, 0), (3, 9, 2), (3, 9, 2)]
    assert tokens.count_tokens(df.limit(0), PATH).count() == 0
