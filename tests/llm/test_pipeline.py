"""The corpus pipeline, stage by stage, against brute force on what the stage before kept."""

import re

import pytest
from pyspark.sql import functions as F
from test_chat_mixture import plain_targets
from test_decontaminate import plain as plain_leaks
from test_jaccard import plain as plain_groups
from test_url_quality_pii import plain_find

import corpus_pipeline
from driftgate.llm import ordinal

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage returned, the documents first."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_names_and_columns(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "mixing sources",
    ]
    for df in kept[1:-1]:
        assert df.schema.simpleString() == kept[0].schema.simpleString()


def test_quality_keeps_the_good(spark, kept):
    labels = {r.doc_id: r.grade for r in ordinal.graded(spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    before, after = texts(kept[0]), texts(kept[1])
    assert set(after) < set(before) and all(after[i] == before[i] for i in after)
    rate = {g: sum(i in after for i in own) / len(own) for g in (0, 1, 2) if (own := [i for i in before if labels.get(i) == g])}
    assert rate[2] > 0.95 and rate.get(0, 0) < 0.2


def test_one_of_each_group_stays(kept):
    before, after = texts(kept[1]), texts(kept[2])
    groups = plain_groups(list(before.items()))
    assert set(after) == {d for d, n, c in groups if d == c or not n}


def test_no_leak_is_left(spark, kept):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before, after = texts(kept[2]), texts(kept[3])
    gone = [(i, before[i]) for i in set(before) - set(after)]
    assert {d for d, _ in plain_leaks(gone, items)} == {d for d, _ in gone}
    short = [(i, t) for i, t in after.items() if len(t) < 1500][:60]
    assert plain_leaks(short, items) == {}


def test_personal_data_is_masked(kept):
    before, after = texts(kept[3]), texts(kept[4])
    assert set(before) == set(after)
    for i, text in after.items():
        assert plain_find(text) == []
        assert plain_find(before[i]) or text == before[i]
    assert all(r.n_chars == len(r.text) for r in kept[4].collect())


def test_mix_meets_targets(kept):
    sizes, taken = {}, {}
    for r in kept[4].collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text))
    for r in kept[5].collect():
        assert 0 <= r.words <= len(WORD.findall(r.text))
        taken[r.source] = taken.get(r.source, 0) + r.words
    for s, goal in plain_targets(sizes).items():
        assert taken.get(s, 0) == pytest.approx(goal, abs=1)


def test_run_equals_stages(spark, kept):
    key = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert key(corpus_pipeline.run(spark, SMALL)) == key(kept[-1])


def test_empty_documents(spark, kept):
    docs = kept[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


#: Names that operators use inside, or add.
CLASHES = """key _key _row _nth row own copy words shard turn shards level expected_grade p_safe p_good keep n_email n_ip n_card
n_phone base_sha256 spans keeper component_id h1 h2 n_shingles root first least n size source_size target taken block place
stratum class_id known_id doc item_id edits grade label _carried slots""".split()


@pytest.mark.parametrize("stage", range(5))
def test_clashing_columns_come_back_untouched(spark, stage):
    """Every stage, given all of its own names as further columns, odd rows and repeated ones."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    twin = docs.limit(5)
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "web", 0), (10**9 + 1, "word " * 300_000, "en", None, 7)], docs.schema)
    wide = docs.unionAll(twin).unionAll(odd)
    for i, name in enumerate(CLASHES):
        wide = wide.withColumn(name, F.concat(F.lit(f"{i}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    out = corpus_pipeline.STAGES[stage][1](spark, wide, SMALL)
    assert out.columns[: len(wide.columns)] == wide.columns
    extra = out.columns[len(wide.columns) :]
    assert extra == ([f"mix_{c}" for c in ("copy", "words", "shard", "turn")] if stage == 4 else [])
    rows = out.collect()
    assert rows
    for r in rows[:50]:
        assert [r[c] for c in CLASHES] == [f"{i}:{'-' if r.doc_id is None else r.doc_id}" for i in range(len(CLASHES))]


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_an_empty_table(spark, stage):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    out = corpus_pipeline.STAGES[stage][1](spark, docs, SMALL)
    assert out.count() == 0 and out.columns[: len(docs.columns)] == docs.columns
