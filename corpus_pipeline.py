"""The corpus pipeline over ``documents``: quality, near duplicates, benchmark leaks, personal data, mixture.

Each stage works on all that its predecessor kept and returns the columns of ``documents``, whatever further ones there
are; the last returns the mix, one row for each copy that it takes. No stage can be expressed in SQL from end to end (learned classifier, hashed
search, seeded draws), so there is none; tests hold every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftgate.llm import decontaminate, jaccard, mixture, ordinal, pii
from driftgate.llm.columns import PACKED, aside
from driftgate.session import WorkArea, ship_package


def _given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled documents that are still there."""
    model = ordinal.train(docs, _given(spark, sf_dir, "labels"))
    own, restore = aside(docs, "text")
    return restore(ordinal.score(own, model).filter("keep"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    ship_package(spark)
    return jaccard.distinct_documents(docs, WorkArea(spark, "pipeline-jaccard"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, _given(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text."""
    ship_package(spark)
    own, restore = aside(docs, "text")
    size = {}
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        size["n_chars"] = F.coalesce(length, F.col(PACKED)["n_chars"])
    return restore(pii.annotate(own, masked=True), **size)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at target weights, copy by copy, dealt to shards."""
    return mixture.mix(spark, docs, WorkArea(spark, "pipeline-mix"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("mixing sources", mix),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each writes its result, which the next one reads."""
    area = WorkArea(spark, "pipeline")
    docs = _given(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = area.save(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
