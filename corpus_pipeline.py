"""A corpus cleaned and packed for training: toxicity, near-duplicates, repeated passages, mixing, packing.

Each stage takes a table of documents. All but the last return the columns of
documents; the last returns packed pieces. ``run`` writes each stage's rows to the
shared folder and reads them back for the next.

Defined cases of all stages: an empty table gives an empty one; extra columns of any
name are carried on (the last stage returns its own columns); null ids, sources and
languages are values like others. Null, empty and blank texts are never toxic, are
near-duplicates of nothing, hold no passage, and are not taken by the mix. Of
repeated rows and exact copies one stays, that of the smallest id; ties of the
mix's shuffle go by text hash and id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deedflow.llm import mixing, near_duplicates, packing, passages, toxicity
from deedflow.llm.common import materialise
from deedflow.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects (score 0.7 or more) go."""
    labels = toxicity.training_rows(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean_documents(docs, toxicity.fit(docs.select("doc_id", "text"), labels))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies stays."""
    return near_duplicates.one_of_each(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut."""
    return passages.without_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: documents taken once, twice or not at all."""
    return mixing.mixed_documents(docs, mixing.mix_sources(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("repeated passages", passage_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
