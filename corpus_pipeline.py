"""The corpus pipeline: documents pass toxicity, language, near-duplicate and secret stages and are packed into windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailloom.llm import langid, packing, secretscan, simhash, store, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the table of labels, doesn't call toxic."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in one of the languages of the documents."""
    return langid.reject_unknown(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.drop_near_duplicates(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the literals that are assigned to sensitive names replaced."""
    return secretscan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in windows of related documents."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.

    Each stage's result is a table in the shared folder, which the next one reads; when it is written, the table that it was made from and
    all that the stage wrote on the way are removed.
    """
    docs, source = None, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with store.scratch(spark) as paths:
            now = store.written(stage(spark, source if docs is None else docs, sf_dir), f"pipeline-{name}")
            paths.pop()
        if docs is not None:
            store.remove(docs)
        docs = now
    return docs
