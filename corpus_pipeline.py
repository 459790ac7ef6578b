"""A training-corpus pipeline: toxicity, near-duplicates, secrets, mixing, tokens; each stage's output is written and read again.

Rows keep the columns of ``documents`` up to the last stage, which returns what its operator does for each document of
the mix (a document taken twice gives two rows).  Empty inputs give empty outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relspark.llm import bpe, mixing, neardup, secrets, toxicity
from relspark.llm._common import durable


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from the labels of ``sf_dir``."""
    return toxicity.clean_documents(docs, toxicity.train_from(spark, sf_dir))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8."""
    return neardup.one_of_each(docs, n=5, percent=80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay."""
    return secrets.redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's tokens and of what they decode to."""
    return bpe.round_trip(docs)


STAGES = [("toxicity", toxicity_stage), ("near-duplicates", neardup_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]
ORACLE_SQL = None  # SQL expresses neither the trained classifier nor the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
