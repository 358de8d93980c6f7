"""A training corpus from raw documents: language ID, near-dedup, decontamination, secret scan, source mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and hands the reread table on. All but the last return
the columns of documents. Nulls in any column are kept as they are: a null text has no letter and goes at the first stage; a row without doc_id is judged by
its text like any other, and of near duplicates it is kept only if no row of its class has an id. Extra columns go through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.llm import decontamination, language_id, secret_scan, simhash_dedup, source_mixing
from fieldstone.llm.common import table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those that no learned language fits."""
    predict = language_id.predictor(spark, language_id.fit(language_id.trained_part(docs)))
    return docs.where(~predict(F.col("text"))["rejected"])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, the one with the smallest doc_id."""
    return simhash_dedup.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of each secret; n_chars follows."""
    return secret_scan.redact(docs, secret_scan.ledger_of(spark, f"{sf_dir}/documents").update(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, with its epoch and the words taken."""
    return source_mixing.mixture(docs)


STAGES = [
    ("language_id", known_language),
    ("simhash_dedup", one_of_each),
    ("decontamination", no_benchmark),
    ("secret_scan", no_secrets),
    ("source_mixing", mixed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
