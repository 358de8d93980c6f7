"""Data and model health: rates, histograms, review queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from . import scoring
from .latest import latest_per_key, top_per_key

FAILED = ("FAILED", "DEAD")


def rate(test: Column) -> Column:
    """Share of rows for which a test holds, to four places; null without rows."""
    return N.round_half_up(F.try_divide(F.count_if(F.coalesce(test, F.lit(False))).cast("double"), F.count("*").cast("double")), 4)


def failure_rates(jobs: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return jobs.where(F.col("job_type").isin(*kinds)).agg(rate(F.col("status").isin(*FAILED)).alias("failure_rate"), F.count("*").alias("job_count"))


def success_rate(rows: DataFrame, ok: Column) -> DataFrame:
    return rows.agg(rate(ok).alias("success_rate"), F.count("*").alias("row_count"))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.coalesce(column, F.lit("UNKNOWN")).alias(column)).agg(F.count("*").alias("row_count"))


def valuation_metrics(results: DataFrame) -> DataFrame:
    return results.agg(rate(F.col("uplift_mid").isNull()).alias("uplift_null_rate"), rate(F.col("basis_gbp").isNull()).alias("asking_price_missing_rate"), F.count("*").alias("result_count"))


def coverage_summary(packs: DataFrame) -> DataFrame:
    return packs.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "SIGNED_OFF").alias("signed_off"), F.count_if(F.col("freshness_status") == "STALE").alias("stale"))


def latest_coverage(coverage: DataFrame) -> DataFrame:
    return latest_per_key(coverage, ["borough_id", "source_family"], F.desc("captured_at"), F.desc("coverage_id"))


def model_metrics(results: DataFrame) -> DataFrame:
    """For each template: losses, and shares that abstain, are out of distribution or need review."""
    rates = results.groupBy("template").agg(rate(F.col("probability").isNull()).alias("abstain_rate"), rate(F.col("support_status") == "OUT_OF_DISTRIBUTION").alias("ood_rate"), rate(F.col("manual_review")).alias("manual_review_rate"))
    return rates.join(scoring.losses(results.where("probability is not null and label is not null"), ["template"]), "template", "left")


def band_agreement(results: DataFrame) -> DataFrame:
    """For each band: cases with an outcome, the share that agrees, and the share of reviewed ones that reviewers call false positives."""
    return results.where("label is not null").groupBy("band").agg(
        F.count("*").alias("case_count"), rate((F.col("probability") >= 0.5) == (F.col("label") == 1)).alias("agreement_rate"),
        N.round_half_up(F.try_divide(F.count_if(F.coalesce(F.col("review") == "FALSE_POSITIVE", F.lit(False))).cast("double"), F.count("review").cast("double")), 4).alias("false_positive_rate"),
    )


def review_queue(runs: DataFrame, limit: int = 50) -> DataFrame:
    """The most recent runs that need a person, with the reason; each reason keeps its first rows."""
    reason = N.first_that_holds([(F.col("manual_review"), "MANUAL_REVIEW"), (F.col("blocked"), "BLOCKED"), (F.col("status") == "FAILED", "FAILED")], None)
    return top_per_key(runs.withColumn("reason", reason).where("reason is not null"), ["reason"], limit, F.desc("created_at"), F.desc("run_id"))
