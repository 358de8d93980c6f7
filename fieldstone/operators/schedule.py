"""What a scheduler and its workers would pick up next, as queries over the job table; locking is left to whoever runs the jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import latest_per_key

MOST_ATTEMPTS = 3


def due_sources(sources: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Active automated sources (source_id, is_active, mode, interval_hours) whose last job is older than their interval, or that never ran."""
    last = jobs.groupBy("source_id").agg(F.max("created_at").alias("last_run_at"))
    joined = sources.where(F.col("is_active") & (F.col("mode") == "COMPLIANT_AUTOMATED")).join(last, "source_id", "left")
    next_at = F.timestamp_seconds(F.unix_timestamp("last_run_at") + F.col("interval_hours") * 3600)
    return joined.where(F.col("last_run_at").isNull() | (next_at <= now)).select("source_id", "last_run_at")


def claimable(jobs: DataFrame, now: Column, stale_minutes: int = 30) -> DataFrame:
    """Jobs to run, in order: queued ones that are due, and running ones whose lock has gone stale."""
    stale = F.unix_timestamp(now) - F.unix_timestamp("locked_at") > stale_minutes * 60
    ready = ((F.col("status") == "QUEUED") & (F.col("next_run_at") <= now)) | ((F.col("status") == "RUNNING") & F.coalesce(stale, F.lit(False)))
    return jobs.where(ready).orderBy(F.asc("next_run_at"), F.asc("created_at"), F.asc("job_id"))


def after_failure(attempts: Column, now: Column, delay_seconds: int = 60, most: int = MOST_ATTEMPTS) -> Column:
    """struct(status, next_run_at) of a job that failed: tried again after a delay, or dead after so many attempts."""
    again = attempts < most
    return F.struct(F.when(again, "QUEUED").otherwise("DEAD").alias("status"), F.when(again, F.timestamp_seconds(F.unix_timestamp(now) + delay_seconds)).alias("next_run_at"))


def deduplicated(jobs: DataFrame) -> DataFrame:
    """New jobs without those whose key is queued or running already; of equal new ones the first."""
    live = F.col("status").isin("QUEUED", "RUNNING")
    return latest_per_key(jobs.where(live), ["job_type", "dedupe_key"], F.asc("created_at"), F.asc("job_id"))
