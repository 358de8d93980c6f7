"""Streams in place of a polled job table: jobs deduplicated within a time, first and last sightings, idempotent batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def read(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def deduplicated(jobs: DataFrame, at: str = "created_at", key: str = "dedupe_key", within: str = "1 hour") -> DataFrame:
    """The first job of each key within a time; later ones are dropped while its state is held."""
    return jobs.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def last_seen(seen: DataFrame, keys: list[str], at: str = "observed_at") -> DataFrame:
    """First and last sighting of each key, right in any order of arrival (update mode)."""
    return seen.groupBy(*keys).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"), F.count("*").alias("times_seen"))


def failures(jobs: DataFrame, at: str = "finished_at", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Failed and all jobs by window and type; windows close once the watermark has passed them."""
    failed = F.count_if(F.col("status").isin("FAILED", "DEAD"))
    out = jobs.withWatermark(at, late).groupBy(F.window(at, window), "job_type").agg(F.count("*").alias("job_count"), failed.alias("failed_count"))
    return out.select(F.col("window.start").alias("window_start"), "job_type", "job_count", "failed_count")


def once_per_batch(rows: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str, path: str) -> DataStreamWriter:
    """A writer that gives each batch to sink with its id, written under batch_id=..., so a replayed batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        sink(batch)
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def drain(writer: DataStreamWriter) -> StreamingQuery:
    """All that is there now, then stop: the scheduled form of a worker's loop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
