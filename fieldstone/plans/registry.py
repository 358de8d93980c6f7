"""Named queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
#: Rows of a task that holds all rows of its keys.
TASK_ROWS = 1 << 20
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt out to all cores: a small file of very many rows would be the work of one or two tasks."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def dealt(rows: DataFrame, keys: list[str], n_rows: int) -> DataFrame:
    """rows in tasks of about TASK_ROWS, those of a key together: what groups and orders them by the keys stays in these tasks, whose memory doesn't grow with the table.

    n_rows: how many rows there are, or an upper bound.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows // TASK_ROWS)), *keys)
