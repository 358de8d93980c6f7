"""Sums over all rows before a row in a global order, without bringing the rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Up to so many rows one task orders them all.
FEW_ROWS = 20_000


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], n_rows: int) -> DataFrame:
    """df with a column for each of sums: its sum over the rows before (0 for the first); n_rows: how many rows df has.

    Many rows are put into ranges of the order; the sums of the ranges, one row each, give where every range begins. Rows that tie in the whole order
    stay in one range and are interchangeable.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if n_rows <= FEW_ROWS:
        w = before(Window.orderBy(*order))
        return df.select("*", *(F.coalesce(F.sum(x).over(w), F.lit(0)).alias(name) for name, x in sums.items()))
    ranged = written(df.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("range_no").agg(*(F.sum(x).alias(name) for name, x in sums.items()))
    w = before(Window.orderBy("range_no"))
    starts = totals.select("range_no", *(F.coalesce(F.sum(name).over(w), F.lit(0)).alias(f"start_{name}") for name in sums))
    w = before(Window.partitionBy("range_no").orderBy(*order))
    inside = ranged.select("*", *(F.coalesce(F.sum(x).over(w), F.lit(0)).alias(f"inside_{name}") for name, x in sums.items()))
    joined = inside.join(F.broadcast(starts), "range_no")  # a row for each shuffle partition
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), *((F.col(f"start_{name}") + F.col(f"inside_{name}")).alias(name) for name in sums))
