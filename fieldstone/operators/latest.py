"""Latest row per key, as-of and effective-dated joins, keyed upserts, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in this order; give an order without ties."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__n") == 1).drop("__n")


def top_per_key(rows: DataFrame, keys: list[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= n)


def effective_on(start: Column, end: Column, day: Column) -> Column:
    """Whether a day is in a closed interval; a missing bound is open."""
    return F.coalesce(start <= day, F.lit(True)) & F.coalesce(end >= day, F.lit(True))


def known_by(valid: Column, as_of: Column) -> Column:
    """Known at a day: a missing date counts as known."""
    return F.coalesce(valid <= as_of, F.lit(True))


def decided_by(decision: Column, as_of: Column) -> Column:
    """Decided at a day: a missing date counts as not decided."""
    return F.coalesce(decision <= as_of, F.lit(False))


def as_of_join(rows: DataFrame, facts: DataFrame, keys: list[str], at: str, since: str, values: list[str]) -> DataFrame:
    """rows with the values of the latest fact of their keys whose `since` is not after `at`; nulls where there is none.

    Facts and rows are merged in one ordered window per key, so the work grows with their number and not with their pairs.
    """
    kinds = [f.dataType.simpleString() for f in (facts.schema[v] for v in values)]
    left = rows.withColumn("__at", F.col(at)).withColumn("__side", F.lit(1)).withColumn("__fact", F.lit(None).cast(f"struct<{','.join(f'{v}:{k}' for v, k in zip(values, kinds, strict=True))}>"))
    right = facts.select(*keys, F.col(since).alias("__at"), F.lit(0).alias("__side"), F.struct(*values).alias("__fact"))
    order = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True).withColumn("__fact", F.last("__fact", ignorenulls=True).over(order))
    return both.where(F.col("__side") == 1).select(*rows.columns, *(F.col(f"__fact.{v}").alias(v) for v in values))


def as_of_lookup(rows: DataFrame, facts: DataFrame, keys: list[str], at: str, since: str, values: list[str]) -> DataFrame:
    """as_of_join() for short series of facts: each fact holds until the next, and rows meet those of their keys in an ordinary join.

    A key with very many rows can then be split between tasks, as no window needs its rows together.
    """
    spans = facts.withColumn("__until", F.lead(since).over(Window.partitionBy(*keys).orderBy(since)))
    spans = spans.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(since).alias("__since"), "__until", F.struct(*values).alias("__fact"))
    on = [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)]
    held = (F.col(at) >= F.col("__since")) & (F.col("__until").isNull() | (F.col(at) < F.col("__until")))
    return rows.join(spans, [*on, held], "left").select(*rows.columns, *(F.col(f"__fact.{v}").alias(v) for v in values))


def last_wins(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """A keyed upsert of imports in order: each key's row of the last import."""
    return latest_per_key(rows, keys, F.desc(sequence))


def append_unseen(new: DataFrame, held: DataFrame, hash_column: str) -> DataFrame:
    """held with the rows of new whose content hash it does not have, each once."""
    fresh = new.dropDuplicates([hash_column]).join(held.select(hash_column), hash_column, "left_anti")
    return held.unionByName(fresh.select(*held.columns))


def conflicts(new: DataFrame, held: DataFrame, path: str, hash_column: str) -> DataFrame:
    """Paths that would be overwritten with other bytes."""
    old = held.select(path, F.col(hash_column).alias("held_hash"))
    return new.select(path, hash_column).join(old, path).where(F.col(hash_column) != F.col("held_hash"))


def page(rows: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    """One page, with the number of all rows as total_rows."""
    total = rows.agg(F.count("*")).scalar()
    return rows.orderBy(*order).offset(offset).limit(limit).withColumn("total_rows", total)
