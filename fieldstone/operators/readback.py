"""Denormalised reads: a parent with its children as sorted arrays, snapshot-first columns, gold-set and release lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import latest_per_key


def nested(parents: DataFrame, children: DataFrame, key: str, name: str, columns: list[str]) -> DataFrame:
    """parents with an array of their children's columns, sorted by these columns in their order; empty without children."""
    listed = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    kind = listed.schema[name].dataType
    return parents.join(listed, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def snapshot_first(live: DataFrame, snapshots: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """live with the columns of the stored snapshot of its key where there is one; even where that says null."""
    held = snapshots.select(key, F.struct(*columns).alias("__held"))
    joined = live.join(held, key, "left")
    return joined.withColumns({c: F.when(F.col("__held").isNotNull(), F.col(f"__held.{c}")).otherwise(F.col(c)) for c in columns}).drop("__held")


def gold_set(labels: DataFrame, review_status: str | None = None, template: str | None = None) -> DataFrame:
    """Labelled cases in the order of review: by status, then the newest."""
    for column, value in (("review_status", review_status), ("template", template)):
        if value is not None:
            labels = labels.where(F.col(column) == value)
    return labels.orderBy(F.asc("review_status"), F.desc_nulls_last("valid_date"), F.desc_nulls_last("first_decision_date"), F.asc("case_id"))


def reviewed(labels: DataFrame, reviews: DataFrame) -> DataFrame:
    """labels with the status and notes of their last review."""
    last = latest_per_key(reviews, ["case_id"], F.desc("reviewed_at"), F.desc("review_id")).select("case_id", F.col("review_status").alias("__status"), F.col("notes").alias("__notes"))
    out = labels.join(last, "case_id", "left")
    return out.withColumn("review_status", F.coalesce("__status", "review_status")).withColumn("notes", F.coalesce("__notes", "notes")).drop("__status", "__notes")


def release_states(log: DataFrame) -> DataFrame:
    """The release that is active in each scope: of its last activation, unless that release was retired since."""
    last = latest_per_key(log, ["template", "scope"], F.desc("changed_at"), F.desc("change_id"))
    return last.select("template", "scope", "release_id", (F.col("action") == "ACTIVATE").alias("is_active"))


def allowed_override(kind: Column, role: Column) -> Column:
    """Whether a role may set an override: bases and reviews are for reviewers, suppression for administrators."""
    return F.when(kind == "RANKING_SUPPRESSION", role == "ADMIN").when(kind.isin("ACQUISITION_BASIS", "BARRIER", "REVIEW_DISPOSITION"), role.isin("REVIEWER", "ADMIN")).otherwise(False)


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, before and after as JSON of the rows that differ: an audit log of an update."""
    rest = [c for c in before.columns if c != key]
    whole = lambda df, name: df.select(key, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias(name))
    both = whole(before, "before").join(whole(after, "after"), key, "full")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))
