"""Control of outputs: visibility by role and scope, incidents, replay checks, the prediction ledger, evidence packs, audit exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from .latest import append_unseen, latest_per_key

ADMINS = ("ADMIN",)
#: Codes that only administrators are told.
INTERNAL = ("SCOPE_DISABLED", "INCIDENT_OPEN", "REPLAY_FAILED", "HASH_MISMATCH")


def scope_states(log: DataFrame) -> DataFrame:
    """The present state of each scope: the last row of the log."""
    return latest_per_key(log, ["scope"], F.desc("changed_at"), F.desc("change_id"))


def open_incidents(log: DataFrame) -> DataFrame:
    """scope and the number of its incidents that aren't resolved."""
    last = latest_per_key(log, ["incident_id"], F.desc("changed_at"), F.desc("change_id"))
    return last.where(F.col("status") != "RESOLVED").groupBy("scope").agg(F.count("*").alias("open_incidents"))


def visibility(runs: DataFrame, scopes: DataFrame, incidents: DataFrame, role: str, include_hidden: bool = False) -> DataFrame:
    """runs (run_id, scope, replay_status, hash_ok) with codes (in order), blocked and redacted for a viewer's role.

    A role that sees redacted output isn't blocked for that alone. Internal codes become OUTPUT_BLOCKED for all but administrators.
    """
    admin = role in ADMINS
    mode = scopes.select("scope", F.col("mode").alias("__mode"))
    joined = runs.join(mode, "scope", "left").join(incidents.select("scope", "open_incidents"), "scope", "left")
    hidden = F.coalesce(F.col("__mode"), F.lit("DISABLED")) == "HIDDEN_ONLY"
    codes = N.reasons(
        (F.coalesce(F.col("__mode"), F.lit("DISABLED")) == "DISABLED", "SCOPE_DISABLED"), (F.coalesce("open_incidents", F.lit(0)) > 0, "INCIDENT_OPEN"),
        (F.col("replay_status") == "FAILED", "REPLAY_FAILED"), (~F.coalesce("hash_ok", F.lit(True)), "HASH_MISMATCH"),
        (hidden & F.lit(not (admin and include_hidden)), "HIDDEN_MODE"), (F.lit(not admin), "ROLE_REDACTED"),
    )
    blocked = F.size(F.filter(codes, lambda c: c != "ROLE_REDACTED")) > 0
    told = codes if admin else F.array_distinct(F.transform(codes, lambda c: F.when(c.isin(*INTERNAL), "OUTPUT_BLOCKED").otherwise(c)))
    return joined.select(*runs.columns, told.alias("codes"), blocked.alias("blocked"), F.lit(not admin).alias("redacted"))


def redacted(rows: DataFrame, columns: list[str], when: Column) -> DataFrame:
    return rows.withColumns({c: F.when(~F.coalesce(when, F.lit(False)), F.col(c)) for c in columns})


def replay(ledger: DataFrame, runs: DataFrame, columns: list[str], score: str = "probability", tolerance: float = 1e-9) -> DataFrame:
    """run_id and REPLAY_OK, HASH_MISMATCH, SCORE_MISMATCH or MISSING: each ledger row against the run worked out anew."""
    now = runs.select("run_id", T.content_hash(runs, *columns).alias("now_hash"), F.col(score).alias("now_score"))
    joined = ledger.select("run_id", "payload_hash", F.col(score).alias("then_score")).join(now, "run_id", "left")
    status = N.first_that_holds(
        [
            (F.col("now_hash").isNull(), "MISSING"), (F.col("now_hash") != F.col("payload_hash"), "HASH_MISMATCH"),
            (~F.coalesce(F.abs(F.col("now_score") - F.col("then_score")) <= tolerance, F.col("now_score").isNull() & F.col("then_score").isNull()), "SCORE_MISMATCH"),
        ],
        "REPLAY_OK",
    )
    return joined.select("run_id", status.alias("replay_status"))


def ledger_rows(runs: DataFrame, columns: list[str], score: str = "probability") -> DataFrame:
    return runs.select("run_id", T.content_hash(runs, *columns).alias("payload_hash"), score)


def append_ledger(ledger: DataFrame, runs: DataFrame, columns: list[str]) -> DataFrame:
    return append_unseen(ledger_rows(runs, columns), ledger, "payload_hash")


def idempotency_key(requests: DataFrame, *parts: str) -> Column:
    return T.content_hash(requests, *parts)


def evidence(packs: list[DataFrame]) -> DataFrame:
    """Evidence rows (site_id, polarity, topic, claim, source, position) of several inputs, each claim once: the first that was given."""
    every = reduce(DataFrame.unionByName, [p.withColumn("pack", F.lit(i)) for i, p in enumerate(packs)])
    return latest_per_key(every, ["site_id", "polarity", "topic", "claim"], F.asc("pack"), F.asc("position"), F.asc("source")).drop("pack")


def evidence_packs(rows: DataFrame) -> DataFrame:
    """site_id with its claims by polarity as arrays, in order of topic and claim."""
    item = F.struct("topic", "claim", "source")
    pick = lambda polarity: F.array_sort(F.collect_list(F.when(F.col("polarity") == polarity, item)))
    return rows.groupBy("site_id").agg(pick("FOR").alias("in_favour"), pick("AGAINST").alias("against"), pick("UNKNOWN").alias("unknown"))


def audit_manifest(runs: DataFrame, columns: list[str], folder: str = "audit") -> DataFrame:
    """run_id, manifest, manifest_hash and path of each run's export."""
    out = runs.select("run_id", T.canonical_json(runs, *columns).alias("manifest")).withColumn("manifest_hash", F.sha2("manifest", 256))
    return out.withColumn("path", F.concat_ws("/", F.lit(folder), "run_id", F.concat("manifest_hash", F.lit(".json"))))
