"""Reviews, releases, schedules, streams, coverage and training support on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import assessments, comparables, health, latest, listings, planning, readback, scenarios, schedule, scoring, valuation
from ..sources.scratch import shared_dir, written
from ..streaming import jobs as streams
from ..streaming import leases
from .registry import dealt, query, table


@query("""WITH r AS (SELECT l_orderkey AS case_id, arg_max(l_linenumber, l_linenumber) AS n FROM lineitem WHERE l_linenumber > 3 GROUP BY 1)
SELECT o_orderkey AS case_id, CASE WHEN n % 2 = 0 THEN 'CONFIRMED' WHEN n IS NOT NULL THEN 'REJECTED' ELSE 'PENDING' END AS review_status, CASE WHEN n IS NOT NULL THEN 'note ' || n ELSE 'none' END AS notes
FROM orders LEFT JOIN r ON case_id = o_orderkey WHERE o_orderkey % 3 = 1 AND (n % 2 = 0 OR n IS NULL)""")
def gold_set_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled cases under their last review, as the gold set lists them."""
    k, n = F.col("o_orderkey"), F.col("l_linenumber")
    labels = table(spark, sf_dir, "orders").select(k.alias("case_id"), F.lit("PENDING").alias("review_status"), F.lit("none").alias("notes"), F.col("o_orderdate").cast("date").alias("valid_date"), F.lit(None).cast("date").alias("first_decision_date"), (k % 3).alias("template"))
    reviews = table(spark, sf_dir, "lineitem").where(n > 3).select(F.col("l_orderkey").alias("case_id"), n.alias("review_id"), n.alias("reviewed_at"), F.when(n % 2 == 0, "CONFIRMED").otherwise("REJECTED").alias("review_status"), F.concat(F.lit("note "), n.cast("string")).alias("notes"))
    now = readback.reviewed(labels, reviews)
    both = readback.gold_set(now, "CONFIRMED", 1).unionByName(readback.gold_set(now, "PENDING", 1))
    return both.select("case_id", "review_status", "notes")


@query("""SELECT o_orderkey AS scenario_id, o_orderkey % 4 = 0 OR o_orderkey % 5 <> o_custkey % 5 AS by_geometry, o_orderkey % 4 = 0 OR (o_custkey % 3 < 2 AND o_orderkey % 2 <> o_custkey % 3) AS by_rulepack FROM orders""")
def stale_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios whose site has another geometry now, or whose rulepack has another hash."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("scenario_id"), c.alias("site_id"), (k % 5).alias("geometry_hash"), (c % 3).alias("borough_id"), F.lit("t").alias("template"), (k % 2).alias("rulepack_hash"), (k % 4 == 0).alias("is_stale"))
    sites = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site_id"), (F.col("c_custkey") % 5).alias("geometry_hash"))
    packs = spark.createDataFrame([(0, "t", 0), (1, "t", 1)], "borough_id int, template string, rulepack_hash int")
    a = scenarios.stale_for_geometry(rows, sites).select("scenario_id", F.col("is_stale").alias("by_geometry"))
    return a.join(scenarios.stale_for_rulepacks(rows, packs).select("scenario_id", F.col("is_stale").alias("by_rulepack")), "scenario_id")


@query("""WITH s AS (SELECT o_orderkey AS id, o_custkey AS site, CASE o_orderkey % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'REJECTED' ELSE 'SUGGESTED' END AS status FROM orders)
SELECT id AS scenario_id, status, NOT coalesce(max(CASE WHEN status = 'CONFIRMED' THEN id END) OVER (PARTITION BY site) > id, false) AS is_current FROM s""")
def scenario_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios after their reviews; later confirmed revisions take an earlier one's place."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("scenario_id"), F.col("o_custkey").alias("site_id"), F.lit("t").alias("template"), k.alias("revision"), F.lit("SUGGESTED").alias("status"), F.lit(True).alias("is_current"))
    log = rows.where("scenario_id % 3 < 2").select("scenario_id", F.lit(2).alias("review_id"), F.lit(7).alias("reviewed_at"), F.when(F.col("scenario_id") % 3 == 0, "CONFIRMED").otherwise("REJECTED").alias("status"))
    earlier = log.withColumns({"review_id": F.lit(1), "status": F.lit("REJECTED")})
    return scenarios.superseded(scenarios.state_after(rows, log.unionByName(earlier))).select("scenario_id", "status", "is_current")


@query("""WITH l AS (SELECT o_custkey AS k, max(o_orderdate) AS last FROM orders GROUP BY 1) SELECT c_custkey AS source_id, CAST(last AS DATE) AS last_run FROM customer LEFT JOIN l ON k = c_custkey WHERE c_custkey % 4 < 3 AND c_custkey % 5 > 0 AND (last IS NULL OR CAST(last AS TIMESTAMP) + to_hours(c_custkey % 9 * 240) <= TIMESTAMP '1998-06-01')""")
def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose last job is older than their interval, or that never ran."""
    k = F.col("c_custkey")
    sources = table(spark, sf_dir, "customer").select(k.alias("source_id"), (k % 4 < 3).alias("is_active"), F.when(k % 5 > 0, "COMPLIANT_AUTOMATED").otherwise("MANUAL_ONLY").alias("mode"), (k % 9 * 240).alias("interval_hours"))
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    found = schedule.due_sources(sources, log, F.lit("1998-06-01").cast("timestamp"))
    return found.select("source_id", F.col("last_run_at").cast("date").alias("last_run"))


@query("""WITH j AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'DONE' ELSE 'FAILED' END AS status, o_orderkey % 100 AS due, o_orderkey % 60 AS locked, o_custkey % 50 AS k FROM orders),
c AS (SELECT id, 'claim' AS what FROM j WHERE (status = 'QUEUED' AND due <= 50) OR (status = 'RUNNING' AND 60 - locked > 30)), d AS (SELECT min(id) AS id, 'only' AS what FROM j WHERE status IN ('QUEUED', 'RUNNING') GROUP BY k),
f AS (SELECT id, CASE WHEN id % 5 < 3 THEN 'QUEUED' ELSE 'DEAD' END AS what FROM j WHERE status = 'FAILED') SELECT * FROM c UNION ALL SELECT * FROM d UNION ALL SELECT * FROM f""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that a worker would claim, jobs left of those with one key, and what becomes of failed ones."""
    k = F.col("o_orderkey")
    at = lambda minutes: F.timestamp_seconds(F.lit(900_000_000) + minutes * 60)
    rows = table(spark, sf_dir, "orders").select(
        k.alias("job_id"), F.lit("t").alias("job_type"), (F.col("o_custkey") % 50).alias("dedupe_key"), F.when(k % 4 == 0, "QUEUED").when(k % 4 == 1, "RUNNING").when(k % 4 == 2, "DONE").otherwise("FAILED").alias("status"),
        at(k % 100).alias("next_run_at"), at(k % 60).alias("locked_at"), at(k).alias("created_at"),
    )
    claim = schedule.claimable(rows.withColumn("next_run_at", F.when(F.col("status") == "QUEUED", F.col("next_run_at") + F.expr("interval 10 minutes"))), at(F.lit(60)))
    only = schedule.deduplicated(rows)
    failed = rows.where("status = 'FAILED'").select(F.col("job_id").alias("id"), schedule.after_failure(F.col("job_id") % 5, at(F.lit(0)))["status"].alias("what"))
    named = lambda df, what: df.select(F.col("job_id").alias("id"), F.lit(what).alias("what"))
    return named(claim, "claim").unionByName(named(only, "only")).unionByName(failed)


@query("""WITH j AS (SELECT s_suppkey AS id, s_suppkey % 6 AS k, s_suppkey % 50 AS due FROM supplier), r AS (SELECT * FROM (VALUES (0, 'SUCCEEDED', 1, 3, 2), (1, 'QUEUED', 1, 3, 2), (2, 'DEAD', 3, 7, 8), (3, 'QUEUED', 1, 3, 31), (4, 'SUCCEEDED', 2, 5, 41), (5, 'QUEUED', 0, 1, 0)) v(k, status, attempts, changes, minutes))
SELECT id AS job_id, status, attempts, changes::BIGINT AS changes, TIMESTAMP '2024-01-01' + to_minutes(due + minutes) AS last_at FROM j JOIN r USING (k)""")
def job_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as jobs whose events come as a stream of files in no order, with a restart: leases run out, failed jobs are tried again, the third failure is the last."""
    minute = lambda n: F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("job_id") % 50 + n) * 60)
    plans = [
        [(0, "ENQUEUED"), (1, "CLAIMED"), (2, "SUCCEEDED")], [(0, "ENQUEUED"), (1, "CLAIMED"), (2, "FAILED")], [(0, "ENQUEUED"), *((3 * i + j, e) for i in range(3) for j, e in ((1, "CLAIMED"), (2, "FAILED")))],
        [(0, "ENQUEUED"), (1, "CLAIMED")], [(0, "ENQUEUED"), (1, "CLAIMED"), (40, "CLAIMED"), (41, "SUCCEEDED")], [(0, "ENQUEUED"), (1, "FAILED")],
    ]
    jobs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("job_id"))
    each = [F.when(F.col("job_id") % 6 == k, F.array(*(F.struct(minute(F.lit(n)).alias("at"), F.lit(e).alias("event")) for n, e in plan))) for k, plan in enumerate(plans)]
    events = jobs.select("job_id", F.explode(F.coalesce(*each)).alias("e")).select("job_id", "e.at", "e.event")
    home = f"{shared_dir(spark)}/leases-{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64("job_id", "at"), F.lit(2))
    clock = events.agg(F.max("at").alias("at")).select(F.lit(-1).cast("long").alias("job_id"), (F.col("at") + F.expr("interval 3 days")).alias("at"), F.lit("ENQUEUED").alias("event"))
    with leases.store(spark):
        for arrival in (events.where(part == 0), events.where(part == 1), clock):
            arrival.write.mode("append").parquet(f"{home}/events")
            found = leases.changes(streams.read(spark, f"{home}/events", events.schema), late="1 day")
            streams.drain(found.writeStream.format("parquet").option("path", f"{home}/changes").option("checkpointLocation", f"{home}/state").outputMode("append"))
    done = spark.read.parquet(f"{home}/changes").where("job_id >= 0")
    last = F.max_by(F.struct("status", "attempts"), F.struct("at", "attempts")).alias("last")
    return done.groupBy("job_id").agg(last, F.count("*").alias("changes"), F.max("at").cast("timestamp_ntz").alias("last_at")).select("job_id", "last.status", "last.attempts", "changes", "last_at")


@query("""SELECT user_id, event_type, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS times_seen FROM events GROUP BY 1, 2""")
def streamed_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream of files until all are in: first and last sighting, whatever order they came in."""
    rows = written(table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).repartition(3, "user_id"), "arrivals")
    home = f"{rows.written_to}-sightings"
    seen = streams.last_seen(streams.read(spark, rows.written_to, rows.schema, files=1), ["user_id", "event_type"], "ts")
    # the last state of each key is in the last batch that touched it
    streams.drain(streams.once_per_batch(seen, lambda batch: None, f"{home}-state", home).outputMode("update"))
    found = spark.read.parquet(home)
    last = latest.latest_per_key(found, ["user_id", "event_type"], F.desc("batch_id"))
    return last.select("user_id", "event_type", F.col("first_seen_at").cast("timestamp_ntz"), F.col("last_seen_at").cast("timestamp_ntz"), "times_seen")


@query("""SELECT sha256('{"as_of":"' || strftime(d, '%Y-%m-%d') || '","scenario_id":' || s || ',"site_id":' || site || '}') AS idempotency_key, site AS site_id FROM (SELECT DISTINCT o_custkey AS site, o_custkey % 7 AS s, CAST(date_trunc('year', o_orderdate) AS DATE) AS d FROM orders) WHERE (site, s, d) NOT IN (SELECT o_custkey, o_custkey % 7, CAST(date_trunc('year', o_orderdate) AS DATE) FROM orders WHERE o_orderkey % 3 = 0)""")
def assessment_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of assessments that no held run answers yet, each once."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("site_id"), (F.col("o_custkey") % 7).alias("scenario_id"), F.trunc("o_orderdate", "year").alias("as_of"))
    held = assessments.run_keys(rows.where("o_orderkey % 3 = 0").drop("o_orderkey"))
    return assessments.new_runs(rows.drop("o_orderkey"), held).select("idempotency_key", "site_id")


@query("""SELECT o_custkey AS assessment_id, max(o_orderdate)::DATE AS created, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_id FROM orders GROUP BY 1""")
def latest_valuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("assessment_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("run_id"))
    return valuation.latest_run(rows).select("assessment_id", F.col("created_at").cast("date").alias("created"), "run_id")


@query("""SELECT 'extant' AS what, floor(CAST(count(*) FILTER (WHERE o_orderkey % 7 = 0) AS DOUBLE) / count(*) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS rate, count(*) AS n, NULL::BIGINT AS stale FROM orders
UNION ALL SELECT 'coverage', CAST(count(*) FILTER (WHERE s_suppkey % 3 = 0) AS DOUBLE), count(*), count(*) FILTER (WHERE s_suppkey % 4 = 0) FROM supplier""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of unresolved extant decisions; signed-off and stale baseline packs."""
    extant = health.success_rate(table(spark, sf_dir, "orders"), F.col("o_orderkey") % 7 == 0)
    k = F.col("s_suppkey")
    packs = health.coverage_summary(table(spark, sf_dir, "supplier").select(F.when(k % 3 == 0, "SIGNED_OFF").otherwise("DRAFT").alias("status"), F.when(k % 4 == 0, "STALE").otherwise("FRESH").alias("freshness_status")))
    first = extant.select(F.lit("extant").alias("what"), F.col("success_rate").alias("rate"), F.col("row_count").alias("n"), F.lit(None).cast("long").alias("stale"))
    return first.unionByName(packs.select(F.lit("coverage").alias("what"), F.col("signed_off").cast("double").alias("rate"), F.col("total").alias("n"), "stale"))


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS template, coalesce(CASE WHEN c_custkey % 4 > 0 THEN CAST(c_custkey % 4 AS VARCHAR) END, 'unknown') AS borough_id, count(*) AS case_count, max(n) AS positive_count, bool_or(ready) AS is_ready
FROM customer JOIN (SELECT c_nationkey AS t, count(*) FILTER (WHERE c_custkey % 3 = 0) AS n, count(*) >= 7 AND count(*) FILTER (WHERE c_custkey % 3 = 0) >= 3 AND count(*) FILTER (WHERE c_custkey % 3 <> 0) >= 3 AS ready FROM customer GROUP BY 1) ON t = c_nationkey GROUP BY 1, 2""")
def training_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows by template and borough, and which templates may be trained."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("template"), F.when(k % 4 > 0, (k % 4).cast("string")).alias("borough_id"), F.when(k % 3 == 0, 1).otherwise(0).alias("label"))
    ready = scoring.readiness(rows).select("template", "positive_count", "is_ready")
    return scoring.support_counts(rows).join(ready, "template")


@query("""SELECT o_orderkey AS id, (CASE WHEN o_orderkey % 3 = 0 THEN 2.0::DOUBLE ELSE (o_orderkey % 10) END - 2.0::DOUBLE) / 4.0::DOUBLE AS z, CASE WHEN o_orderkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS missing, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f, CASE WHEN o_orderkey % 5 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag FROM orders""")
def encoded_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as vectors: z-scores with medians filled in, missing flags, one-hot categories and flags."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 3 != 0, k % 10).alias("units"), F.col("o_orderstatus").alias("status"), F.when(k % 5 == 0, True).alias("flag"))
    vector, _ = scoring.encoded({"units": {"median": 2.0, "mean": 2.0, "std": 4.0, "any_missing": True}}, {"status": ["F", "O"]}, ["flag"])
    v = rows.select("id", vector.alias("v"))
    return v.select("id", *(F.get("v", F.lit(i)).alias(name) for i, name in ((0, "z"), (1, "missing"), (2, "f"), (4, "flag"))))


@query("""WITH s AS (SELECT c_custkey AS site, c_nationkey AS b FROM customer), c AS (SELECT s_suppkey AS id, s_nationkey AS b, DATE '1995-01-01' + CAST(s_suppkey % 900 AS INTEGER) AS d FROM supplier), j AS (SELECT site, id, row_number() OVER (PARTITION BY site ORDER BY 25.0::DOUBLE + 10.0::DOUBLE * exp(-date_diff('day', d, DATE '1999-01-01') / 365.25::DOUBLE / 6.0::DOUBLE) DESC, id) AS n FROM s JOIN c USING (b) WHERE NOT (site % 100 = 0 AND id % 2 = 0)) SELECT site AS site_id, id AS case_id, CAST(n AS INTEGER) AS rank FROM j WHERE n <= 3""")
def unlinked_comparables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparables of sites without the cases that are linked to the site itself."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    like = {"form": F.lit("f"), "units": F.lit(5), "area": F.lit(100.0), "archetype": F.lit("k"), "tokens": F.array(F.lit("x")), "template": F.lit("t")}
    own = table(spark, sf_dir, "customer").select(c.alias("site_id"), F.col("c_nationkey").cast("string").alias("borough_id"), F.lit("1999-01-01").cast("date").alias("as_of"), *(v.alias(n) for n, v in like.items()))
    cases = table(spark, sf_dir, "supplier").select(
        s.alias("case_id"), F.col("s_nationkey").cast("string").alias("borough_id"), F.date_add(F.lit("1995-01-01").cast("date"), (s % 900).cast("int")).alias("decision_date"), F.lit(None).cast("date").alias("valid_date"), F.lit("POSITIVE").alias("label_class"),
        F.lit(None).cast("string").alias("review_status"), *(v.alias(n) for n, v in (like | {"form": F.lit("g"), "archetype": F.lit("m")}).items()),
    )
    linked = own.where("site_id % 100 = 0").select("site_id", "borough_id").join(cases.where("case_id % 2 = 0").select("case_id", "borough_id"), "borough_id").drop("borough_id")
    return comparables.comparable_members(own, cases, linked).select("site_id", "case_id", "rank")


@query("""SELECT l_orderkey AS pack_id, l_linenumber % 3 AS template, max(l_linenumber) AS version FROM lineitem GROUP BY 1, 2""")
def rulepack_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rulepack of each pack and template."""
    packs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pack_id"), (F.col("l_linenumber") % 3).alias("template"), F.col("l_linenumber").alias("version"))
    return latest.latest_per_key(packs, ["pack_id", "template"], F.desc("version"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'held' END ELSE s_name END AS name, s_suppkey % 3 = 0 AND (s_suppkey % 2 = 1 OR s_name <> 'held') AS changed FROM supplier""")
def snapshot_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as their stored snapshot says, even where that says nothing, and the audit rows of what differs."""
    k = F.col("s_suppkey")
    live = table(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_name").alias("name"))
    held = live.where("id % 3 = 0").withColumn("name", F.when(F.col("id") % 2 == 0, "held"))
    now = readback.snapshot_first(live, held, "id", ["name"])
    logged = readback.changes(live, now, "id").select("id", F.lit(True).alias("changed"))
    return now.join(logged, "id", "left").fillna({"changed": False})


@query("""WITH r AS (SELECT s_nationkey AS scope, s_suppkey AS release, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS n FROM supplier) SELECT CAST(scope AS VARCHAR) AS scope, release AS release_id, release % 2 = 0 AS is_active FROM r WHERE n = 1""")
def release_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The release of each scope after its activations and retirements."""
    k = F.col("s_suppkey")
    log = table(spark, sf_dir, "supplier").select(F.lit("t").alias("template"), F.col("s_nationkey").cast("string").alias("scope"), k.alias("release_id"), F.when(k % 2 == 0, "ACTIVATE").otherwise("RETIRE").alias("action"), k.alias("changed_at"), k.alias("change_id"))
    return readback.release_states(log).select("scope", "release_id", "is_active")


@query("""SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN 'LOW' WHEN o_orderkey % 4 = 0 THEN 'MEDIUM' ELSE 'HIGH' END AS scenario_quality, CASE WHEN o_orderkey % 12 >= 10 AND o_orderkey % 5 >= 3 AND o_orderkey % 6 >= 4 THEN 'HIGH' WHEN o_orderkey % 12 >= 7 AND o_orderkey % 6 >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS support_quality FROM orders""")
def quality_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    scenario = scoring.scenario_quality(k % 3 == 0, F.lit("CONFIRMED"), k % 4 == 0)
    return table(spark, sf_dir, "orders").select(k.alias("run_id"), scenario.alias("scenario_quality"), scoring.support_quality(k % 12, k % 5, k % 6).alias("support_quality"))


@query("""SELECT event_id, user_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 40""")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most recent forty."""
    return latest.page(table(spark, sf_dir, "events"), 40, 0, F.desc("ts"), F.desc("event_id")).select("event_id", "user_id", "value")


@query("""SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 4 = 0 THEN 'GRANTED' ELSE 'NONE' END AS want, CASE WHEN p AND NOT o_orderkey % 5 = 0 THEN CASE WHEN w THEN 'POSITIVE' ELSE 'CENSORED' END WHEN p THEN 'EXCLUDED' ELSE 'CENSORED' END AS label_class
FROM (SELECT *, o_orderkey % 4 = 0 AS p, o_orderkey % 900 <= date_diff('day', CAST(o_orderdate AS DATE), (CAST(o_orderdate AS DATE) + INTERVAL 18 MONTH)::DATE) AS w FROM orders)""")
def label_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of single applications: decisions within eighteen months of validity, appeals left out."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    won = k % 4 == 0
    irrelevant = planning.irrelevance(F.when((k % 5 == 0) & won, "APPEAL").otherwise("FULL"), F.lit("FULL_RESIDENTIAL"), F.lit(None).cast("string"))
    decision = planning.normalized_decision(F.when(won, "Granted subject to conditions"), F.lit("pending"))
    label = planning.case_class(F.lit(False), irrelevant, F.lit("t"), decision, day, F.date_add(day, (k % 900).cast("int")), F.lit("pending"))
    return table(spark, sf_dir, "orders").select(k.alias("case_id"), F.when(won, "GRANTED").otherwise("NONE").alias("want"), label.alias("label_class"))


@query("""WITH t AS (SELECT s_suppkey AS k, s_name AS n FROM supplier) SELECT k AS id, CASE WHEN k % 4 = 0 THEN 'UNDER_OFFER' ELSE 'LIVE' END AS status, CASE WHEN k % 5 = 0 THEN 'LAND' WHEN k % 3 = 0 THEN 'REDEVELOPMENT_SITE' WHEN k % 2 = 0 THEN 'LAND' ELSE 'LAND_WITH_BUILDING' END AS listing_type,
  CASE WHEN k % 7 = 0 THEN '' ELSE k || ', ' END || 'High St, London' AS address, 'http://feed?x=1&disposal_id=' || k || '%2F7' AS url FROM t""")
def surplus_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A surplus register's rows as listings."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        k.alias("id"), F.concat(k.cast("string"), F.lit("/7")).alias("disposal_id"), F.when(k % 4 == 0, "Under Offer").otherwise("On sale").alias("sale_status"), F.when(k % 3 == 0, "Redevelopment plot").alias("property_name"), F.lit("").alias("contract_name"),
        F.when(k % 2 == 0, "Surplus land").otherwise("Office").alias("land_usage"), F.when(k % 5 == 0, "1.5").alias("land_area"), F.when(k % 5 == 0, "n/a").otherwise("200").alias("floor_area"), F.when(k % 7 == 0, " ").otherwise(k.cast("string")).alias("property_number"),
        F.lit("High St").alias("street"), F.lit("London").alias("town"), F.lit(None).cast("string").alias("postcode"),
    )
    return listings.surplus_listings(rows, "http://feed?x=1").select("id", "status", "listing_type", "address", "url")


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT k, least(5, count(*)) AS ups, min(n) AS lowest, least(8, 2 * count(*)) AS gaps, count(*) FILTER (WHERE n % 2 = 0) AS links FROM l GROUP BY 1)
SELECT k AS run_id, ups AS positive_count, 'f' || m AS strongest, 0 AS negative_count, gaps AS unknown_count, 'a' || lowest AS first_unknown, nullif(links, 0) AS link_count FROM p JOIN (SELECT k AS j, max(n) AS m FROM l GROUP BY 1) ON j = k""")
def explanation_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drivers, unknowns and evidence links of each run in one row, cut to what a reader is shown."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select(k.alias("run_id"), n.alias("n"))
    known = written(dealt(lines, ["run_id", "n"], lines.count()).distinct(), "lines")
    rows = dealt(known, ["run_id"], known.count())
    first = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("n")))
    up = rows.select("run_id", F.lit("positive").alias("direction"), first.alias("rank"), F.concat(F.lit("f"), F.col("n").cast("string")).alias("feature"), (F.col("n") / 10.0).alias("contribution")).where("rank <= 5 and contribution > 0")
    gaps = rows.select("run_id", F.explode(F.array(F.concat(F.lit("a"), F.col("n").cast("string")), F.concat(F.lit("b"), F.col("n").cast("string")))).alias("feature"))
    links = rows.select("run_id", F.col("n").alias("position"), F.lit("t").alias("topic"), F.lit("s").alias("source_label"), F.when(F.col("n") % 2 == 0, "http://x").alias("source_url"), F.lit(None).cast("string").alias("source_snapshot_id"), F.lit(None).cast("string").alias("raw_asset_id"))
    found = scoring.explanations(up, gaps, links, "run_id")
    size = lambda c: F.size(c).cast("long")
    return found.select("run_id", size("positive").alias("positive_count"), F.get("positive", F.lit(0))["feature"].alias("strongest"), F.size("negative").alias("negative_count"), size("unknowns").alias("unknown_count"), F.get("unknowns", F.lit(0)).alias("first_unknown"), F.when(F.col("evidence_links").isNotNull(), size("evidence_links")).alias("link_count"))


@query("""SELECT c_custkey AS site_id, c_nationkey = s_nationkey AS borough_match, CAST(s_suppkey % 9 - c_custkey % 7 AS BIGINT) AS units_delta, (s_suppkey % 11) * 1.5::DOUBLE - 4.0::DOUBLE AS site_area_delta_sqm, floor(date_diff('day', DATE '1995-01-01', DATE '1999-01-01') / 365.25::DOUBLE * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS years_since_decision FROM customer JOIN supplier ON s_suppkey = c_custkey % 90 + 1""")
def match_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sites and their comparables have in common, and how far apart they are."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier"), s == c % 90 + 1)
    own = F.struct(F.col("c_nationkey").alias("borough_id"), F.lit("f").alias("form"), (c % 7).alias("units"), F.lit(4.0).alias("area"))
    case = F.struct(F.col("s_nationkey").alias("borough_id"), F.lit("f").alias("form"), (s % 9).alias("units"), (s % 11 * 1.5).alias("area"), F.lit("1995-01-01").cast("date").alias("decision_date"), F.lit(None).cast("date").alias("valid_date"))
    found = comparables.match_details(both.select(c.alias("site_id"), own.alias("own"), case.alias("case"), F.lit("1999-01-01").cast("date").alias("as_of")))
    return found.select("site_id", "borough_match", "units_delta", "site_area_delta_sqm", "years_since_decision")
