"""Gates, coverage, support, evidence, filters and site building on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import numeric as N
from ..operators import assessments, control, features, health, latest, listings, planning, readback, scenarios, scoring, sites
from .registry import query, table


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'SOURCE_INACTIVE' WHEN NOT CASE o_orderkey % 3 WHEN 0 THEN o_custkey % 4 IN (0, 1) WHEN 1 THEN o_custkey % 4 IN (2, 0) ELSE o_custkey % 4 = 1 END THEN 'MODE_NOT_ALLOWED' END AS reason FROM orders""")
def compliance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    job = F.when(key % 3 == 0, "MANUAL").when(key % 3 == 1, "CSV").otherwise("AUTOMATED")
    mode = F.element_at(F.array(*[F.lit(x) for x in ("MANUAL_ONLY", "COMPLIANT_AUTOMATED", "CSV_ONLY", "BLOCKED")]), (F.col("o_custkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", listings.compliance(job, mode, key % 6 != 0).alias("reason"))


@query("""WITH l AS (SELECT c_nationkey, CASE c_custkey % 3 WHEN 0 THEN 'BOROUGH_REGISTER' WHEN 1 THEN 'PRIOR_APPROVAL' ELSE 'BROWNFIELD' END AS family, c_custkey % 5 = 0 AS partial, c_custkey % 7 = 0 AS stale, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 3 ORDER BY floor(c_acctbal) DESC, c_custkey DESC) AS n FROM customer WHERE c_nationkey % 6 <> 5),
f AS (SELECT unnest(['BOROUGH_REGISTER', 'PRIOR_APPROVAL', 'BROWNFIELD']) AS family), j AS (SELECT s_suppkey, f.family, CASE WHEN l.family IS NULL OR partial THEN f.family || '_INCOMPLETE' END AS a, CASE WHEN coalesce(stale, false) THEN f.family || '_STALE' END AS b FROM supplier CROSS JOIN f LEFT JOIN l ON s_nationkey = c_nationkey AND l.family = f.family AND n = 1),
u AS (SELECT s_suppkey, a AS code FROM j UNION ALL SELECT s_suppkey, b FROM j) SELECT s_suppkey AS site_id, coalesce(string_agg(code, ',' ORDER BY code), '') AS codes FROM u GROUP BY 1""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sites, customers as coverage captures of their nation."""
    key = F.col("c_custkey")
    family = F.when(key % 3 == 0, "BOROUGH_REGISTER").when(key % 3 == 1, "PRIOR_APPROVAL").otherwise("BROWNFIELD")
    coverage = table(spark, sf_dir, "customer").where(F.col("c_nationkey") % 6 != 5).select(
        F.col("c_nationkey").alias("borough_id"), family.alias("source_family"), F.when(key % 5 == 0, "PARTIAL").otherwise("COMPLETE").alias("coverage_status"), F.when(key % 7 == 0, "STALE").otherwise("FRESH").alias("freshness_status"),
        F.floor("c_acctbal").alias("captured_at"), key.alias("coverage_id"),
    )
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site_id"), F.col("s_nationkey").alias("borough_id"))
    return planning.coverage_gaps(own, coverage).select("site_id", F.array_join("codes", ",").alias("codes"))


@query("""WITH c AS (SELECT o_orderkey, o_custkey % 100 AS site, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS template, CAST(floor(o_totalprice) AS BIGINT) % 500 + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 20 END + CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 10 END + CASE WHEN o_orderkey % 7 = 0 THEN 50 ELSE 0 END AS penalty, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderkey % 11 <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY site, template ORDER BY penalty, d, o_orderkey) AS n FROM c) SELECT site AS site_id, template, o_orderkey AS case_id, penalty FROM k WHERE n = 1""")
def nearest_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 100).alias("site_id"), F.when(key % 2 == 0, "a").otherwise("b").alias("template"), key.alias("case_id"), (F.floor("o_totalprice") % 500).alias("distance_m"), (key % 3 == 0).alias("units_in_range"),
        (key % 5 == 0).alias("same_route"), (key % 7 != 0).alias("residential"), F.when(key % 11 == 0, "PLD").otherwise("REGISTER").alias("source"), F.lit(None).cast("date").alias("decision_date"), F.col("o_orderdate").cast("date").alias("valid_date"),
    )
    return scenarios.nearest_support(rows).select("site_id", "template", "case_id", "penalty")


@query("""SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 4 = 0 THEN 'GEOMETRY_WEAK' END, CASE WHEN p_partkey % 5 = 0 THEN 'EXTANT_NOT_CLEAR' END, CASE WHEN p_partkey % 3 = 0 THEN 'SUPPORT_WEAK' END, CASE WHEN p_partkey % 7 = 0 THEN 'ROUTE_NOT_PREFERRED' END, CASE WHEN p_partkey % 9 = 0 THEN 'DATA_MISSING' END, CASE WHEN p_partkey % 2 = 0 THEN 'SOURCE_STALE' END) AS blockers FROM part""")
def auto_confirm_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    codes = F.when(key % 2 == 0, F.array(F.lit("BROWNFIELD_STALE"))).otherwise(F.array(F.lit("STALE_BROWNFIELD_ROW")))
    why = scenarios.blockers(F.when(key % 4 == 0, "LOW").otherwise("HIGH"), F.when(key % 5 == 0, "ABSTAIN").otherwise("PASS"), key % 3 != 0, key % 7 != 0, F.when(key % 9 == 0, 1).otherwise(0), codes)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(why, ",").alias("blockers"))


@query("""WITH e AS (SELECT user_id AS site_id, CASE event_id % 3 WHEN 0 THEN 'FOR' WHEN 1 THEN 'AGAINST' ELSE 'UNKNOWN' END AS polarity, event_type AS topic, 'claim ' || (event_id % 7) AS claim FROM events)
SELECT site_id, polarity, count(DISTINCT topic || '/' || claim) AS claim_count FROM e GROUP BY 1, 2""")
def evidence_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping packs of events as evidence: each claim once."""
    key = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("site_id"), F.when(key % 3 == 0, "FOR").when(key % 3 == 1, "AGAINST").otherwise("UNKNOWN").alias("polarity"), F.col("event_type").alias("topic"), F.concat(F.lit("claim "), (key % 7).cast("string")).alias("claim"), F.lit("events").alias("source"), key.alias("position"))
    packs = control.evidence([rows, rows.withColumn("source", F.lit("again"))])
    listed = control.evidence_packs(packs)
    sizes = [(name, column) for name, column in (("FOR", "in_favour"), ("AGAINST", "against"), ("UNKNOWN", "unknown"))]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("polarity"), F.size(c).cast("long").alias("claim_count")) for n, c in sizes])).alias("x")
    return listed.select("site_id", each).select("site_id", "x.*").where("claim_count > 0")


@query("""WITH s AS (SELECT c_custkey, CAST(c_custkey % 300 * 10 AS DOUBLE) AS x, CAST(c_custkey % 170 * 10 AS DOUBLE) AS y FROM customer), b AS (SELECT n_nationkey, n_nationkey % 5 * 500.0::DOUBLE + 0.5::DOUBLE AS x, n_nationkey // 5 * 300.0::DOUBLE + 0.5::DOUBLE AS y FROM nation WHERE n_nationkey IN (3, 7, 12))
SELECT c_custkey AS listing_id, CASE WHEN c_custkey % 10 = 0 THEN 'NO_COORDINATES' WHEN NOT EXISTS (SELECT 1 FROM b WHERE s.x > b.x AND s.x < b.x + 500 AND s.y > b.y AND s.y < b.y + 300) THEN 'OUTSIDE_AUTHORITIES' END AS reason FROM s""")
def authority_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as listings with points, three nations as required authorities."""
    key = F.col("c_custkey")
    spot = F.when(key % 10 != 0, G.point(key % 300 * 10, key % 170 * 10))
    rows = table(spark, sf_dir, "customer").select(key.alias("listing_id"), spot.alias("spot"))
    n = F.col("n_nationkey")
    x, y = n % 5 * 500.0 + 0.5, F.floor(n / 5) * 300.0 + 0.5
    lpas = table(spark, sf_dir, "nation").select(n.cast("string").alias("lpa_id"), G.box_shape(x, y, x + 500, y + 300).alias("shape"))
    return sites.within_authorities(rows, lpas, ["3", "7", "12"]).select("listing_id", "reason")


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type <> 'x' QUALIFY n = 1 AND event_id % 3 <> 0""")
def surplus_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' first events, if they pass the policy: one that doesn't still blocks later ones."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", "event_type", F.col("event_id").alias("position"))
    found = listings.surplus_rows(rows, F.col("event_type") != "x", F.col("event_id") % 3 != 0)
    return found.select("event_id", F.lit(1).cast("long").alias("n"))


@query("""SELECT o_custkey AS site_id, count(*) AS run_count, max(o_orderkey) AS last_run FROM orders GROUP BY 1""")
def site_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders nested and counted again."""
    parents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site_id"))
    children = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site_id"), F.col("o_orderkey").alias("run_id"), "o_orderstatus")
    found = readback.nested(parents, children, "site_id", "runs", ["run_id", "o_orderstatus"])
    return found.where(F.size("runs") > 0).select("site_id", F.size("runs").cast("long").alias("run_count"), F.element_at("runs", -1)["run_id"].alias("last_run"))


@query("""SELECT p_partkey AS site_id, CAST(p_size * 4 AS DOUBLE) AS perimeter, floor(CAST(p_size * p_size AS DOUBLE) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS area, CASE WHEN p_size > 0 THEN 0.785398::DOUBLE END AS compactness FROM part""")
def geometry_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, w = F.col("p_partkey"), F.col("p_size").cast("double")
    rows = table(spark, sf_dir, "part").select(key.alias("site_id"), G.box_shape(F.lit(0), F.lit(0), w, w).alias("shape"))
    return features.geometry_features(rows).select("site_id", F.col("site_perimeter_m").alias("perimeter"), F.col("site_area_sqm").alias("area"), F.col("site_compactness").alias("compactness"))


@query("""WITH m AS (SELECT l_orderkey AS site_id, CASE l_linenumber % 5 WHEN 0 THEN 'ARTICLE4' WHEN 1 THEN 'FLOOD_ZONE' WHEN 2 THEN 'POLICY_AREA' WHEN 3 THEN 'BROWNFIELD' ELSE 'LISTED_BUILDING' END AS family, l_linenumber, l_partkey FROM lineitem WHERE l_partkey % 4 <> 3)
SELECT site_id, string_agg(DISTINCT family, ',' ORDER BY family) AS families, bool_or(family = 'ARTICLE4') AS has_article4, bool_or(family = 'BROWNFIELD' AND l_partkey % 2 = 0) AS brownfield_part1, count(*) FILTER (WHERE family = 'POLICY_AREA') AS policy_area_count FROM m GROUP BY 1""")
def designation_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as designations of their order's site; a quarter have ended before the day."""
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    family = F.element_at(F.array(*[F.lit(x) for x in ("ARTICLE4", "FLOOD_ZONE", "POLICY_AREA", "BROWNFIELD", "LISTED_BUILDING")]), (n % 5 + 1).cast("int"))
    day = F.lit("2000-01-01").cast("date")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("site_id"), day.alias("as_of"), family.alias("family"), F.lit(None).cast("string").alias("subtype"), F.when((n % 5 == 3) & (p % 2 == 0), "PART_1").when(n % 5 == 3, "PART_2").alias("part"),
        F.lit(None).cast("string").alias("pip"), F.lit(None).cast("string").alias("tdc"), F.when(p % 4 == 0, day).alias("effective_from"), F.when(p % 4 == 3, F.date_sub(day, 1)).when(p % 4 == 2, day).alias("effective_to"),
    )
    return features.designation_profile(rows).select("site_id", F.array_join("families", ",").alias("families"), "has_article4", "brownfield_part1", "policy_area_count")


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN 'NO_ACTIVE_HIDDEN_RELEASE' WHEN o_orderkey % 9 = 0 THEN 'STORAGE_UNAVAILABLE' WHEN o_orderkey % 5 = 0 THEN 'BASELINE_PACK_NOT_SIGNED_OFF' WHEN o_orderkey % 7 = 0 THEN 'ABSTAIN' ELSE 'SCORED' END AS status, (o_custkey % 10 - 4.0::DOUBLE) / 3.0::DOUBLE AS a, (o_orderkey % 7 - 3.0::DOUBLE) / 2.0::DOUBLE AS b FROM orders),
z AS (SELECT *, CASE WHEN status = 'SCORED' THEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-(0.2::DOUBLE + 0.5::DOUBLE * a - 0.8::DOUBLE * b))) END AS raw FROM r),
c AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(0.1::DOUBLE + 0.9::DOUBLE * ln(raw / (1.0::DOUBLE - raw))))) AS p FROM z)
SELECT o_orderkey AS run_id, status AS execution_status, floor(p * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS probability, CASE WHEN o_orderkey % 12 < 7 THEN 'LOW' WHEN o_orderkey % 4 = 0 OR o_orderkey % 12 < 10 THEN 'MEDIUM' ELSE 'HIGH' END AS estimate_quality FROM c""")
def frozen_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as frozen snapshots of two features under one model."""
    key = F.col("o_orderkey")
    status = scoring.execution_status(key % 8 != 0, key % 9 != 0, F.when(key % 7 == 0, "ABSTAIN").otherwise("PASS"), F.when(key % 5 == 0, "DRAFT").otherwise("SIGNED_OFF"))
    rows = table(spark, sf_dir, "orders").select(
        key.alias("run_id"), F.lit("t").alias("template"), F.array((F.col("o_custkey") % 10 - 4.0) / 3.0, (key % 7 - 3.0) / 2.0).alias("vector"), F.lit(1.0).alias("nearest_distance"), (key % 12).cast("int").alias("template_support"), F.lit(3).alias("borough_support"), F.lit(4).alias("comparables"),
        F.when(key % 4 == 0, "MEDIUM").otherwise("HIGH").alias("coverage_quality"), F.lit("HIGH").alias("geometry_quality"), F.lit("HIGH").alias("scenario_quality"), F.lit(False).alias("site_review"), F.lit(False).alias("scenario_review"), status.alias("execution_status"),
    )
    models = spark.createDataFrame([("t", [0.2, 0.5, -0.8], [0.1, 0.9])], "template string, weights array<double>, platt array<double>")
    return assessments.scored(rows, models).select("run_id", "execution_status", N.round_half_up(F.col("probability"), 6).alias("probability"), "estimate_quality")


@query("""SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'MANUAL_REVIEW' WHEN o_orderkey % 7 = 0 THEN 'BLOCKED' WHEN o_orderstatus = 'P' THEN 'FAILED' END AS reason, o_orderkey AS run_id, row_number() OVER (PARTITION BY reason ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE reason IS NOT NULL QUALIFY n <= 20""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(key.alias("run_id"), (key % 5 == 0).alias("manual_review"), (key % 7 == 0).alias("blocked"), F.when(F.col("o_orderstatus") == "P", "FAILED").otherwise("DONE").alias("status"), F.col("o_orderdate").alias("created_at"))
    return health.review_queue(rows, 20).select("reason", "run_id", F.col("rank").cast("long").alias("n"))


@query("""WITH f AS (SELECT s_suppkey, 1000 + s_suppkey AS v FROM supplier), j AS (SELECT c_custkey, max(s_suppkey) AS k FROM customer JOIN supplier ON s_nationkey = c_nationkey AND s_suppkey <= c_custkey GROUP BY 1) SELECT c.c_custkey, 1000 + k AS value FROM customer c LEFT JOIN j USING (c_custkey)""")
def as_of_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as facts of their nation in order of key, customers as the points at which the last fact is asked for."""
    facts = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("since"), (F.col("s_suppkey") + 1000).alias("value"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("at"))
    return latest.as_of_join(rows, facts, ["nation"], "at", "since", ["value"]).select("c_custkey", "value")
