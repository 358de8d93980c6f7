"""Opportunities, overrides, visibility and health on the driver's tables: customers stand for sites, orders for assessment runs, nations for boroughs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import control, health, latest, listings, ranking, scoring
from .registry import query, table

TODAY = "1998-06-01"
PAGE = 500


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.count("*").alias("support_count"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    p = F.col("o_orderkey") % 101 / 100.0
    quality = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "HIGH").when(F.col("o_orderpriority") == "3-MEDIUM", "MEDIUM").otherwise("LOW")
    uplift = (F.coalesce("cents", F.lit(0)) - F.round(F.col("o_totalprice") * 100).cast("long")).cast("double")
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("site_id"), F.when(F.col("o_orderstatus") == "F", "READY").otherwise("OPEN").alias("state"), F.col("o_orderdate").cast("date").alias("as_of_date"),
        F.when(F.col("o_orderkey") % 11 == 0, "ABSTAIN").otherwise("PASS").alias("eligibility"), F.when(F.col("o_orderkey") % 13 != 0, p).alias("probability"), quality.alias("quality"), (F.col("o_orderkey") % 7 == 0).alias("manual_review"),
        F.when(F.col("o_orderkey") % 5 == 0, None).when(F.col("o_orderkey") % 3 == 0, "LOW").when(F.col("o_orderkey") % 3 == 1, "MEDIUM").otherwise("HIGH").alias("valuation_quality"),
        F.floor(p * uplift / 100.0).cast("double").alias("expected_uplift"), F.coalesce("support_count", F.lit(0)).alias("support_count"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    auction = F.when(F.col("c_custkey") % 3 == 0, F.date_add(F.lit("1998-01-01").cast("date"), (F.col("c_custkey") % 400).cast("int")))
    return c.select(F.col("c_custkey").alias("site_id"), F.col("c_name").alias("display_name"), F.col("n_name").alias("borough"), F.when(F.col("c_acctbal") >= 0, F.floor("c_acctbal").cast("long")).alias("price_gbp"), auction.alias("auction_date"))


RUNS_SQL = """
runs AS (
  SELECT o_orderkey AS run_id, o_custkey AS site_id, CASE WHEN o_orderstatus = 'F' THEN 'READY' ELSE 'OPEN' END AS state, CAST(o_orderdate AS DATE) AS as_of_date,
    CASE WHEN o_orderkey % 11 = 0 THEN 'ABSTAIN' ELSE 'PASS' END AS eligibility, CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 101) / 100.0::DOUBLE END AS probability,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HIGH' WHEN o_orderpriority = '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS quality, o_orderkey % 7 = 0 AS manual_review,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'LOW' WHEN o_orderkey % 3 = 1 THEN 'MEDIUM' ELSE 'HIGH' END AS valuation_quality,
    floor((o_orderkey % 101) / 100.0::DOUBLE * CAST(coalesce(cents, 0) - CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE) / 100.0::DOUBLE) + 0.0::DOUBLE AS expected_uplift, coalesce(support_count, 0) AS support_count
  FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS support_count FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
sites AS (
  SELECT c_custkey AS site_id, c_name AS display_name, n_name AS borough, CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS price_gbp,
    CASE WHEN c_custkey % 3 = 0 THEN DATE '1998-01-01' + CAST(c_custkey % 400 AS INTEGER) END AS auction_date
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY as_of_date DESC, run_id DESC) AS n FROM runs WHERE state = 'READY') WHERE n = 1),
opportunities AS (
  SELECT s.*, r.run_id, r.eligibility, r.probability, r.quality, r.manual_review, r.valuation_quality, r.expected_uplift, r.support_count,
    CASE WHEN r.run_id IS NULL OR r.eligibility <> 'PASS' OR r.probability IS NULL THEN 'Hold' WHEN r.probability >= 0.7::DOUBLE AND r.quality <> 'LOW' AND NOT r.manual_review THEN 'Band A'
      WHEN r.manual_review OR (r.probability >= 0.55::DOUBLE AND r.probability < 0.7::DOUBLE) THEN 'Band B' WHEN r.probability >= 0.4::DOUBLE AND r.probability < 0.55::DOUBLE THEN 'Band C' ELSE 'Band D' END AS band,
    CASE WHEN r.run_id IS NULL THEN 'NO_READY_ASSESSMENT' WHEN r.eligibility <> 'PASS' THEN 'ELIGIBILITY_' || r.eligibility WHEN r.probability IS NULL THEN 'NO_SCORE' END AS hold_reason
  FROM sites s LEFT JOIN latest r USING (site_id))"""


@query(f"""WITH {RUNS_SQL}, ordered AS (
  SELECT *, row_number() OVER (ORDER BY CASE band WHEN 'Band A' THEN 1 WHEN 'Band B' THEN 2 WHEN 'Band C' THEN 3 WHEN 'Band D' THEN 4 ELSE 5 END, coalesce(expected_uplift, 0) DESC,
    CASE valuation_quality WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END DESC, coalesce(date_diff('day', DATE '{TODAY}', auction_date), 10000), CASE WHEN price_gbp IS NULL THEN 1 ELSE 0 END,
    coalesce(support_count, 0) DESC, lower(display_name), site_id) AS place FROM opportunities)
SELECT CAST(place AS INTEGER) AS place, site_id, display_name, borough, band, hold_reason, probability, expected_uplift, valuation_quality, support_count FROM ordered WHERE place <= {PAGE}""")
def opportunity_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of opportunities in planning-first order."""
    today = F.lit(TODAY).cast("date")
    found = ranking.ranked(ranking.opportunities(sites(spark, sf_dir), runs(spark, sf_dir)), today, PAGE)
    placed = found.withColumn("place", F.row_number().over(Window.orderBy(*ranking.ranking_order(today))))
    return placed.select("place", "site_id", "display_name", "borough", "band", "hold_reason", "probability", "expected_uplift", "valuation_quality", "support_count")


@query(f"""WITH {RUNS_SQL} SELECT site_id, band, valuation_quality, price_gbp, auction_date FROM opportunities
WHERE band = 'Band B' AND manual_review AND price_gbp BETWEEN 1000 AND 9000""")
def opportunity_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.opportunities(sites(spark, sf_dir), runs(spark, sf_dir))
    kept = ranking.filters(found, F.lit(TODAY).cast("date"), band_name="Band B", manual_review=True, min_price=1000, max_price=9000)
    return kept.select("site_id", "band", "valuation_quality", "price_gbp", "auction_date")


@query(f"""WITH {RUNS_SQL} SELECT site_id, band, auction_date FROM opportunities WHERE date_diff('day', DATE '{TODAY}', auction_date) BETWEEN 0 AND 60""")
def opportunity_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.opportunities(sites(spark, sf_dir), runs(spark, sf_dir))
    return ranking.filters(found, F.lit(TODAY).cast("date"), deadline_days=60).select("site_id", "band", "auction_date")


@query(f"WITH {RUNS_SQL} SELECT site_id, run_id, as_of_date FROM latest")
def latest_run_per_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ready_runs(runs(spark, sf_dir)).select("site_id", "run_id", "as_of_date")


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_event_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.latest_per_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


@query(f"""WITH {RUNS_SQL} SELECT count(*) AS unassessed_count, min(site_id) AS first_site FROM sites WHERE site_id NOT IN (SELECT site_id FROM runs WHERE state = 'READY')""")
def unassessed_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = sites(spark, sf_dir).join(ranking.ready_runs(runs(spark, sf_dir)), "site_id", "left_anti")
    return rest.agg(F.count("*").alias("unassessed_count"), F.min("site_id").alias("first_site"))


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of overrides: users are runs."""
    kind = F.when(F.col("event_id") % 3 == 0, "ACQUISITION_BASIS").when(F.col("event_id") % 3 == 1, "REVIEW_DISPOSITION").otherwise("RANKING_SUPPRESSION")
    value = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 1000 * 10).cast("double")).otherwise((F.col("event_id") % 2).cast("double"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("override_id"), F.col("user_id").alias("run_id"), kind.alias("override_type"), value.alias("value"), F.when(F.col("event_id") % 4 == 0, "RESOLVED").otherwise("ACTIVE").alias("status"), F.col("ts").alias("created_at"))


@query("""WITH o AS (SELECT event_id, user_id, ts, CASE event_id % 3 WHEN 0 THEN 'ACQUISITION_BASIS' WHEN 1 THEN 'REVIEW_DISPOSITION' ELSE 'RANKING_SUPPRESSION' END AS kind,
  CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 1000 * 10 AS DOUBLE) ELSE CAST(event_id % 2 AS DOUBLE) END AS value FROM events WHERE event_id % 4 <> 0),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY ts DESC, event_id DESC) AS n FROM o) WHERE n = 1),
w AS (SELECT user_id, max(CASE WHEN kind = 'ACQUISITION_BASIS' THEN value END) AS basis, max(CASE WHEN kind = 'REVIEW_DISPOSITION' THEN value END) AS review, max(CASE WHEN kind = 'RANKING_SUPPRESSION' THEN value END) AS off FROM l GROUP BY 1)
SELECT c_custkey AS run_id, coalesce(basis, 500.0::DOUBLE) AS effective_basis_gbp, CAST(c_custkey * 10 AS DOUBLE) - coalesce(basis, 500.0::DOUBLE) AS effective_uplift,
  CASE WHEN review IS NOT NULL THEN review > 0 ELSE c_custkey % 2 = 0 END AS effective_manual_review, coalesce(off > 0, false) AS ranking_suppressed FROM customer LEFT JOIN w ON user_id = c_custkey""")
def override_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), (F.col("c_custkey") * 10).cast("double").alias("land_mid"), F.lit(500.0).alias("basis_gbp"), F.lit(0.5).alias("probability"), (F.col("c_custkey") % 2 == 0).alias("manual_review"))
    return ranking.with_overrides(own, overrides(spark, sf_dir)).select("run_id", "effective_basis_gbp", "effective_uplift", "effective_manual_review", "ranking_suppressed")


@query("""WITH r AS (SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN 'DISABLED' WHEN 1 THEN 'HIDDEN_ONLY' ELSE 'VISIBLE' END AS mode, o_custkey % 25 AS scope, o_orderkey % 17 = 0 AS failed, o_orderkey % 19 <> 0 AS hash_ok FROM orders),
m AS (SELECT n_nationkey AS scope, CASE n_nationkey % 4 WHEN 0 THEN 'DISABLED' WHEN 1 THEN 'HIDDEN_ONLY' ELSE 'VISIBLE' END AS mode, n_nationkey % 5 = 2 AS incident FROM nation),
j AS (SELECT o_orderkey, m.mode, incident, failed, hash_ok FROM r JOIN m USING (scope))
SELECT o_orderkey AS run_id, concat_ws(',', CASE WHEN mode = 'DISABLED' OR incident OR failed OR NOT hash_ok THEN 'OUTPUT_BLOCKED' END, CASE WHEN mode = 'HIDDEN_ONLY' THEN 'HIDDEN_MODE' END, 'ROLE_REDACTED') AS codes,
  mode <> 'VISIBLE' OR incident OR failed OR NOT hash_ok AS blocked FROM j""")
def visibility_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 25).cast("int").alias("scope"), F.when(F.col("o_orderkey") % 17 == 0, "FAILED").otherwise("OK").alias("replay_status"), (F.col("o_orderkey") % 19 != 0).alias("hash_ok"))
    key = F.col("n_nationkey")
    scopes = table(spark, sf_dir, "nation").select(key.alias("scope"), F.when(key % 4 == 0, "DISABLED").when(key % 4 == 1, "HIDDEN_ONLY").otherwise("VISIBLE").alias("mode"))
    incidents = table(spark, sf_dir, "nation").where(key % 5 == 2).select(key.alias("scope"), F.lit(1).alias("open_incidents"))
    return control.visibility(own, scopes, incidents, "ANALYST").select("run_id", F.array_join("codes", ",").alias("codes"), "blocked")


@query("""WITH g AS (SELECT o_orderkey, o_orderkey % 9 = 0 AS changed, o_orderkey % 10 = 0 AS gone, o_orderkey % 6 = 0 AS other FROM orders)
SELECT CASE WHEN gone THEN 'MISSING' WHEN changed THEN 'HASH_MISMATCH' WHEN other THEN 'SCORE_MISMATCH' ELSE 'REPLAY_OK' END AS replay_status, count(*) AS run_count FROM g GROUP BY 1""")
def replay_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger against runs of which some changed, some are gone and some score otherwise."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    then = o.select(key.alias("run_id"), "o_custkey", "o_orderstatus", (key % 101 / 100.0).alias("probability"))
    now = o.where(key % 10 != 0).select(key.alias("run_id"), F.when(key % 9 == 0, -1).otherwise(F.col("o_custkey")).alias("o_custkey"), "o_orderstatus", F.when(key % 6 == 0, 2.0).otherwise(key % 101 / 100.0).alias("probability"))
    columns = ["run_id", "o_custkey", "o_orderstatus"]
    return control.replay(control.ledger_rows(then, columns), now, columns).groupBy("replay_status").agg(F.count("*").alias("run_count"))


@query("""SELECT floor(CAST(count(*) FILTER (WHERE event_id % 7 IN (0, 1)) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS failure_rate, count(*) AS job_count FROM events WHERE event_type IN ('click', 'view', 'purchase')""")
def failure_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_id") % 7 == 0, "FAILED").when(F.col("event_id") % 7 == 1, "DEAD").otherwise("SUCCEEDED")
    return health.failure_rates(table(spark, sf_dir, "events").select(F.col("event_type").alias("job_type"), status.alias("status")), ("click", "view", "purchase"))


@query("""SELECT floor(CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / CAST(count(*) AS DOUBLE) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS success_rate, count(*) AS row_count FROM orders""")
def parse_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.success_rate(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F")


@query("SELECT o_orderpriority, count(*) AS row_count FROM orders GROUP BY 1")
def quality_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.distribution(table(spark, sf_dir, "orders"), "o_orderpriority")


@query(f"""WITH {RUNS_SQL}, x AS (SELECT *, CASE WHEN run_id % 2 = 0 THEN 1 ELSE 0 END AS label FROM runs),
r AS (SELECT quality AS template, floor(CAST(count(*) FILTER (WHERE probability IS NULL) AS DOUBLE) / count(*) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS abstain_rate,
  floor(CAST(count(*) FILTER (WHERE support_count > 5) AS DOUBLE) / count(*) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS ood_rate,
  floor(CAST(count(*) FILTER (WHERE manual_review) AS DOUBLE) / count(*) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS manual_review_rate FROM x GROUP BY 1),
l AS (SELECT quality AS template, floor(avg(power(probability - label, 2)) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS brier,
  floor(avg(-ln(CASE WHEN label = 1 THEN greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, probability)) ELSE 1 - greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, probability)) END)) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS log_loss,
  count(*) AS case_count FROM x WHERE probability IS NOT NULL GROUP BY 1)
SELECT * FROM r LEFT JOIN l USING (template)""")
def model_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).withColumn("label", F.when(F.col("run_id") % 2 == 0, 1).otherwise(0))
    return health.model_metrics(r.select(F.col("quality").alias("template"), "probability", "label", "manual_review", F.when(F.col("support_count") > 5, "OUT_OF_DISTRIBUTION").otherwise("IN_SUPPORT").alias("support_status")))


@query(f"""WITH {RUNS_SQL} SELECT floor(CAST(count(*) FILTER (WHERE expected_uplift < 0) AS DOUBLE) / count(*) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS uplift_null_rate,
  floor(CAST(count(*) FILTER (WHERE price_gbp IS NULL) AS DOUBLE) / count(*) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS asking_price_missing_rate, count(*) AS result_count FROM runs JOIN sites USING (site_id)""")
def valuation_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = runs(spark, sf_dir).join(sites(spark, sf_dir), "site_id")
    return health.valuation_metrics(both.select(F.when(F.col("expected_uplift") >= 0, F.col("expected_uplift")).alias("uplift_mid"), F.col("price_gbp").alias("basis_gbp")))


@query("""WITH x AS (SELECT doc_id, toxic, (doc_id % 101) / 100.0::DOUBLE AS p FROM labels)
SELECT CAST(round_even(p * 100 / 5, 0) * 5 AS INTEGER) AS band, count(*) AS case_count, floor(avg(p) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS mean_probability, floor(avg(toxic) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS observed_rate FROM x GROUP BY 1""")
def calibration_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") % 101 / 100.0).alias("probability"), F.col("toxic").alias("label"))
    found = scoring.calibration(rows)
    return found.withColumns({c: N.round_half_up(F.col(c), 6) for c in ("mean_probability", "observed_rate")})


@query("""WITH x AS (SELECT toxic AS y, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, (doc_id % 101) / 100.0::DOUBLE)) AS q, (doc_id % 101) / 100.0::DOUBLE AS p FROM labels)
SELECT floor(avg(power(p - y, 2)) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS brier, floor(avg(-ln(CASE WHEN y = 1 THEN q ELSE 1 - q END)) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS log_loss, count(*) AS case_count FROM x""")
def brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.losses(table(spark, sf_dir, "labels").select((F.col("doc_id") % 101 / 100.0).alias("probability"), F.col("toxic").alias("label")))


@query("""WITH s AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT min(o_totalprice) AS percentile FROM s WHERE i = CAST(round_even((n - 1) * 0.9::DOUBLE, 0) AS BIGINT)""")
def nearest_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.nearest_rank(table(spark, sf_dir, "orders"), "o_totalprice", 0.9)


@query("""WITH b AS (SELECT CASE WHEN p.o_orderkey % 11 = 0 THEN NULL ELSE p.o_orderkey % 4 + 1 END AS units, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 9 AS DOUBLE) END AS distance, CAST(o_orderkey % 12 AS INTEGER) AS support, CAST(o_custkey % 4 AS INTEGER) AS own, o_orderkey FROM orders p)
SELECT CASE WHEN support < 7 THEN 'OUT_OF_DISTRIBUTION' WHEN own <= 0 THEN 'EDGE_OF_SUPPORT' WHEN distance IS NULL THEN 'EDGE_OF_SUPPORT' WHEN distance > 3.0::DOUBLE THEN 'OUT_OF_DISTRIBUTION' WHEN distance > 1.8::DOUBLE THEN 'EDGE_OF_SUPPORT' ELSE 'IN_SUPPORT' END AS support_status,
CASE WHEN support >= 10 AND own >= 3 AND support % 6 >= 4 THEN 'HIGH' WHEN support >= 7 AND support % 6 >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS support_quality, count(*) AS run_count FROM b GROUP BY 1, 2""")
def support_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    support, own = (key % 12).cast("int"), (F.col("o_custkey") % 4).cast("int")
    status = scoring.support_status(F.when(key % 3 != 0, (key % 9).cast("double")), support, own)
    quality = scoring.support_quality(support, own, support % 6)
    return table(spark, sf_dir, "orders").groupBy(status.alias("support_status"), quality.alias("support_quality")).agg(F.count("*").alias("run_count"))


@query("""WITH p AS (SELECT p_partkey, (p_size - 25.0::DOUBLE) / 10.0::DOUBLE * 0.8::DOUBLE + CASE WHEN p_brand = 'Brand#1' THEN 0.0::DOUBLE ELSE 0.0::DOUBLE END AS size_part, (p_retailprice - 1000.0::DOUBLE) / 500.0::DOUBLE * -0.5::DOUBLE AS price_part FROM part),
l AS (SELECT p_partkey, 'size' AS feature, size_part AS c FROM p UNION ALL SELECT p_partkey, 'price', price_part FROM p),
r AS (SELECT *, CASE WHEN c > 0 THEN 'positive' ELSE 'negative' END AS direction FROM l WHERE c <> 0)
SELECT p_partkey, direction, CAST(row_number() OVER (PARTITION BY p_partkey, direction ORDER BY abs(c) DESC, feature) AS INTEGER) AS rank, feature, sign(c) * floor(abs(c) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS contribution FROM r""")
def driver_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") - 25.0) / 10.0).alias("size"), ((F.col("p_retailprice") - 1000.0) / 500.0).alias("price"))
    found = scoring.drivers(rows, "p_partkey", {"size": 0.8, "price": -0.5})
    return found.withColumn("contribution", N.round_half_up(F.col("contribution"), 6))


@query("""WITH q AS (SELECT o_orderkey, o_orderpriority AS template, o_custkey % 25 AS borough FROM orders), s AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0)
SELECT CASE WHEN n_nationkey IS NOT NULL THEN 'BOROUGH' ELSE 'CITY' END AS scope, coalesce(n_nationkey, -1) AS release_id, count(*) AS request_count FROM q LEFT JOIN s ON borough = n_nationkey GROUP BY 1, 2""")
def active_release_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("template"), (F.col("o_custkey") % 25).cast("int").alias("borough_id"))
    kinds = asked.select("template").distinct()
    some = table(spark, sf_dir, "nation").where(F.col("n_nationkey") % 2 == 0).select(F.col("n_nationkey").alias("borough_id"), F.col("n_nationkey").alias("release_id"))
    own = asked.distinct().join(some, "borough_id").select("template", "borough_id", "release_id")
    city = kinds.select("template", F.lit(None).cast("int").alias("borough_id"), F.lit(-1).alias("release_id"))
    return scoring.active_release(asked, own.unionByName(city).withColumn("state", F.lit("ACTIVE"))).groupBy("scope", "release_id").agg(F.count("*").alias("request_count"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) SELECT user_id, event_type, event_id, value FROM e WHERE n = 1""")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.last_wins(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("""SELECT count(*) AS blob_count, CAST(count(DISTINCT content_hash) AS BIGINT) AS hash_count FROM (SELECT DISTINCT sha256(text) AS content_hash FROM documents)""")
def snapshot_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots by content hash: half of the documents are held already."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    held = docs.where(F.col("doc_id") % 2 == 0).select("content_hash").distinct()
    every = latest.append_unseen(docs.select("content_hash"), held, "content_hash")
    return every.agg(F.count("*").alias("blob_count"), F.countDistinct("content_hash").alias("hash_count"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_type, min(ts) AS first_seen_at, max(ts) AS last_seen_at, max(CASE WHEN n = 1 THEN value END) AS value FROM r GROUP BY 1, 2""")
def merged_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return listings.merge_observations(rows, ("user_id", "event_type"), at="ts", tie="event_id").drop("event_id")
