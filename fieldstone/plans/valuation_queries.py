"""Valuation and market evidence on the driver's tables: line items stand for sales, nations for boroughs, parts for land comparables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import scenarios, valuation
from .registry import query, table

AS_OF = "2001-08-01"


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as sales: the order is the site, the supplier's nation the borough."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    full = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    ref = F.concat_ws("-", F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"), F.lpad(F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("string"), 12, "0"))
    return full.select(
        F.col("l_orderkey").alias("site_id"), F.col("c_nationkey").alias("own"), F.col("s_nationkey").alias("borough_id"), F.col("l_shipdate").cast("date").alias("sale_date"), ref.alias("transaction_ref"),
        F.col("l_extendedprice").alias("rebased"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity")).alias("floor_area"), F.when(F.col("l_linenumber") % 8 == 0, F.lit(900.0)).alias("hint"),
    )


SALES_SQL = """s AS (SELECT l_orderkey AS site_id, c_nationkey AS own, s_nationkey AS borough_id, CAST(l_shipdate AS DATE) AS sale_date, l_extendedprice AS rebased,
  concat_ws('-', lpad(CAST(l_linenumber AS VARCHAR), 3, '0'), lpad(CAST(l_partkey AS VARCHAR), 9, '0'), lpad(CAST(l_suppkey AS VARCHAR), 9, '0'), lpad(CAST(CAST(floor(l_extendedprice * 100 + 0.5::DOUBLE) AS BIGINT) AS VARCHAR), 12, '0')) AS transaction_ref,
  CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity END AS floor_area, CASE WHEN l_linenumber % 8 = 0 THEN 900.0::DOUBLE END AS hint
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


@query(f"""WITH {SALES_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY CASE WHEN own = borough_id THEN 0 ELSE 1 END, sale_date DESC NULLS LAST, transaction_ref) AS n FROM s),
p AS (SELECT site_id, coalesce(CASE WHEN floor_area > 0 THEN rebased / floor_area END, hint) AS v FROM t WHERE n <= 6)
SELECT site_id, count(*) AS comp_count, floor(median(v) * 0.94::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS low, floor(median(v) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS mid, floor(median(v) * 1.06::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS high
FROM p WHERE v IS NOT NULL GROUP BY 1""")
def sales_comp_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = valuation.sales_summary(sales(spark, sf_dir), F.col("own"))
    return found.withColumns({c: N.round_half_up(F.col(c), 2) for c in ("low", "mid", "high")})


@query("""WITH c AS (SELECT c_custkey AS site_id, c_nationkey AS nation, 'Brand#' || (c_custkey % 5 + 1) || (c_custkey % 5 + 1) AS brand, c_custkey % 60 AS size FROM customer),
p AS (SELECT p_partkey, p_brand, p_size, p_retailprice, p_partkey % 25 AS nation FROM part),
j AS (SELECT site_id, p_partkey, p_retailprice, CASE WHEN p_brand = brand AND p.nation = c.nation THEN 0 WHEN p_brand = brand THEN 1 ELSE 2 END AS tier FROM c JOIN p ON c.size = p.p_size),
b AS (SELECT *, min(tier) OVER (PARTITION BY site_id) AS best FROM j),
k AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY DATE '2000-01-01' + CAST(p_partkey % 300 AS INTEGER) DESC, p_partkey) AS n FROM b WHERE tier = best)
SELECT site_id, CAST(min(tier) AS INTEGER) AS tier, count(*) AS comp_count, median(CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice * 0.5::DOUBLE ELSE p_retailprice END) AS low, median(p_retailprice) AS mid, median(CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice * 2.0::DOUBLE ELSE p_retailprice END) AS high
FROM k WHERE n <= 6 GROUP BY 1""")
def land_comp_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site_id"), F.col("c_nationkey").alias("nation"), F.concat(F.lit("Brand#"), (F.col("c_custkey") % 5 + 1).cast("string"), (F.col("c_custkey") % 5 + 1).cast("string")).alias("brand"), (F.col("c_custkey") % 60).alias("size"))
    key, price = F.col("p_partkey"), F.col("p_retailprice")
    p = table(spark, sf_dir, "part").select(
        key.alias("comp_ref"), "p_brand", "p_size", (key % 25).alias("p_nation"), F.date_add(F.lit("2000-01-01").cast("date"), (key % 300).cast("int")).alias("evidence_date"),
        F.when(key % 3 != 0, price * 0.5).alias("value_low"), price.alias("value_mid"), F.when(key % 4 != 0, price * 2.0).alias("value_high"),
    )
    tiers = [{"size": "p_size", "brand": "p_brand", "nation": "p_nation"}, {"size": "p_size", "brand": "p_brand"}, {"size": "p_size"}]
    return valuation.tiered_lookup(c, p, tiers)


@query("""WITH i AS (SELECT CAST(c_nationkey AS VARCHAR) AS borough_id, date_trunc('month', o_orderdate)::DATE AS period_month, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) // count(*) AS DOUBLE) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE month(o_orderdate) % 3 = 1 AND c_nationkey % 5 <> 0 GROUP BY 1, 2),
a AS (SELECT date_trunc('month', o_orderdate)::DATE AS period_month, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) // count(*) AS DOUBLE) AS v FROM orders WHERE month(o_orderdate) % 3 = 1 GROUP BY 1),
s AS (SELECT o_orderkey, CAST(c_nationkey AS VARCHAR) AS borough_id, date_trunc('month', o_orderdate)::DATE AS m, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey),
j AS (SELECT s.*, i.v AS own_then, a.v AS all_then FROM s ASOF LEFT JOIN i ON s.borough_id = i.borough_id AND s.m >= i.period_month ASOF LEFT JOIN a ON s.m >= a.period_month),
n AS (SELECT borough_id, arg_max(v, period_month) AS own_now FROM i WHERE period_month <= DATE '2001-08-01' GROUP BY 1), n2 AS (SELECT arg_max(v, period_month) AS all_now FROM a WHERE period_month <= DATE '2001-08-01')
SELECT o_orderkey, floor(price * coalesce(CASE WHEN coalesce(own_then, all_then) > 0 THEN coalesce(own_now, all_now) / coalesce(own_then, all_then) END, 1.0::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS rebased FROM j LEFT JOIN n USING (borough_id) CROSS JOIN n2""")
def index_rebase_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = both.select("o_orderkey", F.col("c_nationkey").cast("string").alias("borough_id"), F.trunc("o_orderdate", "MM").alias("sale_month"), F.col("o_totalprice").alias("price"), F.lit(AS_OF).cast("date").alias("as_of_month"))
    quarter = rows.where(F.month("sale_month") % 3 == 1)
    mean = F.expr("sum(cast(round(price * 100) as bigint)) div count(*)").cast("double").alias("index_value")
    own = quarter.where(F.col("borough_id").try_cast("int") % 5 != 0).groupBy("borough_id", F.col("sale_month").alias("period_month")).agg(mean)
    nation = quarter.groupBy(F.lit(valuation.NATIONAL).alias("borough_id"), F.col("sale_month").alias("period_month")).agg(mean)
    found = valuation.rebase(rows, own.unionByName(nation))
    return found.select("o_orderkey", N.round_half_up(F.col("rebased"), 2).alias("rebased"))


@query("""WITH v AS (SELECT * FROM (VALUES (DATE '1996-01-01', 'v1'), (DATE '1998-06-01', 'v2'), (DATE '2000-01-01', 'v3')) t(effective_from, version)),
j AS (SELECT o_orderkey, arg_max(version, effective_from) AS version FROM orders LEFT JOIN v ON CAST(o_orderdate AS DATE) >= effective_from GROUP BY 1)
SELECT coalesce(version, 'phase7a_default_v1') AS version, count(*) AS run_count FROM j GROUP BY 1""")
def assumption_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = spark.createDataFrame([("1996-01-01", "v1"), ("1998-06-01", "v2"), ("2000-01-01", "v3")], "effective_from string, version string").withColumn("effective_from", F.to_date("effective_from"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("as_of"))
    return valuation.active_assumptions(rows, sets, "as_of").groupBy("version").agg(F.count("*").alias("run_count"))


TEMPLATE_SQL = "CASE WHEN units <= 4 THEN 'resi_1_4_full' WHEN units <= 9 THEN 'resi_5_9_full' ELSE 'resi_10_49_outline' END"
MIX_SQL = """m AS (SELECT * FROM (VALUES ('resi_1_4_full', '2_bed', 0.5::DOUBLE), ('resi_1_4_full', '3_bed', 0.5::DOUBLE), ('resi_5_9_full', '1_bed', 0.2::DOUBLE), ('resi_5_9_full', '2_bed', 0.55::DOUBLE), ('resi_5_9_full', '3_bed', 0.25::DOUBLE),
  ('resi_10_49_outline', '1_bed', 0.25::DOUBLE), ('resi_10_49_outline', '2_bed', 0.5::DOUBLE), ('resi_10_49_outline', '3_bed', 0.25::DOUBLE)) t(template, unit_type, share)),
o AS (SELECT o_orderkey, CAST(o_orderkey % 49 + 1 AS INTEGER) AS units, o_custkey, o_totalprice FROM orders),
u AS (SELECT o.*, """ + TEMPLATE_SQL + """ AS template FROM o),
f AS (SELECT u.*, unit_type, floor(units * share) AS whole, units * share - floor(units * share) AS rest FROM u JOIN m USING (template)),
k AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY rest DESC, unit_type) AS n, units - sum(whole) OVER (PARTITION BY o_orderkey) AS over FROM f),
counts AS (SELECT o_orderkey, template, units, o_custkey, o_totalprice, unit_type, CAST(whole + CASE WHEN n <= over THEN 1 ELSE 0 END AS BIGINT) AS unit_count FROM k)"""


def schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, each under a key of its own, as schemes of 1 to 49 units."""
    units = (F.col("o_orderkey") % 49 + 1).cast("int")
    template = F.when(units <= 4, "resi_1_4_full").when(units <= 9, "resi_5_9_full").otherwise("resi_10_49_outline")
    return table(spark, sf_dir, "orders").select("o_orderkey", units.alias("units"), template.alias("template"), "o_custkey", "o_totalprice")


@query(f"WITH {MIX_SQL} SELECT o_orderkey, unit_type, unit_count FROM counts")
def unit_mix_apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = schemes(spark, sf_dir)
    return valuation.of_kind(rows, valuation.kind_counts(rows).select("template", "units", "unit_type", "unit_count")).select("o_orderkey", "unit_type", "unit_count")


RESIDUAL_SQL = f"""{MIX_SQL},
a AS (SELECT o_orderkey, template, units, o_custkey, o_totalprice, CAST(sum(unit_count * CASE unit_type WHEN '1_bed' THEN 52 WHEN '2_bed' THEN 72 ELSE 94 END) AS DOUBLE) AS nsa FROM counts GROUP BY 1, 2, 3, 4, 5),
b AS (SELECT *, nsa * 1.15::DOUBLE AS gia, CAST(4000 + o_custkey % 50 * 100 AS DOUBLE) AS ppsm, CASE o_custkey % 3 WHEN 0 THEN 'camden' WHEN 1 THEN 'southwark' ELSE 'islington' END AS borough FROM a),
c AS (SELECT *, nsa * ppsm AS gdv, gia * CASE template WHEN 'resi_1_4_full' THEN 2425.0::DOUBLE WHEN 'resi_5_9_full' THEN 2375.0::DOUBLE ELSE 2280.0::DOUBLE END AS build,
  gia * (60.0::DOUBLE + CASE borough WHEN 'camden' THEN 35.0::DOUBLE WHEN 'southwark' THEN 25.0::DOUBLE ELSE 20.0::DOUBLE END) AS cil FROM b),
d AS (SELECT *, build * (1.0::DOUBLE + 0.08::DOUBLE + 0.10::DOUBLE + 0.03::DOUBLE + 0.05::DOUBLE) + cil + CASE WHEN units >= 10 THEN gdv * CASE borough WHEN 'camden' THEN 0.12::DOUBLE ELSE 0.10::DOUBLE END ELSE 0.0::DOUBLE END AS subtotal FROM c),
e AS (SELECT *, greatest(gdv - (subtotal * (1.0::DOUBLE + 0.06::DOUBLE) + gdv * 0.18::DOUBLE), 0.0::DOUBLE) AS land FROM d)"""


def valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemed = schemes(spark, sf_dir)
    sized = valuation.of_kind(schemed, valuation.areas(valuation.kind_counts(schemed), ["template", "units"]))
    borough = F.when(F.col("o_custkey") % 3 == 0, "camden").when(F.col("o_custkey") % 3 == 1, "southwark").otherwise("islington")
    rows = sized.withColumns({"borough": borough, "ppsm": (4000 + F.col("o_custkey") % 50 * 100).cast("double")})
    return rows.withColumn("land", valuation.land_value(F.col("nsa"), F.col("gia"), F.col("ppsm"), F.col("template"), F.col("borough"), F.col("units")))


@query(f"WITH {RESIDUAL_SQL} SELECT o_orderkey, template, nsa, CAST(floor(land + 0.5::DOUBLE) AS BIGINT) AS land_value, CAST(floor(land - o_totalprice + 0.5::DOUBLE) AS BIGINT) AS uplift FROM e")
def residual_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda c: F.floor(c + 0.5).cast("long")
    return valued(spark, sf_dir).select("o_orderkey", "template", "nsa", whole(F.col("land")).alias("land_value"), whole(valuation.uplift(F.col("land"), F.col("o_totalprice"))).alias("uplift"))


@query(f"""WITH {RESIDUAL_SQL}, q AS (SELECT *, o_totalprice * 2.0::DOUBLE AS second, o_orderkey % 8 AS sales, o_orderkey % 4 AS lands FROM e),
r AS (SELECT *, abs(land - second) >= 250000.0::DOUBLE OR (greatest(land, second) > 0 AND abs(land - second) >= 0.2::DOUBLE * greatest(land, second)) AS diverges FROM q)
SELECT o_orderkey, diverges, CASE WHEN o_orderkey % 9 = 0 OR sales < 3 OR o_orderkey % 10 = 0 OR diverges THEN 'LOW' WHEN sales < 5 OR lands < 2 OR o_orderkey % 6 = 0 THEN 'MEDIUM' ELSE 'HIGH' END AS valuation_quality,
  concat_ws(',', CASE WHEN o_orderkey % 9 = 0 THEN 'ASKING_PRICE_MISSING' END, CASE WHEN sales < 3 THEN 'SALES_COMPS_THIN' END, CASE WHEN sales >= 3 AND sales < 5 THEN 'SALES_COMPS_LIMITED' END, CASE WHEN lands < 2 THEN 'LAND_COMPS_THIN' END,
    CASE WHEN o_orderkey % 10 = 0 THEN 'POLICY_INPUTS_UNKNOWN' END, CASE WHEN o_orderkey % 6 = 0 THEN 'SCENARIO_UNSTABLE' END, CASE WHEN diverges THEN 'METHODS_DIVERGE' END) AS reasons,
  CAST(floor((CASE WHEN diverges THEN (land + second) / 2 ELSE land END) + 0.5::DOUBLE) AS BIGINT) AS mid FROM r""")
def divergence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valued(spark, sf_dir).withColumn("second", F.col("o_totalprice") * 2.0)
    key, apart = F.col("o_orderkey"), valuation.divergent(F.col("land"), F.col("second"))
    quality, why = valuation.valuation_quality(key % 9 != 0, key % 8, key % 4, key % 10 != 0, key % 6 != 0, F.col("diverges"))
    wide = valuation.widened((F.col("land"),) * 3, (F.col("second"),) * 3)
    rows = rows.withColumn("diverges", apart)
    return rows.select("o_orderkey", "diverges", quality.alias("valuation_quality"), F.array_join(why, ",").alias("reasons"), F.floor(F.when(F.col("diverges"), wide[1]).otherwise(F.col("land")) + 0.5).cast("long").alias("mid"))


@query("""WITH t AS (SELECT * FROM (VALUES ('resi_1_4_full', 1, 4, 140.0::DOUBLE, 1600.0::DOUBLE, 0.68::DOUBLE, 240.0::DOUBLE), ('resi_5_9_full', 5, 9, 700.0::DOUBLE, 3200.0::DOUBLE, 0.72::DOUBLE, 180.0::DOUBLE), ('resi_10_49_outline', 10, 49, 1800.0::DOUBLE, 14000.0::DOUBLE, 0.78::DOUBLE, 115.0::DOUBLE)) v(template, lo, hi, amin, amax, net, sqm)),
p AS (SELECT p_partkey, p_retailprice * (p_size + 0) / 10.0::DOUBLE AS area, p_partkey % 13 <> 0 AS geo, p_partkey % 17 <> 0 AS pack, p_partkey % 19 <> 0 AS cited, p_partkey % 23 = 0 AS extant, p_partkey % 2 = 0 AS high FROM part),
j AS (SELECT *, CASE WHEN NOT geo THEN 'NO_GEOMETRY' WHEN NOT pack THEN 'RULEPACK_MISSING' WHEN NOT cited THEN 'CITATIONS_INCOMPLETE' WHEN extant THEN 'ACTIVE_EXTANT_PERMISSION' WHEN area <= 0 THEN 'NO_AREA' WHEN NOT area BETWEEN amin AND amax THEN 'AREA_OUT_OF_RANGE' END AS exclusion,
  CASE WHEN area BETWEEN amin AND amax THEN 4 ELSE -4 END + CASE WHEN high THEN 1 ELSE 0 END - CAST(p_partkey % 3 AS INTEGER) AS score FROM p CROSS JOIN t)
SELECT p_partkey AS site_id, template, exclusion, CASE WHEN exclusion IS NULL THEN CAST(greatest(lo, least(hi, floor(area * net / sqm))) AS INTEGER) END AS units, CAST(100 - score AS INTEGER) AS rank FROM j""")
def scenario_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        key.alias("site_id"), (F.col("p_retailprice") * (F.col("p_size") + 0) / 10.0).alias("area"), (key % 13 != 0).alias("has_geometry"), (key % 17 != 0).alias("has_rulepack"), (key % 19 != 0).alias("citations_ok"),
        (key % 23 == 0).alias("extant_active"), F.when(key % 2 == 0, "HIGH").otherwise("LOW").alias("geom_confidence"), (key % 3).cast("int").alias("missing_flags"), F.lit(0).alias("stale_codes"),
    )
    return scenarios.candidates(rows).select("site_id", "template", "exclusion", "units", "rank")


@query("""WITH s AS (SELECT p_partkey, p_size, 'P' || (p_partkey % 40) AS site, CASE WHEN p_partkey % 5 = 0 THEN 'CONFIRMED' WHEN p_partkey % 7 = 0 THEN 'REJECTED' ELSE 'SUGGESTED' END AS status, p_partkey % 4 = 0 AS stale, p_partkey % 3 <> 0 AS current FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY CASE WHEN status = 'CONFIRMED' AND NOT stale THEN 0 ELSE 1 END, p_size, p_partkey) AS n FROM s WHERE current AND status <> 'REJECTED')
SELECT site AS site_id, p_partkey AS scenario_id, status FROM r WHERE n = 1""")
def headline_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), (key % 40).cast("string")).alias("site_id"), key.alias("scenario_id"), F.when(key % 5 == 0, "CONFIRMED").when(key % 7 == 0, "REJECTED").otherwise("SUGGESTED").alias("status"),
        (key % 4 == 0).alias("is_stale"), (key % 3 != 0).alias("is_current"), F.col("p_size").alias("rank"),
    )
    return scenarios.headline(rows).select("site_id", "scenario_id", "status")
