"""Development scenarios of a site: capacity by template, exclusions, score, headline, auto-confirm gate, state changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from .latest import latest_per_key

#: Templates.
TEMPLATES = [
    ("resi_1_4_full", 1, 4, 140.0, 1600.0, 0.68, 240.0, "FULL", "INFILL"),
    ("resi_5_9_full", 5, 9, 700.0, 3200.0, 0.72, 180.0, "FULL", "REDEVELOPMENT"),
    ("resi_10_49_outline", 10, 49, 1800.0, 14000.0, 0.78, 115.0, "OUTLINE", "BROWNFIELD_REUSE"),
]
TEMPLATE_SCHEMA = "template string, min_units int, max_units int, min_area double, max_area double, net_pct double, sqm_per_home double, route string, form string"
OUT_OF_RANGE, OTHER_ROUTE, OTHER_USE = 20, 10, 50


def templates(spark: SparkSession, keys: tuple[str, ...] | None = None) -> DataFrame:
    rows = [t for t in TEMPLATES if keys is None or t[0] in keys]
    return spark.createDataFrame(rows, TEMPLATE_SCHEMA)


def citations_complete(citations: Column) -> Column:
    """Whether an array of struct(label, source_family, effective_date, url) has entries and each is filled."""
    full = lambda c: F.forall(F.array(c["label"], c["source_family"], c["effective_date"].cast("string"), c["url"]), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.coalesce((F.size(citations) > 0) & F.forall(citations, full), F.lit(False))


def capacity(area: Column) -> Column:
    """Whole homes that fit, within the template's range; null without an area."""
    homes = F.floor(area * F.col("net_pct") / F.col("sqm_per_home"))
    return F.when(homes.isNotNull(), F.greatest(F.col("min_units"), F.least(F.col("max_units"), homes))).cast("int")


def exclusion(area: Column, manual_seed: Column) -> Column:
    """The first reason against a template for a site, or null: columns has_geometry, has_rulepack, citations_ok, extant_active."""
    return N.first_that_holds(
        [
            (~F.col("has_geometry"), "NO_GEOMETRY"), (~F.col("has_rulepack"), "RULEPACK_MISSING"), (~F.col("citations_ok"), "CITATIONS_INCOMPLETE"),
            (F.col("extant_active"), "ACTIVE_EXTANT_PERMISSION"), (area <= 0, "NO_AREA"), (~manual_seed & ~area.between(F.col("min_area"), F.col("max_area")), "AREA_OUT_OF_RANGE"),
        ],
        None,
    )


def candidates(sites: DataFrame, support: DataFrame | None = None, manual_seed: bool = False) -> DataFrame:
    """A row for each site and template: exclusion, units, score, rank and flags.

    sites: site_id, area, has_geometry, has_rulepack, citations_ok, extant_active, geom_confidence, missing_flags, stale_codes. support: site_id, template, units, strong.
    """
    names = [x.split()[0] for x in TEMPLATE_SCHEMA.split(", ")]
    each = F.array(*[F.struct(*(F.lit(v).alias(n) for n, v in zip(names, t, strict=True))) for t in TEMPLATES])
    both = sites.withColumn("__t", F.explode(each)).select(*sites.columns, "__t.*")
    both = both.join(support.select("site_id", "template", F.col("units").alias("support_units"), "strong"), ["site_id", "template"], "left") if support is not None else both.withColumns({"support_units": F.lit(None).cast("int"), "strong": F.lit(False)})
    area, seed = F.col("area"), F.lit(manual_seed)
    units = F.when(F.col("support_units").isNotNull(), F.greatest("min_units", F.least("max_units", "support_units"))).otherwise(capacity(area))
    points = F.when(area.between(F.col("min_area"), F.col("max_area")), 4).otherwise(-4) + F.when(F.col("support_units").isNotNull(), 3).otherwise(0)
    points = points + F.when(F.coalesce("strong", F.lit(False)), 2).otherwise(0) + F.when(F.col("geom_confidence") == "HIGH", 1).otherwise(0)
    points = points - F.coalesce("missing_flags", F.lit(0)) - F.coalesce("stale_codes", F.lit(0))
    out = both.withColumn("exclusion", exclusion(area, seed))
    return out.select("site_id", "template", "exclusion", F.when(F.col("exclusion").isNull(), units).alias("units"), points.alias("score"), (100 - points).alias("rank"), "route", "form")


def nearest_support(cases: DataFrame) -> DataFrame:
    """Each site's and template's nearest approved case, with whole metres and penalties: cases with site_id, template, case_id, distance_m, units_in_range, same_route, residential, source, decision_date, valid_date."""
    penalty = F.floor("distance_m") + F.when(F.col("units_in_range"), 0).otherwise(OUT_OF_RANGE) + F.when(F.col("same_route"), 0).otherwise(OTHER_ROUTE) + F.when(F.col("residential"), 0).otherwise(OTHER_USE)
    kept = cases.where(F.coalesce(F.col("source"), F.lit("")) != "PLD").withColumn("penalty", penalty)
    return latest_per_key(kept, ["site_id", "template"], F.asc("penalty"), F.asc_nulls_last(F.coalesce("decision_date", "valid_date")), F.asc("case_id"))


def blockers(geom_confidence: Column, extant: Column, strong: Column, route_allowed: Column, missing: Column, codes: Column) -> Column:
    """Why a scenario isn't confirmed by itself; empty if it is."""
    return N.reasons(
        (geom_confidence.isin("LOW", "INSUFFICIENT"), "GEOMETRY_WEAK"), (extant != "PASS", "EXTANT_NOT_CLEAR"), (~strong, "SUPPORT_WEAK"), (~route_allowed, "ROUTE_NOT_PREFERRED"),
        (missing > 0, "DATA_MISSING"), (F.exists(codes, lambda c: c.endswith("STALE")), "SOURCE_STALE"),
    )


def headline(scenarios: DataFrame) -> DataFrame:
    """Each site's headline scenario: current and not rejected; confirmed and fresh ones first, then by rank."""
    ready = F.when((F.col("status") == "CONFIRMED") & ~F.col("is_stale"), 0).otherwise(1)
    live = scenarios.where(F.col("is_current") & (F.col("status") != "REJECTED"))
    return latest_per_key(live, ["site_id"], ready.asc(), F.asc("rank"), F.asc("scenario_id"))


def stale_for_geometry(scenarios: DataFrame, sites: DataFrame) -> DataFrame:
    """scenarios, stale where their geometry hash isn't their site's any more."""
    now = sites.select("site_id", F.col("geometry_hash").alias("__now"))
    return scenarios.join(now, "site_id", "left").withColumn("is_stale", F.col("is_stale") | F.coalesce(F.col("geometry_hash") != F.col("__now"), F.lit(False))).drop("__now")


def stale_for_rulepacks(scenarios: DataFrame, packs: DataFrame) -> DataFrame:
    """scenarios, stale where the rulepack of their borough and template has another hash."""
    now = packs.select("borough_id", "template", F.col("rulepack_hash").alias("__now"))
    return scenarios.join(now, ["borough_id", "template"], "left").withColumn("is_stale", F.col("is_stale") | F.coalesce(F.col("rulepack_hash") != F.col("__now"), F.lit(False))).drop("__now")


def state_after(scenarios: DataFrame, reviews: DataFrame) -> DataFrame:
    """scenarios with the status of their last review, if any: a log of confirmations and rejections, the last wins."""
    last = latest_per_key(reviews, ["scenario_id"], F.desc("reviewed_at"), F.desc("review_id")).select("scenario_id", F.col("status").alias("__status"))
    return scenarios.join(last, "scenario_id", "left").withColumn("status", F.coalesce("__status", "status")).drop("__status")


def superseded(scenarios: DataFrame) -> DataFrame:
    """scenarios, current only if no later revision of the same site and template is confirmed."""
    last = F.max(F.when(F.col("status") == "CONFIRMED", F.col("revision"))).over(Window.partitionBy("site_id", "template"))
    return scenarios.withColumn("is_current", F.col("is_current") & ~F.coalesce(last > F.col("revision"), F.lit(False)))
