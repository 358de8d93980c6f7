"""Market evidence and residual land value: comparables, index rebasing, unit mixes, divergence, quality, uplift."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from .latest import as_of_lookup, latest_per_key, top_per_key

#: The default assumption set.
ASSUMPTIONS = {
    "version": "phase7a_default_v1", "gia_multiplier": 1.15, "externals": 0.08, "fees": 0.10, "planning": 0.03, "contingency": 0.05, "finance": 0.06, "margin": 0.18,
    "mayoral_cil": 60.0, "affordable_trigger": 10, "divergence_pct": 0.20, "divergence_gbp": 250_000.0,
}
BUILD_COST = {"resi_1_4_full": 2425.0, "resi_5_9_full": 2375.0, "resi_10_49_outline": 2280.0}
OTHER_BUILD_COST = 2350.0
UNIT_SQM = {"studio": 42.0, "1_bed": 52.0, "2_bed": 72.0, "3_bed": 94.0}
OTHER_UNIT_SQM = 72.0
MIXES = {"resi_1_4_full": {"2_bed": 0.5, "3_bed": 0.5}, "resi_5_9_full": {"1_bed": 0.2, "2_bed": 0.55, "3_bed": 0.25}, "resi_10_49_outline": {"1_bed": 0.25, "2_bed": 0.5, "3_bed": 0.25}}
BOROUGH_CIL, OTHER_CIL = {"camden": 35.0, "southwark": 25.0}, 20.0
AFFORDABLE_SHARE, OTHER_AFFORDABLE = {"camden": 0.12}, 0.10
COMP_LOW, COMP_HIGH, COMPS, COMP_MONTHS = 0.94, 1.06, 6, 36
NATIONAL = "national"


def by_name(col: Column, table: dict[str, float], other: float) -> Column:
    out = None
    for name, value in table.items():
        out = F.when(col == name, value) if out is None else out.when(col == name, value)
    return out.otherwise(other)


def rebase(sales: DataFrame, index: DataFrame, price: str = "price") -> DataFrame:
    """sales (borough_id, sale_month, as_of_month, price) with rebased: times index at as-of over index at sale, of the borough or else national; the price itself where an index is missing."""
    national = index.where(F.col("borough_id") == NATIONAL).select(F.lit(NATIONAL).alias("nation_id"), "period_month", "index_value")
    out = sales.withColumn("nation_id", F.lit(NATIONAL))
    for at, name in (("sale_month", "sale"), ("as_of_month", "now")):
        out = as_of_lookup(out, index.withColumnRenamed("index_value", f"{name}_own"), ["borough_id"], at, "period_month", [f"{name}_own"])
        out = as_of_lookup(out, national.withColumnRenamed("index_value", f"{name}_all"), ["nation_id"], at, "period_month", [f"{name}_all"])
    then, now = F.coalesce("sale_own", "sale_all"), F.coalesce("now_own", "now_all")
    factor = F.coalesce(F.when(then > 0, now / then), F.lit(1.0))
    return out.withColumn("rebased", F.col(price) * factor).drop("nation_id", "sale_own", "sale_all", "now_own", "now_all")


def sales_summary(sales: DataFrame, borough: Column, n: int = COMPS) -> DataFrame:
    """site_id, comp_count and low, mid and high price per square metre of the first n comparables: own borough first, then the newest.

    sales has site_id, borough_id, sale_date, transaction_ref, rebased, floor_area and hint. A comparable without an area uses its hint as it is; one with neither is
    dropped after the cut to n.
    """
    own = F.when(borough == F.col("borough_id"), 0).otherwise(1)
    chosen = top_per_key(sales, ["site_id"], n, own.asc(), F.desc_nulls_last("sale_date"), F.asc("transaction_ref"))
    per_sqm = F.coalesce(F.when(F.col("floor_area") > 0, F.col("rebased") / F.col("floor_area")), F.col("hint"))
    kept = chosen.withColumn("per_sqm", per_sqm).where("per_sqm is not null")
    found = kept.groupBy("site_id").agg(F.count("*").alias("comp_count"), F.median("per_sqm").alias("mid"))
    return found.select("site_id", "comp_count", (F.col("mid") * COMP_LOW).alias("low"), "mid", (F.col("mid") * COMP_HIGH).alias("high"))


def tiered_summary(comps: DataFrame, tiers: list[Column], n: int = COMPS) -> DataFrame:
    """site_id, tier, comp_count and median low, mid and high of the n newest comparables of the first tier that has any; missing lows and highs are mids."""
    tier = F.coalesce(*(F.when(test, i) for i, test in enumerate(tiers)))
    ranked = comps.withColumn("tier", tier).where("tier is not null")
    first = ranked.withColumn("best", F.min("tier").over(Window.partitionBy("site_id"))).where("tier = best")
    chosen = top_per_key(first, ["site_id"], n, F.desc_nulls_last("evidence_date"), F.asc("comp_ref"))
    return chosen.groupBy("site_id").agg(
        F.min("tier").alias("tier"), F.count("*").alias("comp_count"), F.median(F.coalesce("value_low", "value_mid")).alias("low"), F.median("value_mid").alias("mid"), F.median(F.coalesce("value_high", "value_mid")).alias("high")
    )


def tiered_lookup(sites: DataFrame, comps: DataFrame, tiers: list[dict[str, str]], n: int = COMPS) -> DataFrame:
    """tiered_summary() for tiers that are equalities: each maps columns of sites (with site_id) to those of comps.

    The n newest of each key are found once, and sites meet those only: at most n rows for each site and tier.
    """
    newest, facts = (F.desc_nulls_last("evidence_date"), F.asc("comp_ref")), ("evidence_date", "comp_ref", "value_low", "value_mid", "value_high")
    met = []
    for i, tier in enumerate(tiers):
        top = top_per_key(comps.where(reduce(and_, [F.col(c).isNotNull() for c in tier.values()])), list(tier.values()), n, *newest)
        top = top.select(*(F.col(c).alias(f"__{c}") for c in tier.values()), *facts)
        met.append(sites.join(top, reduce(and_, [F.col(s) == F.col(f"__{c}") for s, c in tier.items()])).select("site_id", F.lit(i).alias("tier"), *facts))
    every = reduce(DataFrame.unionByName, met)
    return tiered_summary(every, [F.col("tier") == i for i in range(len(tiers))], n)


def apportion(rows: DataFrame, keys: list[str], units: str, share: str, name: str) -> DataFrame:
    """Whole units of each name: floors, and one more to the largest remainders (ties by name) until all units are given.

    rows has a row for each key and name, with the key's units and the name's share.
    """
    exact = F.col(units) * F.col(share)
    whole = Window.partitionBy(*keys)
    out = rows.withColumn("__floor", F.floor(exact)).withColumn("__rest", exact - F.floor(exact))
    out = out.withColumn("__left", F.col(units) - F.sum("__floor").over(whole)).withColumn("__n", F.row_number().over(whole.orderBy(F.desc("__rest"), F.asc(name))))
    return out.withColumn("unit_count", (F.col("__floor") + F.when(F.col("__n") <= F.col("__left"), 1).otherwise(0)).cast("long")).drop("__floor", "__rest", "__left", "__n")


def kind_counts(rows: DataFrame, mixes: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """template, units, unit_type and unit_count of the different templates and numbers of units of rows, by apportion(): rows that are alike in both have the same counts."""
    shares = [(template, name, share) for template, mix in (mixes or MIXES).items() for name, share in mix.items()]
    mix = rows.sparkSession.createDataFrame(shares, "template string, unit_type string, share double")
    return apportion(rows.select("template", "units").distinct().join(F.broadcast(mix), "template"), ["template", "units"], "units", "share", "unit_type")


def of_kind(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """rows with what kinds (template, units) say of them. Kinds go to all executors, so that rows stay where they are: for schemes, whose units are bounded by template."""
    near = kinds.withColumnsRenamed({"template": "__template", "units": "__units"})
    return rows.join(F.broadcast(near), F.col("template").eqNullSafe(F.col("__template")) & F.col("units").eqNullSafe(F.col("__units"))).drop("__template", "__units")


def areas(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Net and gross internal area of unit counts (keys, unit_type, unit_count)."""
    sqm = F.col("unit_count") * by_name(F.col("unit_type"), UNIT_SQM, OTHER_UNIT_SQM)
    return counts.groupBy(*keys).agg(F.sum(sqm).alias("nsa")).withColumn("gia", F.col("nsa") * ASSUMPTIONS["gia_multiplier"])


def land_value(nsa: Column, gia: Column, per_sqm: Column, template: Column, borough: Column, units: Column, a: dict | None = None) -> Column:
    """Residual land value at a price per square metre: sales value less costs, contributions, finance and margin, not below 0; null if an input is missing."""
    a = ASSUMPTIONS | (a or {})
    gdv = nsa * per_sqm
    build = gia * by_name(template, BUILD_COST, OTHER_BUILD_COST)
    cil = gia * (a["mayoral_cil"] + by_name(borough, BOROUGH_CIL, OTHER_CIL))
    affordable = F.when(units >= a["affordable_trigger"], gdv * by_name(borough, AFFORDABLE_SHARE, OTHER_AFFORDABLE)).otherwise(0.0)
    subtotal = build * (1.0 + a["externals"] + a["fees"] + a["planning"] + a["contingency"]) + cil + affordable
    value = gdv - (subtotal * (1.0 + a["finance"]) + gdv * a["margin"])
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def divergent(first: Column, second: Column, pct: float = ASSUMPTIONS["divergence_pct"], gbp: float = ASSUMPTIONS["divergence_gbp"]) -> Column:
    """Whether two values are apart by a share of the larger or by an amount; false if either is missing."""
    gap = F.abs(first - second)
    return F.coalesce((gap >= gbp) | ((F.greatest(first, second) > 0) & (gap >= pct * F.greatest(first, second))), F.lit(False))


def widened(first: tuple[Column, Column, Column], second: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Least low, mean mid, greatest high; a side that is missing doesn't count."""
    mid = F.when(first[1].isNull(), second[1]).when(second[1].isNull(), first[1]).otherwise((first[1] + second[1]) / 2)
    return F.least(first[0], second[0]), mid, F.greatest(first[2], second[2])


def valuation_quality(basis: Column, sales: Column, lands: Column, policy_known: Column, stable: Column, diverges: Column) -> tuple[Column, Column]:
    """Quality and reasons; it begins high and falls to the lowest that any rule says."""
    rules = [
        (~basis, "ASKING_PRICE_MISSING", 1), (sales < 3, "SALES_COMPS_THIN", 1), ((sales >= 3) & (sales < 5), "SALES_COMPS_LIMITED", 2), (lands < 2, "LAND_COMPS_THIN", 2),
        (~policy_known, "POLICY_INPUTS_UNKNOWN", 1), (~stable, "SCENARIO_UNSTABLE", 2), (diverges, "METHODS_DIVERGE", 1),
    ]
    rank = F.least(*(F.when(F.coalesce(hit, F.lit(True)), level).otherwise(3) for hit, _, level in rules))
    return N.quality_name(rank), N.reasons(*((hit, code) for hit, code, _ in rules))


def uplift(land: Column, basis: Column) -> Column:
    return land - basis


def expected_uplift(p: Column, uplift_mid: Column) -> Column:
    return p * uplift_mid


def active_assumptions(rows: DataFrame, sets: DataFrame, at: str, default: str = ASSUMPTIONS["version"]) -> DataFrame:
    """rows with version, the set that came into force last by their day, or the default before any did.

    The sets (versions of a table kept by hand) are read once and make one expression, so rows need no join.
    """
    known = sets.groupBy("effective_from").agg(F.max("version").alias("version")).orderBy("effective_from").collect()
    version = F.coalesce(*(F.when(F.col(at) >= F.lit(r["effective_from"]), r["version"]) for r in reversed(known)), F.lit(default))
    return rows.withColumn("version", version)


def latest_run(runs: DataFrame, key: str = "assessment_id") -> DataFrame:
    return latest_per_key(runs, [key], F.desc("created_at"), F.desc("run_id"))
