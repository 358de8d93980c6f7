"""Assessment runs: scoring a frozen snapshot, its quality and review flags, valuation and expected uplift in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from . import control, scoring, valuation


def scored(runs: DataFrame, models: DataFrame) -> DataFrame:
    """runs with raw and calibrated probability, display, support status, estimate quality and manual_review.

    runs: run_id, template, vector, nearest_distance, template_support, borough_support, comparables, coverage_quality, geometry_quality, scenario_quality,
    site_review, scenario_review, execution_status. models: template, weights, platt. Runs that aren't to be scored keep nulls.
    """
    joined = runs.join(models.select("template", "weights", "platt"), "template", "left")
    ready = F.col("execution_status") == "SCORED"
    raw = F.when(ready, scoring.raw_probability(F.col("weights"), F.col("vector")))
    out = joined.withColumn("probability_raw", raw).withColumn("probability", scoring.calibrated(F.col("platt"), F.col("probability_raw")))
    out = out.withColumn("support_status", scoring.support_status(F.col("nearest_distance"), F.col("template_support"), F.col("borough_support")))
    support = scoring.support_quality(F.col("template_support"), F.col("borough_support"), F.col("comparables"))
    distance = F.when(F.col("support_status") == "IN_SUPPORT", "HIGH").when(F.col("support_status") == "EDGE_OF_SUPPORT", "MEDIUM").otherwise("LOW")
    out = out.withColumn("estimate_quality", N.lowest_quality(F.col("coverage_quality"), F.col("geometry_quality"), support, F.col("scenario_quality"), distance))
    review = F.coalesce("site_review", F.lit(False)) | F.coalesce("scenario_review", F.lit(False)) | (F.col("estimate_quality") == "LOW") | (F.col("support_status") != "IN_SUPPORT")
    return out.withColumn("manual_review", review).withColumn("display", N.display_probability(F.col("probability"))).drop("weights", "platt")


def valued(runs: DataFrame) -> DataFrame:
    """runs with land values, divergence-widened range, quality, uplift and expected uplift.

    runs: nsa, gia, template, borough_id, units, price_low, price_mid, price_high, basis_gbp, second_low, second_mid, second_high, sales_count, land_count,
    policy_known, is_stable, probability. Land is floored at 0 before uplift; the uplift is that of the widened range.
    """
    land = {c: valuation.land_value(F.col("nsa"), F.col("gia"), F.col(f"price_{c}"), F.col("template"), F.col("borough_id"), F.col("units")) for c in ("low", "mid", "high")}
    out = runs.withColumns({f"land_{c}": v for c, v in land.items()})
    out = out.withColumn("diverges", valuation.divergent(F.col("land_mid"), F.col("second_mid")))
    wide = valuation.widened(tuple(F.col(f"land_{c}") for c in land), tuple(F.col(f"second_{c}") for c in land))
    out = out.withColumns({f"final_{c}": F.when(F.col("diverges"), w).otherwise(F.col(f"land_{c}")) for c, w in zip(land, wide, strict=True)})
    quality, why = valuation.valuation_quality(F.col("basis_gbp").isNotNull(), F.col("sales_count"), F.col("land_count"), F.col("policy_known"), F.col("is_stable"), F.col("diverges"))
    out = out.withColumns({"valuation_quality": quality, "valuation_reasons": why} | {f"uplift_{c}": valuation.uplift(F.col(f"final_{c}"), F.col("basis_gbp")) for c in land})
    out = out.withColumn("expected_uplift", valuation.expected_uplift(F.col("probability"), F.col("uplift_mid")))
    return out.withColumn("valuation_review", (F.col("valuation_quality") == "LOW") | F.col("diverges"))


def run_keys(requests: DataFrame) -> DataFrame:
    """requests (site_id, scenario_id, as_of) with the key under which a repeated request is the same run."""
    return requests.withColumn("idempotency_key", control.idempotency_key(requests, "site_id", "scenario_id", "as_of"))


def new_runs(requests: DataFrame, held: DataFrame) -> DataFrame:
    """Requests whose run isn't held, each once."""
    return run_keys(requests).dropDuplicates(["idempotency_key"]).join(held.select("idempotency_key"), "idempotency_key", "left_anti")
