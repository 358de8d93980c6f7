"""Opportunities: bands, the planning-first order, filters, effective overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from .latest import latest_per_key

#: Bands in order of rank, quality in order of rank.
BANDS = ("Band A", "Band B", "Band C", "Band D", "Hold")
NO_DEADLINE = 10_000


def band(eligibility: Column, probability: Column, quality: Column, manual_review: Column) -> Column:
    """Hold for no pass or no probability; any manual review is Band B, whatever the probability; .70 with low quality is Band D."""
    review = F.coalesce(manual_review, F.lit(False))
    return N.first_that_holds(
        [
            (eligibility.isin("ABSTAIN", "FAIL", "OUT_OF_SCOPE") | probability.isNull(), "Hold"),
            ((probability >= 0.70) & quality.isin("HIGH", "MEDIUM") & ~review, "Band A"),
            (review | ((probability >= 0.55) & (probability < 0.70)), "Band B"),
            ((probability >= 0.40) & (probability < 0.55), "Band C"),
        ],
        "Band D",
    )


def band_rank(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(b) for b in BANDS]), name)


def urgency_days(auction_date: Column, today: Column) -> Column:
    """Days to the auction, below 0 once it is past; far off without one."""
    return F.coalesce(F.datediff(auction_date, today), F.lit(NO_DEADLINE))


def ranking_order(today: Column) -> list[Column]:
    """The order of opportunities: band, uplift, quality, urgency, price there, support, name; ties by id."""
    quality = F.when(F.col("valuation_quality").isNull(), 0).otherwise(N.quality_rank(F.col("valuation_quality")))
    return [
        band_rank(F.col("band")).asc(), F.coalesce("expected_uplift", F.lit(0.0)).desc(), quality.desc(), urgency_days(F.col("auction_date"), today).asc(),
        F.when(F.col("price_gbp").isNull(), 1).otherwise(0).asc(), F.coalesce("support_count", F.lit(0)).desc(), F.lower("display_name").asc(), F.col("site_id").asc(),
    ]


def ready_runs(runs: DataFrame) -> DataFrame:
    """Each site's latest ready run."""
    return latest_per_key(runs.where(F.col("state") == "READY"), ["site_id"], F.desc("as_of_date"), F.desc("run_id"))


def opportunities(sites: DataFrame, runs: DataFrame) -> DataFrame:
    """Assessed sites by their latest ready run, and all others as Hold with a reason.

    sites: site_id, display_name, borough, price_gbp, auction_date. runs: run_id, site_id, state, as_of_date, eligibility, probability, quality, manual_review,
    valuation_quality, expected_uplift, support_count.
    """
    latest = ready_runs(runs)
    assessed = sites.join(latest, "site_id").withColumn("band", band(F.col("eligibility"), F.col("probability"), F.col("quality"), F.col("manual_review")))
    assessed = assessed.withColumn("hold_reason", F.when(F.col("band") == "Hold", F.when(F.col("eligibility") != "PASS", F.concat(F.lit("ELIGIBILITY_"), "eligibility")).otherwise("NO_SCORE")))
    rest = sites.join(latest, "site_id", "left_anti").withColumns({"band": F.lit("Hold"), "hold_reason": F.lit("NO_READY_ASSESSMENT")})
    return assessed.unionByName(rest, allowMissingColumns=True)


def ranked(found: DataFrame, today: Column, limit: int, offset: int = 0) -> DataFrame:
    """A page of opportunities in order; Spark keeps only the first offset + limit rows of each task."""
    return found.orderBy(*ranking_order(today)).offset(offset).limit(limit)


def filters(found: DataFrame, today: Column, borough: str | None = None, band_name: str | None = None, quality: str | None = None, manual_review: bool | None = None, deadline_days: int | None = None, min_price: float | None = None, max_price: float | None = None) -> DataFrame:
    """Optional filters; a missing price or auction date fails its filter."""
    for name, value in (("borough", borough), ("band", band_name), ("valuation_quality", quality), ("manual_review", manual_review)):
        if value is not None:
            found = found.where(F.col(name) == value)
    if deadline_days is not None:
        found = found.where(F.datediff("auction_date", today).between(0, deadline_days))
    if min_price is not None:
        found = found.where(F.col("price_gbp") >= min_price)
    if max_price is not None:
        found = found.where(F.col("price_gbp") <= max_price)
    return found


def active_overrides(overrides: DataFrame) -> DataFrame:
    """The latest override of each run and type that is not resolved."""
    return latest_per_key(overrides.where(F.coalesce(F.col("status"), F.lit("")) != "RESOLVED"), ["run_id", "override_type"], F.desc("created_at"), F.desc("override_id"))


def with_overrides(runs: DataFrame, overrides: DataFrame) -> DataFrame:
    """runs (run_id, land_mid, basis_gbp, probability, manual_review) with their overrides in effect: another basis, a review decided, ranking off."""
    kinds = ["ACQUISITION_BASIS", "REVIEW_DISPOSITION", "RANKING_SUPPRESSION"]
    wide = active_overrides(overrides).groupBy("run_id").pivot("override_type", kinds).agg(F.first("value"))
    out = runs.join(wide, "run_id", "left")
    basis = F.coalesce(F.col("ACQUISITION_BASIS"), F.col("basis_gbp"))
    out = out.withColumn("effective_basis_gbp", basis).withColumn("effective_uplift", F.col("land_mid") - basis)
    out = out.withColumn("effective_expected_uplift", F.col("probability") * F.col("effective_uplift"))
    out = out.withColumn("effective_manual_review", F.when(F.col("REVIEW_DISPOSITION").isNotNull(), F.col("REVIEW_DISPOSITION") > 0).otherwise(F.col("manual_review")))
    return out.withColumn("ranking_suppressed", F.coalesce(F.col("RANKING_SUPPRESSION") > 0, F.lit(False))).drop(*kinds)
