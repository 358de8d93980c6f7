"""Point-in-time features of sites from planning history and market, with only what was known on the day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import numeric as N
from ..sources.scratch import written
from .latest import decided_by, effective_on, known_by

#: Distance bands in metres; both ends count, so a case at 50 m is in two.
BANDS = {"adjacent": (0, 50), "local_precedent": (50, 250), "local_context": (250, 500)}
REFUSED, APPROVED = "NEGATIVE", "POSITIVE"


def geometry_features(sites: DataFrame) -> DataFrame:
    """site_id, site_area_sqm, site_perimeter_m and site_compactness of sites with a shape."""
    shape = F.col("shape")
    return sites.select("site_id", N.round_half_up(G.area(shape), 3).alias("site_area_sqm"), N.round_half_up(G.perimeter(shape), 3).alias("site_perimeter_m"), N.round_half_up(G.compactness(shape), 6).alias("site_compactness"))


def site_features(sites: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Morphology, location and access of sites (site_id, shape, borough_id, geom_confidence, source_type, manual_review) under their scenario.

    scenarios: site_id, template, units, net_pct, form, route, mix (a JSON text), manual_review, status, is_stale, access_assumption. No transport data is
    kept, so bucket and distance of stations are null.
    """
    s = scenarios.select(
        "site_id", F.col("template").alias("scenario_template_key"), F.col("units").alias("scenario_units_assumed"), N.round_half_up(F.col("net_pct"), 4).alias("scenario_net_developable_area_pct"),
        F.col("form").alias("scenario_proposal_form"), F.col("route").alias("scenario_route_assumed"), F.col("mix").alias("scenario_housing_mix_assumed_json"), F.col("manual_review").alias("scenario_manual_review_required"),
        F.col("status").alias("scenario_status"), F.col("is_stale").alias("scenario_is_stale"), F.coalesce(F.trim("access_assumption") != "", F.lit(False)).alias("access_assumption_present"),
    )
    own = geometry_features(sites).join(sites.select("site_id", "borough_id", "geom_confidence", F.col("source_type").alias("geom_source_type"), F.col("manual_review").alias("site_manual_review_required")), "site_id")
    return own.join(s, "site_id", "left").withColumns({"ptal_bucket": F.lit(None).cast("string"), "distance_to_station_m": F.lit(None).cast("double")})


def asking_price_features(listings: DataFrame) -> DataFrame:
    """site_id and what its current listing (price_gbp, price_basis) asks."""
    known = F.coalesce(F.col("price_basis"), F.lit("UNKNOWN")) != "UNKNOWN"
    return listings.select(
        "site_id", F.col("price_gbp").isNotNull().alias("asking_price_present"), (F.col("price_gbp").isNotNull() & known).alias("asking_price_basis_complete"),
        F.col("price_gbp").alias("current_price_gbp"), F.col("price_basis").alias("current_price_basis_type"),
    )


def on_site_history(links: DataFrame) -> DataFrame:
    """Counts of a site's own applications: links with site_id, as_of, label_class, units, route, status, valid_date, decision_date."""
    seen = links.where(known_by(F.col("valid_date"), F.col("as_of")))
    done = decided_by(F.col("decision_date"), F.col("as_of"))
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    return seen.groupBy("site_id", "as_of").agg(
        count(done & (F.col("label_class") == APPROVED)).alias("onsite_positive_count"), count(done & (F.col("label_class") == REFUSED)).alias("onsite_negative_count"),
        count(F.upper("status") == "WITHDRAWN").alias("onsite_withdrawn_count"), count(F.col("route") == "PRIOR_APPROVAL").alias("prior_approval_history_count"),
        F.max(F.when(done & (F.col("label_class") == APPROVED), F.col("units"))).alias("onsite_max_units_approved"),
        F.max(F.when(done & (F.col("label_class") == REFUSED), F.col("units"))).alias("onsite_max_units_refused"),
    )


def band_counts(pairs: DataFrame, keys: tuple[str, ...] = ("site_id", "as_of"), weight: Column | None = None) -> DataFrame:
    """Decided cases near a site by band and outcome: pairs with site_id, as_of (or other keys), distance_m, label_class, same_template; a pair may stand for several."""
    n = F.lit(1) if weight is None else weight
    count = lambda test: F.sum(F.when(F.coalesce(test, F.lit(False)), n).otherwise(0))
    out = []
    for name, (low, high) in BANDS.items():
        for label, word in ((APPROVED, "approved"), (REFUSED, "refused")):
            out.append(count(F.col("distance_m").between(low, high) & (F.col("label_class") == label)).alias(f"{name}_{word}_{low}_{high}m"))
    out.append(count((F.col("distance_m") <= 500) & (F.col("label_class") == APPROVED) & F.col("same_template")).alias("same_template_positive_500m"))
    return pairs.groupBy(*keys).agg(*out, *([] if weight is None else [F.sum(weight).alias("pairs")]))


def nearby_history(sites: DataFrame, cases: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """band_counts() of labelled cases (case_id, shape, label_class, template, decision_date) within 500 m of sites (site_id, shape, as_of, template), linked ones left out.

    Sites of one place, day and template have the same counts, and cases of one spot, outcome, template and day count as one with their number: these
    meet, not their rows. Of sites with links, what the linked cases add to the counts is taken off again.
    """
    place, spot = ["left_mark", "as_of", "own"], ["right_mark", "label_class", "template", "decision_date"]
    spots = cases.withColumn("shape", G.point_shape(G.first_corner(F.col("shape"))))
    near = G.near_shapes(sites, spots, 500.0, cell=1000.0).withColumn("distance_m", G.pair_distance()).groupBy(*G.MARKS).agg(F.min("distance_m").alias("distance_m"))
    near = written(near.where(F.col("distance_m") <= 500), "near")
    own = sites.select("site_id", G.mark(F.col("shape")).alias("left_mark"), "as_of", F.col("template").alias("own"))
    theirs = spots.select("case_id", G.mark(F.col("shape")).alias("right_mark"), *spot[1:])
    decided = decided_by(F.col("decision_date"), F.col("as_of"))
    alike = (F.col("own") == F.col("template")).alias("same_template")

    full = near.join(own.select(*place).distinct(), "left_mark").join(theirs.groupBy(*spot).agg(F.count("*").alias("n")), "right_mark").where(decided)
    known = band_counts(full.select(*place, "distance_m", "label_class", alike, "n"), tuple(place), F.col("n"))
    on = [F.col(f"o.{c}").eqNullSafe(F.col(f"k.{c}")) for c in place]
    counts = own.alias("o").join(known.alias("k"), on).select("o.site_id", "o.as_of", *(F.col(f"k.{c}") for c in known.columns if c not in place))
    if linked is not None:
        pairs = linked.select("site_id", "case_id").distinct().join(own, "site_id").join(theirs, "case_id").join(near, G.MARKS).where(decided)
        off = band_counts(pairs.select("site_id", "as_of", "distance_m", "label_class", alike), weight=F.lit(1))
        counts = counts.unionByName(off.select("site_id", "as_of", *((-F.col(c)).alias(c) for c in off.columns[2:])))
    values = [c for c in counts.columns if c not in ("site_id", "as_of")]
    return counts.groupBy("site_id", "as_of").agg(*(F.sum(c).alias(c) for c in values)).where("pairs > 0").drop("pairs")


def designation_profile(matches: DataFrame) -> DataFrame:
    """site_id, as_of, families (sorted) and flags of designations in force: matches with site_id, as_of, family, subtype, part, pip, tdc, effective_from, effective_to."""
    live = matches.where(effective_on(F.col("effective_from"), F.col("effective_to"), F.col("as_of")))
    has = lambda test: F.coalesce(F.bool_or(F.coalesce(test, F.lit(False))), F.lit(False))
    family = F.lower("family")
    heritage = lambda kind: (family == "heritage") & (F.lower("subtype") == kind)
    return live.groupBy("site_id", "as_of").agg(
        F.array_sort(F.collect_set("family")).alias("families"), has(family == "article4").alias("has_article4"), has(family.isin("flood", "flood_zone")).alias("has_flood_zone"),
        has((family == "conservation_area") | heritage("conservation_area")).alias("has_conservation_area"), has((family == "listed_building") | heritage("listed_building")).alias("has_listed_building_nearby"), has(family == "site_allocation").alias("has_site_allocation"),
        has(F.col("part") == "PART_1").alias("brownfield_part1"), has((F.col("part") == "PART_2") & ((F.col("pip") == "ACTIVE") | (F.col("tdc") == "ACTIVE"))).alias("brownfield_part2_active"),
        has(F.col("pip") == "ACTIVE").alias("pip_active"), has(F.col("tdc") == "ACTIVE").alias("tdc_active"), F.count(F.when(family == "policy_area", 1)).alias("policy_area_count"),
    )


def borough_rates(spine: DataFrame, cases: DataFrame) -> DataFrame:
    """site_id, as_of and, of cases of its borough and template decided by the day: share positive, number, and median days to decision (whole).

    Cases are counted by day and by days to decision first. Shares and numbers are running sums over days; the median meets each day with the
    different numbers of days to decision of the cases before, with their counts.
    """
    keys = ["borough_id", "template", "as_of"]
    days = spine.select(*keys).distinct()
    decided = cases.where(F.col("label_class").isin(APPROVED, REFUSED) & F.col("decision_date").isNotNull())
    decided = decided.select("borough_id", "template", "decision_date", (F.col("label_class") == APPROVED).alias("won"), F.datediff("decision_date", "valid_date").alias("days"))
    # the first day of the spine that counts a case: what happened between two such days is one sum
    spans = days.groupBy("borough_id", "template").agg(F.array_sort(F.collect_set("as_of")).alias("ends"))
    at = F.expr("get(filter(ends, d -> d >= decision_date), 0)")
    counted = decided.groupBy("borough_id", "template", "decision_date", "days").agg(F.count("*").alias("n"), F.count_if("won").alias("won"))
    first = counted.join(spans, ["borough_id", "template"]).withColumn("as_of", at).where("as_of is not null")
    first = first.groupBy(*keys, "days").agg(F.sum("n").alias("n"), F.sum("won").alias("won"))
    upto = Window.partitionBy("borough_id", "template").orderBy("as_of")
    sums = days.join(first.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("won").alias("won")), keys, "left")
    sums = sums.select(*keys, F.sum("n").over(upto).alias("n"), F.sum("won").over(upto).alias("won")).where("n > 0")
    # of each number of days to decision, the cases up to each day
    kinds = first.where("days is not null").select("borough_id", "template", "days").distinct()
    spread = kinds.join(days, ["borough_id", "template"]).join(first.drop("won"), [*keys, "days"], "left")
    spread = spread.select(*keys, "days", F.sum("n").over(Window.partitionBy("borough_id", "template", "days").orderBy("as_of")).alias("n")).where("n > 0")
    order = Window.partitionBy(*keys).orderBy("days")
    ranked = spread.select(*keys, "days", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy(*keys)).alias("all"))
    low, high = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1
    middle = ranked.groupBy(*keys).agg(((F.min(F.when(F.col("upto") >= low, F.col("days"))) + F.min(F.when(F.col("upto") >= high, F.col("days")))) / 2).alias("median"))
    rates = sums.join(middle, keys, "left").select(
        *keys, N.round_half_up(F.col("won") / F.col("n"), 4).alias("borough_template_positive_rate"), F.col("n").alias("borough_template_case_count"),
        F.floor("median").cast("int").alias("borough_template_median_days_to_decision"),
    )
    return spine.join(rates, keys).select("site_id", "as_of", *(c for c in rates.columns if c not in keys))


def snapshot(spine: DataFrame, families: list[DataFrame], counts: tuple[str, ...] = ()) -> DataFrame:
    """One wide row for each spine row (site_id, as_of): families joined on both keys or on the site alone, missing counts as 0, and a flag for each missing value."""
    out = spine
    for family in families:
        out = out.join(family, [c for c in ("site_id", "as_of") if c in family.columns], "left")
    values = [c for c in out.columns if c not in spine.columns]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in values if c in counts or c.endswith("_count") or c.endswith("m") and c.split("_")[0] in ("adjacent", "local", "same")})
    return out.withColumns({f"{c}_missing": F.col(c).isNull() for c in values})


def historical_spine(cases: DataFrame) -> DataFrame:
    """Cases as sites on the day of their validity: the same features then make training rows."""
    return cases.where("valid_date is not null").select(F.col("case_id").alias("site_id"), F.col("valid_date").alias("as_of"), "borough_id", "template", "shape", "label_class")


def coverage_note(status: Column, freshness: Column) -> Column:
    return F.when(F.coalesce(status, F.lit("MISSING")) == "MISSING", "LOW").when((status != "COMPLETE") | (freshness != "FRESH"), "MEDIUM").otherwise("HIGH")
