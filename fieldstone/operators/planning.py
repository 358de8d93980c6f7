"""Planning: spatial links of sites, coverage, extant permission, historical labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import numeric as N
from ..functions import text as T
from ..sources.scratch import superseded, written
from .containment import contained
from .kinds import blocks, pairs_within
from .latest import effective_on, latest_per_key

#: Fixed values.
MANDATORY = ("BOROUGH_REGISTER", "PRIOR_APPROVAL", "BROWNFIELD")
ACTIVE_ROUTES = ("FULL", "OUTLINE", "PIP", "PRIOR_APPROVAL")
ACTIVE_DECISIONS = ("FULL_RESIDENTIAL", "OUTLINE_RESIDENTIAL", "PIP", "TDC", "PRIOR_APPROVAL_RESIDENTIAL", "ORDER_BASED_RESIDENTIAL")
ACTIVE_STATUSES = ("ACTIVE", "IMPLEMENTABLE", "APPROVED")
CLOSED_STATUSES = ("LAPSED", "EXPIRED", "WITHDRAWN", "REFUSED", "CLOSED")
POSITIVE_DECISIONS = ("APPROVED", "ALLOWED", "CONDITIONAL GRANT")
NEGATIVE_DECISIONS = ("REFUSED", "DISMISSED")
EXCLUDED_STATUSES = ("WITHDRAWN", "INVALID", "DUPLICATE", "CLOSED")
WINDOW_MONTHS, CASE_DAYS, CASE_M = 18, 45, 30.0
APPLICATION_M, CONSTRAINT_M, PROFILE_M = 50.0, 50.0, 20.0
MATERIAL_SHARE, MATERIAL_SQM = 0.10, 100.0
TRIVIAL_SHARE, TRIVIAL_SQM = 0.05, 100.0
TITLE_SCORE = 0.75


def spatial_matches(sites: DataFrame, features: DataFrame, near_m: float = 0.0, site_id: str = "site_id", feature_id: str = "feature_id") -> DataFrame:
    """site_id, feature_id, link_type, overlap_sqm, overlap_pct and distance_m of features (column shape) that meet a site or lie near it.

    Polygons match where they meet, even if they only touch; points within the site or within near_m of it.
    """
    pairs = G.near_shapes(sites, features, max(near_m, 0.001))
    own, other = F.col("left_shape"), F.col("right_shape")
    sqm, corner = G.pair_overlap(), lambda a, b: F.exists(F.flatten(a), lambda p: G.distance_to(b, p) <= 0.001)
    polygons = pairs.where(~G.is_point(other) & ~G.is_point(own)).withColumn("sqm", sqm).withColumn("meets", F.when(F.col("sqm") > 0, True).otherwise(corner(own, other) | corner(other, own)))
    whole = polygons.groupBy(*G.MARKS).agg(F.first("left_area").alias("left_area"), F.sum("sqm").alias("sqm"), F.max("meets").alias("meets"))
    touching = whole.where("meets").withColumns({"distance_m": F.lit(0.0), "link_type": F.lit("POLYGON_INTERSECTS")})
    points = pairs.where(G.is_point(other)).withColumn("distance_m", G.pair_distance()).groupBy(*G.MARKS).agg(F.first("left_area").alias("left_area"), F.min("distance_m").alias("distance_m"))
    points = points.where(F.col("distance_m") <= near_m).withColumn("sqm", F.lit(0.0)).withColumn("link_type", F.when(F.col("distance_m") == 0, "POINT_WITHIN_SITE").otherwise("POINT_NEAR_SITE"))
    # written, so that giving them to their rows, of which there may be very many, is all that is left to do
    out = G.with_ids(written(touching.drop("meets").unionByName(points), "matches"), sites, features, site_id, feature_id)
    share = F.coalesce(F.try_divide("sqm", "left_area"), F.lit(0.0))
    return out.select(F.col("left_id").alias(site_id), F.col("right_id").alias(feature_id), "link_type", F.col("sqm").alias("overlap_sqm"), share.alias("overlap_pct"), "distance_m")


def link_confidence(link_type: Column) -> Column:
    return F.when(link_type == "POLYGON_INTERSECTS", "HIGH").when(link_type == "POINT_WITHIN_SITE", "MEDIUM").otherwise("LOW")


def lpa_shares(overlaps: DataFrame) -> DataFrame:
    """site overlaps (site_id, lpa_id, lpa_name, sqm, pct) with is_primary and the site's crossing: NONE, TRIVIAL or MATERIAL, and its borough."""
    ranked = overlaps.withColumn("n", F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("sqm"), F.desc("pct"), F.desc("lpa_name"))))
    whole = Window.partitionBy("site_id")
    rest_sqm = F.sum(F.when(F.col("n") > 1, F.col("sqm")).otherwise(0.0)).over(whole)
    rest_pct = F.sum(F.when(F.col("n") > 1, F.col("pct")).otherwise(0.0)).over(whole)
    several = F.max("n").over(whole) > 1
    crossing = F.when(~several, "NONE").when((rest_pct < TRIVIAL_SHARE) & (rest_sqm < TRIVIAL_SQM), "TRIVIAL").otherwise("MATERIAL")
    first = F.max(F.when(F.col("n") == 1, F.col("lpa_id"))).over(whole)
    out = ranked.withColumn("crossing", crossing).withColumn("first", first)
    return out.select("site_id", "lpa_id", "sqm", "pct", (F.col("n") == 1).alias("is_primary"), "crossing", F.when(F.col("crossing") != "MATERIAL", F.col("first")).alias("borough_id"))


def title_candidates(sites: DataFrame, titles: DataFrame) -> DataFrame:
    """site_id, title_number and score of titles by address (equal .95, one within the other .8) or by the site's point (1.0); the best of each, .75 or more."""
    # rows alike but for their ids have the same matches: these are found and scored once, then given to the rows
    s, own_rows = kinds(sites.select("site_id", "address", "spot"), "site_id")
    t, their_rows = kinds(titles.select("title_number", "address", "shape"), "title_number")
    own, theirs = s.where("address <> ''").select("site", "address"), t.where("address <> ''").select("title", "address")
    equal = own.join(theirs, "address").select("site", "title", F.lit(0.95).alias("score"))
    as_part, as_whole = (lambda df: df.select(F.col("address").alias("part"))), (lambda df: df.select(F.col("address").alias("whole")))
    inner = contained(as_part(own), as_whole(theirs)).toDF("site_address", "title_address")
    outer = contained(as_part(theirs), as_whole(own)).toDF("title_address", "site_address")
    pairs = written(inner.unionByName(outer), "within")  # of different addresses; their sites and titles join them
    partly = own.join(pairs, F.col("address") == F.col("site_address")).drop("address").join(theirs, F.col("address") == F.col("title_address"))
    partly = partly.select("site", "title", F.lit(0.8).alias("score"))
    spots = G.near_pairs(s.where("spot is not null").withColumn("shape", G.point_shape(F.col("spot"))), t.where("shape is not null"), "site", "title", 0.001)
    within = spots.where(G.contains(F.col("right_shape"), G.first_corner(F.col("left_shape")))).select(F.col("left_id").alias("site"), F.col("right_id").alias("title"), F.lit(1.0).alias("score"))
    every = equal.unionByName(partly).unionByName(within)
    best = written(every.groupBy("site", "title").agg(F.max("score").alias("score")).where(F.col("score") >= TITLE_SCORE), "titles")
    # an id with several kinds may meet another one by several scores; all others have one and stay where they are made
    own_blocks, theirs_blocks = blocks(with_several(own_rows, "site_id"), "site", "site_id", "several"), blocks(with_several(their_rows, "title_number"), "title", "title_number", "several")
    end = lambda df, kind, key: df.select(kind, F.col("ids").alias(key), F.col("block").alias(f"{kind}_block"), F.col("several").alias(f"{kind}_several"))
    met = best.join(end(own_blocks, "site", "site_id"), "site").join(end(theirs_blocks, "title", "title_number"), "title")
    several = F.col("site_several") | F.col("title_several")
    of = lambda some: pairs_within(some, ["site", "title", "site_block", "title_block", "site_several", "title_several"], "site_id", "title_number", "score")
    once = of(met.where(~several))
    if not any(df.where("several").limit(1).count() for df in (own_blocks, theirs_blocks)):
        return once
    return once.unionByName(of(met.where(several)).groupBy("site_id", "title_number").agg(F.max("score").alias("score")))


def with_several(ids: DataFrame, key: str) -> DataFrame:
    """ids with `several`: whether the key has several rows."""
    many = written(ids.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit(True).alias("several")), "several")
    return ids.join(many, key, "left").fillna({"several": False})


def kinds(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The different rows without their id, numbered in a column named as the id's first word, and the ids with these numbers."""
    name = key.split("_")[0]
    of = rows.select(key, F.struct(*(c for c in rows.columns if c != key)).alias("of"))
    found = written(of.select("of").distinct().withColumn(name, F.monotonically_increasing_id()), f"{name}-kinds")
    return found.select(name, "of.*"), written(of.join(found, "of").select(key, name).distinct(), f"{name}-ids")


def cluster_geometry(polygon: Column, box: Column, official: Column, titles: Column, spot: Column) -> Column:
    """struct(shape, source_type) of the best geometry there is: polygon, box, official titles, title candidates, point."""
    chain = ((polygon, "SOURCE_POLYGON"), (box, "APPROXIMATE_BBOX"), (official, "TITLE_UNION"), (titles, "TITLE_UNION"), (G.point_shape(spot), "POINT_ONLY"))
    return F.coalesce(*(F.when(shape.isNotNull(), F.struct(shape.alias("shape"), F.lit(kind).alias("source_type"))) for shape, kind in chain))


def latest_coverage(coverage: DataFrame, keys: tuple[str, ...] = ("borough_id", "source_family")) -> DataFrame:
    return latest_per_key(coverage, list(keys), F.desc("captured_at"), F.desc("coverage_id"))


def coverage_gaps(sites: DataFrame, coverage: DataFrame) -> DataFrame:
    """site_id and the codes of its mandatory families that are missing, incomplete or stale, from the latest coverage of its borough."""
    families = F.explode(F.array(*[F.lit(x) for x in MANDATORY])).alias("source_family")
    wanted = sites.select("site_id", "borough_id", families)
    latest = latest_coverage(coverage).select("borough_id", "source_family", "coverage_status", "freshness_status")
    joined = wanted.join(latest, ["borough_id", "source_family"], "left")
    codes = N.reasons(
        (F.coalesce(F.col("coverage_status"), F.lit("MISSING")) != "COMPLETE", "INCOMPLETE"),
        (F.coalesce(F.col("freshness_status"), F.lit("FRESH")) == "STALE", "STALE"),
    )
    codes = F.transform(codes, lambda c: F.concat_ws("_", "source_family", c))
    return joined.groupBy("site_id").agg(F.array_sort(F.flatten(F.collect_list(codes))).alias("codes"))


def active_permission(route: Column, decision_type: Column, status: Column, use: Column, expires: Column, active: Column, as_of: Column) -> Column:
    """Whether an application is a residential permission that still holds."""
    residential = F.upper(F.coalesce(use, F.lit(""))).rlike("C3|RESI")
    return F.coalesce(route.isin(*ACTIVE_ROUTES) & decision_type.isin(*ACTIVE_DECISIONS) & status.isin(*ACTIVE_STATUSES) & residential, F.lit(False)) & F.coalesce(expires >= as_of, F.lit(True)) & F.coalesce(active, F.lit(True))


def non_exclusionary(status: Column, lapsed: Column, expires: Column, as_of: Column) -> Column:
    return F.coalesce(status.isin(*CLOSED_STATUSES), F.lit(False)) | F.coalesce(lapsed, F.lit(False)) | F.coalesce(expires < as_of, F.lit(False))


def active_brownfield(part: Column, pip: Column, tdc: Column, starts: Column, ends: Column, as_of: Column) -> Column:
    """Part 1 never; Part 2 with an active permission in principle or details consent that has not ended."""
    live = F.coalesce(F.upper(pip) == "ACTIVE", F.lit(False)) | F.coalesce(F.upper(tdc) == "ACTIVE", F.lit(False))
    return F.coalesce(part == "PART_2", F.lit(False)) & live & effective_on(starts, ends, as_of)


def material_overlap(pct: Column, sqm: Column, access_control: Column, within_core: Column) -> Column:
    return F.coalesce(pct >= MATERIAL_SHARE, F.lit(False)) | F.coalesce(sqm >= MATERIAL_SQM, F.lit(False)) | F.coalesce(access_control, F.lit(False)) | F.coalesce(within_core, F.lit(False))


def extant_permission(flags: DataFrame) -> DataFrame:
    """site_id, status, eligibility and manual_review from per-match flags: source (REGISTER, BROWNFIELD, PLD), active, material; and per-site gaps.

    flags has site_id, source, is_active, is_material and missing_families; a site without matches has one row of nulls.
    """
    active = F.coalesce(F.col("is_active"), F.lit(False))
    official = active & F.col("source").isin("REGISTER", "BROWNFIELD")
    per_site = flags.groupBy("site_id").agg(
        F.bool_or(official & F.coalesce(F.col("is_material"), F.lit(False))).alias("material"), F.bool_or(official).alias("official"),
        F.bool_or(active & (F.col("source") == "PLD")).alias("pld"), F.max(F.coalesce("missing_families", F.lit(0))).alias("missing"),
    )
    status = N.first_that_holds(
        [
            (F.col("material"), "ACTIVE_EXTANT_PERMISSION_FOUND"), (F.col("official"), "NON_MATERIAL_OVERLAP_MANUAL_REVIEW"),
            (F.col("missing") > 0, "UNRESOLVED_MISSING_MANDATORY_SOURCE"), (F.col("pld"), "CONTRADICTORY_SOURCE_MANUAL_REVIEW"),
        ],
        "NO_ACTIVE_PERMISSION_FOUND",
    )
    eligibility = F.when(status == "ACTIVE_EXTANT_PERMISSION_FOUND", "FAIL").when(status == "NO_ACTIVE_PERMISSION_FOUND", "PASS").otherwise("ABSTAIN")
    return per_site.select("site_id", status.alias("status"), eligibility.alias("eligibility"), (eligibility == "ABSTAIN").alias("manual_review"))


def normalized_decision(decision: Column, status: Column) -> Column:
    """One word for a decision text; a text that holds GRANT or APPROV is an approval whatever stands before it."""
    text = F.upper(F.coalesce(T.filled(F.trim(decision)), status, F.lit("")))
    return (
        F.when(text.contains("APPROV") | text.contains("GRANT"), "APPROVED").when(text.contains("ALLOW"), "ALLOWED")
        .when(text.contains("REFUS"), "REFUSED").when(text.contains("DISMISS"), "DISMISSED").when(text.contains("WITHDRAW"), "WITHDRAWN").otherwise(text)
    )


def template_key(units: Column, route: Column) -> Column:
    return (
        F.when(units.between(1, 4) & (route == "FULL"), "resi_1_4_full").when(units.between(5, 9) & (route == "FULL"), "resi_5_9_full")
        .when(units.between(10, 49) & (route == "OUTLINE"), "resi_10_49_outline")
    )


def proposal_form(description: Column, brownfield: Column) -> Column:
    text = F.lower(F.coalesce(description, F.lit("")))
    return (
        F.when(text.contains("backland"), "BACKLAND").when(text.contains("infill"), "INFILL")
        .when(F.coalesce(brownfield, F.lit(False)) | text.rlike("yard|garage|brownfield"), "BROWNFIELD_REUSE").otherwise("REDEVELOPMENT")
    )


def archetype(template: Column, form: Column, heritage: Column, brownfield: Column, flood: Column) -> Column:
    word = lambda flag, name: F.when(F.coalesce(flag, F.lit(False)), name).otherwise(f"no_{name}")
    return F.concat_ws(":", template, form, word(heritage, "heritage"), word(brownfield, "brownfield"), word(flood, "flood"))


def irrelevance(route: Column, decision_type: Column, use: Column) -> Column:
    """Why an application is no case for labelling; null if it is one."""
    kind = F.upper(F.coalesce(decision_type, F.lit("")))
    return N.first_that_holds(
        [
            (route.startswith("PRIOR_APPROVAL"), "PRIOR_APPROVAL"), (F.upper(route).contains("APPEAL") | kind.contains("APPEAL"), "APPEAL"),
            ((kind != "") & ~kind.contains("RESIDENTIAL") & (F.coalesce(use, F.lit("")) != "C3"), "NOT_RESIDENTIAL"),
        ],
        None,
    )


def case_class(duplicate: Column, irrelevant: Column, template: Column, decision: Column, valid: Column, decided: Column, status: Column) -> Column:
    """EXCLUDED, POSITIVE, NEGATIVE or CENSORED: decisions count within eighteen months of validity, both ends included."""
    in_window = F.coalesce((decided >= valid) & (decided <= F.add_months(valid, WINDOW_MONTHS)), F.lit(False))
    return (
        F.when(F.coalesce(duplicate, F.lit(False)) | irrelevant.isNotNull() | template.isNull(), "EXCLUDED")
        .when(decision.isin(*POSITIVE_DECISIONS), F.when(in_window, "POSITIVE").otherwise("CENSORED"))
        .when(decision.isin(*NEGATIVE_DECISIONS), F.when(in_window, "NEGATIVE").otherwise("CENSORED"))
        .when(F.upper(status).isin(*EXCLUDED_STATUSES), "EXCLUDED")
        .otherwise("CENSORED")
    )


def stronger_cases(weaker: DataFrame, stronger: DataFrame) -> DataFrame:
    """case_id and stronger_id: of each weaker case the first labelled stronger one that is the same case.

    Same borough, units and route (with a span of days the join key), valid within 45 days, and overlapping by half of the smaller polygon, or, with a point on either
    side, within 30 m or of the same description.
    """
    sized = lambda df: df.withColumns({"box": G.bounds(F.col("shape")), "is_box": F.coalesce(G.is_box(F.col("shape")), F.lit(False)), "area": G.area(F.col("shape"))})
    # the span of days is a key too: a case looks into its own span and those before and after
    span = F.floor(F.unix_date("valid_date") / CASE_DAYS)
    a = sized(weaker).withColumn("span", F.explode(F.array(span - 1, span, span + 1))).alias("a")
    b = sized(stronger).withColumn("span", span).alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("borough_id", "units", "route", "span")]
    near = a.join(b, [*on, N.dates_close(F.col("a.valid_date"), F.col("b.valid_date"), CASE_DAYS)])
    bare = F.col("a.shape").isNull() | F.col("b.shape").isNull()
    points = G.is_point(F.col("a.shape")) | G.is_point(F.col("b.shape"))
    boxes = F.col("a.is_box") & F.col("b.is_box")
    gap = F.least(G.distance_to(F.col("a.shape"), G.first_corner(F.col("b.shape"))), G.distance_to(F.col("b.shape"), G.first_corner(F.col("a.shape"))))
    same_text = F.col("a.signature") == F.col("b.signature")
    # one pass over the pairs: only general polygons have anything for the batch function to do
    general = ~bare & ~points & ~boxes
    other = G.overlap_area(F.when(general, F.col("a.shape")), F.when(general, F.col("b.shape")))
    sized_pairs = near.withColumn("shared", F.when(boxes, G.box_overlap(F.col("a.box"), F.col("b.box"))).otherwise(other))
    alike = (F.col("shared") > 0) & ((F.col("shared") >= 0.5 * F.least(F.col("a.area"), F.col("b.area"))) | same_text)
    same = sized_pairs.where(F.when(bare, same_text).when(points, (gap <= CASE_M) | same_text).otherwise(alike))
    found = same.select(F.col("a.case_id").alias("case_id"), F.col("b.case_id").alias("stronger_id"), F.col("b.priority").alias("p"), F.col("b.valid_date").alias("v"), F.col("b.external_ref").alias("x"))
    return latest_per_key(found, ["case_id"], F.desc("p"), F.asc_nulls_last("v"), F.asc("x")).select("case_id", "stronger_id")


def label_cases(applications: DataFrame) -> DataFrame:
    """case_id, label_class, stronger_id and first_decision_date of applications.

    Columns: case_id, external_ref, priority, borough_id, units, route, decision, decision_type, status, use, valid_date, decision_date, description, shape.
    Only cases of a strictly higher priority that are already positive or negative make another one a duplicate, so priorities are labelled
    from the highest down, one join for each.
    """
    cases = applications.withColumns({
        "signature": T.signature(F.coalesce("description", F.lit(""))), "template": template_key(F.col("units"), F.col("route")),
        "normalized": normalized_decision(F.col("decision"), F.col("status")), "irrelevant": irrelevance(F.col("route"), F.col("decision_type"), F.col("use")),
    })
    label = lambda duplicate: case_class(duplicate, F.col("irrelevant"), F.col("template"), F.col("normalized"), F.col("valid_date"), F.col("decision_date"), F.col("status"))
    cases = written(cases, "cases")
    done, priority = None, cases.agg(F.max("priority")).first()[0]
    while True:  # a round for each kind of source; cases without a priority come last
        level = cases.where(F.col("priority").eqNullSafe(F.lit(priority)))
        if done is None:
            found = level.withColumn("stronger_id", F.lit(None).cast(level.schema["case_id"].dataType))
        else:
            known = stronger_cases(level, done.where(F.col("label_class").isin("POSITIVE", "NEGATIVE")))
            found = level.join(known, "case_id", "left")
        labelled = found.withColumn("label_class", label(F.col("stronger_id").isNotNull()))
        before, done = done, written(labelled if done is None else done.unionByName(labelled), "labels")
        if before is not None:
            superseded(before)
        if priority is None:
            break
        priority = cases.where(F.col("priority") < priority).agg(F.max("priority")).first()[0]
    return done.select("case_id", "label_class", "stronger_id", F.col("decision_date").alias("first_decision_date"))
