"""Sites from listing clusters: geometry by fallback, authority and title links, revisions, runtime filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import numeric as N
from . import planning


def within_authorities(listings: DataFrame, boundaries: DataFrame, required: list[str]) -> DataFrame:
    """listings (listing_id, spot) with passes and reason: a listing passes if its point is in a required authority.

    If a required authority has no boundary nothing passes.
    """
    wanted = boundaries.where(F.col("lpa_id").isin(*required))
    missing = len(set(required)) - wanted.select("lpa_id").distinct().count()
    points = listings.where("spot is not null").select("listing_id", G.point_shape(F.col("spot")).alias("shape"))
    pairs = G.near_pairs(points, wanted, "listing_id", "lpa_id", 0.001)
    hits = pairs.where(G.contains(F.col("right_shape"), G.first_corner(F.col("left_shape")))).select(F.col("left_id").alias("listing_id")).distinct().withColumn("__in", F.lit(True))
    joined = listings.join(hits, "listing_id", "left")
    reason = N.first_that_holds([(F.lit(missing > 0), "BOUNDARY_MISSING"), (F.col("spot").isNull(), "NO_COORDINATES"), (F.col("__in").isNull(), "OUTSIDE_AUTHORITIES")], None)
    return joined.withColumn("reason", reason).withColumn("passes", F.col("reason").isNull()).drop("__in")


def build(clusters: DataFrame, boundaries: DataFrame) -> DataFrame:
    """site_id, shape, source_type, geometry_hash, area_sqm, geom_confidence, status, borough_id and crossing of clusters.

    clusters: site_id, polygon, box, official, titles (shapes or null) and spot. Clusters without any geometry give no site.
    """
    chosen = planning.cluster_geometry(*(F.col(c) for c in ("polygon", "box", "official", "titles", "spot")))
    sites = clusters.withColumn("g", chosen).where("g is not null").select("site_id", "g.shape", "g.source_type")
    sites = sites.withColumns({"geometry_hash": G.geometry_hash(F.col("shape")), "area_sqm": G.area(F.col("shape")), "geom_confidence": G.confidence(F.col("source_type"), F.col("shape"))})
    pairs = G.near_pairs(sites, boundaries, "site_id", "lpa_id", 0.001, cell=5_000.0)
    names = boundaries.select(F.col("lpa_id").alias("right_id"), F.col("name").alias("lpa_name"))
    spot = G.is_point(F.col("left_shape")) & G.contains(F.col("right_shape"), G.first_corner(F.col("left_shape")))
    each = pairs.withColumn("sqm", G.pair_overlap()).groupBy(*G.PAIR).agg(F.first("left_area").alias("left_area"), F.sum("sqm").alias("sqm"), F.max(spot).alias("spot"))
    shares = each.where("sqm > 0 or spot").join(names, "right_id")
    found = shares.select(F.col("left_id").alias("site_id"), F.col("right_id").alias("lpa_id"), "lpa_name", "sqm", F.coalesce(F.try_divide("sqm", "left_area"), F.lit(0.0)).alias("pct"))
    links = planning.lpa_shares(found).where("is_primary").select("site_id", "borough_id", "crossing")
    out = sites.join(links, "site_id", "left")
    return out.withColumn("status", G.site_status(F.col("geom_confidence"), F.coalesce(F.col("crossing") == "MATERIAL", F.lit(False))))


def revisions(sites: DataFrame, held: DataFrame) -> DataFrame:
    """held revisions (site_id, revision, geometry_hash) and a further one for each site whose geometry differs from its last."""
    last = held.groupBy("site_id").agg(F.max("revision").alias("__n"), F.max_by("geometry_hash", "revision").alias("__hash"))
    fresh = sites.join(last, "site_id", "left").where(~F.col("geometry_hash").eqNullSafe(F.col("__hash")))
    return held.unionByName(fresh.select("site_id", (F.coalesce("__n", F.lit(0)) + 1).alias("revision"), "geometry_hash"))
