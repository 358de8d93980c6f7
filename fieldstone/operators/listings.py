"""Listings: parsing rows, search, source-fit rules, entity resolution into clusters."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import numeric as N
from ..functions import text as T
from ..functions.markup import page
from ..sources.scratch import written
from .components import connected_components, extended_components
from .kinds import blocks, pairs_within
from .latest import latest_per_key, top_per_key
from .resolution import NEAR_M, cells, judged, links

#: Fixed values.
ALIASES = {
    "headline": ("headline", "title", "name"),
    "description": ("description", "details", "summary"),
    "url": ("canonical_url", "url", "link"),
    "source_listing_id": ("source_listing_id", "listing_id", "id", "reference", "ref"),
    "price_text": ("guide_price_gbp", "price", "guide_price"),
    "address": ("address", "address_text", "location"),
    "lat": ("lat", "latitude"),
    "lon": ("lon", "longitude"),
}
BUILD_TYPES, BUILD_STATUSES = ("LAND", "LAND_WITH_BUILDING", "REDEVELOPMENT_SITE"), ("LIVE", "AUCTION")
CLUSTER_NAMESPACE = T.namespace("listing-cluster")


def from_table(rows: DataFrame, source: str) -> DataFrame:
    """Listings from a feed with free headers: trimmed lower-case names, aliases by first that is filled."""
    named = rows.toDF(*[c.strip().lower() for c in rows.columns])

    def first(field: str) -> Column:
        found = [T.normalize_space(F.col(f"`{c}`").cast("string")) for c in ALIASES[field] if c in named.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    numbered = named.withColumn("__row", F.monotonically_increasing_id())
    url = F.coalesce(T.normalize_url(first("url")), F.concat(F.lit(f"csv://{source}/row-"), F.col("__row") + 1))
    price_text = F.concat(F.lit("£"), F.regexp_replace(first("price_text"), "^£", ""))
    basis = F.concat_ws(" ", first("price_text"), first("description"), first("headline"))
    out = numbered.select(
        F.coalesce(first("source_listing_id"), url).alias("source_listing_id"), url.alias("url"), first("headline").alias("headline"),
        first("description").alias("description"), first("address").alias("address"), first("lat").try_cast("double").alias("lat"), first("lon").try_cast("double").alias("lon"),
        F.coalesce(T.parse_price(price_text), T.parse_price(first("description")), T.parse_price(first("headline"))).alias("price_gbp"), T.price_basis(basis).alias("price_basis"),
    )
    return with_derived(out)


def from_pages(pages: DataFrame) -> DataFrame:
    """Listings from pages (url, html): JSON-LD, then metadata, then headings, then text."""
    pages = pages.withColumn("__page", page(F.col("html")))
    whole, ld = H.text_of(F.col("__page")), H.json_ld_of(F.col("__page"))
    field = lambda *paths: H.first_field(ld, *paths)
    place = H.place(F.col("html"))
    out = pages.select(
        T.normalize_url(F.col("url")).alias("source_listing_id"), T.normalize_url(F.col("url")).alias("url"),
        F.coalesce(H.saying(field("$.name")), H.headline_of(F.col("__page"))).alias("headline"), F.coalesce(field("$.description"), H.description_of(F.col("__page"))).alias("description"),
        F.coalesce(field("$.address.streetAddress", "$.address.addressLocality", "$.address.postalCode"), T.postcode(whole)).alias("address"),
        F.coalesce(field("$.geo.latitude").try_cast("double"), place["lat"]).alias("lat"), F.coalesce(field("$.geo.longitude").try_cast("double"), place["lon"]).alias("lon"),
        F.coalesce(field("$.offers.price").try_cast("double").cast("long"), T.parse_price(whole)).alias("price_gbp"), T.price_basis(whole).alias("price_basis"),
    )
    return with_derived(out)


def with_derived(listings: DataFrame) -> DataFrame:
    texts = (F.col("headline"), F.col("description"))
    return listings.withColumns({
        "status": T.listing_status(*texts), "listing_type": T.listing_type(*texts), "normalized_address": T.normalize_address(F.col("address")),
        "auction_date": T.parse_date(F.col("description")), "search_text": T.join_text(*texts, F.col("address")),
    })


def search(listings: DataFrame, q: str | None = None, fields: tuple[str, ...] = ("headline", "address", "search_text"), equal: dict[str, str] | None = None, price: str = "price_gbp", min_price: float | None = None, max_price: float | None = None) -> DataFrame:
    """Rows in which any field holds q (case ignored), with equal columns and a price in bounds; a missing price fails a bound."""
    tests = [F.col(c) == v for c, v in (equal or {}).items()]
    if q:
        escaped = q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        tests.append(reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{escaped}%"), F.lit(False)) for c in fields]))
    if min_price is not None:
        tests.append(F.col(price) >= min_price)
    if max_price is not None:
        tests.append(F.col(price) <= max_price)
    return listings.where(reduce(lambda a, b: a & b, tests)) if tests else listings


def source_fit(policy: dict, text: str = "search_text") -> Column:
    """A conjunction of the optional rules of a source's policy; an absent rule passes."""
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    marks = lambda words: [lower.contains(w.lower()) for w in words]
    tests = [F.lit(True)]
    for column, key in (("status", "statuses"), ("listing_type", "types")):
        if policy.get(key):
            tests.append(F.coalesce(F.col(column).isin(*policy[key]), F.lit(False)))
    if policy.get("any_text"):
        tests.append(reduce(lambda a, b: a | b, marks(policy["any_text"])))
    tests += marks(policy.get("all_text", ())) + [~x for x in marks(policy.get("none_text", ()))]
    tests += [F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in policy.get("required", ())]
    if policy.get("bbox"):
        west, south, east, north = policy["bbox"]
        tests.append(F.coalesce(F.col("lon").between(west, east) & F.col("lat").between(south, north), F.lit(False)))
    for column, low, high in policy.get("ranges", ()):
        tests.append(F.coalesce(F.col(column).between(low, high), F.lit(False)))
    return reduce(lambda a, b: a & b, tests)


def compliance(job: Column, mode: Column, active: Column) -> Column:
    """Why a job may not run on a source; null if it may."""
    allowed = (
        F.when(job == "MANUAL", mode.isin("MANUAL_ONLY", "COMPLIANT_AUTOMATED"))
        .when(job == "CSV", mode.isin("CSV_ONLY", "MANUAL_ONLY"))
        .otherwise(mode == "COMPLIANT_AUTOMATED")
    )
    return F.when(~F.coalesce(active, F.lit(False)), "SOURCE_INACTIVE").when(~F.coalesce(allowed, F.lit(False)), "MODE_NOT_ALLOWED")


def merge_observations(seen: DataFrame, keys: tuple[str, ...] = ("source_id", "source_listing_id"), at: str = "observed_at", tie: str | None = None) -> DataFrame:
    """One item for each key: first and last time seen, in any order of arrival, and the columns of the last (of several at one time, the one with the greatest tie)."""
    rest, last = [c for c in seen.columns if c not in (*keys, at)], F.struct(at, tie) if tie else F.col(at)
    return seen.groupBy(*keys).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"), *(F.max_by(c, last).alias(c) for c in rest))


def candidate_pairs(listings: DataFrame, highest_lat: float = 61.0, keyed: str | None = None) -> DataFrame:
    """l and r (listing structs, l.id < r.id) of all pairs that share an address or a neighbourhood (and a further column), each once, from an equi-join on keys.

    For reports on pairs: as many as there are, so quadratic in an address. Clusters, confidences and reasons come from resolution.links, which are not.
    """
    whole = listings.select(F.struct("id", "url", "hashes", "address", "words", "price", "lat", "lon").alias("me"))
    step_lat = NEAR_M / 111_000.0 * 1.02
    step_lon = step_lat / math.cos(math.radians(highest_lat))
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    placed = whole.where("me.lat is not null and me.lon is not null").withColumn("cx", F.floor(F.col("me.lon") / step_lon)).withColumn("cy", F.floor(F.col("me.lat") / step_lat))
    shifted = placed.withColumn("d", F.explode(offsets)).select("me", F.concat_ws(":", F.lit("cell"), F.col("cx") + F.col("d.i"), F.col("cy") + F.col("d.j")).alias("key"))
    addressed = whole.where("me.address is not null").select("me", F.concat(F.lit("address:"), "me.address").alias("key"))
    left = addressed.unionByName(placed.select("me", F.concat_ws(":", F.lit("cell"), "cx", "cy").alias("key"))).withColumnRenamed("me", "l")
    right = addressed.unionByName(shifted).withColumnRenamed("me", "r")
    if keyed:
        left, right = left.withColumn("also", F.col(f"l.{keyed}")), right.withColumn("also", F.col(f"r.{keyed}"))
    pairs = left.join(right, ["key", "also"] if keyed else ["key"]).where(F.col("l.id") < F.col("r.id"))
    once = F.col("key").startswith("address:") | ~F.coalesce(F.col("l.address") == F.col("r.address"), F.lit(False))
    return pairs.where(once).select("l", "r")


def shared_key_edges(keyed: DataFrame, score: float, reason: str) -> DataFrame:
    """Edges from each row (id, key) to the first id of its key: they join a key's rows without pairing them all."""
    first = keyed.groupBy("key").agg(F.min("id").alias("left_id"))
    joined = keyed.withColumnRenamed("id", "right_id").join(first, "key").where("left_id <> right_id")
    return joined.select("left_id", "right_id", F.lit(score).alias("score"), F.array(F.lit(reason)).alias("reasons"))


def accepted_pairs(listings: DataFrame) -> DataFrame:
    """left_id, right_id, score and reasons of all pairs of candidate_pairs that are links.

    Listings that differ in nothing but id and url are judged once, as two of another url, and their pairs follow; pairs of one url are judged for themselves.
    """
    facts = ["hashes", "address", "words", "price", "lat", "lon"]
    rows = listings.select("id", "url", F.struct(*facts).alias("of"))
    kinds = written(rows.select("of").distinct().select(F.monotonically_increasing_id().alias("id"), F.lit(None).cast("string").alias("url"), "of"), "kinds")
    urls = rows.where("url <> ''").groupBy("url").agg(F.count("*").alias("n")).where("n > 1").select("url")
    urls = written(urls.withColumn("url_no", F.monotonically_increasing_id()), "urls")  # those of several listings
    members = rows.join(kinds.select("of", F.col("id").alias("kind")), "of").join(urls, "url", "left")
    members = written(members.select("kind", "id", "url_no"), "members")
    each = kinds.select("id", "url", "of.*")
    itself = F.struct("id", "url", *facts)
    alone = each.where("address is not null or (lat is not null and lon is not null)").select(itself.alias("l"), itself.alias("r"))
    links_of = judged(candidate_pairs(each).unionByName(alone))
    found = written(links_of.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), "link"), "judged")
    # a block's listings are of one kind and of one url, or of urls that nothing else has: two blocks are of one url or not, as a whole
    held = blocks(members, "kind", "id", "url_no")
    end = lambda kind, name: held.select(F.col("kind").alias(kind), F.col("ids").alias(name), F.col("block").alias(f"{name}_block"), F.col("url_no").alias(f"{name}_url"))
    met = found.join(end("a", "x"), "a").join(end("b", "y"), "b").where("not coalesce(x_url = y_url, false)")
    # of one kind's two different blocks one order is enough
    at = lambda name: F.struct(F.coalesce(F.col(f"{name}_url"), F.lit(-1)), f"{name}_block")
    met = met.withColumns({"one_kind": F.col("a") == F.col("b"), "one_block": (F.col("a") == F.col("b")) & (at("x") == at("y"))}).where(~F.col("one_kind") | (at("x") <= at("y")))
    pairs = pairs_within(met, ["a", "b", "x_block", "y_block", "x_url", "y_url"], "x", "y", "one_kind", "one_block", "link")
    pairs = pairs.where(~F.col("one_kind") | (F.col("x") < F.col("y")) | (~F.col("one_block") & (F.col("x") > F.col("y"))))
    twins = judged(candidate_pairs(listings.join(urls, "url", "left_semi"), keyed="url"))
    out = pairs.select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"), "link")
    return out.unionByName(twins.select(F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), "link")).select("left_id", "right_id", "link.score", "link.reasons")


def clusters(listings: DataFrame, edges: DataFrame) -> DataFrame:
    """id, cluster_root, confidence and reasons of each listing; one that joins no other is sure of itself."""
    roots = connected_components(edges.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")))
    ends = edges.select(F.explode(F.array("left_id", "right_id")).alias("id"), "score", F.explode("reasons").alias("reason"))
    own = ends.groupBy("id").agg(F.max("score").alias("confidence"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    joined = listings.select("id").join(roots, F.col("id") == F.col("node"), "left").join(own, "id", "left")
    return joined.select("id", F.coalesce("root", "id").alias("cluster_root"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("reasons", F.array(F.lit("singleton"))).alias("reasons"))


def resolved(listings: DataFrame) -> DataFrame:
    """id, cluster_root, confidence and reasons of listings (id, url, hashes, address, words, price, lat, lon)."""
    return clusters(listings, written(links(listings), "links"))


def sharing(listings: DataFrame, new: DataFrame) -> DataFrame:
    """The listings that have an address, url, document or neighbourhood in common with one of the new ones."""
    def keys(df: DataFrame, around: bool) -> DataFrame:
        place = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), cells(F.col("lat").cast("double"), F.col("lon").cast("double"), around))
        named = [F.when(F.col(c) != "", F.array(F.xxhash64(F.lit(c), c))) for c in ("address", "url")]
        documents = F.transform("hashes", lambda h: F.xxhash64(F.lit("document"), h))
        none = F.array().cast("array<bigint>")
        return df.select("id", F.explode(F.array_distinct(F.concat(*(F.coalesce(x, none) for x in (*named, documents, place))))).alias("key"))

    touched = keys(listings, False).join(written(keys(new, True).select("key").distinct(), "keys"), "key", "left_semi").select("id").distinct()
    return listings.join(touched, "id", "left_semi")


def extended(held: DataFrame, listings: DataFrame, new: DataFrame) -> DataFrame:
    """What of held (id, cluster_root, confidence, reasons of listings) changes, and the rows of the new listings, when these are added.

    Only listings that share something with a new one are looked at again, and only their links are judged; clusters that no new link touches keep their rows.
    """
    whole = written(sharing(listings, new).unionByName(new.select(*listings.columns)), "touched")
    edges = written(links(whole), "links")
    roots = held.select(F.col("id").alias("node"), F.col("cluster_root").alias("root"))
    moved = extended_components(roots, edges.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))).select(F.col("node").alias("id"), F.col("root").alias("__root"))
    ends = edges.select(F.explode(F.array("left_id", "right_id")).alias("id"), "score", F.explode("reasons").alias("reason"))
    said = ends.groupBy("id").agg(F.max("score").alias("__score"), F.collect_set("reason").alias("__reasons"))
    before = held.unionByName(new.select("id", F.col("id").alias("cluster_root"), F.lit(1.0).alias("confidence"), F.array(F.lit("singleton")).alias("reasons")))
    alone, none = F.array_contains("reasons", "singleton"), F.array().cast("array<string>")
    now = before.join(moved, "id", "left").join(said, "id", "left").join(new.select("id", F.lit(True).alias("__new")), "id", "left")
    linked = F.col("__score").isNotNull()
    after = now.select(
        "id", F.coalesce("__root", "cluster_root").alias("cluster_root"), F.when(linked & alone, F.col("__score")).when(linked, F.greatest("confidence", "__score")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(linked, F.array_sort(F.array_union(F.when(alone, none).otherwise(F.col("reasons")), F.col("__reasons")))).otherwise(F.col("reasons")).alias("reasons"),
        F.struct("cluster_root", "confidence", "reasons").alias("was"), F.coalesce("__new", F.lit(False)).alias("new"),
    )
    return after.where(F.col("new") | (F.col("was") != F.struct("cluster_root", "confidence", "reasons"))).drop("was", "new")


def cluster_keys(members: DataFrame) -> DataFrame:
    """cluster_root, key and cluster_id: a stable id of the sorted members."""
    listed = members.groupBy("cluster_root").agg(F.array_sort(F.collect_list(F.col("id").cast("string"))).alias("ids"))
    key = F.concat(F.lit("listing-cluster:"), F.sha1(F.array_join("ids", "|").cast("binary")))
    return listed.select("cluster_root", key.alias("key"), T.uuid5(CLUSTER_NAMESPACE, key).alias("cluster_id"))


def current_listing(members: DataFrame) -> DataFrame:
    """Each cluster's listing that was seen last, then is surest, then has the greatest id."""
    return latest_per_key(members, ["cluster_root"], F.desc_nulls_last("last_seen_at"), F.desc("confidence"), F.desc("id"))


def build_candidates(members: DataFrame) -> DataFrame:
    """Clusters whose current listing may become a site: type, status, and a place or address."""
    now = current_listing(members)
    placed = (F.col("lat").isNotNull() & F.col("lon").isNotNull()) | F.col("normalized_address").isNotNull()
    return now.where(F.col("listing_type").isin(*BUILD_TYPES) & F.col("status").isin(*BUILD_STATUSES) & placed)


def first_per_id(rows: DataFrame, key: str, position: str) -> DataFrame:
    return latest_per_key(rows, [key], F.asc(position))


def surplus_rows(rows: DataFrame, before: Column, policy: Column, key: str = "id", position: str = "position") -> DataFrame:
    """A register's rows: the first of each id that passes `before`, if it passes the policy too; a first row that fails it still blocks later ones."""
    return first_per_id(rows.where(before), key, position).where(policy)


def surplus_listings(rows: DataFrame, feed_url: str) -> DataFrame:
    """rows of a surplus register (disposal_id, sale_status, property_name, contract_name, land_usage, land_area, floor_area, property_number, street, town, postcode)
    with status, listing_type, address and url.
    """
    area = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    text = F.lower(F.concat_ws(" ", *(T.filled(F.col(c)) for c in ("property_name", "contract_name", "land_usage"))))
    kind = N.first_that_holds(
        [
            ((area("land_area") > 0) & (area("floor_area") <= 0), "LAND"), (text.contains("development") | text.contains("redevelop"), "REDEVELOPMENT_SITE"),
            (F.lower("land_usage").contains("surplus land"), "LAND"),
        ],
        "LAND_WITH_BUILDING",
    )
    address = T.normalize_space(F.concat_ws(", ", *(T.filled(F.trim(F.col(c))) for c in ("property_number", "street", "town", "postcode"))))
    mark = "&" if "?" in feed_url else "?"
    return rows.withColumns({
        "status": F.when(F.lower("sale_status") == "under offer", "UNDER_OFFER").otherwise("LIVE"), "listing_type": kind, "address": address,
        "url": F.concat(F.lit(f"{feed_url}{mark}disposal_id="), F.url_encode(F.col("disposal_id").cast("string"))),
    })


def crawl_candidates(pages: DataFrame, sitemaps: DataFrame, allow: str, most: int, scope: str | None = None) -> DataFrame:
    """source, url and position of pages to fetch: links of seed pages (source, url, html), all or those that a selector holds, then locations of sitemaps (source, xml), that match a pattern.

    Each URL once, at its first place; at most `most` of a source.
    """
    linked = H.links(pages, scope=scope).select(F.col("url").alias("seed"), "target", "position").join(pages.select("source", F.col("url").alias("seed")), "seed")
    linked = linked.select("source", F.col("target").alias("url"), F.lit(0).alias("part"), "seed", "position")
    listed = sitemaps.select("source", F.posexplode(H.sitemap_urls(F.col("xml"))).alias("position", "url"))
    listed = listed.select("source", T.normalize_url(F.col("url")).alias("url"), F.lit(1).alias("part"), F.lit("").alias("seed"), "position")
    every = linked.unionByName(listed).where(F.col("url").rlike(allow))
    first = latest_per_key(every, ["source", "url"], F.asc("part"), F.asc("seed"), F.asc("position"))
    kept = top_per_key(first, ["source"], most, F.asc("part"), F.asc("seed"), F.asc("position"), F.asc("url"), rank="place")
    return kept.select("source", "url", "place")


def relinked(sites: DataFrame, members: DataFrame) -> DataFrame:
    """sites (site_id, cluster_id, current_listing_id) whose current listing has moved on to another cluster follow it."""
    now = members.select(F.col("listing_id").alias("current_listing_id"), F.col("cluster_id").alias("__now"))
    joined = sites.join(now, "current_listing_id", "left")
    moved = F.coalesce(F.col("__now") != F.col("cluster_id"), F.lit(False))
    return joined.select(*(F.col(c) for c in sites.columns if c != "cluster_id"), F.coalesce("__now", "cluster_id").alias("cluster_id"), moved.alias("moved"))


def obsolete(held: DataFrame, fresh: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Keys that a rebuild no longer has."""
    return held.select(key).distinct().join(fresh.select(key).distinct(), key, "left_anti")
