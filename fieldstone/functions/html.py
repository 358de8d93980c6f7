"""Listing pages: text, titles, metadata, JSON-LD, links and places.

Markup is read once a page by markup.page(), a struct whose fields the *_of functions take; what a page's source says in other ways, by patterns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .markup import links_within, page, page_links, selected_texts
from .text import coordinates, filled, normalize_space, normalize_url

#: Marks of documents that belong to no single listing, marks of documents, and marks of maps.
GENERIC_MARKERS = ("common_conditions", "common auction conditions", "auction_notices", "auction notices", "terms_and_conditions")
DOCUMENT_MARKERS, MAP_MARKERS = (".pdf", "pdf.php"), ("map", "site plan", "floor plan", "floorplan")
#: Headlines that say nothing about a listing.
GENERIC_HEADLINES = ("login to see times and book a viewing", "local information", "legal documents", "epc rating", "guide prices and common auction conditions", "addendums")
#: Places in JSON, in attributes, in a call and in a map's link; latitude, then longitude.
PLACE_PATTERNS = (
    r"""(?i)long_lat"\s*:\s*"\{\\?"lat\\?":(-?\d+\.\d+),\\?"lng\\?":(-?\d+\.\d+)\}""",
    r"""(?i)data-lat="\s*(-?\d+\.\d+)\s*"[^>]+data-l(?:ng|on)="\s*(-?\d+\.\d+)\s*\"""",
    r"""(?i)data-lat='\s*(-?\d+\.\d+)\s*'[^>]+data-l(?:ng|on)='\s*(-?\d+\.\d+)\s*'""",
    r"""(?i)loadMap\([^)]*'(-?\d+\.\d+)'[^)]*'(-?\d+\.\d+)'""",
    r"""(?i)[?&]q=(-?\d+\.\d+),(-?\d+\.\d+)""",
)


def whole_entities(html: Column) -> Column:
    """The page with ampersands that begin no entity with a semicolon as text: a name that was cut off or isn't ended stays as it is written."""
    return F.regexp_replace(html, r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)", "&amp;")


def text_of(parts: Column) -> Column:
    return normalize_space(parts["text"])


def text_content(html: Column) -> Column:
    """The page's text without scripts, styles and noscript parts."""
    return text_of(page(html))


def element_text(html: Column, selector: str) -> Column:
    """Text of the first element that a selector fits."""
    return normalize_space(F.get(selected_texts(html, selector), F.lit(0)))


def meta_of(parts: Column, name: str) -> Column:
    return normalize_space(F.try_element_at(parts["metas"], F.lit(name)))


def meta_content(html: Column, name: str) -> Column:
    """content of the first meta tag with this name or property."""
    return meta_of(page(html), name)


def json_ld_of(parts: Column) -> Column:
    blocks = F.transform(parts["records"], F.trim)
    records = F.transform(blocks, lambda b: F.when(b.startswith("["), F.from_json(b, "array<string>")).otherwise(F.array(b)))
    return F.filter(F.flatten(F.filter(records, lambda r: r.isNotNull())), lambda r: r.startswith("{") & F.json_object_keys(r).isNotNull())


def json_ld(html: Column) -> Column:
    """The page's JSON-LD records as JSON texts: all blocks, and the elements of those that are arrays; blocks that are no JSON give none."""
    return json_ld_of(page(html))


def first_field(records: Column, *paths: str) -> Column:
    """The first filled text at the paths (joined with blanks) of JSON records."""
    texts = F.transform(records, lambda r: normalize_space(F.concat_ws(" ", *(F.get_json_object(r, p) for p in paths))))
    return F.get(F.filter(texts, lambda t: t.isNotNull()), F.lit(0))


def place(html: Column) -> Column:
    """struct(lat, lon) from the first pattern that occurs in the page's source, else from its text."""
    found = [[F.regexp_extract(html, pattern, i).try_cast("double") for i in (1, 2)] for pattern in PLACE_PATTERNS]
    return F.coalesce(*(F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon"))) for lat, lon in found), coordinates(html))


def absolute_url(link: Column, base: Column) -> Column:
    site = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"/[^/]*$", "/")
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), link))
        .when(link.startswith("/"), F.concat(site, link))
        .otherwise(F.concat(folder, link))
    )


def links(pages: DataFrame, url: str = "url", html: str = "html", scope: str | None = None) -> DataFrame:
    """url, position (from 0), target and label of each link of each page, in page order; with a scope, of those in elements that this selector fits."""
    every = page_links(F.col(html)) if scope is None else links_within(F.col(html), scope)
    found = pages.select(F.col(url).alias("url"), F.posexplode(every).alias("position", "anchor"))
    link = F.struct(normalize_url(absolute_url(F.trim("anchor.href"), F.col("url"))).alias("target"), normalize_space(F.col("anchor.label")).alias("label"))
    # unfolded as a row of its own, so that tests on it don't repeat the expressions that make it
    return found.select("url", "position", F.explode(F.array(link)).alias("link")).select("url", "position", "link.target", "link.label")


def document_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url, target, label and kind (MAP or BROCHURE) of each page's document links: those with a document's mark in target or label.

    A repeated target comes once: a map if any of its links is one, with that link's label, else with the first label that says something.
    """
    has = lambda marks: F.lower(F.concat_ws(" ", "target", "label")).rlike("|".join(re.escape(m) for m in marks))
    found = links(pages, url, html).where(has(DOCUMENT_MARKERS) & ~has(GENERIC_MARKERS)).withColumn("is_map", has(MAP_MARKERS))
    said = F.col("label").isNotNull()
    merged = found.groupBy("url", "target").agg(
        F.min("position").alias("position"), F.bool_or("is_map").alias("is_map"), F.min_by("label", F.when(said, F.col("position"))).alias("first_label"),
        F.min_by("label", F.when(F.col("is_map"), F.col("position"))).alias("map_label"),
    )
    return merged.select("url", "position", "target", F.coalesce("map_label", "first_label").alias("label"), F.when(F.col("is_map"), "MAP").otherwise("BROCHURE").alias("kind"))


def sitemap_urls(xml: Column) -> Column:
    """The locations of a sitemap, in order."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def saying(headline_text: Column) -> Column:
    return F.when(~F.lower(headline_text).isin(*GENERIC_HEADLINES), headline_text)


def headline_of(parts: Column) -> Column:
    headings = F.transform(parts["headings"], normalize_space)
    first = F.get(F.filter(headings, lambda t: t.isNotNull() & ~F.lower(t).isin(*GENERIC_HEADLINES)), F.lit(0))
    return F.coalesce(saying(meta_of(parts, "og:title")), first, saying(normalize_space(parts["title"])))


def headline(html: Column) -> Column:
    """og:title, else the first h1, else the title; those that say nothing are passed over."""
    return headline_of(page(html))


def description_of(parts: Column) -> Column:
    return F.coalesce(meta_of(parts, "og:description"), meta_of(parts, "description"), filled(text_of(parts)))


def description(html: Column) -> Column:
    return description_of(page(html))
