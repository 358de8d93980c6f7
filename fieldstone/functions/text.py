"""Column functions on listing and planning text: normalising, parsing, keyword rules, ids and hashes.

All are built-in expressions, so they stay in generated code, but for the last step of canonical JSON. Null in gives null out unless a docstring says otherwise.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, DecimalType, MapType, StringType, StructType, TimestampNTZType, TimestampType

#: Address abbreviations, written out when a space stands on both sides.
ADDRESS_WORDS = {"rd": "road", "st": "street", "ave": "avenue", "ln": "lane", "ct": "court"}
#: Keyword rules in order of precedence; all keywords of a rule must occur.
PRICE_BASIS_RULES = (
    (("price on application",), "PRICE_ON_APPLICATION"),
    (("poa",), "PRICE_ON_APPLICATION"),
    (("offers in excess",), "OFFERS_IN_EXCESS_OF"),
    (("offers over",), "OFFERS_OVER"),
    (("guide price", "auction"), "AUCTION_GUIDE"),
    (("guide price",), "GUIDE_PRICE"),
    (("asking price",), "ASKING_PRICE"),
)
STATUS_RULES = ((("sold stc",), "SOLD_STC"), (("sstc",), "SOLD_STC"), (("under offer",), "UNDER_OFFER"), (("withdrawn",), "WITHDRAWN"), (("auction",), "AUCTION"))
TYPE_RULES = (
    (("garage court",), "GARAGE_COURT"),
    (("site with building",), "LAND_WITH_BUILDING"),
    (("land with building",), "LAND_WITH_BUILDING"),
    (("redevelopment",), "REDEVELOPMENT_SITE"),
    (("development opportunity",), "REDEVELOPMENT_SITE"),
    (("land",), "LAND"),
    (("plot",), "LAND"),
    (("site",), "LAND"),
)
#: Months, and words that a description's signature leaves out.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
SIGNATURE_STOPWORDS = ("the", "and", "of", "to", "provide", "residential", "units", "unit", "site", "with", "at")
#: Patterns of prices, dates, postcodes and places.
PRICE_PATTERN = r"(?i)£\s*([0-9][0-9,]*(?:\.[0-9]+)?)(million|mn|m|thousand|k)?"
DATE_PATTERN = r"(\d{1,2})\s+([A-Za-z]{3,9})\s+(\d{4})"
POSTCODE_PATTERN = r"\b([A-Z]{1,2}\d[A-Z\d]?)\s*(\d[A-Z]{2})\b"
COORDINATE_PATTERN = r"(5[0-9]\.\d{3,})[^0-9+-]+([+-]?0\.\d{3,})"


def filled(col: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(col, F.lit(""))


def normalize_space(col: Column) -> Column:
    """Runs of white space as one blank, trimmed; empty becomes null."""
    return filled(F.trim(F.regexp_replace(col, r"\s+", " ")))


def join_text(*parts: Column) -> Column:
    """The parts that are there, with blanks between, normalised."""
    return normalize_space(F.concat_ws(" ", *parts))


def normalize_url(col: Column) -> Column:
    """Without fragment, and without a closing slash unless it is the root path."""
    plain = F.regexp_replace(F.trim(col), r"#.*$", "")
    root = plain.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*/?$")
    return F.when(root, plain).otherwise(F.regexp_replace(plain, r"/+$", ""))


def normalize_address(col: Column) -> Column:
    """Lower case, other characters than letters and digits as blanks, abbreviations written out; empty becomes null."""
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(col), r"[^a-z0-9]+", " ")), F.lit(" "))
    for short, long in ADDRESS_WORDS.items():
        out = F.replace(out, F.lit(f" {short} "), F.lit(f" {long} "))
    return filled(F.trim(out))


def first_rule(text: Column, rules: tuple, other: Column) -> Column:
    """The value of the first rule whose keywords all occur in text (lower case), else other."""
    lower = F.lower(text)
    out = None
    for words, value in rules:
        hit = lower.contains(words[0])
        for word in words[1:]:
            hit = hit & lower.contains(word)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(other)


def price_basis(text: Column) -> Column:
    """How a price is meant; UNKNOWN for null."""
    return first_rule(F.coalesce(text, F.lit("")), PRICE_BASIS_RULES, F.lit("UNKNOWN"))


def listing_status(*texts: Column) -> Column:
    """Status by keyword; LIVE for any other text, UNKNOWN for none."""
    joined = F.concat_ws(" ", *texts)
    return first_rule(joined, STATUS_RULES, F.when(F.trim(joined) != "", F.lit("LIVE")).otherwise("UNKNOWN"))


def listing_type(*texts: Column) -> Column:
    return first_rule(F.concat_ws(" ", *texts), TYPE_RULES, F.lit("UNKNOWN"))


def parse_price(text: Column) -> Column:
    """Whole pounds of the first price; a suffix counts only right behind the number, and halves go to the even pound."""
    number = F.replace(F.regexp_extract(text, PRICE_PATTERN, 1), F.lit(","), F.lit(""))
    suffix = F.lower(F.regexp_extract(text, PRICE_PATTERN, 2))
    scale = F.when(suffix.isin("m", "mn", "million"), 1_000_000.0).when(suffix.isin("k", "thousand"), 1_000.0).otherwise(1.0)
    return F.bround(number.try_cast("double") * scale, 0).cast("long")


def parse_date(text: Column) -> Column:
    """The first day, month name and year as a date; null if there is none or it is no date."""
    day, name, year = (F.regexp_extract(text, DATE_PATTERN, i) for i in (1, 2, 3))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(name, 1, 3)))
    plain = F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.when((year != "") & (month > 0), F.try_to_date(plain, "yyyy-MM-dd"))


def postcode(text: Column) -> Column:
    upper = F.upper(text)
    return F.when(F.regexp_extract(upper, POSTCODE_PATTERN, 1) != "", F.concat_ws(" ", F.regexp_extract(upper, POSTCODE_PATTERN, 1), F.regexp_extract(upper, POSTCODE_PATTERN, 2)))


def postcode_district(code: Column) -> Column:
    """What stands before the first blank, in upper case."""
    return filled(F.upper(F.split_part(F.trim(code), F.lit(" "), F.lit(1))))


def coordinates(text: Column) -> Column:
    """struct(lat, lon) of the first pair that looks like one around London; null without."""
    lat, lon = (F.regexp_extract(text, COORDINATE_PATTERN, i).try_cast("double") for i in (1, 2))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, in order, repeats kept."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda x: x != "")


def signature(text: Column) -> Column:
    """The tokens without stop words, sorted, repeats kept: equal for texts that differ in order and filling only."""
    return F.array_sort(F.filter(tokens(text), lambda x: ~x.isin(*SIGNATURE_STOPWORDS)))


def jaccard(left: Column, right: Column) -> Column:
    """Shared share of two arrays' different elements; 0 if either is empty or null."""
    both, either = F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))
    return F.when((F.coalesce(F.size(left), F.lit(0)) <= 0) | (F.coalesce(F.size(right), F.lit(0)) <= 0), 0.0).otherwise(both / either)


def slug(text: Column) -> Column:
    return filled(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""))


def authority_label(text: Column) -> Column:
    """An authority's plain name: without the words around it, each word with a capital."""
    bare = F.regexp_replace(F.lower(text), r"\b(london borough of|royal borough of|city of|borough|council)\b", " ")
    return F.initcap(normalize_space(bare))


def yes(col: Column) -> Column:
    """Whether a JSON value counts as true: there, and not false, 0, empty or null."""
    return ~F.coalesce(F.lower(F.trim(col)), F.lit("")).isin("", "false", "0", "0.0", "null", "[]", "{}")


def json_ready(col: Column, kind: DataType) -> Column:
    """The column with what JSON has no form for as text: decimals, dates and times (those of a time zone in UTC, with its offset)."""
    match kind:
        case DecimalType() | DateType():
            return col.cast("string")
        case TimestampType() | TimestampNTZType():
            zone = "" if isinstance(kind, TimestampNTZType) else "+00:00"
            plain = F.to_utc_timestamp(col, F.current_timezone()) if zone else col
            whole = F.date_format(plain, "yyyy-MM-dd HH:mm:ss")
            return F.concat(whole, F.when(F.date_format(plain, "SSSSSS") == "000000", "").otherwise(F.date_format(plain, ".SSSSSS")), F.lit(zone))
        case ArrayType():
            return F.transform(col, lambda x: json_ready(x, kind.elementType))
        case MapType():
            return F.transform_values(col, lambda _, x: json_ready(x, kind.valueType))
        case StructType():
            return F.when(col.isNotNull(), F.named_struct(*(x for f in kind.fields for x in (F.lit(f.name), json_ready(col[f.name], f.dataType)))))
    return col


@F.pandas_udf(StringType())
def sorted_keys(texts: pd.Series) -> pd.Series:
    """JSON texts with sorted keys, no blanks, ASCII escapes and numbers in their shortest form."""
    return texts.map(lambda x: json.dumps(json.loads(x), sort_keys=True, separators=(",", ":")), na_action="ignore")


def canonical_json(df: DataFrame, *columns: str) -> Column:
    """An object of columns of df as canonical JSON: equal values give equal texts whatever the order of columns, fields and map keys; nulls are kept."""
    parts = [x for c in columns for x in (F.lit(c), json_ready(F.col(f"`{c}`"), df.schema[c].dataType))]
    return sorted_keys(F.to_json(F.named_struct(*parts), {"ignoreNullFields": "false"}))


def content_hash(df: DataFrame, *columns: str) -> Column:
    """SHA-256 of canonical_json()."""
    return F.sha2(canonical_json(df, *columns), 256)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """The deterministic id (version 5) of a name in a namespace (32 hex digits)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def namespace(seed: str) -> str:
    """32 hex digits that stand for a seed."""
    return hashlib.sha1(seed.encode()).hexdigest()[:32]


def storage_path(source: Column, asset_id: Column, name: Column, longest: int = 64) -> Column:
    """A safe path: unusual characters as dashes, the name cut and told apart by its digest."""
    safe = F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-")
    short = F.when(F.length(safe) <= longest, safe).otherwise(F.concat(F.substring(safe, 1, longest - 13), F.lit("-"), F.substring(F.sha2(name, 256), 1, 12)))
    return F.concat_ws("/", slug(source), asset_id, short)
