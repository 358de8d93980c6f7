"""Readers for the documents that planning and market sources publish, by Spark's own formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import text as T
from .sheets import spreadsheet

COVERAGE = "array<struct<borough_id:string,source_family:string,coverage_status:string,freshness_status:string,coverage_note:string,gap_reason:string>>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path and value, the whole text of each file, and content_hash."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value", F.sha2("value", 256).alias("content_hash"))


def envelope(spark: SparkSession, path: str, field: str, item: str) -> DataFrame:
    """Rows of one array of JSON documents: item is the DDL of its elements."""
    found = documents(spark, path).withColumn("rows", F.from_json(F.get_json_object("value", f"$.{field}"), f"array<{item}>"))
    return found.select("path", "content_hash", F.posexplode("rows").alias("position", "row")).select("path", "content_hash", "position", "row.*")


def coverage_rows(spark: SparkSession, path: str, boroughs: DataFrame | None = None) -> DataFrame:
    """The coverage that a document claims, from its meta or metadata. With boroughs (borough_id), a row of any other one is an error."""
    listed = F.coalesce(F.get_json_object("value", "$.meta.coverage"), F.get_json_object("value", "$.metadata.coverage"))
    rows = documents(spark, path).select("path", F.explode(F.from_json(listed, COVERAGE)).alias("row")).select("path", "row.*")
    if boroughs is None:
        return rows
    known = boroughs.select(F.col("borough_id").cast("string").alias("borough_id"), F.lit(True).alias("__known")).distinct()
    unknown = F.raise_error(F.concat(F.lit("Coverage row references unknown borough '"), F.coalesce("borough_id", F.lit("")), F.lit("'.")))
    return rows.join(known, "borough_id", "left").where(F.coalesce(F.col("__known"), unknown.cast("boolean"))).select(*rows.columns)


def features(spark: SparkSession, path: str, properties: str, lines: bool = False) -> DataFrame:
    """GeoJSON features: properties (DDL fields) and shape (repaired), from polygons of any number of parts and holes, and points.

    lines: for layers of any size that have each feature in a line of its own; content_hash is then the feature's, and position its place in the reading.
    """
    if lines:
        text = F.regexp_replace(F.trim("value"), ",$", "")
        each = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), text.alias("feature")).where(F.get_json_object("feature", "$.type") == "Feature")
        each = each.select("path", F.sha2("feature", 256).alias("content_hash"), F.monotonically_increasing_id().alias("position"), "feature")
    else:
        each = documents(spark, path).select("path", "content_hash", F.posexplode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("position", "feature"))
    inner = F.from_json(F.get_json_object("feature", "$.properties"), properties)
    read = each.withColumns({"p": inner, "shape": G.shape_from_geojson(F.get_json_object("feature", "$.geometry"))})
    return read.select("path", "content_hash", "position", "p.*", G.repaired(F.col("shape")).alias("shape"))


def boundary_id(borough_id: Column, lpa_id: Column, slug: Column, name: Column, gss_code: Column, feature_id: Column, geometry: Column) -> Column:
    """The first id that is there, down to one made from the geometry."""
    return F.coalesce(*(T.filled(F.trim(c)) for c in (borough_id, lpa_id, slug)), T.slug(name), T.filled(gss_code), T.filled(feature_id), F.concat(F.lit("lpa_"), F.substring(F.sha2(geometry, 256), 1, 12)))


def delimited(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """A table with a header; names trimmed and in lower case, all values text. line_breaks: values may hold some, so each file is one task."""
    rows = spark.read.csv(path, header=True, multiLine=line_breaks, escape='"')
    return rows.toDF(*[c.strip().lower() for c in rows.columns])


def feed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of a feed: csv, xlsx, json as an array or under rows, items or results, or jsonl with one object in a line, which may be of any size."""
    if kind == "jsonl":
        return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("position"), F.from_json("value", "map<string,string>").alias("row")).where("row is not null")
    if kind == "csv":
        return delimited(spark, path)
    if kind == "xlsx":
        return spreadsheet(spark, path)
    if kind != "json":
        raise ValueError(f"no reader for {kind}")
    whole = documents(spark, path)
    rows = F.coalesce(*(F.from_json(F.get_json_object("value", p), "array<map<string,string>>") for p in ("$.rows", "$.items", "$.results", "$")))
    return whole.select("path", F.posexplode(rows).alias("position", "row"))


def sales(rows: DataFrame) -> DataFrame:
    """Sales from price-paid rows with any of the usual headers."""
    pick = lambda *names: F.coalesce(*(T.filled(F.trim(F.col(n).cast("string"))) for n in names if n in rows.columns), F.lit(None).cast("string"))
    tenure = F.upper(F.substring(pick("tenure", "estate_type", "duration"), 1, 1))
    code = pick("postcode")
    return rows.select(
        pick("transaction_ref", "transaction_id", "unique_id").alias("transaction_ref"), T.slug(pick("borough_id", "district")).alias("borough_id"), F.to_date(pick("sale_date", "date", "deed_date")).alias("sale_date"),
        pick("price_gbp", "price_paid", "price").try_cast("double").cast("long").alias("price_gbp"), F.when(tenure == "F", "FREEHOLD").when(tenure == "L", "LEASEHOLD").alias("tenure"),
        F.coalesce(pick("postcode_district"), T.postcode_district(code)).alias("postcode_district"), pick("floor_area_sqm").try_cast("double").alias("floor_area_sqm"),
        F.coalesce(pick("address_text"), T.normalize_space(F.concat_ws(", ", pick("saon"), pick("paon"), pick("street"), pick("town"), code))).alias("address_text"),
    )


def polygons_with_point(spark: SparkSession, path: str, row_tag: str, positions: str, x: float, y: float) -> DataFrame:
    """GML rows whose shape holds a point: boxes first, then the shape. positions names the field of 'x y x y ...' texts."""
    rows = spark.read.format("xml").option("rowTag", row_tag).load(path)
    numbers = F.transform(F.split(F.trim(F.col(positions)), r"\s+"), lambda v: v.try_cast("double"))
    at = F.sequence(F.lit(0), (F.size(numbers) / 2 - 1).cast("int"))
    ringed = rows.withColumn("shape", F.array(F.transform(at, lambda i: G.point(F.get(numbers, i * 2), F.get(numbers, i * 2 + 1))))).withColumn("box", G.bounds(F.col("shape")))
    near = ringed.where(F.lit(x).between(F.col("box.minx"), F.col("box.maxx")) & F.lit(y).between(F.col("box.miny"), F.col("box.maxy")))
    return near.where(G.contains(F.col("shape"), G.point(F.lit(x), F.lit(y)))).drop("box")


def union_with_point(spark: SparkSession, path: str, row_tag: str, positions: str, x: float, y: float) -> DataFrame:
    """The union of all polygons_with_point(), one row; none without hits."""
    return G.union_shapes(polygons_with_point(spark, path, row_tag, positions, x, y).withColumn("everything", F.lit(1)), "everything").select("shape")
