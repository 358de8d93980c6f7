"""Readers on files that are written from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import numeric as N
from ..operators import listings
from ..sources import readers
from ..sources.scratch import shared_dir
from .registry import query, table


def lines(rows: DataFrame, line: Column, name: str) -> str:
    """The folder to which a text of each row is written, a line each."""
    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.select(line.alias("value")).write.text(path)
    return path


def whole(rows: DataFrame, item: Column, head: str, tail: str, name: str) -> str:
    """The folder of one document that lists an item of each row; for tables of a few rows."""
    listed = rows.agg(F.array_join(F.array_sort(F.collect_list(item)), ", ").alias("items"))
    return lines(listed, F.concat(F.lit(head), "items", F.lit(tail)), name)


@query("""SELECT s_suppkey AS id, s_name AS headline, CAST(s_suppkey * 1000 AS BIGINT) AS price_gbp, 'GUIDE_PRICE' AS price_basis, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 51.5::DOUBLE END AS lat, lower(replace(s_name, '#', ' ')) || ' high street' AS address FROM supplier""")
def csv_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings imported from CSV with free headers."""
    k = F.col("s_suppkey")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    rows = table(spark, sf_dir, "supplier")
    line = F.concat_ws(",", k.cast("string"), quoted(F.concat(F.lit("  "), F.col("s_name"), F.lit(" "))), quoted(F.concat((k * 1000).cast("string"))), quoted(F.concat(F.lit("guide price, "), k.cast("string"))), F.when(k % 3 == 0, "bad").otherwise("51.5"), quoted(F.concat("s_name", F.lit(", High St"))))
    header = spark.createDataFrame([(" Ref ,Title,PRICE,Details,Lat,Location",)], "value string")
    # each file has a header, as in a folder of exports
    path = lines(header.unionByName(rows.select(line.alias("value"))).coalesce(1), F.col("value"), "csv")
    found = listings.from_table(readers.feed(spark, path, "csv"), "s")
    return found.select(F.col("source_listing_id").cast("long").alias("id"), "headline", "price_gbp", "price_basis", "lat", F.col("normalized_address").alias("address"))


@query("""SELECT c_custkey AS id, c_name AS name FROM customer""")
def json_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed with one JSON object in a line."""
    path = lines(table(spark, sf_dir, "customer"), F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))), "jsonl")
    return readers.feed(spark, path, "jsonl").select(F.col("row")["id"].cast("long").alias("id"), F.col("row")["name"].alias("name"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS ref, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation""")
def json_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an array of one JSON document, as planning registers, indices and rulepacks come."""
    path = whole(table(spark, sf_dir, "nation"), F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")), '{"applications": [', "]}", "envelope")
    return readers.envelope(spark, path, "applications", "struct<n_nationkey:bigint,n_name:string,n_regionkey:bigint>").select(F.col("n_nationkey").alias("ref"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS borough_id, 'BROWNFIELD' AS source_family, CASE WHEN n_regionkey = 1 THEN 'PARTIAL' ELSE 'COMPLETE' END AS coverage_status FROM nation""")
def coverage_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage that a document claims in its metadata."""
    item = F.to_json(F.struct(F.col("n_nationkey").cast("string").alias("borough_id"), F.lit("BROWNFIELD").alias("source_family"), F.when(F.col("n_regionkey") == 1, "PARTIAL").otherwise("COMPLETE").alias("coverage_status")))
    path = whole(table(spark, sf_dir, "nation"), item, '{"metadata": {"coverage": [', "]}}", "coverage")
    return readers.coverage_rows(spark, path).select("borough_id", "source_family", "coverage_status")


@query("""SELECT CASE p_partkey % 3 WHEN 0 THEN 'part-' || p_partkey WHEN 1 THEN 'E' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS boundary_id, CAST(p_size * p_size AS DOUBLE) + CASE WHEN p_partkey % 2 = 0 THEN 96.0::DOUBLE ELSE 0.0::DOUBLE END AS area FROM part""")
def geojson_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer of boundaries with a feature in a line: polygons, and multipolygons with holes."""
    k, w = F.col("p_partkey"), F.col("p_size")
    ring = lambda x, y, width: F.array(*[F.array(a.cast("double"), b.cast("double")) for a, b in ((x, y), (x + width, y), (x + width, y + width), (x, y + width), (x, y))])
    zero, far = F.lit(0), F.lit(100)
    single = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring(zero, zero, w)).alias("coordinates")))
    several = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring(zero, zero, w)), F.array(ring(far, zero, F.lit(10)), ring(far + 2, zero + 2, F.lit(2)))).alias("coordinates")))
    properties = F.to_json(F.struct(F.when(k % 3 == 0, F.concat(F.lit("Part "), k.cast("string"))).alias("name"), F.when(k % 3 == 1, F.concat(F.lit("E"), k.cast("string"))).alias("gss"), k.cast("string").alias("id")))
    line = F.concat(F.lit('{"type": "Feature", "properties": '), properties, F.lit(', "geometry": '), F.when(k % 2 == 0, several).otherwise(single), F.lit("},"))
    found = readers.features(spark, lines(table(spark, sf_dir, "part"), line, "geojson"), "name string, gss string, id string", lines=True)
    none = F.lit(None).cast("string")
    key = readers.boundary_id(none, none, none, F.col("name"), F.col("gss"), F.col("id"), none)
    return found.select(key.alias("boundary_id"), N.round_half_up(G.area(F.col("shape")), 3).alias("area"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS transaction_ref, CAST(o_orderdate AS DATE) AS sale_date, CAST(floor(o_totalprice) AS BIGINT) AS price_gbp, CASE o_orderkey % 3 WHEN 0 THEN 'FREEHOLD' WHEN 1 THEN 'LEASEHOLD' END AS tenure, 'NW1' AS postcode_district, (o_custkey % 90) || ', High St, NW1 2AB' AS address_text FROM orders""")
def price_paid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales from price-paid rows with the usual headers."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.cast("string").alias("transaction_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_totalprice").cast("string").alias("price"), F.when(k % 3 == 0, "F").when(k % 3 == 1, "leasehold").alias("duration"),
        F.lit("NW1 2AB").alias("postcode"), (F.col("o_custkey") % 90).cast("string").alias("paon"), F.lit("High St").alias("street"),
    )
    return readers.sales(rows).select("transaction_ref", "sale_date", "price_gbp", "tenure", "postcode_district", "address_text")


@query("""SELECT CAST((max(n_nationkey * 2 + 20) - min(n_nationkey * 2)) * 10 AS DOUBLE) AS area, count(*) AS hits FROM nation WHERE n_nationkey * 2 <= 30 AND n_nationkey * 2 + 20 > 30""")
def gml_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GML parcels that hold a point, and the area of their union."""
    k = F.col("n_nationkey")
    lo, hi = (k * 2).cast("string"), (k * 2 + 20).cast("string")
    pos = F.concat_ws(" ", lo, F.lit("0"), hi, F.lit("0"), hi, F.lit("10"), lo, F.lit("10"))
    path = whole(table(spark, sf_dir, "nation"), F.concat(F.lit("<parcel><id>"), k.cast("string"), F.lit("</id><pos>"), pos, F.lit("</pos></parcel>")), "<all>", "</all>", "gml")
    hits = readers.polygons_with_point(spark, path, "parcel", "pos", 30.0, 5.0).agg(F.count("*").alias("hits"))
    union = readers.union_with_point(spark, path, "parcel", "pos", 30.0, 5.0).select(N.round_half_up(G.area(F.col("shape")), 3).alias("area"))
    return union.withColumn("one", F.lit(1)).join(hits.withColumn("one", F.lit(1)), "one").drop("one")  # a row each
