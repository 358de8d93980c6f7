"""Scalar rules of planning, numbers, text, pages and permissions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import html as H
from ..functions import numeric as N
from ..functions import text as T
from ..operators import control, listings, planning, readback, scenarios, valuation
from .registry import query, table


@query("""WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS d, DATE '1996-01-01' + CAST(o_orderkey % 700 AS INTEGER) AS ends FROM orders)
SELECT o_orderkey AS case_id, o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 AND o_orderstatus <> 'P' AND o_orderkey % 4 < 2 AND ends >= d AND o_orderkey % 7 > 0 AS active_permission, o_orderstatus = 'P' OR o_orderkey % 6 = 0 OR ends < d AS not_exclusionary,
  o_orderkey % 2 = 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0) AND ends >= d AS active_brownfield, o_orderkey % 100 >= 10 OR o_orderkey % 211 >= 100 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 AS is_material FROM o""")
def permission_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    ends = F.date_add(F.lit("1996-01-01").cast("date"), (k % 700).cast("int"))
    lapsed = F.col("o_orderstatus") == "P"
    active = planning.active_permission(
        F.when(k % 3 == 0, "ADVERT").when(k % 3 == 1, "FULL").otherwise("PIP"), F.when(k % 5 == 0, "COMMERCIAL").otherwise("FULL_RESIDENTIAL"), F.when(lapsed, "LAPSED").otherwise("APPROVED"),
        F.when(k % 4 == 0, "C3 homes").when(k % 4 == 1, "residential"), ends, k % 7 != 0, day,
    )
    brownfield = planning.active_brownfield(F.when(k % 2 == 0, "PART_2").otherwise("PART_1"), F.when(k % 3 == 0, "active"), F.when(k % 5 == 0, "ACTIVE").otherwise("ENDED"), F.lit(None).cast("date"), ends, day)
    material = planning.material_overlap((k % 100) / 100.0, (k % 211).cast("double"), k % 13 == 0, F.when(k % 17 == 0, True))
    return table(spark, sf_dir, "orders").select(
        k.alias("case_id"), active.alias("active_permission"), planning.non_exclusionary(F.when(lapsed, "LAPSED").otherwise("APPROVED"), k % 6 == 0, ends, day).alias("not_exclusionary"), brownfield.alias("active_brownfield"), material.alias("is_material"),
    )


@query("""WITH p AS (SELECT p_partkey, p_partkey % 5 AS k FROM part) SELECT p_partkey AS case_id, CASE k WHEN 0 THEN 'BACKLAND' WHEN 1 THEN 'INFILL' WHEN 2 THEN 'BROWNFIELD_REUSE' ELSE CASE WHEN p_partkey % 7 = 0 THEN 'BROWNFIELD_REUSE' ELSE 'REDEVELOPMENT' END END AS form,
  't:f:' || CASE WHEN p_partkey % 2 = 0 THEN 'heritage' ELSE 'no_heritage' END || ':' || CASE WHEN p_partkey % 7 = 0 THEN 'brownfield' ELSE 'no_brownfield' END || ':no_flood' AS archetype FROM p""")
def proposal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, "Backland infill homes").when(k % 5 == 1, "INFILL of a yard").when(k % 5 == 2, "homes on a garage court").when(k % 5 == 3, "new homes")
    return table(spark, sf_dir, "part").select(k.alias("case_id"), planning.proposal_form(text, k % 7 == 0).alias("form"), planning.archetype(F.lit("t"), F.lit("f"), k % 2 == 0, k % 7 == 0, F.lit(None).cast("boolean")).alias("archetype"))


@query("""WITH s AS (SELECT c_custkey AS k, 51.0::DOUBLE + c_custkey % 100 / 200.0::DOUBLE AS la, -0.4::DOUBLE + c_custkey % 77 / 100.0::DOUBLE AS lo, c_acctbal AS b FROM customer),
h AS (SELECT *, sin(radians(51.5::DOUBLE - la) / 2.0::DOUBLE) * sin(radians(51.5::DOUBLE - la) / 2.0::DOUBLE) + cos(radians(la)) * cos(radians(51.5::DOUBLE)) * sin(radians(-0.1::DOUBLE - lo) / 2.0::DOUBLE) * sin(radians(-0.1::DOUBLE - lo) / 2.0::DOUBLE) AS a FROM s)
SELECT k AS id, CAST(floor(12742000.0::DOUBLE * atan2(sqrt(a), sqrt(1.0::DOUBLE - a)) + 0.5::DOUBLE) AS BIGINT) AS metres, k % 1000 >= 950 OR k % 1000 * 20 >= 19000 AS close_price, abs(k % 90 - 45) <= 30 AS close_date, (DATE '2024-01-31' + INTERVAL (k % 30) MONTH)::DATE AS months_on,
  date_trunc('month', DATE '2024-01-31' + CAST(k % 400 AS INTEGER))::DATE AS month_start, floor(1000000.0::DOUBLE / (1.0::DOUBLE + exp(-(k % 21 - 10))) + 0.5::DOUBLE) / 1000000.0::DOUBLE AS sigmoid, CAST(least(100, floor((k % 1001 / 1000.0::DOUBLE) * 100.0::DOUBLE / 5.0::DOUBLE + 0.5::DOUBLE) * 5) AS INTEGER) || '%' AS display,
  CASE least(k % 4, k % 3 + 1) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS lowest, (k % 9) / CAST(k % 9 + 8 AS DOUBLE) AS share FROM h""")
def number_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances, closeness, months, probabilities as shown, lowest qualities and unit mixes."""
    k, day = F.col("c_custkey"), F.lit("2024-01-31").cast("date")
    quality = lambda n: F.when(n == 3, "HIGH").when(n == 2, "MEDIUM").when(n == 1, "LOW")
    mix = N.normalized_mix(F.create_map(F.lit("1_bed"), (k % 9).cast("double"), F.lit("2_bed"), F.lit(8.0), F.lit("3_bed"), F.lit(-4.0)))
    months = F.element_at(F.array(*[N.add_months(day, i) for i in range(30)]), (k % 30 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), F.floor(N.haversine_m(51.0 + k % 100 / 200.0, -0.4 + k % 77 / 100.0, F.lit(51.5), F.lit(-0.1)) + 0.5).cast("long").alias("metres"), N.prices_close(k % 1000, F.lit(1000)).alias("close_price"),
        N.dates_close(F.date_add(day, (k % 90).cast("int")), F.date_add(day, 45), 30).alias("close_date"), months.alias("months_on"), N.month_start(F.date_add(day, (k % 400).cast("int"))).alias("month_start"),
        N.round_half_up(N.sigmoid((k % 21 - 10).cast("double")), 6).alias("sigmoid"), N.display_probability(k % 1001 / 1000.0).alias("display"), N.lowest_quality(quality(k % 4), quality(k % 3 + 1)).alias("lowest"), mix["1_bed"].alias("share"),
    )


NAMESPACE = "0123456789abcdef0123456789abcdef"


@query(f"""WITH c AS (SELECT c_custkey AS k, c_name AS n, sha1(unhex('{NAMESPACE}') || encode(c_name)) AS h FROM customer)
SELECT k AS id, n || ' ' || k AS search_text, lower(replace(n, '#', '-')) AS slug, CASE k % 3 WHEN 0 THEN 'Camden' WHEN 1 THEN 'Tower Hamlets' ELSE 'Kingston Upon Thames' END AS authority, CASE WHEN k % 2 = 0 THEN k END AS cast_number, k % 4 < 2 AS is_true,
  substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 WHEN 0 THEN '8' WHEN 1 THEN '9' WHEN 2 THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS stable_id,
  'src-1/' || k || '/' || CASE WHEN k % 2 = 0 THEN 'plan-' || k || '.pdf' ELSE repeat('x', 51) || '-' || substr(sha256(repeat('x', 70) || k), 1, 12) END AS path, 3 AS token_count, CASE WHEN k % 2 = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS jaccard, 3 AS warning_count FROM c""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search texts, slugs, authority names, lenient casts, JSON truth, stable ids, storage paths, token sets and flattened warnings."""
    k, name = F.col("c_custkey"), F.col("c_name")
    number = k.cast("string")
    label = F.when(k % 3 == 0, "London Borough of Camden").when(k % 3 == 1, "tower hamlets council").otherwise("Royal Borough of KINGSTON upon Thames")
    truth = F.get_json_object(F.when(k % 4 == 0, '{"flag": true}').when(k % 4 == 1, '{"flag": "yes"}').when(k % 4 == 2, '{"flag": 0}').otherwise("{}"), "$.flag")
    file = F.when(k % 2 == 0, F.concat(F.lit("plan "), number, F.lit(".pdf"))).otherwise(F.concat(F.repeat(F.lit("x"), 70), number))
    other = F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("c")))
    warnings = F.create_map(F.lit("one"), F.array(F.lit("w1"), F.lit("w2")), F.lit("two"), F.array(F.lit("w3")))
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), T.join_text(name, F.lit(None).cast("string"), number).alias("search_text"), T.slug(name).alias("slug"), T.authority_label(label).alias("authority"), F.when(k % 2 == 0, number).otherwise("n/a").try_cast("bigint").alias("cast_number"), T.yes(truth).alias("is_true"),
        T.uuid5(NAMESPACE, name).alias("stable_id"), T.storage_path(F.lit("Src 1"), number, file).alias("path"), F.size(T.tokens(F.lit("One, two;three"))).alias("token_count"),
        T.jaccard(F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("d"), F.lit("b"), F.lit("e"))).otherwise(F.array(F.lit("a"), F.lit("d"), F.lit("e"))), other).alias("jaccard"),
        F.size(F.flatten(F.map_values(warnings))).alias("warning_count"),
    )


@query("""WITH m AS (SELECT o_orderkey, '{"note":' || CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE '"x"' END || ',"o_orderkey":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' AS manifest FROM orders) SELECT o_orderkey AS run_id, sha256(manifest) AS manifest_hash, 'audit/' || o_orderkey || '/' || sha256(manifest) || '.json' AS path FROM m""")
def audit_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(k.alias("run_id"), k, F.col("o_orderstatus").alias("status"), F.when(k % 2 == 1, "x").alias("note"))
    return control.audit_manifest(runs, ["o_orderkey", "status", "note"]).select("run_id", "manifest_hash", "path")


@query("""SELECT o_orderkey AS run_id, sha256('{"case":{"code":"' || o_orderstatus || '","key":' || o_orderkey || '},"flags":{"late":' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || ',"open":null},"price":' || o_totalprice::VARCHAR || ',"rates":[0.5,' || (o_orderkey % 8 / 8.0::DOUBLE)::VARCHAR || '],"when":"' || strftime(o_orderdate, '%Y-%m-%d') || '"}') AS payload_hash FROM orders""")
def canonical_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of nested payloads as canonical JSON: sorted keys, compact, numbers in their shortest form."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("run_id"), F.col("o_orderdate").cast("date").alias("when"), F.array(F.lit(0.5), k % 8 / 8.0).alias("rates"), F.col("o_totalprice").alias("price"),
        F.create_map(F.lit("open"), F.lit(None).cast("boolean"), F.lit("late"), k % 2 == 0).alias("flags"), F.struct(k.alias("key"), F.col("o_orderstatus").alias("code")).alias("case"),
    )
    return rows.select("run_id", T.content_hash(rows, "when", "rates", "price", "flags", "case").alias("payload_hash"))


@query("""SELECT p_partkey AS pack_id, p_partkey % 5 NOT IN (0, 1, 2) AS complete FROM part""")
def citation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    one = F.struct(F.lit("Plan").alias("label"), F.lit("POLICY").alias("source_family"), F.when(k % 5 != 1, F.lit("2024-01-01")).cast("date").alias("effective_date"), F.when(k % 5 == 2, "").otherwise("http://x").alias("url"))
    full = F.struct(F.lit("Map").alias("label"), F.lit("POLICY").alias("source_family"), F.lit("2024-01-01").cast("date").alias("effective_date"), F.lit("http://y").alias("url"))
    cited = F.when(k % 5 == 0, F.array().cast("array<struct<label:string,source_family:string,effective_date:date,url:string>>")).otherwise(F.array(full, one))
    return table(spark, sf_dir, "part").select(k.alias("pack_id"), scenarios.citations_complete(cited).alias("complete"))


@query("""SELECT page_id, 'http://x.y/lots/' || CASE WHEN page_id % 4 = 3 THEN 'get' ELSE page_id || '.pdf' END AS target, CASE page_id % 4 WHEN 0 THEN 'Particulars' WHEN 1 THEN 'Floor plan' WHEN 2 THEN 'Particulars' ELSE 'the .PDF' END AS label, CASE WHEN page_id % 4 = 1 THEN 'MAP' ELSE 'BROCHURE' END AS kind FROM pages""")
def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that pages link to: by target or label, general conditions left out, a map wherever one link says so."""
    k = F.col("page_id").cast("string")
    a = lambda href, label: F.concat(F.lit('<a class="d" href="'), href, F.lit('">'), label, F.lit("</a>"))
    own = F.concat(k, F.lit(".pdf"))
    html = (
        F.when(F.col("page_id") % 4 == 0, F.concat(a(own, F.lit("")), a(own, F.lit("<b>Particulars</b>")), a(F.lit("common_conditions.pdf"), F.lit("Conditions"))))
        .when(F.col("page_id") % 4 == 1, F.concat(a(own, F.lit("Particulars")), a(own, F.lit("Floor plan"))))
        .when(F.col("page_id") % 4 == 2, F.concat(a(own, F.lit("Particulars")), a(F.lit("about.html"), F.lit("About us"))))
        .otherwise(a(F.lit("get"), F.lit("the .PDF")))
    )
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("http://x.y/lots/list?"), k).alias("url"), html.alias("html"))
    return H.document_links(pages).join(pages.select("page_id", "url"), "url").select("page_id", "target", "label", "kind")


@query("""SELECT page_id, 51.0::DOUBLE + page_id % 400 / 1000.0::DOUBLE AS lat, 0.0::DOUBLE - (100 + page_id % 300) / 1000.0::DOUBLE AS lon, CASE page_id % 3 WHEN 0 THEN 'Lot ' || page_id WHEN 1 THEN 'Heading' ELSE 'Title' END AS headline, CASE page_id % 3 WHEN 0 THEN '5 High St Camden' WHEN 1 THEN 'NW1 2AB' END AS address, 250000::BIGINT AS price_gbp, 'GUIDE_PRICE' AS price_basis FROM pages""")
def page_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings read from pages: JSON-LD arrays, places in attributes, map links and text, headings that say nothing passed over, postcodes for addresses."""
    k = F.col("page_id")
    lat, lon = F.format_string("51.%03d", (k % 400).cast("int")), F.format_string("-0.%03d", (100 + k % 300).cast("int"))
    spot = (
        F.when(k % 4 == 0, F.concat(F.lit('<div data-lat="'), lat, F.lit('" id="m" data-lng="'), lon, F.lit('"></div>')))
        .when(k % 4 == 1, F.concat(F.lit('<a href="https://maps?z=1&q='), lat, F.lit(","), lon, F.lit('">Map</a>')))
        .when(k % 4 == 2, F.concat(F.lit("<script>loadMap(1, '"), lat, F.lit("', '"), lon, F.lit("')</script>")))
        .otherwise(F.concat(F.lit("<p>at "), lat, F.lit(", "), lon, F.lit("</p>")))
    )
    ld = F.concat(F.lit('<script type="application/ld+json">no json</script><script type="application/ld+json">[{"description": "d"}, {"name": "Lot '), k.cast("string"), F.lit('", "address": {"streetAddress": "5 High St", "addressLocality": "Camden"}}]</script>'))
    head = F.when(k % 3 == 0, ld).when(k % 3 == 1, "<title>Title</title><h1>Local information</h1><h1>Heading</h1><p>In NW1 2AB</p>").otherwise("<title>Title</title>")
    html = F.concat(F.lit("<html>"), head, spot, F.lit("<p>Guide price £250,000</p></html>"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("http://x.y/"), k.cast("string")).alias("url"), html.alias("html"))
    found = listings.from_pages(pages)
    return found.select(F.split_part("url", F.lit("/"), F.lit(4)).cast("long").alias("page_id"), "lat", "lon", "headline", "address", "price_gbp", "price_basis")


@query("""SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND text ILIKE '%the%' AND NOT text ILIKE '%password%' AND source IS NOT NULL AND source <> '' AND n_chars BETWEEN 100 AND 5000""")
def source_fit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as listings under a source's policy."""
    policy = {"statuses": ["en", "de"], "any_text": ["the"], "none_text": ["password"], "required": ["source"], "ranges": [("n_chars", 100, 5000)]}
    return table(spark, sf_dir, "documents").withColumnRenamed("lang", "status").where(listings.source_fit(policy, "text")).select("doc_id")


@query("""SELECT s_suppkey AS id, 'supplier' AS kind FROM supplier WHERE s_name ILIKE '%00001%' AND s_nationkey = 3 OR (s_name ILIKE '%9%' AND s_acctbal >= 9000) UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal <= -900""")
def entity_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches of clusters, sites and assessments: by name, authority, status and bounds."""
    s = table(spark, sf_dir, "supplier")
    by_name = listings.search(s, "00001", ("s_name",), equal={"s_nationkey": 3}).unionByName(listings.search(s, "9", ("s_name",), price="s_acctbal", min_price=9000)).distinct()
    listed = listings.search(table(spark, sf_dir, "customer"), equal={"c_mktsegment": "BUILDING"}, price="c_acctbal", max_price=-900)
    return by_name.select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind")).unionByName(listed.select("c_custkey", F.lit("customer")).toDF("id", "kind"))


@query("""SELECT n_nationkey AS id, n_nationkey % 5 = 0 AND n_nationkey % 3 = 0 OR (n_nationkey % 5 BETWEEN 1 AND 3 AND n_nationkey % 3 <= 1) AS allowed, CASE WHEN n_nationkey % 3 <> 2 THEN n_name END AS told FROM nation""")
def role_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which role may set which override, and rows redacted for viewers."""
    k = F.col("n_nationkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("RANKING_SUPPRESSION", "ACQUISITION_BASIS", "BARRIER", "REVIEW_DISPOSITION", "OTHER")]), (k % 5 + 1).cast("int"))
    role = F.when(k % 3 == 0, "ADMIN").when(k % 3 == 1, "REVIEWER").otherwise("ANALYST")
    rows = table(spark, sf_dir, "nation").select(k.alias("id"), readback.allowed_override(kind, role).alias("allowed"), F.col("n_name").alias("told"))
    return control.redacted(rows, ["told"], F.col("id") % 3 == 2)


@query("""SELECT o_orderkey AS id, least(a - 10, b - 20) AS low, (a + b) / 2.0::DOUBLE AS mid, greatest(a + 10, b + 20) AS high, floor((a - 500.0::DOUBLE) * (o_orderkey % 100) / 100.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS expected FROM (SELECT o_orderkey, CAST(o_orderkey % 1000 AS DOUBLE) + 500 AS a, CAST(o_custkey % 700 AS DOUBLE) AS b FROM orders)""")
def widened_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges widened by a second method, and uplift weighed with its probability."""
    a, b = (F.col("o_orderkey") % 1000).cast("double") + 500, (F.col("o_custkey") % 700).cast("double")
    low, mid, high = valuation.widened((a - 10, a, a + 10), (b - 20, b, b + 20))
    expected = valuation.expected_uplift(F.col("o_orderkey") % 100 / 100.0, valuation.uplift(a, F.lit(500.0)))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), low.alias("low"), mid.alias("mid"), high.alias("high"), N.round_half_up(expected, 2).alias("expected"))


@query("""SELECT c_custkey AS id, CAST(CASE WHEN c_custkey % 4 = 0 THEN 0 WHEN c_custkey % 4 = 1 THEN 10 ELSE c_custkey % 50 END AS DOUBLE) AS gap, c_custkey % 4 = 0 OR (c_custkey % 4 > 1 AND c_custkey % 50 = 0) AS at_site, CASE c_custkey % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'INSUFFICIENT' END AS confidence FROM customer""")
def geometry_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in, in a hole of, and beside a square: distances, and confidence by source."""
    k = F.col("c_custkey")
    square = G.shape_from_wkt(F.lit("POLYGON ((0 0, 100 0, 100 100, 0 100, 0 0), (40 40, 60 40, 60 60, 40 60, 40 40))"))
    spot = F.when(k % 4 == 0, G.point(F.lit(20), k % 50 + 1)).when(k % 4 == 1, G.point(F.lit(50), F.lit(50))).otherwise(G.point(100 + k % 50, F.lit(50)))
    kind = F.when(k % 5 == 0, "ANALYST_DRAWN").when(k % 5 == 1, "TITLE_UNION").when(k % 5 == 2, "APPROXIMATE_BBOX").when(k % 5 == 3, "POINT_ONLY").otherwise("OTHER")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), square.alias("shape"), spot.alias("spot"), kind.alias("source"))
    gap = G.distance_to(F.col("shape"), F.col("spot"))
    return rows.select("id", gap.alias("gap"), (gap == 0).alias("at_site"), G.confidence(F.col("source"), F.col("shape")).alias("confidence"))
