"""States kept by logs, conflicts, ledgers, categories, revisions, crawls and lists on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import control, latest, listings, scenarios, scoring, sites
from .registry import query, table


@query("""WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS mode FROM events GROUP BY 1),
i AS (SELECT event_id % 500 AS incident, arg_max(user_id, (ts, event_id)) AS scope, arg_max(event_id % 3, (ts, event_id)) AS state FROM events GROUP BY 1)
SELECT s.user_id AS scope, any_value(mode) AS mode, count(i.incident) AS open_incidents FROM s LEFT JOIN i ON i.scope = s.user_id AND i.state <> 0 GROUP BY 1""")
def scope_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as scopes: the last mode of each, and its incidents whose last entry doesn't say that they are resolved."""
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("user_id").alias("scope"), F.col("event_type").alias("mode"), F.col("ts").alias("changed_at"), F.col("event_id").alias("change_id"))
    status = F.when(F.col("event_id") % 3 == 0, "RESOLVED").otherwise("OPEN")
    incidents = e.select((F.col("event_id") % 500).alias("incident_id"), F.col("user_id").alias("scope"), status.alias("status"), F.col("ts").alias("changed_at"), F.col("event_id").alias("change_id"))
    found = control.scope_states(log).join(control.open_incidents(incidents), "scope", "left")
    return found.select("scope", "mode", F.coalesce("open_incidents", F.lit(0)).cast("long").alias("open_incidents"))


@query("""SELECT o_orderkey AS path, o_orderkey % 4 = 0 AS changed FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 = 0""")
def snapshot_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored paths that would be overwritten with other bytes."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("path"), F.sha2(F.concat("o_orderstatus", k.cast("string")), 256).alias("content_hash"))
    held = rows.where("path % 3 = 0").withColumn("content_hash", F.when(F.col("path") % 4 == 0, F.lit("other")).otherwise(F.col("content_hash")))
    return latest.conflicts(rows, held, "path", "content_hash").select("path", F.lit(True).alias("changed"))


@query("""SELECT o_orderkey AS run_id, count(*) AS row_count FROM (SELECT o_orderkey, o_custkey AS c FROM orders UNION SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_custkey END FROM orders) GROUP BY 1""")
def ledger_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger that gets the rows of runs again, of which some have changed: rows that it has already are not added."""
    k = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(k.alias("run_id"), F.col("o_custkey").alias("customer"), F.lit(0.5).alias("probability"))
    again = runs.withColumn("customer", F.when(F.col("run_id") % 5 == 0, -1).otherwise(F.col("customer")))
    ledger = control.ledger_rows(runs, ["run_id", "customer"])
    return control.append_ledger(ledger, again, ["run_id", "customer"]).groupBy("run_id").agg(F.count("*").alias("row_count"))


@query("""SELECT 'status' AS feature, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS categories FROM orders UNION ALL
SELECT 'year', array_to_string(list_sort(list(DISTINCT y)), ',') FROM (SELECT CASE WHEN o_orderkey % 7 > 0 THEN year(o_orderdate)::VARCHAR END AS y FROM orders) WHERE y IS NOT NULL""")
def category_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of categorical features, missing ones and empty texts left out."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.when(k % 7 > 0, F.year("o_orderdate").cast("string")).otherwise(F.when(k % 2 == 0, F.lit(""))).alias("year"))
    return scoring.categories(rows, ["status", "year"]).select("feature", F.array_join("categories", ",").alias("categories"))


@query("""SELECT c_custkey AS site_id, 1 AS revision, 10 + c_custkey % 5 AS width FROM customer WHERE c_custkey % 4 <> 3 UNION ALL
SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 1 ELSE 2 END, CASE c_custkey % 4 WHEN 3 THEN 10 + c_custkey % 5 ELSE 40 END FROM customer WHERE c_custkey % 4 IN (1, 3)""")
def geometry_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions of sites' shapes: a further one only where the shape has changed, whatever corner its ring begins at."""
    k = F.col("c_custkey")
    ring = lambda w, turn: F.array(F.array(*((lambda p: p[turn:] + p[:turn])([G.point(F.lit(0), F.lit(0)), G.point(w, F.lit(0)), G.point(w, F.lit(10)), G.point(F.lit(0), F.lit(10))]))))
    own = 10 + k % 5
    rows = table(spark, sf_dir, "customer").select(k.alias("site_id"), G.geometry_hash(ring(own, 0)).alias("was"), G.geometry_hash(F.when(k % 4 == 1, ring(F.lit(40), 0)).otherwise(ring(own, 2))).alias("geometry_hash"), own.alias("own"))
    held = rows.where("site_id % 4 <> 3").select("site_id", F.lit(1).alias("revision"), F.col("was").alias("geometry_hash"))
    now = sites.revisions(rows.select("site_id", "geometry_hash"), held)
    joined = now.join(rows.select("site_id", "was", "own"), "site_id")
    return joined.select("site_id", "revision", F.when(F.col("geometry_hash") == F.col("was"), F.col("own")).otherwise(F.lit(40)).cast("int").alias("width"))


@query("""WITH p AS (SELECT page_id, 'http://s' || page_id % 5 || '.x/lot/' || page_id // 10 AS lot FROM pages), f AS (SELECT page_id % 5 AS source, lot, min(page_id) AS first FROM p GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY first) AS place FROM f) SELECT source, lot AS url, place FROM r WHERE place <= 9""")
def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to fetch next: links of one block of seed pages that match a pattern, each once at its first place, nine of a source."""
    k = F.col("page_id")
    lot = F.concat(F.lit("/lot/"), F.floor(k / 10).cast("string"))
    html = F.concat(F.lit("<nav><a href=/lot/900>no</a></nav><div class=results><p>"), F.lit("<a href="), lot, F.lit(">lot</a><a href=/about>no</a></div>"))
    pages = table(spark, sf_dir, "pages").select((k % 5).alias("source"), F.concat(F.lit("http://s"), (k % 5).cast("string"), F.lit(".x/list/"), F.lpad(k.cast("string"), 9, "0")).alias("url"), html.alias("html"))
    maps = pages.select("source", F.lit("<urlset></urlset>").alias("xml")).distinct()
    return listings.crawl_candidates(pages, maps, r"/lot/\d+$", 9, scope="div.results")


@query("""SELECT t.n AS template, count(*) AS part_count FROM part JOIN (SELECT unnest(['resi_5_9_full', 'resi_10_49_outline']) AS n, unnest([0, 1]) AS k) t ON p_partkey % 2 = t.k GROUP BY 1""")
def template_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts under two of the seeded scenario templates."""
    names = ("resi_5_9_full", "resi_10_49_outline")
    found = scenarios.templates(spark, names)
    key = found.columns[0]
    return table(spark, sf_dir, "part").withColumn(key, F.when(F.col("p_partkey") % 2 == 0, names[0]).otherwise(names[1])).join(found.select(key), key).groupBy(F.col(key).alias("template")).agg(F.count("*").alias("part_count"))
