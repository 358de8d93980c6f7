"""Filter interaction audit: what each of five filters removes in each of their 120 orders, part by part.

Filters are the letters A to E, true where a text fails: A has few words, B repeats its words, C is rich in capitals, D holds special signs, E is
the text of a smaller id. A row's failures are one mask of five bits; masks are counted by part, and the counts of at most 32 masks give every order.

E comes from partition refinement. All rows are one class; they are split by their number of code points, then by the hashes of successive blocks
of the text, and after each split classes of one id go. The full texts of what is left are compared, so E is exact whatever the hashes
do; ids beyond the smallest of their text are marked.

Null texts are empty, and so is the name of a null part. Rows without an id count in their part, fail E never and make nobody fail it. Rows that repeat
an id count once each. Of several labels of an id, one that says 1 is enough. Without rows there are no parts and no result. Further columns are left alone.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

LETTERS = "ABCDE"
#: Thresholds of the filters: words at least; distinct words, in percent, at least; capitals, in percent of code points, at most; signs.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 2, "[#$%&*|]"
#: Code points of the first blocks; a last block holds the rest of the text.
BLOCKS = (64, 512, 4096)
LAST = f"class_{len(BLOCKS) + 1}"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(text: Column) -> list[Column]:
    """Conditions A to D of a text that is not null."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n = F.size(words)
    return [n < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text), text.rlike(SIGNS)]


def with_classes(rows: DataFrame, text: str = "text", bits: int = 64) -> DataFrame:
    """rows with class_0 (code points), class_1, ...: each splits the one before by the hash of one more block of the text."""
    rows, start = rows.withColumn("class_0", F.length(text).cast("long")), 1
    for level, size in enumerate([*BLOCKS, None], 1):
        block = F.substring(text, start, size) if size else F.substr(F.col(text), F.lit(start))
        rows, start = rows.withColumn(f"class_{level}", F.xxhash64(f"class_{level - 1}", block).bitwiseAND(F.lit((1 << bits - 1) - 1)) if bits < 64 else F.xxhash64(f"class_{level - 1}", block)), start + (size or 0)
    return rows


def several_ids(rows: DataFrame, level: int) -> DataFrame:
    """The classes of a level that hold more than one id."""
    return written(rows.groupBy(f"class_{level}").agg(F.min("row_key").alias("least"), F.max("row_key").alias("most")).where("least < most").select(f"class_{level}"), "several")


def refined(facts: DataFrame) -> DataFrame:
    """class_n of the last level for the classes that still hold several ids when all blocks have been looked at."""
    live = facts.where("row_key is not null").select("row_key", *(f"class_{i}" for i in range(len(BLOCKS) + 2)))
    for level in range(len(BLOCKS) + 1):
        live = written(live.join(several_ids(live, level), f"class_{level}", "left_semi").drop(f"class_{level}"), "live")
    return several_ids(live, len(BLOCKS) + 1)


def repeats(docs: DataFrame, facts: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """facts (row_key, class_n, text_check ...) with `repeated`: the row's text is also that of a smaller key."""
    whole = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("row_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    texts = with_classes(whole, bits=bits).select("row_key", "text", LAST).join(refined(facts), LAST, "left_semi")
    groups = texts.groupBy(LAST, "text").agg(F.min("row_key").alias("first"))  # full texts are compared here
    classes = written(groups.groupBy(LAST).agg(F.count("*").alias("texts"), F.min("first").alias("first")), "classes")
    marked = facts.join(classes.where("texts = 1").select(LAST, "first"), LAST, "left").withColumn("repeated", F.coalesce(F.col("row_key") > F.col("first"), F.lit(False))).drop("first")
    mixed = classes.where("texts > 1").select(LAST)
    if mixed.isEmpty():
        return marked
    # different texts under one hash: their rows are told apart by the text itself
    own = texts.join(mixed, LAST, "left_semi")
    later = own.join(own.groupBy(LAST, "text").agg(F.min("row_key").alias("first")), [LAST, "text"]).where("row_key > first")
    later = written(later.select("row_key", LAST, F.xxhash64(F.lit(1), "text").alias("text_check"), F.lit(True).alias("later")).distinct(), "later")
    return marked.join(later, ["row_key", LAST, "text_check"], "left").withColumn("repeated", F.col("repeated") | F.coalesce("later", F.lit(False))).drop("later")


def masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", bits: int = 64) -> DataFrame:
    """row_key, part and mask (bit i: the text fails filter i) of each row."""
    named = docs.select(F.col(key).alias("row_key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    failed = sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(failures(F.col("text")))), F.lit(0))
    facts = with_classes(named, bits=bits).withColumns({"mask": failed, "text_check": F.xxhash64(F.lit(1), "text")}).drop("text")
    marked = repeats(docs, written(facts, "facts"), key, text, bits)
    return marked.select("row_key", "part", (F.col("mask") + F.when(F.col("repeated"), 16).otherwise(0)).alias("mask"))


def effects(spark: SparkSession) -> DataFrame:
    """For each mask, order and step, what becomes of a row with that mask: 19,200 rows of noughts and ones, and its share in 120 orders."""
    rows = []
    for mask in range(1 << len(LETTERS)):
        failed = {x for i, x in enumerate(LETTERS) if mask >> i & 1}
        for order in map("".join, itertools.permutations(LETTERS)):
            gone = next((i for i, x in enumerate(order) if x in failed), len(order))
            for at, x in enumerate(order):
                rows.append((mask, order, at + 1, int(gone > at), int(gone == at), int(gone < at and x in failed), int(failed == {x}), 120 // len(failed) if x in failed else 0))
    return spark.createDataFrame(rows, "mask int, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, share long")


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", label_key: str = "doc_id", quality: str = "quality", toxic: str = "toxic", bits: int = 64) -> DataFrame:
    """part, filter_order, step and COUNTS for every part, order and step."""
    said = labels.where(F.col(label_key).isNotNull()).groupBy(F.col(label_key).alias("row_key"))
    said = written(said.agg(F.max((F.col(quality) == 1).cast("int")).alias("good"), F.max((F.col(toxic) == 1).cast("int")).alias("toxic")), "labels")
    rows = masks(docs, key, text, part, bits).join(said, "row_key", "left")
    counted = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("good", "toxic")))
    each = counted.join(F.broadcast(effects(docs.sparkSession)), "mask")
    of = {x: F.col("n") * F.col(x) for x in COUNTS[:4]} | {"good_lost": F.col("good") * F.col("removed"), "toxic_lost": F.col("toxic") * F.col("removed"), "shapley": F.col("n") * F.col("share")}
    return each.groupBy("part", "filter_order", "step").agg(*(F.sum(x).cast("long").alias(name) for name, x in of.items()))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op11_filter_audit": op11_filter_audit}
ORACLE = {
    "op11_filter_audit": """
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM docs),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT doc_id, part,
    (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
  FROM split),
counted AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM failed LEFT JOIN said USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS own FROM orders, (SELECT unnest(range(1, 6)) AS step)),
seen AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails, contains(fails, own) AS hit,
    len(list_filter(range(1, step), lambda i: contains(fails, filter_order[i]))) > 0 AS before
  FROM counted, steps),
summed AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (WHERE NOT before AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT before AND hit), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE before AND hit), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE NOT before AND hit), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT before AND hit), 0) AS toxic_lost
  FROM seen GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM summed"""
}
