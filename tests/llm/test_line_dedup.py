import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldstone.llm import line_dedup as M

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least_points=40, least_docs=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders = defaultdict(set)
    for d, t in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                holders[key(line)].add(d)
    gone = {k: max(ids) for k, ids in holders.items() if len(k) >= least_points and len(ids) >= least_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if d is None or gone.get(key(x), d) <= d]
        out.append((d, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in df.collect()), key=str)


def made(n=120, ids=90):
    chance = random.Random(4)
    lines = [f"{'Line' if i % 2 else 'é line'} number {i} " + "x" * (21 + i % 9) for i in range(25)] + ["", "short", "\t", "A" * 39, "É" * 40, "é" * 39 + "\x85"]
    dress = lambda x: chance.choice([x, x.upper() if x.isascii() else x, f"  {x}\t\r", f"\x0b{x}"])
    return [(chance.randrange(ids) if i % 20 else None, "\n".join(dress(chance.choice(lines)) for _ in range(chance.randrange(1, 9)))) for i in range(n)]


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (7, 3)])
def test_matches_brute_force_by_any_batches(spark, batches, fanout):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(M.dedup_lines(docs, batches=batches, fanout=fanout)) == brute(rows)


def test_batches_in_any_order(spark, tmp_path):
    rows = [(i, t) for i, (_, t) in enumerate(made())]
    keys = M.keys_of(spark.createDataFrame(rows, "doc_id long, text string"))
    index = M.LineIndex(spark, str(tmp_path), fanout=2)
    for part in (1, 0, 3, 2, 4):
        index.add(keys.where(F.col("doc_id") % 5 == part))
    want = {(bytes(r.line_key), r.last) for r in keys.groupBy("line_key").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where("n >= 5").collect()}
    assert {(bytes(r.line_key), r.last) for r in index.common().collect()} == want
    again = M.LineIndex(spark, str(tmp_path), fanout=2)  # a session that finds the folder
    assert again.runs() == index.runs() and {(bytes(r.line_key), r.last) for r in again.common().collect()} == want


def test_levels_and_what_a_batch_adds(spark, tmp_path):
    index = M.LineIndex(spark, str(tmp_path), fanout=2, buckets=3)
    batch = lambda ids, lines: spark.createDataFrame([(i, x.encode()) for i in ids for x in lines], "doc_id long, line_key binary")
    index.add(batch(range(90, 100), ["hot", "a"]))
    index.add(batch(range(80, 84), ["hot", "b"]))  # all of hot is known: only b is new
    assert [(x.level, x.first, x.last) for x in index.runs()] == [(1, 0, 1)]
    assert sorted((bytes(r.line_key), r.docs, r["last"]) for r in index.rows(index.runs()[0]).collect()) == [(b"a", 10, 99), (b"b", 4, 83), (b"hot", 10, 99)]
    index.add(batch([70], ["hot", "b"]))
    assert [(bytes(r.line_key), r.docs) for r in index.rows(index.runs()[1]).collect()] == [(b"b", 1)]
    assert [(x.level, x.first, x.last) for x in index.runs()] == [(1, 0, 1), (0, 2, 2)]
    index.add(batch([200], ["hot"]))  # a later document is news
    assert [(x.level, x.first, x.last) for x in index.runs()] == [(2, 0, 3)]
    assert {(bytes(r.line_key), r["last"]) for r in index.common().collect()} == {(b"a", 99), (b"b", 83), (b"hot", 200)}


def test_broken_compaction_changes_nothing(spark, tmp_path):
    index = M.LineIndex(spark, str(tmp_path), fanout=9)
    rows = spark.createDataFrame([(i, b"x") for i in range(6)], "doc_id long, line_key binary")
    index.add(rows.where("doc_id < 3"))
    index.add(rows.where("doc_id >= 3"))
    index._write(index.merged(index.runs()), 1, 0, 1)  # and its inputs are still there
    (tmp_path / f"run-0-2-2-{index.buckets}").mkdir()  # begun, never finished
    assert [(x.level, x.first, x.last) for x in index.runs()] == [(1, 0, 1)]
    assert index.merged(index.runs()).select("docs", "last").collect() == [(6, 5)]


def test_runs_are_not_shuffled_for_a_batch(spark, tmp_path):
    index = M.LineIndex(spark, str(tmp_path), fanout=9, buckets=4)
    rows = spark.createDataFrame([(i, bytes([i % 50])) for i in range(600)], "doc_id long, line_key binary")
    index.add(rows)
    old = index.rows(index.runs()[0]).withColumnRenamed("line_key", "old_key").hint("merge")
    plan = rows.groupBy("line_key").count().join(old, F.col("line_key") == F.col("old_key"), "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange") == 1


def test_query_matches_sql(spark):
    d, db = "/root/testdata/sf0.001", duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    got, want = M.op13_line_dedup(spark, d), db.sql(M.ORACLE["op13_line_dedup"])
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[want.columns.index(c)] for c in got.columns) for r in want.fetchall())
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, got.collect())) == sorted((a, b, c, hashlib.sha256(t.encode()).hexdigest()) for a, b, c, t in brute(rows))


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("n_lines", F.lit("mine"))
    got = M.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines_", "n_dropped"] and got.drop("n_lines_", "n_dropped").exceptAll(docs).count() == 0
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(got.drop("n_lines").withColumnRenamed("n_lines_", "n_lines")) == brute(rows)
    assert M.dedup_lines(no_docs).count() == 0
