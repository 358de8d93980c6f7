import random

import corpus_pipeline as P
import fieldstone.llm.registry as R


def test_stages_keep_the_columns_and_take_effect(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, rows = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, d), "test-stage")
        assert docs.columns == columns
        rows[name] = docs.count()
    assert 200 >= rows["language_id"] > rows["simhash_dedup"] > rows["decontamination"] == rows["secret_scan"] > 100
    assert docs.select("doc_id").distinct().count() == docs.count()
    last = P.STAGES[-1][1](spark, docs, d)
    assert sorted(P.run(spark, d).select("doc_id", "epoch", "taken").collect()) == sorted(last.select("doc_id", "epoch", "taken").collect())
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash_dedup", "decontamination", "secret_scan", "source_mixing"]


def test_no_secret_and_no_item_is_left(spark, tmp_path):
    from fieldstone.llm import decontamination, secret_scan

    d = "/root/testdata/sf0.001"
    out = P.run(spark, d).where("epoch = 1").select("doc_id", "text")
    assert decontamination.find_matches(out, spark.read.parquet(f"{d}/benchmark.parquet")).count() == 0
    assert secret_scan.Ledger(spark, str(tmp_path)).update(out).where("n_access + n_hex + n_assign > 0").count() == 0


def test_the_language_stage_drops_what_it_should(spark):
    """Random letters, numbers and a script that no language has go; all documents in learned languages stay."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    chance = random.Random(4)
    junk = ["".join(chance.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(400)) for _ in range(20)] + ["Привет мир как дела сегодня " * 12, "12 34 ½ ² !!", "", None]
    rows = spark.createDataFrame([(10_000_000 + i, t, None, "junk", 400) for i, t in enumerate(junk)], docs.schema)
    kept = P.STAGES[0][1](spark, docs.unionByName(rows), d)
    assert kept.where("source = 'junk'").count() == 0 and kept.count() == docs.count()


def test_odd_rows_pass_every_stage(spark, odd_docs, no_docs):
    d = "/root/testdata/sf0.001"
    for docs in (odd_docs, no_docs):
        for _, stage in P.STAGES:
            docs = P.written(stage(spark, docs, d), "test-odd")


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in R.queries()) == list(range(1, 11))
