import re
from collections import defaultdict
from itertools import cycle

import pytest
from pyspark.sql import functions as F

from fieldstone.llm import source_mixing as M


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = dict(zip(names, cycle((1, 2, 3))))
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        share = sum(weights[s] for s in names if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else left * weights[s] / share for s in names}
        more = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not more:
            return target
        capped |= more


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


@pytest.mark.parametrize("text", [None, "", " ", "a", " a", "a ", " a  b ", "a\tb\nc\x0bd\x0ce\rf", "a b \x1cc d", "\n\n", "é 日本 x"])
def test_word_count(spark, text):
    assert spark.createDataFrame([(text,)], "text string").select(M.word_count("text")).first()[0] == words(text)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 20, "c": 30}, {"a": 1000, "b": 1, "c": 1, None: 5}, {"z": 0, "a": 7}, {"é": 3, "Z": 400, "a": 2, None: 90, "b": 1, "": 4}, {"a": 0}, {"a": 5}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in M.targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes)) and all(got[s] <= 3 * n for s, n in sizes.items())


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += words(r.text)
    target = brute_targets(sizes)
    rows = M.op3_source_mixing(spark, d).collect()
    assert len(rows) == len(docs)
    by_id, taken = {r.doc_id: r for r in rows}, defaultdict(int)
    for r in docs:
        got = by_id[r.doc_id]
        assert got.size == words(r.text) and got.source_size == sizes[r.source] and got.target == pytest.approx(target[r.source])
        assert 0 <= got.taken <= 3 * got.size
        taken[r.source] += got.taken
    assert all(abs(taken[s] - target[s]) < 1.001 for s in sizes)
    assert sorted(rows) == sorted(M.op3_source_mixing(spark, d).collect())


def test_cells_make_one_order(spark, monkeypatch):
    """However many cells there are, rows follow each other without gaps."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    monkeypatch.setattr(M, "CELL_ROWS", 30)
    many = M.mix(docs).collect()
    monkeypatch.setattr(M, "CELL_ROWS", 10_000)
    assert sorted(many) == sorted(M.mix(docs).collect())


def test_odd_rows(spark, odd_docs, no_docs):
    rows = M.mix(odd_docs).collect()
    assert len(rows) == 9 and sum(r.taken for r in rows) <= sum(r.size for r in rows)
    assert M.mix(no_docs).count() == 0
    out = M.mixture(odd_docs)
    assert out.columns == [*odd_docs.columns, "epoch", "taken"]
    assert all(r.taken > 0 and r.text for r in out.collect())
    assert M.mixture(no_docs).count() == 0


def test_mixture_repeats_epochs(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j " * 30, "a"), (2, "x y", "b"), (3, "z", "b")], "doc_id long, text string, source string")
    rows = M.mixture(docs).orderBy("doc_id", "epoch").collect()
    assert [(r.doc_id, r.epoch, r.taken) for r in rows if r.source == "b"] == [(2, 1, 2), (2, 2, 2), (2, 3, 2), (3, 1, 1), (3, 2, 1), (3, 3, 1)]
    assert sum(r.taken for r in rows) == pytest.approx(303, abs=1)


def test_texts_hold_the_words_taken(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = M.mixture(docs).collect()
    assert all(words(r.text) == r.taken for r in rows)
    whole = {r.doc_id: r.text for r in docs.collect()}
    cut = [r for r in rows if r.text != whole[r.doc_id]]
    assert 0 < len(cut) <= 20 and all(r.n_chars == len(r.text) and whole[r.doc_id].split()[: r.taken] == r.text.split() for r in cut)


def test_columns_that_the_mixture_adds_too(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 7, "x", 1.5), (2, "d e", "s", 8, "y", 2.5)], "doc_id long, text string, source string, epoch int, taken string, __key double")
    out = M.mixture(docs)
    assert out.columns == [*docs.columns, "epoch_", "taken_"]
    assert sorted((r.doc_id, r.epoch, r.taken, r.epoch_, r.taken_) for r in out.collect()) == [(1, 7, "x", 1, 3), (2, 8, "y", 1, 2)]


@pytest.mark.parametrize("copies", [7, 400])
def test_copies_at_the_cut_keep_to_the_budget(spark, copies):
    """All rows of two sources are one row each time: the words taken still sum up to the targets."""
    rows = [(1, "a b c d e", "big")] * copies + [(2, "x y z", "small")] * (copies // 3) + [(2, "x y z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    target = brute_targets({"big": 5 * copies, "small": 3 * (copies // 3), None: 3})
    out, taken = M.mixture(docs).collect(), defaultdict(int)
    for r in out:
        assert words(r.text) == r.taken
        taken[r.source] += r.taken
    assert all(target[s] - 1 < taken[s] <= target[s] for s in target)
    assert taken["big"] < 5 * copies and len(out) < 3 * len(rows)


def test_targets_of_very_many_sources(spark, monkeypatch):
    from fieldstone.operators import ranges

    sizes = {f"s{i}": (i * 7919) % 101 for i in range(300)} | {None: 5_000}
    monkeypatch.setattr(ranges, "FEW_ROWS", 10)
    got = {r.source: r.target for r in M.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(brute_targets(sizes))
