import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstone.llm import vector_search as M

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, is_query, k=5):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = {}
    for q, a in usable:
        if is_query(q):
            scored = sorted((-(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), i) for i, b in usable if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / max(1, sum(map(len, want.values())))


def test_query_recall_and_scores(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    vectors = dict(rows)
    want = brute(rows, lambda i: i % 50 == 0)
    got = found(M.op4_vector_search(spark, d))
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    assert recall(got, want) >= 0.95
    for q, near in got.items():
        a = np.array(vectors[q], float)
        for i, s in near:
            b = np.array(vectors[i], float)
            assert s == pytest.approx(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), abs=1e-12)


def test_many_lists_and_pieces_keep_recall(spark, monkeypatch):
    chance = np.random.default_rng(1)
    middles = chance.normal(size=(30, 32))
    x = middles[chance.integers(0, 30, 3000)] + 0.5 * chance.normal(size=(3000, 32))
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    monkeypatch.setattr(M, "LIST_SIZE", 50)
    monkeypatch.setattr(M, "PIECE", 30)
    want = brute(rows, lambda i: i % 100 == 0)
    assert recall(found(M.nearest(df, F.col("vec_id") % 100 == 0)), want) >= 0.9


@pytest.mark.parametrize("shape", ["random", "half"])
def test_vectors_without_structure_are_found_too(spark, monkeypatch, shape):
    chance = np.random.default_rng(4)
    x = chance.normal(size=(6000, 64))
    if shape == "half":
        x[::2] = chance.normal(size=(10, 64))[chance.integers(0, 10, 3000)] + 0.05 * chance.normal(size=(3000, 64))
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    monkeypatch.setattr(M, "LIST_SIZE", 60)
    want = brute(rows, lambda i: i % 50 == 0)
    assert recall(found(M.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), F.col("vec_id") % 50 == 0)), want) >= 0.93


def test_normal_tail():
    assert M.tail(np.array([-3.0, 0.0, 1.0, 2.5, 4.0])) == pytest.approx([0.99865, 0.5, 0.158655, 0.0062097, 3.167e-5], rel=1e-3)


def test_copies_ties_and_unusable_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(40)] + [(100, [2.0, 1.0]), (101, None), (102, [0.0, 0.0]), (103, [1.0, None]), (104, [1.0, float("nan")]), (105, [float("inf"), 1.0]), (106, []), (None, [1.0, 2.0]), (7, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = found(M.nearest(df, F.col("vec_id") % 10 == 0))
    assert sorted(got) == [0, 10, 20, 30, 100]
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[30]] == [0, 1, 2, 3, 4] == [i for i, _ in got[100]]


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0), (3, [1.0, 1.0, 1.0], 0)], SCHEMA)
    got = found(M.nearest(df, F.col("vec_id") >= 0))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {0: [2, 1], 1: [2, 0], 2: [0, 1]}
    assert M.nearest(df.where("false"), F.col("vec_id") >= 0).count() == 0
    assert M.nearest(df.where("vec_id = 0"), F.col("vec_id") >= 0).count() == 0


def test_scan_abandons_only_far_candidates():
    chance = np.random.default_rng(2)
    middles = chance.normal(size=(40, 64))
    x = M.unit(middles[chance.integers(0, 40, 2000)] + 0.6 * chance.normal(size=(2000, 64))) @ M.rotation(64)
    hits = total = 0
    for i, near in enumerate(M.scan(x[:50], x, 6, np.full(50, 4.0))):
        best = np.argsort(((x - x[i]) ** 2).sum(axis=1))[:6]
        hits += len(np.intersect1d(near, best))
        total += 6
        assert len(near) == 6
    assert hits / total > 0.97


def test_tiny_and_huge_vectors_take_part(spark):
    chance = np.random.default_rng(6)
    plain = chance.normal(size=(300, 8))
    sizes = np.array([1.0, 1e-200, 1e200, 5e-310])[np.arange(300) % 4]
    rows = [(i, v, 0) for i, v in enumerate((plain * sizes[:, None]).tolist())]
    got = found(M.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 10 < 4))
    want = brute([(i, v) for i, v in enumerate(plain.tolist())], lambda i: i % 10 < 4)
    assert got.keys() == want.keys() and recall(got, want) >= 0.99
    exact = {q: dict(x) for q, x in brute(list(enumerate(plain.tolist())), lambda i: i % 10 < 4, 300).items()}
    # subnormal components have few digits left
    assert all(s == pytest.approx(exact[q][i], abs=1e-12 if q % 4 < 3 and i % 4 < 3 else 1e-6) for q, x in got.items() for i, s in x)
