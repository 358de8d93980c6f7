import hashlib
import math

import duckdb
import numpy as np

from fieldstone.llm import centroid_clustering as M


def brute(rows, k=16, rounds=3, size=64):
    """(vec_id, cluster, distance) of rows (vec_id, vector) and the centroids, all distances worked out in Python's whole numbers."""
    kept = [(i, [math.floor(64 * float(y)) for y in v]) for i, v in rows if v is not None and len(v) == size and all(y is not None and math.isfinite(y) for y in v)]
    own = [x for _, x in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)][:k]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(own))

    for _ in range(rounds):
        near = [nearest(x)[1] for _, x in kept]
        for j in range(len(own)):
            if mine := [x for (_, x), n in zip(kept, near, strict=True) if n == j]:
                own[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return [(i, j, d) for i, x in kept for d, j in [nearest(x)]], own


def test_assign_keeps_ties_and_skips_distances():
    chance = np.random.default_rng(1)
    x = np.concatenate([chance.integers(-3, 3, (500, 4)), chance.integers(-40, 40, (500, 4)) * 25])
    centroids = np.concatenate([x[:6], x[:3], x[500:509]])  # some centroids twice: ties everywhere
    near, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf, np.float32), np.zeros((len(x), len(centroids)), np.float32)
    every = len(x) * len(centroids)
    for _ in range(5):
        worked = M.assign(x, near, upper, lower, centroids)
        exact = np.stack([M.squared(x, c) for c in centroids], axis=1)
        assert (near == exact.argmin(axis=1)).all() and worked < every
        root = np.sqrt(exact.astype(float))
        assert (upper >= root[np.arange(len(x)), near]).all() and (lower <= root).all()
        after = centroids + chance.integers(-1, 2, centroids.shape)
        upper, lower = M.moved(upper, lower, near, centroids, after)
        centroids = after
    assert worked < every / 2


def test_bounds_round_outwards():
    x = np.array([0.0, 1.0, 1 / 3, 2.0**31 + 1, 1e-30])
    assert (M.up(x).astype(float) >= x).all() and (M.down(x).astype(float) <= x).all()


def rows_of(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance").collect()), key=str)


def test_query_matches_brute_force_and_sql(spark):
    d, db = "/root/testdata/sf0.001", duckdb.connect()
    got = M.op12_centroid_clustering(spark, d)
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, own = brute(rows)
    assert rows_of(got) == sorted(want, key=str)
    r = got.where("cluster = 3").first()
    assert r.cluster_inertia == sum(d for _, j, d in want if j == 3) and r.inertia == sum(d for _, _, d in want)
    assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, own[3])).encode()).hexdigest()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    sql = db.sql(M.ORACLE["op12_centroid_clustering"])
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[sql.columns.index(c)] for c in got.columns) for r in sql.fetchall())


def test_ties_copies_and_small_whole_vectors(spark):
    chance = np.random.default_rng(2)
    rows = [(i % 190, [float(y) / 64 for y in chance.integers(-2, 3, 4)]) for i in range(400)]
    found, own = M.clusters(spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3), vector="v", k=9, rounds=4, size=4)
    want, centroids = brute(rows, 9, 4, 4)
    assert own.tolist() == centroids and rows_of(found) == sorted(want, key=str)


def test_rows_that_take_no_part(spark):
    fine = [0.5] * 64
    rows = [(1, fine, 1), (2, None, 1), (3, [], 1), (4, [0.5] * 63, 1), (5, [*fine[1:], None], 1), (6, [*fine[1:], float("nan")], 1), (7, [*fine[1:], float("inf")], 1), (None, [0.25] * 64, 1), (8, [*fine[1:], 1e300], 1), (1, fine, 1), (9, [-0.001] * 64, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int")
    got, own = M.clusters(df)
    assert sorted((r.vec_id or 0, r.distance) for r in got.collect())[0][0] == 0 and got.count() == 4 and len(own) == 3
    want, _ = brute([(a, b) for a, b, _ in rows if a != 8])
    assert rows_of(got) == sorted(want, key=str)
    assert M.clusters(df.where("false"))[0].count() == 0 and M.clusters(df.where("vec_id is null"))[0].count() == 0
