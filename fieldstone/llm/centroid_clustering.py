"""Centroid clustering with Elkan's bounds on whole-number vectors.

Each vector keeps an upper bound of the distance to its own centroid and a lower bound of that to every centroid. When centroids have moved, the
bounds move with them, and a distance is worked out only where neither the bounds nor the distances between centroids
say that another centroid is strictly farther. Bounds are rounded outwards and pruning is strict, so ties are always worked out, in whole numbers: the
result is that of working out everything. Bounds travel with their vectors, in one table for each round; sums of the components of a
cluster come from all tasks and meet as one row for each cluster and component.

Vectors that are null, have another number of components than asked for, or null or non-finite ones, take no part; nor do those with a
component of 2^21 or more in magnitude, whose squared distances a long may not hold. Rows without an id are clustered but never the first centroids.
Rows that repeat are vectors of their own; of several with one id the smaller in its components begins. With fewer vectors than centroids there are
fewer clusters, and none without vectors. Further columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import superseded
from .common import table, written

CLUSTERS, ROUNDS, COMPONENTS, SCALE, SALT = 16, 3, 64, 64, "1:"
#: Components below this in magnitude have squared distances that fit a long.
LARGEST = 1 << 21
#: Vectors looked at together.
ROWS = 4096
LONGEST = (1 << 63) - 1


def up(x: np.ndarray) -> np.ndarray:
    """float32 of x, not below it."""
    return np.nextafter(np.asarray(x).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    """float32 of x, not above it."""
    return np.nextafter(np.asarray(x).astype(np.float32), np.float32(-np.inf))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of whole numbers."""
    gap = x - y
    return (gap * gap).sum(axis=1)


def halves(centroids: np.ndarray) -> np.ndarray:
    """Half of the distance between each two centroids, rounded down; infinite for a centroid and itself."""
    out = np.stack([down(np.sqrt(squared(centroids, c).astype(float)) / 2) for c in centroids])
    np.fill_diagonal(out, np.inf)
    return out


def assign(x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray) -> int:
    """Brings near (the nearest centroid, of equals the smaller number), upper and lower up to date in place; gives the distances worked out."""
    half = halves(centroids)
    some = np.flatnonzero(upper >= half.min(axis=1)[near])
    tight, exact, worked = np.zeros(len(x), bool), np.zeros(len(x), np.int64), 0
    for j in range(len(centroids)):
        open_to = lambda rows: rows[(near[rows] != j) & (upper[rows] >= lower[rows, j]) & (upper[rows] >= half[near[rows], j])]  # noqa: B023, E731
        rows = open_to(some)
        loose = rows[~tight[rows]]
        if len(loose):
            worked += len(loose)
            exact[loose] = squared(x[loose], centroids[near[loose]])
            root = np.sqrt(exact[loose].astype(float))
            upper[loose], lower[loose, near[loose]], tight[loose] = up(root), down(root), True
            rows = open_to(rows)
        worked += len(rows)
        other = squared(x[rows], centroids[j])
        lower[rows, j] = down(np.sqrt(other.astype(float)))
        closer = (other < exact[rows]) | ((other == exact[rows]) & (j < near[rows]))
        rows, other = rows[closer], other[closer]
        near[rows], exact[rows], upper[rows] = j, other, up(np.sqrt(other.astype(float)))
    return worked


def moved(upper: np.ndarray, lower: np.ndarray, near: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds after the centroids have moved."""
    far = np.nextafter(np.sqrt(squared(before, after).astype(float)), np.inf)
    return up(upper.astype(float) + far[near]), down(lower.astype(float) - far)


def whole(column: pa.Array, size: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(kind)


def quantised(vectors: DataFrame, key: str, vector: str, size: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id and x (whole numbers) of each vector that takes part."""
    x = F.col(vector).cast("array<double>")
    fits = (F.size(x) == size) & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < LARGEST))
    rows = vectors.where(F.coalesce(fits, F.lit(False)))
    return rows.select(F.col(key).alias("vec_id"), F.transform(x, lambda y: F.floor(y * scale).cast("int")).alias("x"))


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS, salt: str = SALT) -> np.ndarray:
    """The vectors whose salted ids have the smallest hashes, in their order."""
    own: Column = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    found = rows.where("vec_id is not null").select(own.alias("hash"), "x").orderBy("hash", "x").limit(clusters).collect()  # one row for each cluster
    return np.array([r["x"] for r in found], np.int64)


def round_of(rows: DataFrame, centroids: np.ndarray, before: np.ndarray | None = None) -> DataFrame:
    """The rows (vec_id, x; after the first round near, upper, lower too) with their nearest centroids and bounds."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = whole(part.column(1), size, np.int64)
                if before is None:
                    near, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf, np.float32), np.zeros((len(x), k), np.float32)
                else:
                    near, lower = part.column(2).to_numpy().astype(np.int64), whole(part.column(4), k, np.float32)
                    upper, lower = moved(part.column(3).to_numpy(), lower, near, before, centroids)
                assign(x, near, upper, lower, centroids)
                bounds = pa.ListArray.from_arrays(np.arange(0, lower.size + 1, k, dtype=np.int32), pa.array(lower.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(near.astype(np.int32)), pa.array(upper), bounds], names=["vec_id", "x", "near", "upper", "lower"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, x array<int>, near int, upper float, lower array<float>")


def next_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of each cluster's mean; centroids without vectors stay."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            near = batch.column(0).to_numpy()
            np.add.at(sums, near, whole(batch.column(1), size, np.int64))
            n += np.bincount(near, minlength=k)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, size)), pa.array(np.tile(np.arange(size), len(some))), pa.array(sums[some].ravel()), pa.array(np.repeat(n[some], size))], names=["cluster", "place", "total", "n"])

    parts = state.select("near", "x").mapInArrow(run, "cluster long, place long, total long, n long")
    after = centroids.copy()
    for r in parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():  # clusters x components
        after[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return after


def final_of(state: DataFrame, centroids: np.ndarray, before: np.ndarray) -> DataFrame:
    """vec_id, cluster and exact squared distance by the final centroids."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, near = whole(batch.column(1), size, np.int64), batch.column(2).to_numpy()
            found = [squared(x[i : i + ROWS], centroids[near[i : i + ROWS]]) for i in range(0, len(x), ROWS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], names=["vec_id", "cluster", "distance"])

    return round_of(state, centroids, before).mapInArrow(run, f"vec_id {state.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def clusters(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, size: int = COMPONENTS, scale: int = SCALE, salt: str = SALT) -> tuple[DataFrame, np.ndarray]:
    """key, cluster, distance, cluster_inertia and inertia (null beyond a long) of each vector, and the final centroids."""
    spark = vectors.sparkSession
    rows = quantised(vectors, key, vector, size, scale)
    centroids = first_centroids(rows, k, salt)
    if not len(centroids):  # no vector with an id
        kind = vectors.schema[key].dataType.simpleString()
        return spark.createDataFrame([], f"{key} {kind}, cluster int, distance long, cluster_inertia long, inertia long"), centroids
    state, before = written(round_of(rows, centroids), "round"), None
    for turn in range(rounds):
        before, centroids = centroids, next_centroids(state, centroids)
        if turn + 1 < rounds:
            last, state = state, written(round_of(state, centroids, before), "round")
            superseded(last)
    found = written(final_of(state, centroids, before) if rounds else final_of(state, centroids, centroids), "clusters")
    superseded(state)
    sums = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # a row for each cluster
    every = sum(sums.values())
    of = spark.createDataFrame([(i, x if x <= LONGEST else None, every if every <= LONGEST else None) for i, x in sums.items()], "cluster int, cluster_inertia long, inertia long")
    return found.join(F.broadcast(of), "cluster").select(F.col("vec_id").alias(key), "cluster", "distance", "cluster_inertia", "inertia"), centroids


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clusters(table(spark, sf_dir, "embeddings"))
    prints = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    return found.join(F.broadcast(spark.createDataFrame(prints, "cluster int, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(n: int) -> str:
    """SQL of one assignment and of the centroids that follow from it."""
    return f"""
near_{n} AS MATERIALIZED (
  SELECT v.row_no, arg_min(c.cluster, struct_pack(d := list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c := c.cluster)) AS cluster,
    min(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT) AS distance
  FROM kept v, centroids_{n} c GROUP BY v.row_no),
sums_{n} AS (
  SELECT cluster, i, sum(x[i])::HUGEINT AS total, count(*)::HUGEINT AS n
  FROM near_{n} JOIN kept USING (row_no), (SELECT unnest(range(1, 65)) AS i) GROUP BY cluster, i),
means_{n} AS (
  SELECT cluster, list((CASE WHEN total >= 0 THEN total // n ELSE -((n - 1 - total) // n) END)::BIGINT ORDER BY i) AS x FROM sums_{n} GROUP BY cluster),
centroids_{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.x, c.x) AS x FROM centroids_{n} c LEFT JOIN means_{n} m USING (cluster))"""


QUERIES = {"op12_centroid_clustering": op12_centroid_clustering}
ORACLE = {
    "op12_centroid_clustering": f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda y: floor(64 * y::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
centroids_0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY hash, x) - 1)::INTEGER AS cluster, x
  FROM (SELECT sha256('1:' || vec_id::VARCHAR) AS hash, x FROM kept WHERE vec_id IS NOT NULL ORDER BY hash, x LIMIT 16)),
{",".join(_round_sql(n) for n in range(4))}
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM near_3 JOIN kept USING (row_no) JOIN centroids_3 c USING (cluster)"""
}
