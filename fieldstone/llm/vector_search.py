"""Approximate nearest neighbours by adaptive dimension scan in inverted lists.

Vectors are scaled to length one, rotated by a fixed random rotation and put into the list of the nearest centroid. A query first looks through
its nearest lists, which gives it a k-th best. From that and from each other list's size and spread it expects how many nearer vectors the list
holds, and looks through lists, the densest in such vectors first, until those left should hold few: a query with close neighbours is done soon,
one without any goes on.
In a list, distances grow column block by column block; after each block a hypothesis test abandons candidates whose distance, estimated
from the columns so far, is too far beyond the present k-th best. What is left is compared by cosine in double precision on the
original vectors.

Equal vectors are one class with its smallest ids, as many as an answer can need, so copies don't fill a list. Lists with close centroids
form a bundle, and a query travels once to each bundle that it looks into. Bundles are cut into pieces of bounded size, and so are the queries
of a bundle. Vectors that are null, zero, hold null or non-finite components, or have another length than most, take no part,
nor do rows without an id. Ties go to the smaller id; with too few candidates all are returned. An empty table gives an empty result.
Rows with one id and different vectors are vectors of their own; an id is returned once, at its best, and never for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_sample, table, written

NEIGHBOURS, SEED = 5, 3
#: Vectors that the centroids are fitted on, at most about, and for each list; classes aimed at in a list; lists at most.
SAMPLE, LIST_SAMPLE, LIST_SIZE, MOST_LISTS = 20_000, 8, 32, 16_384
#: Lists that a query looks through first: at least so many, and so many times the root of the number of lists.
PROBES, PROBES_ROOT = 16, 4
#: Share of the k nearest that the lists left out may be expected to hold.
MISSED = 0.1
#: Candidates in a piece of a bundle, queries that travel to it in one group, and queries held against it at once.
PIECE, QUERY_GROUP, QUERY_PIECE = 4096, 16_384, 256
#: Columns in a block, and how many standard deviations too far a candidate must look to be abandoned.
COLUMNS, DOUBT = 16, 2.1


def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def scaled(rows: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its largest component is near 1: no square is lost or infinite, and cosines stay exactly what they are."""
    _, power = np.frexp(np.abs(rows).max(axis=1, initial=0.0))
    return np.ldexp(rows, -power[:, None])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = scaled(rows)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """The rows of a column of lists of `size` numbers."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.zeros((0, size)), *(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) for x in parts)])


def nearest_middle(rows: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of middle to each row and their cosine, some rows at a time."""
    found = [(y.argmax(axis=1), y.max(axis=1)) for y in (rows[i : i + 1024] @ middle.T for i in range(0, max(1, len(rows)), 1024))]
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def centroids(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """k-means on unit vectors."""
    chance = np.random.default_rng(SEED)
    own = sample[chance.choice(len(sample), min(n, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near, _ = nearest_middle(sample, own)
        sums = np.zeros_like(own)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        own = np.where(size > 0, sums / np.maximum(size, 1e-12), own)
    return own


def usable(vector: Column, size: int | None = None) -> Column:
    """A vector that takes part: no null or non-finite component, not zero, and of this size."""
    plain = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    right = plain & F.exists(vector, lambda x: x != 0)
    return F.coalesce(right & (F.size(vector) == size) if size is not None else right, F.lit(False))


def scan(queries: np.ndarray, candidates: np.ndarray, k: int, bounds: np.ndarray, probed: np.ndarray | None = None) -> list[np.ndarray]:
    """For each query, its k nearest candidates within its bound (a squared distance) with high probability, more if they tie, by rotated vectors.

    probed: the candidates that each query looks at; all if there is none.
    """
    size, out = queries.shape[1], []
    first = min(COLUMNS, size)
    q, c = queries[:, :first], candidates[:, :first]
    head = np.maximum((q * q).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * q @ c.T, 0)
    for i, (q, part, bound) in enumerate(zip(queries, head, bounds.tolist(), strict=True)):
        live, done = np.arange(len(part)) if probed is None else np.flatnonzero(probed[i]), first
        part = part[live]
        while True:
            if len(live) > k:  # the k that look nearest so far tighten the bound
                look = live[np.argpartition(part, k - 1)[:k]]
                bound = min(bound, ((candidates[look] - q) ** 2).sum(axis=1).max())
            if done == size:
                break
            stay = part * (size / done) <= bound * (1 + DOUBT / np.sqrt(done)) ** 2 + 1e-9
            live, part = live[stay], part[stay]
            to = min(size, done + COLUMNS)
            part = part + ((candidates[live, done:to] - q[done:to]) ** 2).sum(axis=1)
            done = to
        out.append(live[part <= bound + 1e-9])
    return out


def tail(z: np.ndarray) -> np.ndarray:
    """The share of a normal distribution beyond z."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    density = np.exp(-z * z / 2) / np.sqrt(2 * np.pi)
    beyond = density * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z >= 0, beyond, 1 - beyond)


def expected_nearer(closeness: np.ndarray, kth: np.ndarray, n: np.ndarray, mean: np.ndarray, spread: np.ndarray, size: int) -> np.ndarray:
    """For each query and list, the vectors of the list that should be nearer than the query's k-th best: directions around a centroid are taken as random.

    closeness: cosine of query and centroid. n, mean, spread: a list's vectors and their cosines with the centroid.
    """
    own = np.clip(mean + np.where(closeness >= 0, 1, -1) * spread, -1, 1)
    sd = np.sqrt(np.maximum((1 - own**2) * (1 - closeness**2), 1e-6) / max(1, size - 1))
    return n * tail((kth[:, None] - own * closeness) / sd)


def classes_of(vectors: DataFrame, key: str, vector: str, k: int) -> tuple[DataFrame, int]:
    """class_id (its smallest id), vector and ids (its k + 1 smallest) of each different usable vector; and their size."""
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(usable(F.col("vector")))
    size = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").select("size").first()
    size = size[0] if size else 0
    rows = rows.where(F.size("vector") == size).select("vec_id", F.transform("vector", lambda x: x + 0.0).alias("vector")).distinct()
    # in two steps, so that a vector's many copies are cut to their smallest ids before they meet
    part = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    for step in ("part", None):
        first = rows.withColumn("part", part) if step else rows
        groups = ["vector", "part"] if step else ["vector"]
        ranked = first.withColumn("n", F.row_number().over(Window.partitionBy(*groups).orderBy("vec_id")))
        rows = ranked.where(F.col("n") <= k + 1).select("vec_id", "vector")
    classes = rows.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return classes.select(F.col("ids")[0].alias("class_id"), "vector", "ids"), size


@dataclass
class Lists:
    """Centroids of the lists and the bundle of each; then how many vectors each list holds and how close to the centroid they are (mean and spread)."""

    middle: np.ndarray
    bundle: np.ndarray
    turn: np.ndarray
    n: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def first(self, closeness: np.ndarray, k: int, probes: int) -> list[np.ndarray]:
        """The nearest lists of each query: `probes`, or as many as hold k candidates."""
        near = np.argsort(-closeness, axis=1, kind="stable")
        return [x[: max(probes, int(np.searchsorted(np.cumsum(self.n[x]), k + 1)) + 1)] for x in near]

    def further(self, closeness: np.ndarray, kth: np.ndarray, k: int, probes: int) -> list[np.ndarray]:
        """The lists that each query looks through after its first ones."""
        expected = expected_nearer(closeness, kth, self.n, self.mean, self.spread, self.middle.shape[1])
        out = []
        for done, row in zip(self.first(closeness, k, probes), expected, strict=True):
            row[done] = 0
            order = np.argsort(-row / np.maximum(self.n, 1), kind="stable")  # most nearer ones for each vector looked at
            left = row.sum() - np.cumsum(row[order])  # what the lists after each one should hold
            out.append(order[: int((left > MISSED * k).sum()) + 1] if row.sum() > MISSED * k else order[:0])
        return out


def placed_in_lists(classes: DataFrame, n: int, size: int, kind: str) -> tuple[DataFrame, Lists]:
    """classes (class_no, vector, ids) with list, and the lists, from centroids of a bounded sample."""
    spark = classes.sparkSession
    count = max(1, min(MOST_LISTS, n // LIST_SIZE))
    sample = bounded_sample(classes, "class_no", max(SAMPLE, LIST_SAMPLE * count)).select("class_no", "vector").orderBy("class_no").toArrow()
    middle = centroids(unit(matrix(sample.column("vector"), size)), count) if sample.num_rows else np.zeros((1, max(1, size)))
    bundle, _ = nearest_middle(middle, centroids(middle, max(1, n // PIECE)))
    shared = spark.sparkContext.broadcast(middle)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near, closeness = nearest_middle(unit(matrix(batch.column(1), size)), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.int32()), pa.array(closeness), batch.column(1), batch.column(2)], names=["class_no", "list", "closeness", "vector", "ids"])

    placed = written(classes.select("class_no", "vector", "ids").mapInArrow(place, f"class_no long, list int, closeness double, vector array<double>, ids array<{kind}>"), "lists")
    # a row for each of at most MOST_LISTS lists
    found = {r["list"]: r for r in placed.groupBy("list").agg(F.count("*").alias("n"), F.avg("closeness").alias("mean"), F.stddev_pop("closeness").alias("spread")).collect()}
    about = np.array([(found[i]["n"], found[i]["mean"], found[i]["spread"]) if i in found else (0, 0.0, 0.0) for i in range(len(middle))], float)
    return placed, Lists(middle, bundle, rotation(max(1, size)), *about.T)


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each row of `vectors` that is_query holds for."""
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    classes, size = classes_of(vectors, key, vector, k)
    classes = written(classes.withColumn("class_no", F.monotonically_increasing_id()), "vectors")
    placed, lists = placed_in_lists(classes, classes.count(), size, kind)
    probes = max(PROBES, int(PROBES_ROOT * len(lists.n) ** 0.5))
    shared = spark.sparkContext.broadcast(lists)

    asked = vectors.where(is_query & F.col(key).isNotNull()).select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("vector"))
    asked = asked.where(usable(F.col("vector"), size)).select("query_id", F.transform("vector", lambda x: x + 0.0).alias("vector")).distinct()
    asked = written(asked, "queries")
    # copies among the queries are searched once
    query_classes = asked.groupBy("vector").agg(F.min("query_id").alias("q")).select("q", "vector", F.lit(-2.0).alias("kth"))

    def first_lists(closeness: np.ndarray, kth: np.ndarray) -> list[np.ndarray]:
        return shared.value.first(closeness, k, probes)

    def more_lists(closeness: np.ndarray, kth: np.ndarray) -> list[np.ndarray]:
        return shared.value.further(closeness, kth, k, probes)

    def bundled(choose, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row, bundle, lists) of the lists that the queries of a batch look through."""
        found = shared.value
        for at in range(0, batch.num_rows, QUERY_PIECE):
            part = batch.slice(at, QUERY_PIECE)
            for i, chosen in enumerate(choose(unit(matrix(part.column(1), size)) @ found.middle.T, part.column(2).to_numpy()), at):
                own = found.bundle[chosen]
                order = np.argsort(own, kind="stable")
                edges = np.flatnonzero(np.diff(own[order], prepend=-1))
                for rows in np.split(order, edges[1:]) if len(order) else []:
                    yield i, int(own[rows[0]]), np.sort(chosen[rows])

    def counting(choose):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(shared.value.n), np.int64)
            for batch in batches:
                for _, bundle, _ in bundled(choose, batch):
                    n[bundle] += 1
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some])], names=["bundle", "n"])

        return run

    def probing(choose, pieces: np.ndarray, groups: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turn = 0
            for batch in batches:
                who, bundles, parts, own, chosen = [], [], [], [], []
                for i, bundle, found in bundled(choose, batch):
                    turn += 1
                    n = int(pieces[bundle])
                    who += [i] * n
                    bundles += [bundle] * n
                    parts += range(n)
                    own += [turn % int(groups[bundle])] * n
                    chosen += [found] * n
                rows = pa.array(who, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), *(pa.array(x, pa.int32()) for x in (bundles, parts, own)), pa.array(chosen, pa.list_(pa.int32())), batch.column(1).take(rows), batch.column(2).take(rows)],
                    names=["q", "bundle", "piece", "query_group", "lists", "vector", "kth"],
                )

        return run

    def hold(queries: pa.Table, found: pa.Table) -> pa.Table:
        a, b = scaled(matrix(queries.column("vector"), size)), scaled(matrix(found.column("vector"), size))
        la, lb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        turn = shared.value.turn
        ra, rb = a / la[:, None] @ turn, b / lb[:, None] @ turn
        bounds = 2 - 2 * queries.column("kth").to_numpy()
        here, place = np.unique(found.column("list").to_numpy(), return_inverse=True)
        wanted = queries.column("lists").to_pylist()
        who, which, scores = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
        for at in range(0, len(a) if len(b) else 0, QUERY_PIECE):
            to = at + QUERY_PIECE
            looks = np.array([np.isin(here, x) for x in wanted[at:to]])
            for i, near in enumerate(scan(ra[at:to], rb, k + 1, bounds[at:to], looks[:, place]), at):
                score = (b[near] * a[i]).sum(axis=1) / (lb[near] * la[i])
                best = np.argsort(-score, kind="stable")[: 2 * k + 2]
                who.append(np.full(len(best), i))
                which.append(near[best])
                scores.append(score[best])
        rows, hits = pa.array(np.concatenate(who)), pa.array(np.concatenate(which))
        return pa.table({"q": queries.column("q").take(rows), "ids": found.column("ids").take(hits), "score": np.concatenate(scores)})

    def search(queries: DataFrame, choose) -> DataFrame:
        queries = written(queries, "asking")
        # a row for each of at most MOST_LISTS bundles
        asking = {r["bundle"]: r["n"] for r in queries.mapInArrow(counting(choose), "bundle int, n long").groupBy("bundle").agg(F.sum("n").alias("n")).collect()}
        held = np.bincount(lists.bundle, lists.n, len(lists.n))
        pieces = np.maximum(1, -(-held.astype(int) // PIECE))
        groups = np.array([-(-asking.get(i, 1) // QUERY_GROUP) for i in range(len(held))])
        rows = [(i, int(x), int(pieces[x]), int(groups[x])) for i, x in enumerate(lists.bundle)]
        info = spark.createDataFrame(rows, "list int, bundle int, pieces int, groups int")
        candidates = placed.join(F.broadcast(info), "list").withColumn("piece", F.pmod(F.xxhash64("class_no"), F.col("pieces")).cast("int"))
        candidates = candidates.select("bundle", "piece", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("query_group"), "list", "vector", "ids")
        probed = queries.mapInArrow(probing(choose, pieces, groups), f"q {kind}, bundle int, piece int, query_group int, lists array<int>, vector array<double>, kth double")
        keys = ["bundle", "piece", "query_group"]
        return written(probed.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(hold, f"q {kind}, ids array<{kind}>, score double"), "met")

    first = search(query_classes, first_lists)
    order = Window.partitionBy("q").orderBy(F.desc("score"))
    each = first.select("q", "score", F.explode("ids").alias("vec_id")).withColumn("n", F.row_number().over(order))
    kth = each.where(F.col("n") == k + 1).select("q", F.col("score").alias("kth"))
    rest = query_classes.drop("kth").join(kth, "q", "left").select("q", "vector", F.coalesce("kth", F.lit(-1.0)).alias("kth"))
    met = first.unionByName(search(rest, more_lists))
    best = met.select("q", "score", F.explode("ids").alias("vec_id")).groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = written(best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("q", "vec_id", "score"), "top")
    who = asked.join(query_classes, "vector").select("query_id", "q")
    answers = who.join(top, "q").where(F.col("vec_id") != F.col("query_id")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op4_vector_search": op4_vector_search}
ORACLE: dict[str, str] = {}
