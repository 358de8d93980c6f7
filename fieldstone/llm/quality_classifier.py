"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities.

A token has a fixed sparse vector of signs from its hash. The vector of a hash bucket of tokens is the sum of the sparse vectors of the tokens
beside them, over every document of the corpus. A document is the mean of its tokens' vectors (frequent tokens weigh less), its
length and its share of different tokens. The network is fitted on a bounded sample of labelled rows; a
part of it kept apart sets the temperature.

Null and empty texts have zero vectors and get a score like any other. Without labels of both kinds every score is the share of label 1 (1/2 if
there are none). Labels that disagree about a document count by their mean. Repeated rows are scored row by row.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordTable, bounded_sample, flat, fold, kept, slices, table, written

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
#: Size of the vectors, signs in a sparse vector, buckets of tokens: the vectors of all words take BUCKETS * SIZE * 4 bytes at any input.
SIZE, SIGNS, BUCKETS = 32, 2, 1 << 14
#: Buckets in one row of the table of sums, and rows that a task adds up.
BLOCK, FAN_IN = 1 << 10, 64
#: Labelled documents that the network is fitted on, at most about.
SAMPLE_DOCS = 20_000
HIDDEN, EPOCHS, RATE, DECAY, SEED = 24, 250, 0.01, 1e-4, 5
SMOOTH = 1e-3


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text) if text else []


def token_codes(found: list[str]) -> np.ndarray:
    """A bucket, and the places and signs of the sparse vector, of each token: columns bucket, place 1, place 2, signs."""
    hashes = np.fromiter((zlib.crc32(x.encode("utf-8", "replace")) for x in found), np.uint64, len(found))
    with np.errstate(over="ignore"):
        mixed = (hashes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    out = np.zeros((len(found), 2 + SIGNS), np.int32)
    out[:, 0] = hashes % np.uint64(BUCKETS)
    for i in range(SIGNS):
        out[:, 1 + i] = (mixed >> np.uint64(8 * i)) % np.uint64(SIZE)
    out[:, -1] = (mixed >> np.uint64(48)) & np.uint64((1 << SIGNS) - 1)
    return out


def context_sums(docs: DataFrame, text: str) -> DataFrame:
    """block, sums: for BLOCK buckets at a time, the summed sparse vectors of their tokens' neighbours, and their tokens' count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordTable(token_codes)
        sums, n = np.zeros(BUCKETS * SIZE), np.zeros(BUCKETS)
        for batch in slices(batches):
            found, offsets = flat([tokens(x) for x in batch.column(0).to_pylist()])
            own = codes.rows(found)
            if not len(own):
                continue
            n += np.bincount(own[:, 0], minlength=BUCKETS)
            inside = np.ones(len(own), bool)
            inside[offsets[:-1][offsets[:-1] < len(own)]] = False  # a document's first token has none before it
            right = np.flatnonzero(inside)
            for at, by in ((right, right - 1), (right - 1, right)):
                for i in range(SIGNS):
                    sign = 1.0 - 2.0 * ((own[by, -1] >> i) & 1)
                    sums += np.bincount(own[at, 0].astype(np.int64) * SIZE + own[by, 1 + i], sign, BUCKETS * SIZE)
        both = np.concatenate([sums.reshape(BUCKETS, SIZE), n[:, None]], axis=1)
        rows = [(i, both[i * BLOCK : (i + 1) * BLOCK]) for i in range(BUCKETS // BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, x in rows if x.any()], pa.int32()), pa.array([x.tobytes() for _, x in rows if x.any()], pa.binary())], names=["block", "sums"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK * (SIZE + 1))
        for x in rows["sums"]:
            total += np.frombuffer(x)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "sums": [total.tobytes()], "part": rows["part"].iloc[:1]})

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "block int, sums binary").withColumn("part", F.spark_partition_id())
    parts = written(parts, "contexts")
    n = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while n > 1:  # a tree of sums: no task gets more than FAN_IN parts of a block, however many there are
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("block", "part").applyInPandas(add, "block int, sums binary, part int")
        n = -(-n // FAN_IN)
        parts = written(parts, "contexts") if n > 1 else parts
    return parts.select("block", "sums")


@dataclass
class Vectors:
    """Of each bucket: its vector times its weight, and the weight."""

    vectors: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(blocks: list[tuple[int, bytes]]) -> Vectors:
        both = np.zeros((BUCKETS, SIZE + 1))
        for i, x in blocks:
            both[i * BLOCK : (i + 1) * BLOCK] = np.frombuffer(x).reshape(BLOCK, SIZE + 1)
        n, length = both[:, -1], np.linalg.norm(both[:, :-1], axis=1)
        weights = SMOOTH / (SMOOTH + n / max(1.0, n.sum()))
        vectors = both[:, :-1] / np.maximum(length, 1e-9)[:, None]
        return Vectors((vectors * weights[:, None]).astype(np.float32), weights.astype(np.float32))

    def features(self, texts: list[str | None], codes: WordTable) -> np.ndarray:
        found = [tokens(x) for x in texts]
        every, offsets = flat(found)
        n = np.diff(offsets)
        different = np.fromiter((len(set(x)) for x in found), np.float64, len(found))
        out = np.zeros((len(found), SIZE + 2))
        some = np.flatnonzero(n)
        if len(some):
            bucket = codes.rows(every)[:, 0]
            weight = np.add.reduceat(self.weights[bucket], offsets[some])
            out[some, :SIZE] = np.add.reduceat(self.vectors[bucket], offsets[some], axis=0) / np.maximum(weight, 1e-9)[:, None]
        out[:, SIZE], out[:, SIZE + 1] = np.log1p(n), different / np.maximum(n, 1)
        return out


@dataclass
class Network:
    """Two layers on standardised features, and a temperature."""

    mean: np.ndarray
    spread: np.ndarray
    first: tuple[np.ndarray, np.ndarray]
    second: tuple[np.ndarray, float]
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.tanh((x - self.mean) / self.spread @ self.first[0] + self.first[1])
        return z @ self.second[0] + self.second[1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))

    @staticmethod
    def fitted(x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> Network:
        width, chance = x.shape[1], np.random.default_rng(SEED)
        share = float(y.mean()) if len(y) else 0.5
        if not len(y) or share in (0.0, 1.0):
            level = min(max(share, 1e-6), 1 - 1e-6)
            return Network(np.zeros(width), np.ones(width), (np.zeros((width, HIDDEN)), np.zeros(HIDDEN)), (np.zeros(HIDDEN), float(np.log(level / (1 - level)))))
        train = ~apart if (~apart).any() else np.ones(len(y), bool)
        mean, spread = x[train].mean(axis=0), x[train].std(axis=0) + 1e-6
        a, t = (x[train] - mean) / spread, y[train]
        p = [chance.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), chance.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        for _ in range(max(20, min(EPOCHS, 400_000 // len(a)))):
            order = chance.permutation(len(a))
            for at in range(0, len(a), 256):
                i = order[at : at + 256]
                h = np.tanh(a[i] @ p[0] + p[1])
                off = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t[i]) / len(i)
                back = off[:, None] * p[2] * (1 - h * h)
                step += 1
                for k, g in enumerate((a[i].T @ back + DECAY * p[0], back.sum(axis=0), h.T @ off + DECAY * p[2], off.sum(keepdims=True))):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        net = Network(mean, spread, (p[0], p[1]), (p[2], float(p[3][0])))
        if apart.any():
            z, truth = net.logit(x[apart]), y[apart]

            def loss(temperature: float) -> float:
                q = np.clip(1 / (1 + np.exp(-np.clip(z / temperature, -30, 30))), 1e-9, 1 - 1e-9)
                return float(-(truth * np.log(q) + (1 - truth) * np.log(1 - q)).mean())

            net.temperature = float(min(np.geomspace(0.3, 10, 60), key=loss))
        return net


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row_key, label, text of about `most` labelled documents at most; of the documents only these travel."""
    truth = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("row_key")).agg(F.avg(F.col(label).cast("double")).alias("label"))
    sample = written(bounded_sample(truth, "row_key", most), "labels")
    own = docs.select(F.col(key).alias("row_key"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "row_key")
    # of rows with one id, one teaches, so that the result is bounded like the labels
    one = own.groupBy("row_key").agg(F.first("label").alias("label"), F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one"))
    return one.select("row_key", "label", F.col("one.text").alias("text"))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", most: int = SAMPLE_DOCS) -> DataFrame:
    """key, columns of docs named __* and score of each row; learns from all rows of labels."""
    spark = docs.sparkSession
    blocks = written(context_sums(docs, text), "contexts").toArrow()
    vectors = Vectors.of(list(zip(blocks.column("block").to_pylist(), blocks.column("sums").to_pylist(), strict=True)))
    shared, version = spark.sparkContext.broadcast(vectors), uuid.uuid4().hex

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = kept("tokens", version, lambda: WordTable(token_codes))
        for batch in slices(batches):
            x = shared.value.features(batch.column(2).to_pylist(), codes).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(list(x), pa.list_(pa.float32()))], names=["row_key", "label", "x"])

    sample = labelled(docs, labels, label, most, key, text).select("row_key", "label", "text")
    rows = sorted(sample.mapInArrow(describe, "row_key string, label double, x array<float>").toArrow().to_pylist(), key=lambda r: (r["row_key"], r["x"]))
    x = np.array([r["x"] for r in rows], float).reshape(-1, SIZE + 2)
    y = np.round(np.array([r["label"] for r in rows], float))
    apart = np.array([zlib.crc32(f"apart {r['row_key']}".encode()) % 5 == 0 for r in rows], bool)
    net = spark.sparkContext.broadcast(Network.fitted(x, y, apart))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        codes = kept("tokens", version, lambda: WordTable(token_codes))
        parts = [net.value.score(shared.value.features(texts.iloc[i : i + 512].tolist(), codes)) for i in range(0, len(texts), 512)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    extra = [c for c in docs.columns if c.startswith("__")]
    return docs.select(key, *extra, score(F.col(text).cast("string")).alias("score"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("__held_out"))
    labels = table(spark, sf_dir, "labels").where(F.coalesce(fold("doc_id", 4), F.lit(2)) != 2)
    found = quality_scores(docs, labels).withColumnRenamed("__held_out", "held_out")
    return found.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLE: dict[str, str] = {}
