"""SimHash near-dedup: fingerprints, pigeonhole block join, exact Hamming check, connected components.

A fingerprint has a bit for each bit that is set in over half of the text's shingle hashes. Fingerprints are cut into m blocks; two
that differ in at most r bits agree in at least m - r blocks, so every such pair meets under one of the choices of m - r blocks.
m follows the number of different fingerprints, so that the blocks of a key hold enough bits; any m finds all pairs.

Equal fingerprints are one row throughout. A bucket gives a forest over its links and not all its pairs. A bucket beyond
MOST_IN_BUCKET is split exactly: fingerprints within four bits share a point within two bits of either.

Null and empty texts have fingerprint zero and link like any other. Repeated rows fall in one class; null ids never become a class id
unless a class has no other. Further columns are left alone, and an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import slices, table, written

SHINGLE_WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints that one key may have before its rows are split by points.
MOST_IN_BUCKET = 1 << 16
#: Fingerprints aimed at in a bucket of unrelated ones.
AIM = 16


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False)) if len(words) >= shingle_words else [b" ".join(words)]
    hashes = np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """key, a hash of the text (to tell rows of one key apart) and the fingerprint as a signed long, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(x, shingle_words) for x in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["row_key", "text_hash", "fp"])

    chosen = docs.select(F.col(key).alias("row_key"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"row_key {docs.schema[key].dataType.simpleString()}, text_hash long, fp long")


def block_masks(blocks: int, radius: int) -> list[int]:
    """The masks of all choices of blocks - radius blocks out of 64 bits, as signed longs."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in itertools.pairwise(edges)]
    masks = (sum(chosen) for chosen in itertools.combinations(parts, blocks - radius))
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def blocks_for(n: int, radius: int) -> int:
    """The fewest blocks whose keys keep buckets of unrelated fingerprints near AIM."""
    blocks = radius + 1
    while blocks < 2 * radius and n > AIM * 2 ** (64 * (blocks - radius) // blocks):
        blocks += 1
    return blocks


def bucket_links(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A forest of links that joins exactly those of fps that a chain of links joins."""
    left, out = np.arange(1, len(fps)), []
    waiting = [0]
    while waiting or len(left):
        if not waiting:
            waiting, left = [int(left[0])], left[1:]
        at = waiting.pop()
        near = np.bitwise_count(fps[left] ^ fps[at]) <= radius
        if near.any():
            new, left = left[near], left[~near]
            out.append((np.full(len(new), fps[at]), fps[new]))
            waiting.extend(new.tolist())
    return out


def links(fps: DataFrame, n: int, radius: int = RADIUS, most: int = MOST_IN_BUCKET) -> DataFrame:
    """a, b: links between different fingerprints (column fp), enough to join all that differ in at most `radius` bits by chains."""
    masks = block_masks(blocks_for(n, radius), radius)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("mask_no", "mask")).select("mask_no", F.col("fp").bitwiseAND(F.col("mask")).alias("bucket"), "fp")
    keyed = keyed.repartition("mask_no", "bucket").sortWithinPartitions("mask_no", "bucket")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = ["a", "b", "over"]

        def rows(a: np.ndarray, b: np.ndarray, over: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), over))], names=schema)

        def solve(numbers: np.ndarray, buckets: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate([[True], (numbers[1:] != numbers[:-1]) | (buckets[1:] != buckets[:-1])]))
            sizes = np.diff(np.append(starts, len(own)))
            group = np.repeat(np.arange(len(starts)), sizes)
            pairs = []
            small = sizes[group] <= AIM
            for shift in range(1, min(AIM, sizes.max())):
                near = small[shift:] & (group[shift:] == group[:-shift]) & (np.bitwise_count(own[shift:] ^ own[:-shift]) <= radius)
                pairs.append((own[:-shift][near], own[shift:][near]))
            for k in np.flatnonzero((sizes > AIM) & (sizes <= most)):
                pairs += bucket_links(own[starts[k] : starts[k] + sizes[k]], radius)
            if pairs:
                yield rows(*(np.concatenate(x) for x in zip(*pairs, strict=True)), False)
            for k in np.flatnonzero(sizes > most):
                yield rows(*[own[starts[k] : starts[k] + sizes[k]]] * 2, True)

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # the last bucket, which the next batch may go on with
        over: tuple[int, int] | None = None  # the bucket whose rows are handed on
        for batch in batches:
            numbers, buckets, own = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            if not len(own):
                continue
            last = np.flatnonzero((numbers != numbers[-1]) | (buckets != buckets[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if over and (numbers[0], buckets[0]) == over:
                same = (numbers == over[0]) & (buckets == over[1])
                yield rows(own[same], own[same], True)
                numbers, buckets, own = numbers[~same], buckets[~same], own[~same]
                cut = max(0, cut - int(same.sum()))
                if not len(own):
                    continue
            over = None
            if cut:
                yield from solve(*(np.concatenate(x) for x in zip(*held, (numbers[:cut], buckets[:cut], own[:cut]), strict=True)))
                held = []
            elif held and (held[-1][0][0], held[-1][1][0]) != (numbers[0], buckets[0]):
                yield from solve(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            held.append((numbers[cut:], buckets[cut:], own[cut:]))
            if sum(len(x[0]) for x in held) > most:
                over = (numbers[-1], buckets[-1])
                every = np.concatenate([x[2] for x in held])
                yield rows(every, every, True)
                held = []
        if held:
            yield from solve(*(np.concatenate(x) for x in zip(*held, strict=True)))

    found = written(keyed.mapInArrow(within, "a long, b long, over boolean"), "links")
    direct = found.where("not over").select("a", "b")
    return direct.unionByName(point_links(found.where("over").select(F.col("a").alias("fp")).distinct(), radius))


def point_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links through shared points: two fingerprints within `radius` (even) bits share a point within half of it, and only such do."""
    flips = np.array([sum(1 << b for b in chosen) for n in range(radius // 2 + 1) for chosen in itertools.combinations(range(64), n)], np.uint64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            own = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((own[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(own, len(flips)).view(np.int64))], names=["point", "fp"])

    points = fps.mapInArrow(spread, "point long, fp long")
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a < top").select("point", "a")
    return points.join(least, "point").where("a < fp").select("a", F.col("fp").alias("b")).distinct()


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, root (a fingerprint for each class) and component_id (the smallest row_key reachable) of each different fingerprint of prints (row_key, fp)."""
    fps = written(prints.groupBy("fp").agg(F.min("row_key").alias("least")), "fps")
    roots = connected_components(links(fps, fps.count(), radius))
    joined = written(fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return written(joined.join(ids, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """key, text_hash, fingerprint (16 hex digits), component_id and root of each row; root tells classes apart that have no id."""
    prints = written(fingerprints(docs, key, text, shingle_words), "prints")
    found = classes(prints, radius)
    return prints.join(found, "fp").select(F.col("row_key").alias(key), "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, one of each class of near duplicates: the one with the smallest key (of equal keys, the smallest text hash)."""
    found = written(near_duplicates(docs, key, text, shingle_words, radius), "marked")
    first = found.groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("row_key"), "text_hash")).alias("first"))
    first = first.select(F.col("first.row_key").alias("__first_key"), F.col("first.text_hash").alias("__first_hash"))
    again = not found.groupBy(key, "text_hash").count().where("count > 1").isEmpty()
    own = docs.withColumn("__text_hash", F.xxhash64(F.col(text).cast("string")))
    rows = own.join(first, F.col(f"`{key}`").eqNullSafe(F.col("__first_key")) & (F.col("__text_hash") == F.col("__first_hash")), "left_semi")
    if again:  # rows that repeat in full
        rows = rows.dropDuplicates([key, "__text_hash"])
    return rows.drop("__text_hash")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


QUERIES = {"op8_simhash_dedup": op8_simhash_dedup}
ORACLE: dict[str, str] = {}
