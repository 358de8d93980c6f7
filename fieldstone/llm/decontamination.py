"""Benchmark decontamination: SimHash fingerprints of item-sized windows, multi-index Hamming search, exact check.

Every window of a document that has as many words as an item is a candidate place for it; for items longer than the document, the whole
document is. A window that shares no shingle with any item has
similarity 0 and gets no fingerprint. The others do; the blocks of an item's fingerprint index it under all values within
floor(radius / blocks) bits, which finds every fingerprint within the radius. Candidates are then compared by weighted
Jaccard similarity of their five-word shingles (a shingle weighs more the fewer items have it).

A benchmark beyond a bound is searched in parts. Weights are those of the whole benchmark all the same: a part knows how many items have the shingles of
its own items; how many have the others is joined to the windows that may be similar enough, in whatever way the others weigh. So parts change nothing.

Words are in lower case (A-Z) and split at ASCII white space. Items with fewer than five words have no shingle: they match where the same words
follow each other. Null and empty texts match nothing. Equal items each match. An empty benchmark leaves all documents alone. Repeated rows are judged row by row.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, WordTable, flat, kept, slices, table, written

SHINGLE_WORDS, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 17, 6
#: Items that go to the executors at once, and their text; a larger benchmark is searched in parts.
MOST_ITEMS, MOST_ITEM_BYTES = 50_000, 16 << 20
#: Pairs of fingerprints that a search holds at once.
MOST_PAIRS = 1 << 20


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit hashes of the runs of `size` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return out


def window_prints(shingles: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """SimHash of the `length` shingles from each of starts on (ascending)."""
    lo, hi = int(starts[0]), int(starts[-1]) + length
    signs = np.unpackbits(shingles[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((hi - lo + 1, 64), np.int32)
    np.cumsum(signs, axis=0, out=sums[1:])
    ones = sums[starts - lo + length] - sums[starts - lo]
    return np.packbits(ones * 2 > length, axis=1, bitorder="little").view("<u8").ravel()


class BlockIndex:
    """Fingerprints within a radius: by the values of each block within floor(radius / blocks) bits."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.prints, self.radius = prints, radius
        self.edges = [round(64 * i / blocks) for i in range(blocks + 1)]
        self.tables = []
        for block in range(blocks):
            values = np.arange(1 << (self.edges[block + 1] - self.edges[block]), dtype=np.uint64)
            flips = values[np.bitwise_count(values) <= radius // blocks]
            near = (self.block(prints, block)[:, None] ^ flips).ravel()
            items = np.repeat(np.arange(len(prints), dtype=np.int32), len(flips))
            by = np.argsort(near, kind="stable")
            self.tables.append((np.searchsorted(near[by], np.arange(len(values) + 1, dtype=np.uint64)), items[by]))

    def block(self, prints: np.ndarray, block: int) -> np.ndarray:
        lo, hi = self.edges[block], self.edges[block + 1]
        return (prints >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in prints, item) of all pairs within the radius."""
        found = [np.zeros(0, np.int64)]
        for block, (offsets, items) in enumerate(self.tables):
            value = self.block(prints, block).astype(np.int64)
            first, n = offsets[value], offsets[value + 1] - offsets[value]
            ends = np.cumsum(n)
            lo = 0
            while lo < len(prints):  # as many fingerprints at once as have MOST_PAIRS candidates, one at least
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + MOST_PAIRS, side="right")))
                who = np.repeat(np.arange(lo, hi), n[lo:hi])
                at = np.arange(len(who)) - np.repeat(ends[lo:hi] - n[lo:hi] - (ends[lo - 1] if lo else 0), n[lo:hi]) + np.repeat(first[lo:hi], n[lo:hi])
                item = items[at]
                near = np.bitwise_count(prints[who] ^ self.prints[item]) <= self.radius
                found.append(who[near] * len(self.prints) + item[near])
                lo = hi
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))


class Benchmark:
    """Items in the form that windows are held against. Of a part of a benchmark: shared has the shingles that several items of the whole have, in order, how many have each, and the whole's number of items."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS, shared: tuple[np.ndarray, np.ndarray, int] | None = None):
        self.threshold, self.words = threshold, WordTable(word_hashes)
        every: list[tuple[int, object, np.ndarray]] = []
        short: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            hashes = self.words.rows(split_words(text))
            if len(hashes) >= SHINGLE_WORDS:
                every.append((len(hashes) - SHINGLE_WORDS + 1, item_id, shingle_hashes(hashes)))
            elif len(hashes):
                short[len(hashes)][int(shingle_hashes(hashes, len(hashes))[0])].append(item_id)
        every.sort(key=lambda x: x[0])
        #: By number of words, the hashes of items too short for a shingle, in order, and their ids.
        self.short = {size: (np.sort(np.array(list(found), np.uint64)), found) for size, found in sorted(short.items())}
        self.lengths, self.ids = np.array([x for x, _, _ in every], np.int64), [x for _, x, _ in every]
        sets = [np.unique(x, return_counts=True) for _, _, x in every]
        self.hashes, self.times = (np.concatenate([np.zeros(0, kind), *(x[i] for x in sets)]) for i, kind in ((0, np.uint64), (1, np.int64)))
        self.ends = np.concatenate([[0], np.cumsum([len(x) for x, _ in sets])]).astype(np.int64)
        self.known, holders = np.unique(self.hashes, return_counts=True)
        n = len(every)
        if shared is not None:
            several, counts, n = shared
            holders = np.ones(len(self.known), np.int64)
            at = np.minimum(np.searchsorted(several, self.known), max(0, len(several) - 1))
            same = several[at] == self.known if len(several) else np.zeros(len(self.known), bool)
            holders[same] = counts[at[same]]
        self.weights, self.other = np.log(1 + n / holders), math.log(1 + n)
        self.totals = np.add.reduceat(self.times * self.weights_of(self.hashes), self.ends[:-1]) if every else np.zeros(0)
        self.shelf = np.zeros(1 << 20, bool)
        self.shelf[(self.known >> np.uint64(44)).astype(np.int64)] = True
        prints = [window_prints(x, np.zeros(1, np.int64), length) for length, _, x in every]
        self.index = BlockIndex(np.concatenate(prints) if prints else np.zeros(0, np.uint64), radius, blocks)

    def weights_of(self, hashes: np.ndarray) -> np.ndarray:
        """The weight of each shingle: the more the fewer items have it."""
        at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        return np.where(self.known[at] == hashes, self.weights[at], self.other) if len(self.known) else np.full(len(hashes), self.other)

    def similarities(self, window: np.ndarray, items: np.ndarray) -> list[float]:
        """Weighted Jaccard similarity of a window's shingles with each of some items."""
        own, times = np.unique(window, return_counts=True)
        weights = self.weights_of(own)
        total, out = float((times * weights).sum()), []
        for item in items.tolist():
            theirs = slice(self.ends[item], self.ends[item + 1])
            at = np.minimum(np.searchsorted(self.hashes[theirs], own), self.ends[item + 1] - self.ends[item] - 1)
            same = self.hashes[theirs][at] == own
            both = float((np.minimum(times, self.times[theirs][at]) * weights)[same].sum())
            out.append(both / (total + self.totals[item] - both))
        return out

    def short_matches(self, hashes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, tuple[int, float, int, int, int]]]:
        """(text, match) of the first place in each text of each item that is too short for a shingle."""
        for size, (keys, ids) in self.short.items():
            runs = shingle_hashes(hashes, size)
            hits = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, runs), len(keys) - 1)] == runs)
            own = np.searchsorted(offsets, hits, side="right") - 1
            inside = hits + size <= offsets[own + 1]
            seen = set()
            for at, i in zip(hits[inside].tolist(), own[inside].tolist(), strict=True):
                if (i, runs[at]) not in seen:
                    seen.add((i, runs[at]))
                    yield from ((i, (item_id, 1.0, at - int(offsets[i]), size, 0)) for item_id in ids[int(runs[at])])

    def matches(self, texts: Iterable[str | None]) -> list[list[tuple[int, float, int, int, int]]]:
        """For each text, (item_id, similarity, first word, words, differing bits) of each item that some window of it matches, at its best window."""
        return self.looked_through(texts, lambda x: x, self.best_windows)

    def possible_matches(self, texts: Iterable[str | None]) -> list[list[tuple]]:
        """For each text, its possible_windows(); those of items too short for a shingle are sure."""
        return self.looked_through(texts, lambda x: (x[0], 1.0, 1.0, *x[2:], [], []), self.possible_windows)

    def looked_through(self, texts: Iterable[str | None], short: Callable, whole: Callable) -> list[list[tuple]]:
        words, offsets = flat([split_words(x) for x in texts])
        out: list[list[tuple]] = [[] for _ in range(len(offsets) - 1)]
        hashes = self.words.rows(words)
        for i, match in self.short_matches(hashes, offsets):
            out[i].append(short(match))
        shingles = shingle_hashes(hashes)
        if not len(shingles) or not len(self.known):
            return out
        maybe = np.flatnonzero(self.shelf[(shingles >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, shingles[maybe]), len(self.known) - 1)
        hits = maybe[self.known[at] == shingles[maybe]]
        own = np.searchsorted(offsets, hits, side="right") - 1
        inside = hits + SHINGLE_WORDS <= offsets[own + 1]  # not over the end of a text
        hits, own = hits[inside], own[inside]
        for i in np.unique(own).tolist():
            lo, hi = offsets[i], offsets[i + 1] - SHINGLE_WORDS + 1
            out[i] += whole(shingles[lo:hi], hits[own == i] - lo)
        return out

    def near_windows(self, shingles: np.ndarray, hits: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(start, length, fingerprint, items) of the windows of a text within the radius of items, from its shingles and the places of those that items have; shorter windows first."""
        places, lengths, prints = [], [], []
        sizes = self.lengths[self.lengths <= len(shingles)]
        if len(sizes) < len(self.lengths):  # some items are longer: they are held against the whole text
            sizes = np.append(sizes, len(shingles))
        for length in np.unique(sizes).tolist():
            open_at = np.zeros(len(shingles) + 1, np.int32)
            np.add.at(open_at, np.maximum(hits - length + 1, 0), 1)
            np.add.at(open_at, hits + 1, -1)
            starts = np.flatnonzero(np.cumsum(open_at[: len(shingles) - length + 1]) > 0)
            for part in np.split(starts, range(1 << 14, len(starts), 1 << 14)):
                if len(part):
                    places.append(part)
                    lengths.append(np.full(len(part), length))
                    prints.append(window_prints(shingles, part, length))
        for part in range(len(places)) if sum(map(len, places)) > 1 << 16 else ([None] if places else []):
            some = slice(None) if part is None else slice(part, part + 1)
            starts, sizes, found = (np.concatenate(x[some]) for x in (places, lengths, prints))
            who, items = self.index.search(found)
            same = (self.lengths[items] == sizes[who]) | ((sizes[who] == len(shingles)) & (self.lengths[items] > len(shingles)))
            who, items = who[same], items[same]
            edges = np.flatnonzero(np.diff(who, prepend=-1))  # pairs come in order of their windows
            for w, own in zip(who[edges].tolist(), np.split(items, edges[1:]) if len(edges) else [], strict=True):
                yield int(starts[w]), int(sizes[w]), int(found[w]), own

    def best_windows(self, shingles: np.ndarray, hits: np.ndarray) -> list[tuple[int, float, int, int, int]]:
        """matches() of one text from its shingles and the places of those that items have."""
        best: dict[int, tuple] = {}
        for start, length, own_print, own in self.near_windows(shingles, hits):
            for item, score in zip(own.tolist(), self.similarities(shingles[start : start + length], own), strict=True):
                item_id = self.ids[item]
                if score >= self.threshold and (item_id not in best or round(score, 12) > round(best[item_id][0], 12)):  # of windows that tie, the first
                    best[item_id] = (score, start, length + SHINGLE_WORDS - 1, (own_print ^ int(self.index.prints[item])).bit_count())
        return [(x, *found) for x, found in sorted(best.items())]

    def possible_windows(self, shingles: np.ndarray, hits: np.ndarray) -> list[tuple]:
        """(item_id, both, rest, first word, words, differing bits, hashes, times) of windows that may be similar enough: their similarity is both / (rest + the weights of hashes, each so many times)."""
        out, least = [], math.log(2)  # what a shingle that all items have weighs
        for start, length, own_print, own in self.near_windows(shingles, hits):
            hashes, times = np.unique(shingles[start : start + length], return_counts=True)
            at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            known = self.known[at] == hashes
            total = float((times * self.weights[at])[known].sum())
            for item in own.tolist():
                theirs = slice(self.ends[item], self.ends[item + 1])
                place = np.minimum(np.searchsorted(self.hashes[theirs], hashes), self.ends[item + 1] - self.ends[item] - 1)
                same = self.hashes[theirs][place] == hashes
                both = float((np.minimum(times, self.times[theirs][place]) * self.weights[at])[same].sum())
                rest = total + float(self.totals[item]) - both
                if both >= self.threshold * (rest + least * times[~known].sum()) - 1e-9:
                    bits = (own_print ^ int(self.index.prints[item])).bit_count()
                    out.append((self.ids[item], both, rest, start, length + SHINGLE_WORDS - 1, bits, hashes[~known].view(np.int64).tolist(), times[~known].tolist()))
        return out


def parts_of(benchmark: DataFrame, item: str, text: str) -> list[DataFrame]:
    """The items in parts of bounded size: mostly one."""
    items = benchmark.select(F.col(item).alias("item_id"), F.col(text).cast("string").alias("text")).where("item_id is not null and text is not null")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // MOST_ITEMS), -(-size // MOST_ITEM_BYTES))
    parts = parts if parts == 1 else 2 * parts  # hashing leaves some parts fuller
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i) for i in range(parts)]


def shared_shingles(items: DataFrame) -> tuple[DataFrame, int]:
    """hash and n of the shingles that several items (item_id, text) have, and the number of items that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, _ = flat([[*np.unique(x).view(np.int64).tolist(), None] for t in batch.column(0).to_pylist() if len(x := shingle_hashes(word_hashes(split_words(t))))])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["hash"])

    counted = items.select("text").mapInArrow(run, "hash long").groupBy("hash").agg(F.count("*").alias("n"))  # the null one counts items
    counted = written(counted.where("n > 1 or hash is null"), "shared")
    whole = counted.where("hash is null").first()
    return counted.where("hash is not null"), whole["n"] if whole else 0


def own_shingles(part: DataFrame, shared: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of shared, the rows of shingles that a part's items have, in order: no more than the part, which is bounded, has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_hashes(word_hashes(split_words(t))) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.zeros(0, np.uint64), *found])).view(np.int64))], names=["hash"])

    rows = shared.join(part.select("text").mapInArrow(run, "hash long").distinct(), "hash").toArrow()
    hashes, n = rows.column("hash").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def ready_for(spark: SparkSession, part: DataFrame, shared: tuple[np.ndarray, np.ndarray, int] | None = None) -> Callable[[], Benchmark]:
    """A function that gives a part of the benchmark ready for search in a Python worker."""
    rows = [(r[0], r[1]) for r in part.orderBy("item_id", "text").toArrow().to_pandas().itertuples(index=False)]
    sent, version = spark.sparkContext.broadcast((rows, shared)), uuid.uuid4().hex
    return lambda: kept("benchmark", version, lambda: Benchmark(sent.value[0], shared=sent.value[1]))


def matches_in_parts(rows: DataFrame, parts: list[DataFrame], item_kind: str) -> DataFrame:
    """row_no, item_id, similarity, start_word, n_words and hamming from rows (row_no, text; each row_no once) and all parts of a benchmark."""
    spark, every = rows.sparkSession, parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    shared, n = shared_shingles(every)
    schema = f"row_no long, item_id {item_kind}, both double, rest double, start_word long, n_words long, hamming long, hashes array<long>, times array<long>"
    names, out = [x.split()[0] for x in schema.split(", ")], None
    for part in parts:
        ready = ready_for(spark, part, (*own_shingles(part, shared), n))

        def run(batches: Iterator[pa.RecordBatch], ready=ready) -> Iterator[pa.RecordBatch]:
            found = ready()
            for batch in slices(batches):
                numbers = batch.column(0).to_pylist()
                got = [(i, *x) for i, own in zip(numbers, found.possible_matches(batch.column(1).to_pylist()), strict=True) for x in own]
                if got:
                    kinds = [None] * 7 + [pa.list_(pa.int64())] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*got, strict=True), kinds, strict=True)], names=names)

        one = written(rows.select("row_no", "text").mapInArrow(run, schema), "possible")  # a worker holds one part at a time
        out = one if out is None else out.unionByName(one)
    place = ["row_no", "item_id", "start_word", "n_words"]
    other = out.select(*place, F.explode(F.arrays_zip("hashes", "times")).alias("x")).select(*place, F.col("x.hashes").alias("hash"), F.col("x.times").alias("times"))
    weighed = other.join(shared, "hash", "left").groupBy(*place).agg(F.sum(F.col("times") * F.log(1 + n / F.coalesce("n", F.lit(1)))).alias("others"))
    scored = out.drop("hashes", "times").join(weighed, place, "left").withColumn("similarity", F.col("both") / (F.col("rest") + F.coalesce("others", F.lit(0.0))))
    best = scored.where(F.col("similarity") >= SIMILARITY).groupBy("row_no", "item_id").agg(
        F.max_by(F.struct("similarity", "start_word", "n_words", "hamming"), F.struct(F.round("similarity", 12), -F.col("n_words"), -F.col("start_word"))).alias("best")
    )
    return best.select("row_no", "item_id", "best.*")


def numbered(docs: DataFrame) -> DataFrame:
    """docs, written, with a number __row for each row."""
    return written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")


def find_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item_id, similarity, start_word, n_words and hamming of each document and item that it holds."""
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    chosen, parts = docs.select(F.col(key).alias("row_key"), F.col(text).cast("string").alias("text")), parts_of(benchmark, item, item_text)
    names = ["row_key", "item_id", "similarity", "start_word", "n_words", "hamming"]
    if len(parts) > 1:
        rows = numbered(chosen).withColumnRenamed("__row", "row_no")
        return rows.select("row_no", "row_key").join(matches_in_parts(rows, parts, item_kind), "row_no").select(*names).withColumnRenamed("row_key", key)
    ready = ready_for(docs.sparkSession, parts[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ready()
        for batch in slices(batches):
            who, rows = [], []
            for i, got in enumerate(found.matches(batch.column(1).to_pylist())):
                who += [i] * len(got)
                rows += got
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), *(pa.array(x) for x in columns)], names=names)

    return chosen.mapInArrow(run, f"row_key {kind}, item_id {item_kind}, similarity double, start_word long, n_words long, hamming long").withColumnRenamed("row_key", key)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that hold no item, all columns."""
    parts = parts_of(benchmark, item, item_text)
    if len(parts) == 1:
        return docs.where(~holds_item(ready_for(docs.sparkSession, parts[0]))(F.col(text).cast("string")))
    rows = numbered(docs)
    chosen = rows.select(F.col("__row").alias("row_no"), F.col(text).cast("string").alias("text"))
    found = matches_in_parts(chosen, parts, benchmark.schema[item].dataType.simpleString()).select(F.col("row_no").alias("__row")).distinct()
    return rows.join(found, "__row", "left_anti").drop("__row").select(*docs.columns)


def holds_item(ready: Callable[[], Benchmark]) -> Callable[[Column], Column]:
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        found = ready()
        return pd.Series([bool(x) for at in range(0, len(texts), SLICE_ROWS) for x in found.matches(texts.iloc[at : at + SLICE_ROWS])], dtype=bool)

    return holds


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontamination": op7_decontamination}
ORACLE: dict[str, str] = {}
