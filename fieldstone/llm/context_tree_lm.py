"""LM scoring by context-tree weighting over bytes.

A byte is eight binary decisions. For each decision and each context of 0 to DEPTH bytes before it there is a Krichevsky-Trofimov
estimate, and a context's estimate is mixed with that of its longer contexts by the evidence of the training text:
P(s) = w KT(s) + (1 - w) P(longer). The sum of log P over a text is its code length.

Sequence counts are gathered over the whole training text by Spark, and the tree keeps every context: it grows with the text. Contexts of
TOP bytes are dealt out with all the longer ones below them, so that a task grows whole branches; only the shorter ones pass through the
driver, from sums. A branch with many sequences is cut into the branches below it, and its upper levels are tables of their sums. Each sequence's score is a row of a written table. The most frequent go to all executors; the others are joined by
shuffle, and so are sequences that training never had, which are scored in the branch they would belong to.

A text is its words in lower case (A-Z), each followed by a space, the last by the end mark. Null and empty texts are the end mark alone.
Without training text each decision has probability 1/2. The word model that scores are held against counts every training token; words
too rare to be sent to all executors are joined by shuffle. Repeated rows are scored row by row.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, kept, segment_sum, slices, table, written

DEPTH = 6
#: Contexts of each length that a tree from fit_tree() keeps, at most: the most frequent ones. The query's tree has no such bound.
MOST_CONTEXTS = 1 << 15
#: Length of the contexts whose branches are dealt out, and sequences of which a task grows the branches at once (more if one branch has more).
TOP, MOST_GROWN = 3, 100_000
#: Sequences of a branch beyond which it is dealt out by contexts of SPLIT bytes and grown by those of SPLIT + 1, which have 65,536 sequences at most.
LARGE_BRANCH, SPLIT = 400_000, 4
#: Sequences whose scores go to all executors, at most: the most frequent ones.
MOST_SENT = 1 << 21
#: Words that go to all executors, at most: the most frequent ones.
MOST_WORDS = 1 << 17
#: A task hands its counts on when it holds about so many different sequences, or words.
MOST_HELD, MOST_WORDS_HELD = 3_000_000, 300_000
END = b"\n"


def encoded(text: str | None) -> tuple[list[bytes], bytes]:
    """The words, and the bytes that the model codes."""
    words = (text or "").encode().lower().split()
    return words, b" ".join(words) + END


def sequences(coded: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text: the byte with the `depth` bytes before it, as a number; and where each text begins."""
    pad = END * depth
    whole = np.frombuffer(b"".join(pad + x for x in coded), np.uint8)
    sizes = np.array([len(x) for x in coded], np.int64)
    keep = np.ones(len(whole), bool)
    begins = np.concatenate([[0], np.cumsum(sizes + depth)])
    for i in range(depth):
        keep[begins[:-1] + i] = False
    number = np.zeros(len(whole), np.uint64)
    for i in range(depth + 1):
        number[i:] |= whole[: len(whole) - i].astype(np.uint64) << np.uint64(8 * i)
    return number[keep], np.concatenate([[0], np.cumsum(sizes)])


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(keys)
    keys, counts = keys[by], counts[by]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def count_corpus(docs: DataFrame, text: str, depth: int = DEPTH) -> DataFrame:
    """seq (null for words), word (null for sequences) and n over all texts; END stands for the ends of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        fresh: list[np.ndarray] = []

        def settle() -> None:
            if fresh:
                every = np.sort(np.concatenate(fresh))
                starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
                held.append((every[starts], np.diff(np.append(starts, len(every)))))
                fresh.clear()
            if len(held) > 1 and sum(len(x[0]) for x in held) > MOST_HELD // 2:
                held[:] = [merged(*(np.concatenate(x) for x in zip(*held, strict=True)))]

        def seq_rows() -> pa.RecordBatch:
            keys, n = merged(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.nulls(len(keys), pa.binary()), pa.array(n)], names=["seq", "word", "n"])

        def word_rows() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["seq", "word", "n"])
            words.clear()
            return rows

        for batch in slices(batches):
            coded = []
            for x in batch.column(0).to_pylist():
                own, line = encoded(x)
                words.update(own)
                coded.append(line)
            words[END] += len(coded)
            fresh.append(sequences(coded, depth)[0])
            if sum(map(len, fresh)) > MOST_HELD:
                settle()
            if held and len(held[0][0]) > MOST_HELD:
                yield seq_rows()
            if len(words) > MOST_WORDS_HELD:
                yield word_rows()
        settle()
        if held:
            yield seq_rows()
        if words:
            yield word_rows()

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "seq long, word binary, n long")
    return parts.groupBy("seq", "word").agg(F.sum("n").alias("n"))


class Slots:
    """Values by 64-bit key, by open addressing in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: float = np.nan):
        self.bits = max(4, int(len(keys) * 3 // 2).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, missing, np.float32)
        taken = np.zeros(1 << self.bits, bool)
        left, self.steps = np.arange(len(keys)), 0
        while len(left):
            at = self.slot(keys[left], self.steps)
            free = np.flatnonzero(~taken[at])
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.values[at[won]], taken[at[won]] = keys[left[won]], values[left[won]], True
            left = np.delete(left, won)
            self.steps += 1
        self.taken = taken

    def slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, and where there was none."""
        at = self.slot(keys, 0)
        out, hit = self.values[at], (self.keys[at] == keys) & self.taken[at]
        left = np.flatnonzero(~hit & self.taken[at])
        for step in range(1, self.steps):
            if not len(left):
                break
            at = self.slot(keys[left], step)
            same = (self.keys[at] == keys[left]) & self.taken[at]
            out[left[same]], hit[left[same]] = self.values[at[same]], True
            left = left[~same & self.taken[at]]
        return out, ~hit


def log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1.0)


def node_keys(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of the decision, bit) of the eight decisions of each sequence, as arrays of eight rows."""
    context, byte = seq & ~np.uint64(255), seq & np.uint64(255)
    keys = np.stack([context | np.uint64(1 << i) | (byte >> np.uint64(8 - i)) for i in range(8)])
    bits = np.stack([(byte >> np.uint64(7 - i)) & np.uint64(1) for i in range(8)])
    return keys, bits.astype(bool)


@dataclass
class Level:
    """Of contexts of one length: sorted decisions, the weight of their own estimate, it, and the estimate of the rarer longer ones."""

    keys: np.ndarray
    weight: np.ndarray
    own: np.ndarray
    rest: np.ndarray
    contexts: np.ndarray
    mask: np.uint64

    def at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """weight, own, rest of each key; 1/2 for decisions never seen."""
        if not len(self.keys):
            half = np.full(len(keys), 0.5)
            return half, half, half
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        seen = self.keys[place] == keys
        return tuple(np.where(seen, x[place], 0.5) for x in (self.weight, self.own, self.rest))


@dataclass
class Tree:
    levels: list[Level]
    scores: list[Slots]

    @staticmethod
    def branches(counts: list[tuple[np.ndarray, np.ndarray]], first: int = 0) -> tuple[list[Level], tuple[np.ndarray, ...]]:
        """The levels from the kept sequences and counts of each depth from `first` on, and the first one's keys, zeros, ones and total logs."""
        found = []
        for seq, n in counts:
            keys, bits = node_keys(seq)
            unique = np.unique(keys)
            ones, every = np.zeros(len(unique)), np.zeros(len(unique))
            for own, bit in zip(keys, bits, strict=True):
                place = np.searchsorted(unique, own)
                every += np.bincount(place, n, len(unique))
                ones += np.bincount(place[bit], n[bit], len(unique))
            found.append((unique, every - ones, ones))
        levels: list[Level] = []
        below = None
        for depth in range(first + len(counts) - 1, first - 1, -1):
            keys, zeros, ones = found.pop()
            own = log_kt(zeros, ones)
            mask = np.uint64((1 << (8 * depth + 8)) - 1)
            if below is None:
                weight, rest, total = np.ones(len(keys)), np.full(len(keys), 0.5), own
            else:
                child_keys, child_zeros, child_ones, child_total = below
                place = np.searchsorted(keys, child_keys & mask) if len(child_keys) else np.zeros(0, np.int64)
                less = [x - np.bincount(place, y, len(keys)) for x, y in ((zeros, child_zeros), (ones, child_ones))]
                longer = np.bincount(place, child_total, len(keys)) + log_kt(*less)
                top = np.maximum(own, longer)
                total = top + np.log(0.5 * np.exp(own - top) + 0.5 * np.exp(longer - top))
                weight = np.exp(own + np.log(0.5) - total)
                rest = (less[1] + 0.5) / (less[0] + less[1] + 1)
            below = (keys, zeros, ones, total)
            contexts = np.unique(counts[depth - first][0] >> np.uint64(8))
            levels.insert(0, Level(keys, weight.astype(np.float32), ((ones + 0.5) / (zeros + ones + 1)).astype(np.float32), rest.astype(np.float32), contexts, mask))
        return levels, below

    @staticmethod
    def grown(counts: list[tuple[np.ndarray, np.ndarray]]) -> Tree:
        """From the kept sequences and counts of each depth, from 0 on."""
        tree = Tree(Tree.branches(counts)[0], [])
        tree.scores = [Slots(seq, tree.log2(seq, depth)) for depth, (seq, _) in enumerate(counts)]
        return tree

    def log2(self, seq: np.ndarray, deepest: int) -> np.ndarray:
        """Binary log probability of each sequence's last byte, by contexts of up to `deepest` bytes (all kept)."""
        out = np.zeros(len(seq))
        keys, bits = node_keys(seq)
        for i in range(8):
            p = None
            for depth in range(deepest, -1, -1):
                level = self.levels[depth]
                weight, own, rest = level.at(keys[i] & level.mask)
                longer = rest if p is None else p
                p = weight * own + (1 - weight) * longer
            out += np.log2(np.where(bits[i], p, 1 - p))
        return out

    def score(self, seq: np.ndarray) -> np.ndarray:
        """Binary log probability of each sequence's last byte by its longest kept context."""
        if not self.levels or not len(self.levels[0].keys):
            return np.full(len(seq), -8.0)
        out = np.zeros(len(seq), np.float32)
        left = np.arange(len(seq))
        for depth in range(len(self.levels) - 1, -1, -1):
            own = seq[left] & self.levels[depth].mask
            value, missing = self.scores[depth].find(own)
            out[left[~missing]] = value[~missing]
            left, own = left[missing], own[missing]
            contexts = self.levels[depth].contexts
            if depth == 0:
                known = np.ones(len(left), bool)
            else:
                place = np.minimum(np.searchsorted(contexts, own >> np.uint64(8)), max(0, len(contexts) - 1))
                known = contexts[place] == own >> np.uint64(8) if len(contexts) else np.zeros(len(left), bool)
            if known.any():  # a kept context before a byte that it never had
                unique, inverse = np.unique(own[known], return_inverse=True)
                out[left[known]] = self.log2(unique, depth)[inverse]
            left = left[~known]
        return out


def least_count(times: DataFrame, column: str, most: int, at_least: int = 1) -> int:
    """The count from which on rows are taken, so that at most `most` are: from a histogram in eighths of octaves, which has at most some hundred rows."""
    bucket = F.floor(F.log2(column) * 8).alias("bucket")
    left, least = most, None
    for r in times.groupBy(bucket).agg(F.count("*").alias("n"), F.min(column).alias("lowest"), F.max(column).alias("highest")).orderBy(F.desc("bucket")).collect():
        if r["n"] > left:
            return max(at_least, r["highest"] + 1 if least is None else least)
        left, least = left - r["n"], r["lowest"]
    return at_least


def fit_tree(counts: DataFrame, depth: int = DEPTH, most: int = MOST_CONTEXTS) -> Tree:
    """A tree in memory from counts (seq, n) of whole sequences. What comes to the driver is bounded by `most` contexts of each length.

    Shorter sequences are summed from the next longer ones. A context is only kept with the shorter ones it ends in, so the least count never falls.
    """
    tables = [counts]
    for d in range(depth - 1, -1, -1):
        shorter = F.col("seq").bitwiseAND(F.lit((1 << (8 * d + 8)) - 1)).alias("seq")
        tables.insert(0, written(tables[0].groupBy(shorter).agg(F.sum("n").alias("n")), "sequences"))
    least, levels = 1, []
    for own in tables:
        context = F.shiftright("seq", 8)
        times = own.groupBy(context.alias("context")).agg(F.sum("n").alias("times"))
        least = least_count(times, "times", most, least)
        rows = own.join(times.where(F.col("times") >= least), context == F.col("context"), "left_semi").toArrow()
        seq, n = rows.column("seq").to_numpy().astype(np.int64).view(np.uint64), rows.column("n").to_numpy()
        by = np.argsort(seq)
        levels.append((seq[by], n[by]))
    return Tree.grown(levels)


def whole_branches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """seq and n of whole branches from rows (branch, seq, n) in order of branch."""
    held: list[tuple[np.ndarray, ...]] = []
    limit = MOST_GROWN
    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy() for i in range(3)))
        if sum(len(x[0]) for x in held) >= limit:
            branch, seq, n = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(branch, branch[-1]))
            if cut:
                yield seq[:cut].view(np.uint64), n[:cut]
            held, limit = [(branch[cut:], seq[cut:], n[cut:])], max(MOST_GROWN, 2 * (len(seq) - cut))
    if sum(len(x[0]) for x in held):
        _, seq, n = (np.concatenate(x) for x in zip(*held, strict=True))
        yield seq.view(np.uint64), n


def branch_levels(seq: np.ndarray, n: np.ndarray, first: int = TOP) -> tuple[list[Level], tuple[np.ndarray, ...]]:
    """Tree.branches() of whole branches, from contexts of `first` bytes on."""
    return Tree.branches([merged(seq & np.uint64((1 << (8 * d + 8)) - 1), n) for d in range(first, DEPTH + 1)], first)


def context(size: int) -> Column:
    """The last `size` bytes before a sequence's own."""
    return F.col("seq").bitwiseAND(F.lit((1 << (8 * size + 8)) - 256))


def dealt(seqs: DataFrame, size: int = TOP) -> DataFrame:
    """branch, seq and n, each branch in one task and in order."""
    return seqs.select(context(size).alias("branch"), "seq", "n").repartition("branch").sortWithinPartitions("branch")


SUMS = "key long, zeros double, ones double, longer double"


def sums_above(counts: DataFrame, first: int) -> DataFrame:
    """SUMS of the decisions after contexts of first - 1 bytes, from the branches of contexts of `first` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, n in whole_branches(batches):
            keys, *sums = branch_levels(seq, n, first)[1]
            unique, place = np.unique(keys & np.uint64((1 << (8 * first)) - 1), return_inverse=True)
            columns = [np.bincount(place, x, len(unique)) for x in sums]
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), *(pa.array(x) for x in columns)], names=["key", "zeros", "ones", "longer"])

    return dealt(counts, first).mapInArrow(run, SUMS).groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "longer")))


def mixed(zeros: np.ndarray, ones: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight of a context's own estimate, that, and the log of the mixture, where all longer contexts are in the tree."""
    own = log_kt(zeros, ones)
    total = np.logaddexp(own, longer) + np.log(0.5)
    return np.exp(own + np.log(0.5) - total), (ones + 0.5) / (zeros + ones + 1), total


@dataclass
class Split:
    """The large branches (a table of contexts of TOP bytes; None without any), and weight, own, zeros, ones and total of the decisions after contexts of TOP to SPLIT bytes in them."""

    large: DataFrame | None
    levels: dict[int, DataFrame]


def split_branches(counts: DataFrame) -> Split:
    sizes = counts.groupBy(context(TOP).alias("branch")).agg(F.count("*").alias("n"))
    large = written(sizes.where(F.col("n") > LARGE_BRANCH).select("branch"), "large")
    if large.isEmpty():
        return Split(None, {})
    sums, levels = sums_above(counts.withColumn("branch", context(TOP)).join(large, "branch", "left_semi"), SPLIT + 1), {}

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, own, total = mixed(*(batch.column(i).to_numpy() for i in (1, 2, 3)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(weight), pa.array(own), pa.array(total)], names=["key", "zeros", "ones", "weight", "own", "total"])

    for depth in range(SPLIT, TOP - 1, -1):
        levels[depth] = written(sums.mapInArrow(mix, "key long, zeros double, ones double, weight double, own double, total double"), "level")
        shorter = F.col("key").bitwiseAND(F.lit((1 << (8 * depth)) - 1)).alias("key")
        sums = levels[depth].groupBy(shorter).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("total").alias("longer"))
    return Split(large, levels)


def top_levels(counts: DataFrame, split: Split) -> list[Level]:
    """The levels of contexts of fewer than TOP bytes. To the driver come the decisions of the longest of these, whose number has a bound."""
    if split.large is None:
        found = sums_above(counts, TOP)
    else:
        small = sums_above(counts.withColumn("branch", context(TOP)).join(split.large, "branch", "left_anti"), TOP)
        above = F.col("key").bitwiseAND(F.lit((1 << (8 * TOP)) - 1)).alias("key")
        found = small.unionByName(split.levels[TOP].select(above, "zeros", "ones", F.col("total").alias("longer")))
        found = found.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "longer")))
    found = found.toArrow()
    keys, zeros, ones, longer = (found.column(i).to_numpy() for i in range(4))
    by = np.argsort(keys)
    keys, zeros, ones, longer = keys[by].view(np.uint64), zeros[by], ones[by], longer[by]
    levels: list[Level] = []
    for depth in range(TOP - 1, -1, -1):
        weight, own, total = mixed(zeros, ones, longer)
        mask = np.uint64((1 << (8 * depth + 8)) - 1)
        levels.insert(0, Level(keys, weight.astype(np.float32), own.astype(np.float32), np.full(len(keys), 0.5, np.float32), np.unique(keys >> np.uint64(8)), mask))
        keys, place = np.unique(keys & (mask >> np.uint64(8)), return_inverse=True)
        zeros, ones, longer = (np.bincount(place, x, len(keys)) for x in (zeros, ones, total))
    return levels


SCORES = "seq long, n long, score float"


def scored_rows(levels: list[Level], seq: np.ndarray, n: np.ndarray, first: int, unseen: bool) -> pa.RecordBatch | None:
    """The scores of the training sequences of whole branches of `first` bytes, or of those not in training, by the levels above and their own."""
    wanted = n == 0 if unseen else n > 0
    if not wanted.any():
        return None
    own, _ = branch_levels(seq[n > 0], n[n > 0], first)
    score = Tree([*levels, *own], []).log2(seq[wanted], DEPTH).astype(np.float32)
    return pa.RecordBatch.from_arrays([pa.array(seq[wanted].view(np.int64)), pa.array(n[wanted]), pa.array(score)], names=["seq", "n", "score"])


def large_scores(seqs: DataFrame, split: Split, shared, unseen: bool) -> DataFrame:
    """sequence_scores() of the sequences in large branches: dealt by contexts of SPLIT bytes, each after the decisions above it, and grown by those of one byte more, some at once."""
    pairs = seqs.select(context(TOP).alias("top"), context(SPLIT).alias("branch")).distinct()
    at = lambda size: F.col("key").bitwiseAND(F.lit((1 << (8 * size + 8)) - 256))
    parts = [seqs.select(context(SPLIT).alias("branch"), F.lit(DEPTH).alias("depth"), context(SPLIT + 1).alias("place"), "seq", "n", F.lit(0.0).alias("weight"), F.lit(0.0).alias("own"))]
    for depth, level in split.levels.items():
        held = level.withColumn("top", at(TOP)).join(pairs, "top")
        held = held if depth < SPLIT else held.where(at(SPLIT) == F.col("branch"))
        parts.append(held.select("branch", F.lit(depth).alias("depth"), F.lit(0).cast("long").alias("place"), F.col("key").alias("seq"), F.lit(0).cast("long").alias("n"), "weight", "own"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.repartition("branch").sortWithinPartitions("branch", "depth", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, list[tuple[np.ndarray, ...]]] = {}
        held: list[tuple[np.ndarray, ...]] = []
        now: int | None = None

        def settle(whole: bool) -> Iterator[pa.RecordBatch]:
            """Scores the sequences held, all or those before the last place."""
            if not held:
                return
            place, seq, n = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = len(seq) if whole else int(np.searchsorted(place, place[-1]))
            held[:] = [(place[cut:], seq[cut:], n[cut:])] if cut < len(seq) else []
            if not cut:
                return
            levels = list(shared.value)
            for depth in range(TOP, SPLIT + 1):
                keys, weight, own = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in zip(zip(*above[depth], strict=True) if above.get(depth) else ((),) * 3, (np.uint64, np.float64, np.float64), strict=True))
                by = np.argsort(keys)
                half = np.full(len(keys), 0.5, np.float32)
                levels.append(Level(keys[by], weight[by].astype(np.float32), own[by].astype(np.float32), half, keys[:0], np.uint64((1 << (8 * depth + 8)) - 1)))
            found = scored_rows(levels, seq[:cut].view(np.uint64), n[:cut], SPLIT + 1, unseen)
            if found is not None:
                yield found

        for batch in batches:
            branch, depth, place, seq, n, weight, own = (batch.column(i).to_numpy() for i in range(7))
            edges = np.flatnonzero((np.diff(branch, prepend=branch[:1]) != 0) | (np.diff(depth, prepend=depth[:1]) != 0)) if len(branch) else []
            for lo, hi in zip([0, *edges], [*edges, len(branch)], strict=True):
                if lo == hi:
                    continue
                if branch[lo] != now:
                    yield from settle(True)
                    above, now = {}, int(branch[lo])
                if depth[lo] < DEPTH:
                    above.setdefault(int(depth[lo]), []).append((seq[lo:hi].view(np.uint64), weight[lo:hi], own[lo:hi]))
                    continue
                held.append((place[lo:hi], seq[lo:hi], n[lo:hi]))
                if sum(len(x[0]) for x in held) > MOST_GROWN:
                    yield from settle(False)
        yield from settle(True)

    return rows.mapInArrow(run, SCORES)


def sequence_scores(counts: DataFrame, top: list[Level], split: Split, asked: DataFrame | None = None) -> DataFrame:
    """seq, n and score (binary log probability) of each training sequence, or those of `asked` (seq), none of which is in training."""
    shared, unseen = counts.sparkSession.sparkContext.broadcast(top), asked is not None
    seqs = counts if asked is None else counts.unionByName(asked.select("seq", F.lit(0).cast("long").alias("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, n in whole_branches(batches):
            found = scored_rows(shared.value, seq, n, TOP, unseen)
            if found is not None:
                yield found

    if split.large is None:
        return written(dealt(seqs).mapInArrow(run, SCORES), "scores")
    marked = seqs.withColumn("top", context(TOP))
    small, large = (marked.join(split.large.withColumnRenamed("branch", "top"), "top", how).drop("top") for how in ("left_anti", "left_semi"))
    return written(dealt(small).mapInArrow(run, SCORES).unionByName(large_scores(large, split, shared, unseen)), "scores")


def score_texts(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held-back columns of docs named __*, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of each row."""
    spark = docs.sparkSession
    counts = written(count_corpus(training, text), "counts")
    sequence_counts, word_counts = counts.where("seq is not null").select("seq", "n"), counts.where("word is not null").select("word", "n")
    n, v = word_counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    split = split_branches(sequence_counts)
    top = top_levels(sequence_counts, split)
    scores = sequence_scores(sequence_counts, top, split)
    least_sent = least_count(scores, "n", MOST_SENT)
    sent = scores.where(F.col("n") >= least_sent).select("seq", "score").toArrow()
    hot = Slots(sent.column("seq").to_numpy().view(np.uint64), sent.column("score").to_numpy())
    del sent
    least = least_count(word_counts, "n", MOST_WORDS)
    frequent = word_counts.where(F.col("n") >= least).toArrow()
    common = dict(zip(frequent.column("word").to_pylist(), frequent.column("n").to_pylist(), strict=True))
    total = n + 0.5 * (v + 1)
    shared, version = spark.sparkContext.broadcast((hot, common)), uuid.uuid4().hex
    del hot, common
    extra = [c for c in docs.columns if c.startswith("__")]
    kind = docs.schema[key].dataType.simpleString()
    names = ["row_id", "row_key", *extra, "n_tokens", "known", "base", "bits", "n_bytes", "rare", "rare_times", "rare_seqs"]
    schema = ", ".join(["row_id long", f"row_key {kind}", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in extra), "n_tokens long, known long, base double, bits double, n_bytes long, rare array<binary>, rare_times array<long>, rare_seqs array<long>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, times = shared.value
        logs = kept("words", version, lambda: {w: float(np.log10((c + 0.5) / total)) for w, c in times.items()})
        get = logs.get
        for batch in slices(batches, 256):
            coded, n_tokens, known, base, rare = [], [], [], [], []
            for x in batch.column(2 + len(extra)).to_pylist():
                words, line = encoded(x)
                coded.append(line)
                words.append(END)
                found = [get(w) for w in words]
                unknown = [w for w, y in zip(words, found, strict=True) if y is None] if None in found else []
                n_tokens.append(len(words))
                known.append(len(words) - len(unknown))
                base.append(sum(y for y in found if y is not None) if unknown else sum(found))
                rare.append(Counter(unknown))  # a word that fills a text is one row of the join
            seq, begins = sequences(coded, DEPTH)
            value, missing = model.find(seq)
            bits = segment_sum(np.where(missing, 0, value), begins)
            left = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(missing)])[begins].astype(np.int32)), pa.array(seq[missing].view(np.int64)))
            columns = [pa.array(n_tokens), pa.array(known), pa.array(base, pa.float64()), pa.array(bits), pa.array(np.diff(begins)), pa.array([list(x) for x in rare], pa.list_(pa.binary())), pa.array([list(x.values()) for x in rare], pa.list_(pa.int64())), left]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(2 + len(extra))), *columns], names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(key).alias("row_key"), *extra, F.col(text).cast("string").alias("text"))
    scored = written(rows.mapInArrow(run, schema), "scored")
    rare = scored.where(F.size("rare") > 0).select("row_id", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select("row_id", F.col("x.rare").alias("word"), F.col("x.rare_times").alias("times"))
    found = rare.join(word_counts.where(F.col("n") < least), "word", "left")
    logs, held = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(total)), F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)
    sums = found.groupBy("row_id").agg(F.sum(F.col("times") * logs).alias("rare_base"), F.sum(held).alias("rare_known"))
    rare_seqs = scored.where(F.size("rare_seqs") > 0).select("row_id", F.explode("rare_seqs").alias("seq"))
    others = scores.where(F.col("n") < least_sent).select("seq", "score")
    unseen = sequence_scores(sequence_counts, top, split, rare_seqs.select("seq").distinct().join(others, "seq", "left_anti"))
    seq_sums = rare_seqs.join(others.unionByName(unseen.select("seq", "score")), "seq").groupBy("row_id").agg(F.sum(F.col("score").cast("double")).alias("rare_bits"))
    bits = F.col("bits") + F.coalesce("rare_bits", F.lit(0.0))
    return scored.join(sums, "row_id", "left").join(seq_sums, "row_id", "left").select(
        F.col("row_key").alias(key), *extra, "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (bits * F.lit(float(np.log10(2.0)))).alias("score"), (-bits / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op2_context_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(fold("doc_id", 5) == 1, F.lit(False)).alias("__held_out"))
    return score_texts(docs, docs.where("not __held_out")).withColumnRenamed("__held_out", "held_out")


QUERIES = {"op2_context_tree_lm": op2_context_tree_lm}
ORACLE: dict[str, str] = {}
