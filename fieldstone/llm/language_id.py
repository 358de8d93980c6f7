"""Language ID: one interpolated Kneser-Ney character model per language, in sorted hash arrays.

A text is its runs of letters in lower case; each run is read between two boundaries. The language with the lowest cross-entropy
per character wins. Texts kept apart from training say how far above its language's mean the cross-entropy of a text of
its length may be; a text beyond that, or without a letter, is rejected.

Null texts and texts without a letter are `und` with score 0 and rejected. Ties go to the language that sorts first. Without any
labelled text every document is `und`. Repeated rows are scored row by row; further columns are left alone.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordTable, flat, fold, kept, segment_sum, slices, table, written

#: Letters with their marks; digits, fractions and other numbers are none.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
ORDER = 4
#: The models are fitted on at most about so many labelled documents and characters, the same for each language; they hold all sequences found there.
SAMPLE_DOCS, SAMPLE_CHARS = 20_000, 1 << 26
#: A text is rejected beyond so many times this quantile of the excess of texts kept apart, by classes of length (so many characters and more).
SLACK, QUANTILE, CLASSES = 2.0, 0.995, np.array([50, 100, 200, 400])
#: Few texts say little about a high quantile: the limit of all counts as so many texts more of each class and language; the one before any text as so many more of all.
SHRINK, PRIOR, PRIOR_TEXTS = 1000, 40.0, 100
#: Characters beyond which a longer text isn't judged more strictly.
LONG = 400
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def letter_runs(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For k from 0 to order, a 64-bit hash of the k codes that end at each place."""
    with np.errstate(over="ignore"):
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
        mixed ^= mixed >> np.uint64(29)
        out = [np.zeros(len(codes), np.uint64)]
        for k in range(1, order + 1):
            before = np.zeros(len(codes), np.uint64)
            before[1:] = out[-1][:-1] if k > 1 else 0
            out.append((before * np.uint64(0xBF58476D1CE4E5B9) + mixed * np.uint64(2 * k + 1)) ^ (before >> np.uint64(31)))
    return out


def gram_hash(gram: str) -> int:
    return int(gram_hashes(np.frombuffer(gram.encode("utf-32-le", "replace"), np.uint32), len(gram))[len(gram)][-1]) if gram else 0


@dataclass
class Models:
    """languages; for each order the sorted hashes and what they add or hand down, one column for each language."""

    languages: list[str]
    order: int
    uniform: float
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    mean: np.ndarray | None = None
    limit: np.ndarray | None = None
    sharpness: float = 1.0
    #: Share of the texts kept apart that the limits reject, by class of length, and how many there are.
    kept_apart: list[tuple[float, int]] = field(default_factory=list)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Natural log probability of each word in each language, boundaries included."""
        if not words:
            return np.zeros((0, len(self.languages)))
        codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "replace"), np.uint32)
        place = np.arange(len(codes))
        start = np.maximum.accumulate(np.where(codes == 32, place, 0))
        start = np.concatenate([[0], start[:-1]])  # the boundary before each place
        hashes, p = gram_hashes(codes, self.order), np.full((len(codes), len(self.languages)), self.uniform)
        for k in range(1, self.order + 1):
            at = np.flatnonzero(place - start >= k - 1) if k > 1 else place
            at = at[at > 0]
            # a context may begin at the boundary itself
            before = hashes[k - 1][at - 1] if k > 1 else np.zeros(len(at), np.uint64)
            down = look_up(self.contexts[k], before, 1.0)
            p[at] = look_up(self.grams[k], hashes[k][at], 0.0) + down * p[at]
        ends = np.flatnonzero(codes == 32)
        return segment_sum(np.log(p[1:]), ends).astype(np.float32)

    def judge(self, texts: Iterable[str | None], words: WordTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per character in each language, characters, and words of each text."""
        runs, offsets = flat([letter_runs(x) for x in texts])
        if not self.languages:
            return np.zeros((len(offsets) - 1, 0)), np.zeros(len(offsets) - 1), np.diff(offsets)
        chars = segment_sum(np.fromiter(map(len, runs), np.float64, len(runs)) + 1, offsets)
        return -segment_sum(words.rows(runs), offsets) / np.maximum(chars, 1)[:, None], chars, np.diff(offsets)

    def decide(self, entropy: np.ndarray, chars: np.ndarray, n_words: np.ndarray) -> pd.DataFrame:
        """language, score and rejected for each text."""
        if not self.languages:
            return pd.DataFrame({"lang_pred": ["und"] * len(chars), "score": np.zeros(len(chars)), "rejected": np.ones(len(chars), bool)})
        best, none = entropy.argmin(axis=1), n_words == 0
        z = -entropy * np.minimum(chars, LONG)[:, None] * self.sharpness
        z -= z.max(axis=1, keepdims=True)
        score = 1 / np.exp(z).sum(axis=1)
        excess = (entropy.min(axis=1) - self.mean[best]) * np.sqrt(np.minimum(chars, LONG))
        names = np.array([*self.languages, "und"], dtype=object)
        return pd.DataFrame({"lang_pred": names[np.where(none, len(self.languages), best)], "score": np.where(none, 0.0, score), "rejected": none | (excess > self.limit[length_class(chars), best])})


def length_class(chars: np.ndarray) -> np.ndarray:
    return np.searchsorted(CLASSES, chars, side="right")


def limits(excess: np.ndarray, chars: np.ndarray, truth: np.ndarray, width: int) -> np.ndarray:
    """The largest excess allowed in each class of length (rows) and language, from texts of known language."""

    def drawn(own: np.ndarray, to: float, weight: int) -> float:
        return (len(own) * SLACK * max(0.0, np.quantile(own, QUANTILE)) + weight * to) / (len(own) + weight) if len(own) else to

    of_all, lengths = drawn(excess, PRIOR, PRIOR_TEXTS), length_class(chars)
    of_class = [drawn(excess[lengths == k], of_all, SHRINK) for k in range(len(CLASSES) + 1)]
    return np.array([[drawn(excess[(lengths == k) & (truth == i)], x, SHRINK) for i in range(width)] for k, x in enumerate(of_class)])


def look_up(arrays: tuple[np.ndarray, np.ndarray], wanted: np.ndarray, other: float) -> np.ndarray:
    keys, values = arrays
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), other)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], other)


def estimate(counts: dict[str, dict[str, int]], languages: list[str], order: int) -> Models:
    """Kneser-Ney models from counts of the longest sequences (shorter at a word's begin), for each language."""
    width, alphabet = len(languages), {c for found in counts.values() for gram in found for c in gram}
    grams: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(width)) for _ in range(order + 1)]
    contexts: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.ones(width)) for _ in range(order + 1)]
    for column, language in enumerate(languages):
        level = dict(counts.get(language, {}))
        by_length: list[Counter] = [Counter() for _ in range(order + 1)]
        for gram, n in level.items():
            by_length[len(gram)][gram] += n  # shorter ones stand at a word's begin and have no longer form
        for k in range(order, 1, -1):  # shorter ones count the different characters before them
            for gram in by_length[k]:
                by_length[k - 1][gram[1:]] += 1
        for k in range(1, order + 1):
            found = by_length[k]
            ones, twos = sum(n == 1 for n in found.values()), sum(n == 2 for n in found.values())
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
            total, kinds = Counter(), Counter()
            for gram, n in found.items():
                total[gram[:-1]] += n
                kinds[gram[:-1]] += 1
            for gram, n in found.items():
                grams[k][gram][column] = (n - discount) / total[gram[:-1]] if n > discount else 0.0
            for context, n in total.items():
                contexts[k][context][column] = discount * kinds[context] / n

    def arrays(found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array([gram_hash(x) for x in found], np.uint64)
        by = np.argsort(keys)
        return keys[by], (np.array(list(found.values())).reshape(-1, width)[by])

    return Models(languages, order, 1 / (len(alphabet) + 1), [arrays(x) for x in grams], [arrays(x) for x in contexts])


def count_grams(rows: DataFrame, order: int) -> DataFrame:
    """lang, gram, n of rows with lang and text: sequences of `order` characters, and the shorter ones at a word's begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words[language].update(letter_runs(text))
        for language, found in words.items():
            n: Counter = Counter()
            for word, times in found.items():
                padded = f" {word} "
                for end in range(2, len(padded) + 1):
                    n[padded[max(0, end - order) : end]] += times
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(n), pa.string()), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["lang", "gram", "n"])

    return rows.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def sample_of_each(rows: DataFrame, most: int, most_chars: int = SAMPLE_CHARS) -> DataFrame:
    """rows (row_key, lang, text), of each language as large a part by a hash of row_key as its equal share of documents and characters allows."""
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    rate = [(r["lang"], int(min(1.0, most / len(sizes) / r["n"], most_chars / len(sizes) / max(1, r["chars"])) * (1 << 30))) for r in sizes]
    if not rate:
        return rows
    rates = F.broadcast(rows.sparkSession.createDataFrame(rate, "lang string, rate long"))  # a row for each language
    return rows.join(rates, "lang").where(F.pmod(F.xxhash64(F.lit(7), "row_key"), F.lit(1 << 30)) < F.col("rate")).drop("rate")


def fit(rows: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, most: int = SAMPLE_DOCS) -> Models:
    """Models of the languages of labelled rows, from a bounded sample; a tenth of it sets the limits and the score's sharpness."""
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("row_key"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    sample = sample_of_each(rows, most).withColumn("apart", F.pmod(F.xxhash64(F.lit(13), "row_key"), F.lit(10)) == 0)
    grams = written(count_grams(sample.where(~F.col("apart")).select("lang", "text"), order), "grams")
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for batch in grams.toArrow().to_batches():
        for language, gram, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            counts[language][gram] = n
    if not counts:
        return Models([], order, 1.0, [], [])
    models = estimate(counts, sorted(counts), order)
    width = len(models.languages)
    shared, version, place = sample.sparkSession.sparkContext.broadcast(models), uuid.uuid4().hex, {x: i for i, x in enumerate(models.languages)}

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept("languages", version, lambda: WordTable(shared.value.word_scores))
        for batch in slices(batches):
            entropy, chars, n = shared.value.judge(batch.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(entropy.astype(float)), pa.list_(pa.float64())), pa.array(chars), pa.array(n)], names=["lang", "entropy", "chars", "n"])

    seen = [r for r in sample.where("apart").select("lang", "text").mapInArrow(tell, "lang string, entropy array<double>, chars double, n long").where("n > 0").toArrow().to_pylist() if r["lang"] in place]
    models.mean, models.limit = np.full(width, np.log(64.0)), np.full((len(CLASSES) + 1, width), np.inf)
    truth = np.array([place[r["lang"]] for r in seen], int)
    entropy = np.array([r["entropy"] for r in seen]).reshape(-1, width)
    chars = np.array([r["chars"] for r in seen])
    for i in range(width):
        if (own := truth == i).sum() >= 5:
            models.mean[i] = np.average(entropy[own, i], weights=np.minimum(chars[own], LONG))
    if len(seen):
        excess = (entropy[np.arange(len(seen)), truth] - models.mean[truth]) * np.sqrt(np.minimum(chars, LONG))
        models.limit = limits(excess, chars, truth, width)
        lengths = length_class(chars)
        beyond = excess > models.limit[lengths, truth]
        models.kept_apart = [(float(beyond[own].mean()) if own.any() else 0.0, int(own.sum())) for own in (lengths == k for k in range(len(CLASSES) + 1))]

        def loss(sharpness: float) -> float:
            z = -entropy * np.minimum(chars, LONG)[:, None] * sharpness
            z -= z.max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]))

        models.sharpness = min((0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0), key=loss)
    return models


def predictor(spark: SparkSession, models: Models):
    """A column function: text to struct(lang_pred, score, rejected)."""
    shared, version = spark.sparkContext.broadcast(models), uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        found = shared.value
        words = kept("languages", version, lambda: WordTable(found.word_scores))
        parts = [texts.iloc[i : i + 512] for i in range(0, len(texts), 512)]
        out = [found.decide(*found.judge(x, words)) for x in parts] or [found.decide(np.zeros((0, len(found.languages))), np.zeros(0), np.zeros(0, int))]
        return pd.concat(out, ignore_index=True)

    def column(text: Column) -> Column:
        return predict(text.cast("string"))

    return column


def trained_part(docs: DataFrame) -> DataFrame:
    """The rows that language ID learns from: crc32(doc_id as text) mod 5 is not 0."""
    return docs.where(F.coalesce(fold("doc_id", 5), F.lit(0)) != 0)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predict = predictor(spark, fit(trained_part(docs)))
    found = docs.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(True)).alias("held_out"), predict(F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.rejected")


QUERIES = {"op5_language_id": op5_language_id}
ORACLE: dict[str, str] = {}
