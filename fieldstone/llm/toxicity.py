"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, with exception phrases, normalised by length.

Folding puts look-alike letters and digit substitutions in the place of the plain letter. The lexicon holds words and word beginnings whose
share of toxic training documents stands out, with their log odds as weights; the exceptions are whole words and word pairs
around matches that keep to documents that are not toxic. A document's features are its summed weight, and that weight per
word; a logistic curve fitted on the same bounded sample makes it a probability.

Null and empty texts have no match and get the score of such texts. Without labels of both kinds there is no lexicon, and every score is the
share of toxic labels (1/2 if there are none). Labels that disagree about a document count by their mean. Repeated rows are scored row by row.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, kept, slices, table, written
from .quality_classifier import labelled

WORD = re.compile(r"[^\W_]+")
#: Characters read as the letter after them. 1 stands for i and for l, so these two are one letter in folded text.
LOOK_ALIKES = {
    "0": "o", "1": "i", "l": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "п": "n",
    "α": "a", "ο": "o", "ι": "i", "ρ": "p", "υ": "u", "τ": "t", "κ": "k", "ν": "v", "ε": "e", "σ": "o", "η": "n", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "i", "ø": "o", "ł": "i", "đ": "d",
}
#: Labelled documents that lexicon and curve are fitted on, at most about. Every term of theirs that stands out is an entry.
SAMPLE_DOCS = 20_000
#: Lengths of word beginnings; toxic documents with a term, its deviation from the overall share, and share of toxic ones, at least.
BEGINNINGS, LEAST_DOCS, LEAST_DEVIATION, LEAST_SHARE = (5, 6, 7), 4, 5.0, 0.6
#: Documents that are not toxic around an exception, and their share, at least.
EXCEPTION_DOCS, EXCEPTION_SHARE = 4, 0.8
#: Terms that a task counts before it hands them on: this bounds its memory.
MOST_HELD = 100_000
#: Words that a text counts as at least, when its weight is put against its length.
SHORT = 20.0


def _table() -> dict[int, str]:
    table = {ord(k): v for k, v in LOOK_ALIKES.items()}
    for code in range(0xC0, 0x250):  # letters with marks stand for the plain letter
        if code not in table and (plain := unicodedata.normalize("NFKD", chr(code))[0].lower()).isascii() and plain.isalpha():
            table[code] = table.get(ord(plain), plain)
    for code in range(0xFF01, 0xFF5F):  # full-width forms
        plain = unicodedata.normalize("NFKC", chr(code)).lower()
        table[code] = table.get(ord(plain), plain)
    for code in (*range(0x300, 0x370), *range(0x200B, 0x2010), 0xAD, 0xFEFF):  # marks and invisible characters
        table[code] = ""
    return table


FOLDS = _table()
BEFORE_LETTER = re.compile(r"[@$](?=[^\W_])")


def folded(text: str | None) -> str:
    """Lower case, look-alikes as plain letters; @ and $ only before a letter or digit, as they also end words."""
    text = (text or "").lower()
    if "$" in text or "@" in text:
        text = BEFORE_LETTER.sub(lambda m: "s" if m[0] == "$" else "a", text)
    return text.translate(FOLDS)


@dataclass
class Lexicon:
    """Weights of whole words and of word beginnings, exceptions, and the curve: bias and slopes."""

    words: dict[str, float]
    beginnings: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, ...] = (-3.0, 2.0, 1.0)

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for term in self.words.keys() | self.beginnings.keys():
            out.add_word(term, term)
        out.make_automaton()
        return out

    def matches(self, text: str, automaton: ahocorasick.Automaton) -> dict[tuple[int, int], float]:
        """(start, end) of each matched word in folded text and its weight, the largest of its terms."""
        found: dict[tuple[int, int], float] = {}
        if not len(automaton):
            return found
        for last, term in automaton.iter(text):
            start = last + 1 - len(term)
            if start and text[start - 1].isalnum():
                continue
            end = last + 1
            while end < len(text) and text[end].isalnum():
                end += 1
            weight = max(self.words.get(term, 0.0) if end == last + 1 else 0.0, self.beginnings.get(term, 0.0))
            if weight > found.get((start, end), 0.0):
                found[start, end] = weight
        return found

    def features(self, text: str, automaton: ahocorasick.Automaton) -> tuple[float, float]:
        found = self.matches(text, automaton)
        if not found:
            return 0.0, 0.0
        words = word_places(text) if self.exceptions else []
        weight = sum(w for place, w in found.items() if not self.exceptions or self.exceptions.isdisjoint(around(text, words, *place)))
        if not weight:
            return 0.0, 0.0
        return float(np.log1p(weight)), float(np.log1p(100 * weight / max(SHORT, len(text.split()))))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ np.array(self.curve[1:]), -30, 30)))


def word_places(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in WORD.finditer(text)]


def around(text: str, words: list[tuple[int, int]], start: int, end: int) -> list[str]:
    """The matched word, and it with the word before and the word after, from the places of all words."""
    word = text[start:end]
    before, after = bisect_right(words, start, key=lambda x: x[1]) - 1, bisect_left(words, end, key=lambda x: x[0])
    pairs = [f"{text[slice(*words[before])]} {word}"] if before >= 0 else []
    return [word, *pairs, *([f"{word} {text[slice(*words[after])]}"] if after < len(words) else [])]


def tally(sample: DataFrame, terms) -> DataFrame:
    """term, toxic and other: documents of either kind in whose folded text terms(text) finds the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in slices(batches):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term in terms(folded(text)):
                    counts.setdefault(term, [0, 0])[int(label >= 0.5)] += 1
            if len(counts) > MOST_HELD:
                yield rows(counts)
                counts = {}
        yield rows(counts)

    def rows(counts: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([x[1] for x in counts.values()], pa.int64()), pa.array([x[0] for x in counts.values()], pa.int64())], names=["term", "toxic", "other"])

    return sample.select("label", "text").mapInArrow(run, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def word_terms(text: str) -> set[str]:
    """Words, and word beginnings with a star."""
    words = set(WORD.findall(text))
    return words | {f"{w[:n]}*" for w in words for n in BEGINNINGS if len(w) >= n}


def fit(sample: DataFrame) -> Lexicon:
    """Lexicon, exceptions and curve from labelled rows (row_key, label, text)."""
    sample = written(sample, "toxic-sample")
    toxic, n = sample.agg(F.coalesce(F.sum((F.col("label") >= 0.5).cast("long")), F.lit(0)), F.count("*")).first()
    if not 0 < toxic < n:
        level = min(max(toxic / n if n else 0.5, 1e-6), 1 - 1e-6)
        return Lexicon({}, {}, curve=(float(np.log(level / (1 - level))), 0.0, 0.0))
    share = toxic / n
    seen = F.col("toxic") + F.col("other")
    deviation = (F.col("toxic") - seen * share) / F.sqrt(seen * share * (1 - share))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("other") + 0.5) / (n - toxic + 1))
    chosen = tally(sample, word_terms).where((F.col("toxic") >= LEAST_DOCS) & (deviation >= LEAST_DEVIATION) & (F.col("toxic") >= seen * LEAST_SHARE))
    # what is collected is bounded by the sample: an entry is in LEAST_DOCS of its documents at least
    rows = chosen.select("term", odds.alias("odds")).collect()
    lexicon = Lexicon({r["term"]: r["odds"] for r in rows if not r["term"].endswith("*")}, {r["term"][:-1]: r["odds"] for r in rows if r["term"].endswith("*")})
    shared, version = sample.sparkSession.sparkContext.broadcast(lexicon), uuid.uuid4().hex

    def phrases(text: str) -> set[str]:
        automaton = kept("lexicon", version, shared.value.automaton)
        found = shared.value.matches(text, automaton)
        words = word_places(text) if found else []
        return {x for place in found for x in around(text, words, *place)}

    harmless = tally(sample, phrases).where((F.col("other") >= EXCEPTION_DOCS) & (F.col("other") >= seen * EXCEPTION_SHARE))
    lexicon.exceptions = frozenset(r["term"] for r in harmless.select("term").collect())
    shared, version = sample.sparkSession.sparkContext.broadcast(lexicon), uuid.uuid4().hex
    final, final_version = shared, version

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = kept("lexicon", final_version, final.value.automaton)
        for batch in slices(batches):
            x = [final.value.features(folded(t), automaton) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in x]), pa.array([b for _, b in x])], names=["label", "a", "b"])

    found = sample.select("label", "text").mapInArrow(describe, "label double, a double, b double").toArrow()
    rows = np.stack([found.column(c).to_numpy() for c in ("a", "b", "label")], axis=1)
    rows = rows[np.lexsort(rows.T)]  # one order in every run; the sample is bounded
    x, y = np.concatenate([np.ones((len(rows), 1)), rows[:, :2]], axis=1), (rows[:, 2] >= 0.5).astype(float)
    lexicon.curve = logistic(x, y)
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[float, ...]:
    """Bias and slopes (not below 0) by Newton steps."""
    b = np.zeros(x.shape[1])
    hold = np.zeros(x.shape[1], bool)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (p - y) + ridge * b
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        use = ~hold
        b[use] -= np.linalg.solve(curve[np.ix_(use, use)], slope[use])
        hold |= (b < 0) & (np.arange(len(b)) > 0)
        b[hold] = 0.0
    return tuple(b.tolist())


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", most: int = SAMPLE_DOCS) -> DataFrame:
    """key, columns of docs named __* and score of each row; learns from all rows of labels."""
    lexicon = fit(labelled(docs, labels, label, most, key, text))
    shared, version = docs.sparkSession.sparkContext.broadcast(lexicon), uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        automaton = kept("lexicon", version, shared.value.automaton)
        x = np.array([shared.value.features(folded(t), automaton) for t in texts]).reshape(-1, 2)
        return pd.Series(shared.value.score(x))

    extra = [c for c in docs.columns if c.startswith("__")]
    return docs.select(key, *extra, score(F.col(text).cast("string")).alias("score"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("__held_out"))
    labels = table(spark, sf_dir, "labels").where(F.coalesce(fold("doc_id", 5), F.lit(0)) != 0)
    found = toxicity_scores(docs, labels).withColumnRenamed("__held_out", "held_out")
    return found.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLE: dict[str, str] = {}
