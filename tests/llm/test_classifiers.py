"""Language ID, quality and toxicity: exact pieces against brute force, whole queries by held-out accuracy."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstone.llm import language_id as L
from fieldstone.llm import quality_classifier as Q
from fieldstone.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def slow_kneser_ney(counts, order, alphabet):
    """p(char | context) by the textbook recursion."""
    levels = [None] * (order + 1)
    own = {k: {} for k in range(1, order + 1)}
    for g, n in counts.items():
        own[len(g)][g] = own[len(g)].get(g, 0) + n
    for k in range(order, 1, -1):
        for g in own[k]:
            own[k - 1][g[1:]] = own[k - 1].get(g[1:], 0) + 1
    for k in range(1, order + 1):
        ones, twos = (sum(n == i for n in own[k].values()) for i in (1, 2))
        levels[k] = own[k], (min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5)

    def p(gram):
        if not gram:
            return 1 / (alphabet + 1)
        found, discount = levels[len(gram)]
        context = gram[:-1]
        same = [n for g, n in found.items() if g[:-1] == context]
        if not same:
            return p(gram[1:])
        n = found.get(gram, 0)
        return max(n - discount, 0) / sum(same) + discount * len(same) / sum(same) * p(gram[1:])

    return p


def test_kneser_ney_matches_the_recursion():
    texts = {"aa": "abra cadabra abba", "bb": "bob cob mob sob"}
    counts = {}
    for lang, text in texts.items():
        for word in text.split():
            padded = f" {word} "
            for end in range(2, len(padded) + 1):
                gram = padded[max(0, end - 3) : end]
                counts.setdefault(lang, {})[gram] = counts.setdefault(lang, {}).get(gram, 0) + 1
    models = L.estimate(counts, ["aa", "bb"], 3)
    alphabet = len({c for x in counts.values() for g in x for c in g})
    words = ["abra", "cob", "zebra", "b", "abcabc"]
    got = models.word_scores(words)
    for column, lang in enumerate(("aa", "bb")):
        p = slow_kneser_ney(counts[lang], 3, alphabet)
        for row, word in enumerate(words):
            padded = f" {word} "
            want = sum(math.log(p(padded[max(0, end - 3) : end])) for end in range(2, len(padded) + 1))
            assert got[row, column] == pytest.approx(want, rel=1e-5)


def test_language_query(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = L.op5_language_id(spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert not any(r.rejected for r in rows)


def test_foreign_text_is_rejected(spark):
    models = L.fit(L.trained_part(spark.read.parquet(f"{SF}/documents.parquet")))
    predict = L.predictor(spark, models)
    rows = spark.createDataFrame([("zxqj wvkq xxqz jjqw " * 30,), ("Привет мир как дела " * 20,), ("the and of thing",), ("123 ?!",), (None,)], "text string").select(predict(F.col("text")).alias("p")).collect()
    assert [r.p.rejected for r in rows] == [True, True, False, True, True]
    assert [r.p.lang_pred for r in rows[3:]] == ["und", "und"] and rows[3].p.score == 0


def test_numbers_are_no_letters(spark):
    predict = L.predictor(spark, L.fit(L.trained_part(spark.read.parquet(f"{SF}/documents.parquet"))))
    rows = spark.createDataFrame([("½ ²",), ("Ⅷ ٣ ①",), ("x²",), ("हिन्दी",)], "text string").select("text", predict(F.col("text")).alias("p")).collect()
    assert [r.p.lang_pred == "und" for r in rows] == [True, True, False, False]
    assert L.letter_runs("हिन्दी e\u0301t\u00e9 a1b") == ["हिन्दी", "e\u0301t\u00e9", "a", "b"]


def test_small_languages_are_learned(spark):
    """A language with one document in a thousand gets as large a share of the sample as any."""
    rows = [(i, f"the cat and the dog number {i % 7} sat", "en") for i in range(3000)] + [(9000 + i, "der hund und die katze schliefen", "de") for i in range(30)]
    models = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=200)
    assert models.languages == ["de", "en"]
    assert models.word_scores(["und"])[0].argmax() == 0 and models.word_scores(["and"])[0].argmax() == 1


def test_rejection_keeps_to_its_rate(spark):
    """Of texts kept apart under 1% of each class of length; junk goes."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    models = L.fit(L.trained_part(docs))
    assert sum(n for _, n in models.kept_apart) > 500 and all(share < 0.01 for share, n in models.kept_apart if n > 100)
    chance = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz      "))
    junk = [("".join(chance.choice(letters, n)),) for n in (60, 150, 400, 2000) for _ in range(50)]
    predict = L.predictor(spark, models)
    rejected = [r[0] for r in spark.createDataFrame(junk, "text string").select(predict(F.col("text"))["rejected"]).collect()]
    assert np.mean(rejected[50:]) > 0.99 and np.mean(rejected[:50]) > 0.9


def test_language_odd_rows(spark, odd_docs, no_docs):
    for training in (odd_docs, no_docs, odd_docs.withColumn("lang", F.lit(None).cast("string"))):
        predict = L.predictor(spark, L.fit(training))
        rows = odd_docs.select("doc_id", predict(F.col("text")).alias("p")).collect()
        assert len(rows) == 9 and {r.doc_id: r.p.lang_pred for r in rows}[6] == "und"
        assert no_docs.select(predict(F.col("text"))).count() == 0


def roc(rows, truth):
    pairs = sorted((r.score, truth[r.doc_id]) for r in rows)
    good, bad = [i for i, (_, y) in enumerate(pairs) if y], [i for i, (_, y) in enumerate(pairs) if not y]
    return (np.mean(good) - (len(good) - 1) / 2) / len(bad)


def test_quality_query(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = Q.op6_quality_classifier(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert roc(held, truth) > 0.93
    assert sorted(rows) == sorted(Q.op6_quality_classifier(spark, SF).collect())


def test_context_sums_match_brute_force(spark):
    texts = ["The cat, the CAT!! sat.", None, "", "one", "a b a b ### a", "solo ? solo"]
    sums, n = np.zeros((Q.BUCKETS, Q.SIZE)), np.zeros(Q.BUCKETS)
    for text in texts:
        found = Q.tokens(text)
        codes = Q.token_codes(found)
        for i in range(len(found)):
            n[codes[i, 0]] += 1
            for j in (i - 1, i + 1):
                if 0 <= j < len(found):
                    for s in range(Q.SIGNS):
                        sums[codes[i, 0], codes[j, 1 + s]] += 1 - 2 * (codes[j, -1] >> s & 1)
    rows = Q.context_sums(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()
    got = np.zeros((Q.BUCKETS, Q.SIZE + 1))
    for r in rows:
        got[r.block * Q.BLOCK : (r.block + 1) * Q.BLOCK] = np.frombuffer(r.sums).reshape(Q.BLOCK, Q.SIZE + 1)
    assert np.array_equal(got[:, :-1], sums) and np.array_equal(got[:, -1], n)


def test_context_sums_of_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(Q, "FAN_IN", 3)
    texts = spark.createDataFrame([(f"the cat {i} sat on the mat",) for i in range(60)], "text string")
    few, many = ({r.block: r.sums for r in Q.context_sums(x, "text").collect()} for x in (texts.coalesce(1), texts.repartition(20)))
    assert few == many


def test_repeated_ids_teach_once(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(50)] + [(2, "other"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    assert sorted((r.row_key, r.label) for r in Q.labelled(docs, labels, "quality", 100).collect()) == [(1, 0.5), (2, 1.0)]


def test_toxicity_query(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = T.op10_toxicity(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    known = [r for r in rows if r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in known]) > 0.95


def test_toxicity_of_held_out_rows(spark):
    """Rows that the lexicon was not learned from, on the largest of the small tables."""
    d = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in T.op10_toxicity(spark, d).where("held_out").collect() if r.doc_id in truth]
    toxic = [r.predicted for r in rows if truth[r.doc_id]]
    harmless = [r.predicted for r in rows if not truth[r.doc_id]]
    assert len(toxic) > 30 and np.mean(toxic) > 0.9 and np.mean(harmless) < 0.02


def test_words_are_counted_by_any_white_space():
    lexicon = T.Lexicon({"scum": 1.0}, {})
    automaton = lexicon.automaton()
    blank, lines = (lexicon.features("scum" + f"{x}word" * 300, automaton) for x in (" ", "\n"))
    assert blank == lines


def test_exceptions_look_at_the_next_word_however_far():
    text = "scum" + " " * 90 + "lake, and " + "-" * 70 + " old scum"
    words = T.word_places(text)
    assert T.around(text, words, 0, 4) == ["scum", "scum lake"]
    assert T.around(text, words, len(text) - 4, len(text)) == ["scum", "old scum"]


def test_folding_and_matching():
    assert T.folded("Lo$er 1oser LOSER$$$ a@b ＬＯＳＥＲ") == "ioser ioser ioser$$$ aab ioser"
    lexicon = T.Lexicon({"idiot": 2.0, "scum": 1.0}, {T.folded("achl"): 3.0}, frozenset({T.folded("scum lake"), T.folded("achlich")}))
    automaton = lexicon.automaton()
    found = lambda text: {T.folded(text)[a:b]: w for (a, b), w in lexicon.matches(T.folded(text), automaton).items()}
    assert found("an 1D10T, an іdіоt, an ÍDIÓT and an ｉｄｉｏｔ") == {"idiot": 2.0}
    assert len(lexicon.matches(T.folded("an 1D10T, an іdіоt, an ÍDIÓT and an ｉｄｉｏｔ"), automaton)) == 4
    assert found("idiotic scumbag xscum") == {} and found("achlung scum$$$") == {T.folded("achlung"): 3.0, "scum": 1.0}
    assert lexicon.features(T.folded("at scum lake"), automaton) == (0.0, 0.0) and lexicon.features(T.folded("achlich"), automaton) == (0.0, 0.0)
    assert lexicon.features(T.folded("scum"), automaton) > lexicon.features(T.folded("scum " + "word " * 500), automaton)


@pytest.mark.parametrize("score,label", [(Q.quality_scores, "quality"), (T.toxicity_scores, "toxic")])
def test_scores_of_odd_rows(spark, odd_docs, no_docs, score, label):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 0, 0), (5, 1, 1), (5, 0, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.where("false"), labels.where(f"{label} = 1")):
        rows = score(odd_docs, known).collect()
        assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
        assert score(no_docs, known).count() == 0


@pytest.mark.parametrize("left_out", ["fr", "en"])
def test_an_unlearned_language_is_rejected(spark, left_out):
    """Of the same script; the learned ones are left alone."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    predict = L.predictor(spark, L.fit(L.trained_part(docs.where(F.col("lang") != left_out))))
    other = (F.col("lang") == left_out).alias("other")
    rows = docs.where(L.fold("doc_id", 5) == 0).select(other, predict(F.col("text"))["rejected"].cast("int").alias("rejected"))
    share = {r.other: r.share for r in rows.groupBy("other").agg(F.avg("rejected").alias("share")).collect()}
    assert share[True] > 0.9 and share[False] < 0.005
