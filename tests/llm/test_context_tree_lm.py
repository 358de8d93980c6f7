import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldstone.llm import context_tree_lm as M


class SlowTree:
    """Context-tree weighting by recursion over dictionaries."""

    def __init__(self, texts, depth, most):
        self.depth, self.counts = depth, [defaultdict(lambda: [0, 0]) for _ in range(depth + 1)]
        times = [Counter() for _ in range(depth + 1)]
        for text in texts:
            whole = M.END * depth + text
            for i in range(depth, len(whole)):
                for d in range(depth + 1):
                    times[d][whole[i - d : i]] += 1
                    for b in range(8):
                        self.counts[d][whole[i - d : i], 1 << b | whole[i] >> (8 - b)][whole[i] >> (7 - b) & 1] += 1
        self.kept, least = [], 1
        for d in range(depth + 1):
            buckets, left = defaultdict(list), most
            for c, n in times[d].items():
                buckets[math.floor(math.log2(n) * 8)].append(n)
            lowest = None
            for _, found in sorted(buckets.items(), reverse=True):
                if len(found) > left:
                    lowest = lowest or max(found) + 1
                    break
                left, lowest = left - len(found), min(found)
            if sum(map(len, buckets.values())) > most:
                least = max(least, lowest)
            self.kept.append({c for c, n in times[d].items() if n >= least})
            assert len(self.kept[-1]) <= most
        self.children = [defaultdict(list) for _ in range(depth)]
        for d in range(depth):
            for c in self.kept[d + 1]:
                self.children[d][c[1:]].append(c)
        self.memo = {}

    @staticmethod
    def kt(zeros, ones):
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.log(math.pi) - math.lgamma(zeros + ones + 1)

    def node(self, d, context, prefix):
        """log of the weighted probability, weight of the own estimate, rest counts."""
        key = d, context, prefix
        if key not in self.memo:
            zeros, ones = self.counts[d].get((context, prefix), (0, 0))
            own = self.kt(zeros, ones)
            if d == self.depth:
                self.memo[key] = own, 1.0, (0, 0)
            else:
                rest, longer = [zeros, ones], 0.0
                for c in self.children[d][context]:
                    z, o = self.counts[d + 1].get((c, prefix), (0, 0))
                    rest[0] -= z
                    rest[1] -= o
                    longer += self.node(d + 1, c, prefix)[0]
                longer += self.kt(*rest)
                top = max(own, longer)
                total = top + math.log(0.5 * math.exp(own - top) + 0.5 * math.exp(longer - top))
                self.memo[key] = total, math.exp(own + math.log(0.5) - total), tuple(rest)
        return self.memo[key]

    def log2(self, before, byte):
        out = 0.0
        for b in range(8):
            prefix, p = 1 << b | byte >> (8 - b), None
            for d in range(self.depth, -1, -1):
                context = before[len(before) - d :]
                if context not in self.kept[d]:
                    continue
                zeros, ones = self.counts[d].get((context, prefix), (0, 0))
                _, weight, rest = self.node(d, context, prefix)
                if p is None:
                    p = 0.5 if (zeros, ones) == (0, 0) else (rest[1] + 0.5) / (sum(rest) + 1) if d < self.depth else 0.5
                if (zeros, ones) == (0, 0):
                    weight = 0.5
                p = weight * (ones + 0.5) / (zeros + ones + 1) + (1 - weight) * p
            out += math.log2(p if byte >> (7 - b) & 1 else 1 - p)
        return out


@pytest.mark.parametrize("depth,most", [(2, 1 << 17), (3, 40), (5, 60)])
def test_tree_matches_recursion(spark, depth, most):
    chance = random.Random(depth)
    texts = ["".join(chance.choice("ab cé") for _ in range(chance.randint(0, 60))) for _ in range(40)]
    coded = [M.encoded(t)[1] for t in texts]
    counts = M.count_corpus(spark.createDataFrame([(t,) for t in texts], "text string"), "text", depth)
    tree = M.fit_tree(counts.where("seq is not null"), depth, most)
    slow = SlowTree(coded, depth, most)
    for text in [*texts[:10], "zebra abba", "", "éé ab c", "a" * 50]:
        line = M.encoded(text)[1]
        got = tree.score(M.sequences([line], depth)[0])
        whole = M.END * depth + line
        assert got == pytest.approx([slow.log2(whole[i - depth : i], whole[i]) for i in range(depth, len(whole))], rel=1e-4, abs=1e-4)


def test_probabilities_add_up_to_one(spark):
    counts = M.count_corpus(spark.createDataFrame([("the cat sat on the mat",), ("the dog",)], "text string"), "text", 3)
    tree = M.fit_tree(counts.where("seq is not null"), 3)
    for context in (b"the", b"zzz", b"\n\n\n", b"e c"):
        seq = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert (2.0 ** tree.score(seq).astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_query_matches_brute_force_word_model(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    tokens = {r.doc_id: [*(r.text or "").encode().lower().split(), b"\n"] for r in docs}
    count = Counter(w for i, words in tokens.items() if not held(i) for w in words)
    total = sum(count.values()) + 0.5 * (len(count) + 1)
    rows = M.op2_context_tree_lm(spark, d).collect()
    assert len(rows) == len(docs)
    for r in rows:
        words = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(words), sum(w in count for w in words), sum(count.values()))
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / total) for w in words))


def test_model_beats_the_word_model_on_held_out_texts(spark):
    rows = [r for r in M.op2_context_tree_lm(spark, "/root/testdata/sf0.1").where("held_out").collect()]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert sum(r.bits_per_byte for r in rows) / len(rows) < 2.4


def test_rare_words_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x y z " * 30 + f"only{i} twice{i % 5}") for i in range(20)], "doc_id long, text string")
    whole = {r.doc_id: (r.n_known, r.base_score) for r in M.score_texts(docs, docs.where("doc_id < 10")).collect()}
    monkeypatch.setattr(M, "MOST_WORDS", 10)
    joined = {r.doc_id: (r.n_known, r.base_score) for r in M.score_texts(docs, docs.where("doc_id < 10")).collect()}
    assert all(joined[i][0] == n and joined[i][1] == pytest.approx(s) for i, (n, s) in whole.items())


def test_odd_rows(spark, odd_docs, no_docs):
    rows = M.score_texts(odd_docs, odd_docs).collect()
    assert len(rows) == 9 and all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert [r.n_tokens for r in rows if r.doc_id in (2, 3, 4)] == [1, 1, 1]
    untrained = M.score_texts(odd_docs, no_docs).collect()
    assert {r.doc_id: r.score for r in untrained}[2] == pytest.approx(-8 * math.log10(2)) and all(r.n_known == 0 for r in untrained)
    assert M.score_texts(no_docs, odd_docs).count() == 0


def test_query_tree_keeps_every_context(spark, monkeypatch):
    """More contexts than any bound had: scores are those of a tree that leaves none out, with few sequences sent and many joined."""
    chance = random.Random(3)
    words = ["".join(chance.choice("abcdefghij") for _ in range(8)) for _ in range(12_000)] * 3
    chance.shuffle(words)
    texts = [" ".join(words[i::30]) for i in range(30)]  # long contexts tell much, and most are rare
    docs = spark.createDataFrame(list(enumerate([*texts, "zebra abba", "", None])), "doc_id long, text string")
    training = docs.where("doc_id < 25")
    whole = M.fit_tree(M.count_corpus(training, "text").where("seq is not null"), M.DEPTH, 1 << 30)
    assert len(whole.levels[M.DEPTH].contexts) > 1 << 16
    monkeypatch.setattr(M, "MOST_GROWN", 5_000)
    for sent in (1 << 21, 1_000):
        monkeypatch.setattr(M, "MOST_SENT", sent)
        got = {r.doc_id: r for r in M.score_texts(docs, training).collect()}
        for i, text in enumerate([*texts, "zebra abba", "", None]):
            bits = whole.score(M.sequences([M.encoded(text)[1]], M.DEPTH)[0]).astype(float).sum()
            assert got[i].score == pytest.approx(bits * math.log10(2), rel=1e-4)


@pytest.mark.parametrize("large", [1 << 30, 12])
def test_query_path_matches_recursion(spark, monkeypatch, large):
    """Scores of the query's own path, with branches whole and cut, by recursion over dictionaries that keep every context."""
    monkeypatch.setattr(M, "LARGE_BRANCH", large)
    monkeypatch.setattr(M, "MOST_GROWN", 40)
    monkeypatch.setattr(M, "MOST_SENT", 30)
    chance = random.Random(12)
    words = ["the", "then", "there", "she", "sea", "seat", "ea"]
    texts = [" ".join(chance.choice(words) + chance.choice(["", "", chance.choice("abcdr")]) for _ in range(chance.randint(0, 25))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate([*texts, "zebra then abba", "", None])), "doc_id long, text string")
    training = docs.where("doc_id < 30")
    counts = M.count_corpus(training, "text").where("seq is not null").select("seq", "n")
    split = M.split_branches(counts)
    assert (split.large is None) == (large > 12) and (split.large is None or split.large.count() > 5)
    slow = SlowTree([M.encoded(t)[1] for t in texts[:30]], M.DEPTH, 1 << 30)
    got = {r.doc_id: r for r in M.score_texts(docs, training).collect()}
    for i, text in enumerate([*texts, "zebra then abba", "", None]):
        if i % 3 and i < 40:
            continue
        line = M.encoded(text)[1]
        whole = M.END * M.DEPTH + line
        bits = sum(slow.log2(whole[j - M.DEPTH : j], whole[j]) for j in range(M.DEPTH, len(whole)))
        assert got[i].score == pytest.approx(bits * math.log10(2), rel=2e-4)
