import math
import random
from collections import Counter

import numpy as np
import pytest

from fieldstone.llm import decontamination as M


def texts(chance, n):
    vocabulary = ["".join(chance.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    return " ".join(chance.choice(vocabulary) for _ in range(n))


def similarity(a, b, items):
    """Weighted Jaccard similarity of two Counters of shingles, by its definition."""
    sets = [set(M.shingle_hashes(M.word_hashes(M.split_words(t))).tolist()) for _, t in items if len(M.split_words(t)) >= 5]
    holders = Counter(x for own in sets for x in own)
    weight = lambda x: math.log(1 + len(sets) / holders[x]) if holders[x] else math.log(1 + len(sets))
    return sum(min(a[x], b[x]) * weight(x) for x in a.keys() & b.keys()) / sum(max(a[x], b[x]) * weight(x) for x in a.keys() | b.keys())


def brute(text, items, benchmark):
    """Best window of each item by exact similarity over all windows of its size."""
    out = {}
    shingles = M.shingle_hashes(M.word_hashes(M.split_words(text))).tolist()
    for i, item in items:
        own = M.shingle_hashes(M.word_hashes(M.split_words(item))).tolist()
        for s in range(len(shingles) - len(own) + 1) if own else ():
            if not set(own) & set(shingles[s : s + len(own)]):
                continue
            score = similarity(Counter(shingles[s : s + len(own)]), Counter(own), benchmark)
            if score >= M.SIMILARITY:
                out[i] = max(out.get(i, 0), score)
    return out


def test_block_index_finds_all_within_the_radius():
    chance = random.Random(3)
    prints = np.array([chance.getrandbits(64) for _ in range(60)], np.uint64)
    near = np.array([int(prints[chance.randrange(60)]) ^ sum(1 << b for b in chance.sample(range(64), chance.randint(0, 22))) for _ in range(500)], np.uint64)
    found = set(zip(*(x.tolist() for x in M.BlockIndex(prints).search(near)), strict=True))
    want = {(i, j) for i in range(500) for j in range(60) if int(near[i] ^ prints[j]).bit_count() <= M.RADIUS}
    assert found == want and len(want) > 300


def test_planted_passages_are_found_and_clean_texts_left_alone():
    chance = random.Random(5)
    items = [(i, texts(chance, chance.choice([5, 8, 15, 30, 59]))) for i in range(60)]
    every = [*items, (900, "too short"), (901, None), (902, items[0][1])]
    benchmark = M.Benchmark(every)
    clean = [texts(chance, chance.randint(0, 300)) for _ in range(80)]
    assert all(not x for x in benchmark.matches(clean))
    planted, want = [], []
    for i, item in items:
        words = item.split()
        if len(words) >= 59 and i % 2:
            words[30] = "changed"
        planted.append(" ".join([texts(chance, 50), *words, texts(chance, 70)]).upper())
        want.append(brute(planted[-1], items, every))
    got = [{m[0]: m[1] for m in x if m[0] < 900} for x in benchmark.matches(planted)]
    assert all(i in w for (i, _), w in zip(items, want, strict=True))
    assert got == [pytest.approx(w) for w in want]
    assert {m[0] for m in benchmark.matches([planted[0]])[0]} == {0, 902}


def test_borderline_recall():
    """Windows whose similarity is barely enough are nearly always within the radius."""
    chance = random.Random(8)
    items = [(i, texts(chance, 50)) for i in range(120)]
    benchmark, docs = M.Benchmark(items), []
    for _, item in items:
        words = item.split()
        words[0] = words[-1] = "edge"
        words[chance.choice([1, 2])] = "edge"
        docs.append(texts(chance, 20) + " " + " ".join(words) + " " + texts(chance, 20))
    want = [brute(d, items, items) for d in docs]
    got = benchmark.matches(docs)
    assert sum(i in w for i, w in enumerate(want)) > 100
    assert sum(bool(g) for g, w in zip(got, want, strict=True) if w) >= 0.97 * sum(map(bool, want))


def test_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    known = {h for i, t in items for h in M.shingle_hashes(M.word_hashes(M.split_words(t))).tolist()}
    want = {}
    for r in docs:
        if known & set(M.shingle_hashes(M.word_hashes(M.split_words(r.text))).tolist()):
            want |= {(r.doc_id, i): s for i, s in brute(r.text, items, items).items()}
    got = {(r.doc_id, r.item_id): r.similarity for r in M.op7_decontamination(spark, d).collect()}
    assert got == pytest.approx(want) and want


def test_odd_rows(spark, odd_docs, no_docs):
    benchmark = spark.createDataFrame([(1, "the quick brown FOX jumps over the lazy dog"), (2, None), (None, "a b c d e f"), (3, "")], "item_id long, text string")
    rows = M.find_matches(odd_docs, benchmark).collect()
    assert [(r.doc_id, r.item_id, r.similarity) for r in rows] == [(1, 1, 1.0)] * 2
    kept = M.keep_clean(odd_docs, benchmark)
    assert kept.columns == odd_docs.columns and kept.count() == 7
    nothing = benchmark.where("false")
    assert M.keep_clean(odd_docs, nothing).count() == 9 and M.find_matches(odd_docs, nothing).count() == 0
    assert M.find_matches(no_docs, benchmark).count() == 0


def test_large_benchmarks_are_searched_in_parts(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(M, "MOST_ITEMS", 2)
    benchmark = spark.createDataFrame([(i, f"item number {i} has these words") for i in range(9)] + [(99, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")
    assert len(M.parts_of(benchmark, "item_id", "text")) == 10
    assert {r.item_id for r in M.find_matches(odd_docs, benchmark).collect()} == {99}
    assert sorted(r.doc_id or 0 for r in M.keep_clean(odd_docs, benchmark).collect()) == [0, 2, 3, 4, 5, 6, 7]


def test_parts_change_nothing(spark, monkeypatch):
    """Items that share shingles across parts: the same rows and similarities with one part and with many."""
    chance = random.Random(21)
    openings = [texts(chance, 9) for _ in range(3)]
    items = [(i, f"{chance.choice(openings)} {texts(chance, chance.choice([6, 9, 14]))} {chance.choice(openings)}") for i in range(60)] + [(70, "two words"), (71, None), (72, openings[0])]
    docs = []
    for i, (_, item) in enumerate(items[:60]):
        words = item.split()
        if i % 3:
            words[-1 - i % 5] = "changed"
        if i % 4 == 3:
            words += openings[i % 3].split()
        docs.append((i, " ".join([texts(chance, 20), *words, chance.choice(openings), "two words" if i % 9 == 0 else ""])))
    docs += [(0, docs[0][1]), (100, texts(chance, 200)), (101, None), (None, docs[5][1])]
    df, benchmark = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")

    def found():
        rows = M.find_matches(df, benchmark).collect()
        return sorted((r.doc_id or -1, r.item_id, round(r.similarity, 9), r.start_word, r.n_words, r.hamming) for r in rows), sorted(r.doc_id or -1 for r in M.keep_clean(df, benchmark).collect())

    one = found()
    monkeypatch.setattr(M, "MOST_ITEMS", 16)
    assert len(M.parts_of(benchmark, "item_id", "text")) == 8
    many = found()
    assert one == many and len(one[0]) > 60 and any(r[2] < 0.99 for r in one[0]) and 100 in one[1]


def test_items_without_a_shingle_match_their_words():
    benchmark = M.Benchmark([(1, "Not a shingle"), (2, "two words"), (3, "not a shingle"), (4, "five words make one shingle")])
    got = benchmark.matches(["here is NOT a\nshingle and not a shingle", "two", "words two words", "not a", None, "five words make one shingle"])
    assert got == [[(1, 1.0, 2, 3, 0), (3, 1.0, 2, 3, 0)], [], [(2, 1.0, 1, 2, 0)], [], [], [(4, 1.0, 0, 5, 0)]]


def test_many_items_take_bounded_memory(monkeypatch):
    """50,000 items at once: the pairs of fingerprints are looked at in pieces, with the same result."""
    chance = np.random.default_rng(7)
    prints = chance.integers(0, 1 << 63, 50_000, dtype=np.uint64) << np.uint64(1)
    index, windows = M.BlockIndex(prints), np.concatenate([prints[:40], prints[40:80] ^ np.uint64(0b1011), chance.integers(0, 1 << 63, 2000, dtype=np.uint64)])
    largest, count = 0, np.bitwise_count

    def watched(x):
        nonlocal largest
        largest = max(largest, len(x))
        return count(x)

    monkeypatch.setattr(M.np, "bitwise_count", watched)
    who, items = index.search(windows)
    monkeypatch.undo()
    assert largest <= M.MOST_PAIRS + 50_000
    near = np.array([int((count(windows[i] ^ prints) <= M.RADIUS).sum()) for i in range(0, len(windows), 50)])
    assert np.array_equal(np.bincount(who, minlength=len(windows))[::50], near) and set(range(80)) <= set(who[who == items].tolist())


def test_documents_that_are_cut_items_are_found():
    """A document of 80 to 99% of an item has no window of the item's size."""
    chance = random.Random(11)
    items = [(i, texts(chance, chance.choice([12, 24, 36, 60]))) for i in range(200)]
    benchmark = M.Benchmark(items)
    found = wanted = 0
    for i, item in items:
        words = item.split()
        cut = words[: len(words) - chance.randint(1, max(1, len(words) // 6))]
        own, whole = (M.shingle_hashes(M.word_hashes(M.split_words(" ".join(x)))).tolist() for x in (cut, words))
        score = similarity(Counter(own), Counter(whole), items)
        got = {m[0]: m[1:4] for m in benchmark.matches([" ".join(cut)])[0]}
        assert i not in got or got[i] == (pytest.approx(score), 0, len(cut))
        wanted += score >= M.SIMILARITY
        found += i in got
    assert wanted > 120 and found >= 0.97 * wanted
    assert benchmark.matches([" ".join(items[0][1].split()[:5])]) == [[]]
