import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from fieldstone.llm import simhash_dedup as M


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(items, linked):
    """Smallest id of each item's component: items are (id, fingerprint)."""
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i][1], items[j][1]):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(items):
        least[find(i)] = min(least.get(find(i), key), key)
    return [least[find(i)] for i in range(len(items))]


@pytest.mark.parametrize("text", [None, "", "one", "A b C", "a b c d", "The cat sat on the mat " * 5, "é Ü \x1c x\x0by z w", "x " * 20_000])
def test_fingerprint(text):
    assert M.fingerprint(text) == brute_fingerprint(text)


def test_every_pair_within_radius_meets_under_a_mask():
    chance = random.Random(1)
    for blocks in (5, 6, 7, 8):
        masks = [m & (1 << 64) - 1 for m in M.block_masks(blocks, 4)]
        for _ in range(300):
            flips = sum(1 << b for b in chance.sample(range(64), 4))
            assert any(flips & m == 0 for m in masks)


def groups(chance, n, spread):
    out = set()
    while len(out) < n:
        middle = chance.getrandbits(64)
        for _ in range(chance.randint(1, 9)):
            out.add(middle)
            for b in chance.sample(range(64), chance.randint(1, spread)):
                middle ^= 1 << b
    return sorted(out)[:n]


@pytest.mark.parametrize("most", [M.MOST_IN_BUCKET, 20])
def test_links_join_what_brute_force_joins(spark, most, monkeypatch):
    """Also with buckets that are split by points."""
    chance = random.Random(most)
    fps = groups(chance, 500, 6)
    near = chance.getrandbits(64)
    fps = sorted({*fps, *(near ^ sum(1 << b for b in chance.sample(range(64), 2)) for _ in range(60))})
    monkeypatch.setattr(M, "AIM", 8)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in M.connected_components(M.links(df, len(fps), most=most)).collect()}
    want = brute_components(list(zip(signed, fps, strict=True)), lambda a, b: (a ^ b).bit_count() <= 4)
    assert [roots.get(x, x) for x in signed] == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (1, 2), (2, 1)]
    found = {r.node: r.root for r in M.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 201)} | {i: 1000 for i in range(1001, 1100)}


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    items = [(r.doc_id, brute_fingerprint(r.text)) for r in docs]
    want = brute_components(items, lambda a, b: (a ^ b).bit_count() <= 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in M.op8_simhash_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: (f"{fp:016x}", c) for (k, fp), c in zip(items, want, strict=True)}


def test_odd_rows_and_keep_one(spark, odd_docs, no_docs):
    rows = M.near_duplicates(odd_docs).collect()
    assert len(rows) == 9
    empty = {r.doc_id: r.component_id for r in rows}
    assert empty[2] == empty[3] == empty[4] == 2
    kept = M.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter({1: 1, 2: 1, None: 1, 5: 1, 6: 1, 7: 1})
    assert M.keep_one(no_docs).count() == 0 and M.near_duplicates(no_docs).count() == 0


def test_keep_one_takes_one_of_each_class(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    classes = defaultdict(list)
    for r in M.near_duplicates(docs).collect():
        classes[r.component_id].append(r.doc_id)
    assert sorted(r.doc_id for r in M.keep_one(docs).select("doc_id").collect()) == sorted(map(min, classes.values()))


def test_different_texts_without_an_id_all_stay(spark):
    texts = ["the cat sat on the mat and slept", "an entirely different row of many other words", "an entirely different row of many other words"]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(4, "a text that has an id of its own here")], "doc_id long, text string")
    assert sorted(r.text for r in M.keep_one(docs).collect()) == sorted({*texts, "a text that has an id of its own here"})
