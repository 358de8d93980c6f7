"""Entity resolution: all pairs judged by hand against the links that are made."""

import itertools
import math
import random

import pytest

from fieldstone.operators import kinds, listings, resolution

SCHEMA = "id int, url string, hashes array<string>, address string, words array<string>, price double, lat double, lon double"


def near(a, b):
    if None in (a[6], a[7], b[6], b[7]):
        return False
    p, q = math.radians(a[6]), math.radians(b[6])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[7] - a[7]) / 2) ** 2
    return 6_371_000 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h)) <= 75


def judged(a, b):
    """(score, reasons) of a pair by the rule, or None."""
    score, why = 0.0, set()
    if a[1] and a[1] == b[1]:
        score, why = 1.0, {"canonical_url_exact"}
    if set(a[2] or ()) & set(b[2] or ()):
        score, why = max(score, 0.98), why | {"document_hash_exact"}
    x, y = set(a[4] or ()), set(b[4] or ())
    likeness = len(x & y) / len(x | y) if x and y else 0.0
    if a[3] and a[3] == b[3]:
        at, why = 0.72, why | {"normalized_address_exact"}
        if likeness >= 0.75:
            at, why = at + 0.12, why | {"headline_similarity"}
        if a[5] is not None and b[5] is not None and max(a[5], b[5]) > 0 and abs(a[5] - b[5]) / max(a[5], b[5]) <= 0.05:
            at, why = at + 0.1, why | {"guide_price_close"}
        if near(a, b) or (a[6] is None and a[7] is None) or (b[6] is None and b[7] is None):
            at, why = at + 0.08, why | {"coordinates_consistent"}
        score = max(score, at)
    if score < 0.82 and near(a, b) and likeness >= 0.85:
        score, why = 0.84, why | {"coordinates_close", "headline_similarity"}
    return (round(min(score, 0.995), 3), why) if score >= 0.82 else None


def brute(rows):
    root, best, why = {r[0]: r[0] for r in rows}, {}, {}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in itertools.combinations(rows, 2):
        if found := judged(a, b):
            root[max(find(a[0]), find(b[0]))] = min(find(a[0]), find(b[0]))
            for i in (a[0], b[0]):
                best[i], why[i] = max(best.get(i, 0), found[0]), why.get(i, set()) | found[1]
    return {r[0]: (find(r[0]), best.get(r[0], 1.0), sorted(why.get(r[0], {"singleton"}))) for r in rows}


def found(df):
    return {r.id: (r.cluster_root, r.confidence, r.reasons) for r in df.collect()}


def some_rows(seed, addresses, prices, n=260):
    chance = random.Random(seed)
    words = [f"w{i}" for i in range(9)]
    rows = []
    for i in range(n):
        place = chance.choice([(None, None), (51.5, -0.1), (51.5004, -0.1), (51.5009, -0.1), (51.5 + chance.random() / 50, -0.1), (51.5, None)])
        rows.append((
            i, chance.choice([f"u{i}", f"u{i}", f"u{i}", None, "", f"u{i // 20}"]), chance.choice([None, [], [], [f"h{i % 40}", f"g{i}"]]), chance.choice([None, "", *[f"{k} high road" for k in range(addresses)] * 3]),
            chance.choice([None, [], chance.sample(words, 4), words[: chance.randrange(1, 9)], words[:5]]), chance.choice([None, 0.0, 100.0 * 1.013 ** chance.randrange(prices)]), *place,
        ))
    return rows


@pytest.mark.parametrize(("seed", "addresses", "prices"), [(1, 3, 9), (3, 1, 200)])
def test_clusters_scores_and_reasons_are_those_of_all_pairs(spark, seed, addresses, prices):
    rows = some_rows(seed, addresses, prices)
    got, want = found(listings.resolved(spark.createDataFrame(rows, SCHEMA))), brute(rows)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_added_listings_change_only_what_they_touch(spark):
    rows = some_rows(5, 60, 40, 160)
    rows = [(*r[:6], *((52 + r[0] / 10, 0.5) if r[6] else (None, None))) if r[0] % 4 else r for r in rows]
    random.Random(2).shuffle(rows)
    df = lambda some: spark.createDataFrame(some, SCHEMA)
    held = found(listings.resolved(df(rows[:90])))
    for before, to in ((90, 100), (100, 160)):
        kept = spark.createDataFrame([(i, *x) for i, x in held.items()], "id int, cluster_root int, confidence double, reasons array<string>")
        changed = found(listings.extended(kept, df(rows[:before]), df(rows[before:to])))
        assert all(changed[i] != held.get(i) for i in changed) and {r[0] for r in rows[before:to]} <= changed.keys()
        held |= changed
        want = brute(rows[:to])
        assert {i: (held[i], want[i]) for i in want if held[i] != want[i]} == {}
        assert len(changed) < to / 2 or to == 160


def test_equal_listings_at_one_price(spark):
    row = ("1 high road", ["land", "plot"], 100.0, 51.5, -0.1)
    rows = [(1, "a", [], *row), (2, "b", [], *row), (3, "c", [], "1 high road", ["other"], 400.0, None, None)]
    got = found(listings.resolved(spark.createDataFrame(rows, SCHEMA)))
    assert got[1] == got[2] == (1, 0.995, ["coordinates_consistent", "guide_price_close", "headline_similarity", "normalized_address_exact"]) and got[3] == (3, 1.0, ["singleton"])


@pytest.mark.parametrize("same_price", [True, False])
def test_a_common_address_is_not_all_pairs(spark, same_price):
    n = 50_000
    rows = spark.sparkContext.parallelize(range(n), 8).map(
        lambda i: (i, f"u{i}", [], "the postcode's centroid", [f"w{i % 997}", f"x{i % 1009}", f"y{i % 2003}", "land"], 250_000.0 if same_price else float(20_000 + i * 37 % 900_000), 51.5, -0.1 if i % 3 else -0.1001)
    )
    df = spark.createDataFrame(rows, SCHEMA)
    if not same_price:
        assert n - 1 <= resolution.candidate_links(df).count() < 10 * n
        return
    got = listings.resolved(df)
    assert got.select("cluster_root").distinct().count() == 1 and got.where("confidence < 0.9").count() == 0


def test_empty_tables(spark):
    assert listings.resolved(spark.createDataFrame([], SCHEMA)).count() == 0
    lone = [(1, None, None, None, None, None, None, None), (2, "", [], "", [], 0.0, None, 1.0)]
    assert found(listings.resolved(spark.createDataFrame(lone, SCHEMA))) == brute(lone)


def test_accepted_pairs_are_those_of_the_rule(spark):
    chance = random.Random(5)
    pick = lambda *of: chance.choice(of)
    rows = [(i, pick("u1", "u2", "", None, f"v{i}"), pick([], None, ["h1"]), pick("a", "b", None), pick(["x", "y"], ["x"]), pick(None, 100.0, 103.0, 400.0), *pick((None, None), (51.5, -0.1), (51.5004, -0.1), (51.6, None))) for i in range(70)]
    df = spark.createDataFrame(rows, "id int, url string, hashes array<string>, address string, words array<string>, price double, lat double, lon double")
    judged = listings.candidate_pairs(df).withColumn("link", resolution.link()).where("link is not null")
    want = sorted((r.a, r.b, r.score, r.reasons) for r in judged.selectExpr("l.id a", "r.id b", "link.score", "link.reasons").collect())
    got = sorted((r.left_id, r.right_id, r.score, r.reasons) for r in listings.accepted_pairs(df).collect())
    assert got == want and len(got) > 100
    copies = spark.range(40).selectExpr("id", "concat('u', id) url", "array('h') hashes", "'a' address", "array('x') words", "1.0d price", "null lat", "null lon").selectExpr("id", "url", "hashes", "address", "words", "price", "cast(lat as double) lat", "cast(lon as double) lon")
    seen = []
    one = listings.candidate_pairs
    listings.candidate_pairs = lambda of, **kw: seen.append(of.count()) or one(of, **kw)
    try:
        assert listings.accepted_pairs(copies).count() == 40 * 39 // 2 and seen == [1, 0]
    finally:
        listings.candidate_pairs = one


def test_pairs_of_listings_alike_come_in_blocks_on_all_cores(spark, monkeypatch):
    monkeypatch.setattr(kinds, "BLOCK", 3)
    chance = random.Random(6)
    pick = lambda *of: chance.choice(of)
    rows = [(i, pick("u1", "u2", "", None, f"v{i}", f"w{i}"), [], pick("a", "a", "b"), pick(["x"], ["y"]), pick(100.0, 103.0, 400.0), None, None) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, url string, hashes array<string>, address string, words array<string>, price double, lat double, lon double")
    brute = listings.candidate_pairs(df).withColumn("link", resolution.link()).where("link is not null")
    want = sorted((r.a, r.b, r.score, r.reasons) for r in brute.selectExpr("l.id a", "r.id b", "link.score", "link.reasons").collect())
    found = listings.accepted_pairs(df)
    assert sorted((r.left_id, r.right_id, r.score, r.reasons) for r in found.collect()) == want and len(want) > 500
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_facts_of_a_link_are_worked_out_once(spark):
    df = spark.createDataFrame(some_rows(3, 5, 20, 40), SCHEMA)
    plan = resolution.links(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("arrays_overlap(") == 1 and "RepartitionByExpression" in plan
