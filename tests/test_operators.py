import datetime as dt
import json
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstone.functions import geo as G
from fieldstone.operators import assessments, comparables, components, containment, control, features, kinds, latest, listings, planning, ranges, ranking, readback, refits, resolution, scenarios, scoring, sites, valuation
from fieldstone.sources import readers
from fieldstone.streaming import jobs

DAY = dt.date(2024, 1, 1)


def days(n):
    return DAY + dt.timedelta(days=n)


def ring(x, y, w, h=None):
    h = h or w
    return [[{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]]


def spot(x, y):
    return [[{"x": float(x), "y": float(y)}]]


def test_as_of_joins_agree(spark):
    chance = random.Random(2)
    facts = [(k, n, n * 10 + i) for i, k in enumerate("abc") for n in sorted(chance.sample(range(100), 9))]
    rows = [(i, chance.choice("abcd"), chance.randrange(-5, 110)) for i in range(200)]
    want = {i: max(((n, v) for kk, n, v in facts if kk == k and n <= at), default=(None, None))[1] for i, k, at in rows}
    f, r = spark.createDataFrame(facts, "k string, since int, v int"), spark.createDataFrame(rows, "id int, k string, at int")
    for join in (latest.as_of_join, latest.as_of_lookup):
        assert {x.id: x.v for x in join(r, f, ["k"], "at", "since", ["v"]).collect()} == want


def test_components_match_union_find(spark):
    chance = random.Random(6)
    edges = [(chance.randrange(300), chance.randrange(300)) for _ in range(220)]
    parent = list(range(300))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert {i: got.get(i, i) for i in range(300)} == {i: find(i) for i in range(300)}


def test_listing_resolution(spark):
    rows = [
        (1, "u1", ["h1"], "1 high street", ["garden", "plot", "kent"], 100.0, 51.5, -0.1), (2, "u1", [], "9 low road", ["x"], None, None, None), (3, "u3", ["h1", "h2"], None, ["y"], 5.0, None, None),
        (4, "u4", [], "1 high street", ["garden", "plot", "kent"], 101.0, None, None), (5, "u5", [], "1 high street", ["other"], 101.0, 51.6, -0.3), (6, "u6", [], None, ["garden", "plot", "kent"], None, 51.50001, -0.10001),
        (7, "u7", [], None, ["garden", "plot", "kent"], None, 51.502, -0.1), (8, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, url string, hashes array<string>, address string, words array<string>, price double, lat double, lon double")
    edges = resolution.links(df)
    assert {(r.left_id, r.right_id) for r in edges.collect()} <= {(1, 2), (1, 3), (1, 4), (1, 5), (4, 5), (1, 6)}
    members = listings.clusters(df, edges)
    got = {r.id: (r.cluster_root, r.reasons) for r in members.collect()}
    assert [got[i][0] for i in range(1, 9)] == [1, 1, 1, 1, 1, 1, 7, 8] and got[8][1] == ["singleton"]
    assert got[1][1] == ["canonical_url_exact", "coordinates_close", "coordinates_consistent", "document_hash_exact", "guide_price_close", "headline_similarity", "normalized_address_exact"]
    keys = listings.cluster_keys(members).collect()
    assert len({k.cluster_id for k in keys}) == 3 and keys == listings.cluster_keys(members).collect()


def test_listing_sources(spark, tmp_path):
    (tmp_path / "feed.csv").write_text('Title, Price ,Location,URL,Lat\n"Land, with plot",£1.2m,"12 High St",http://x.y/a/#z,51.5\nSite,POA,,,bad\n')
    found = listings.from_table(readers.delimited(spark, str(tmp_path / "feed.csv")), "feed").orderBy("source_listing_id").collect()
    assert [(r.source_listing_id, r.price_gbp, r.price_basis, r.listing_type, r.normalized_address, r.lat) for r in found] == [
        ("csv://feed/row-2", None, "PRICE_ON_APPLICATION", "LAND", None, None), ("http://x.y/a", 1_200_000, "UNKNOWN", "LAND", "12 high street", 51.5),
    ]
    page = '<html><head><title>Fallback</title></head><body><h1>Garage court</h1><p>Guide price £90k, auction on 3 May 2024, at 51.5001 , -0.1234</p></body></html>'
    parsed = listings.from_pages(spark.createDataFrame([("http://x.y/p", page)], "url string, html string"))
    row = parsed.first()
    assert (row.headline, row.price_gbp, row.price_basis, row.listing_type, row.status, row.auction_date) == ("Garage court", 90_000, "AUCTION_GUIDE", "GARAGE_COURT", "AUCTION", dt.date(2024, 5, 3))
    fit = listings.source_fit({"types": ["GARAGE_COURT"], "any_text": ["auction", "tender"], "none_text": ["sold"], "required": ["headline"], "bbox": (-0.5, 51.0, 0.2, 52.0)})
    assert parsed.where(fit).count() == 1 and parsed.where(listings.source_fit({"none_text": ["auction"]})).count() == 0


def test_json_sources(spark, tmp_path):
    doc = {"meta": {"coverage": [{"borough_id": "camden", "source_family": "BROWNFIELD", "coverage_status": "COMPLETE"}]}, "sales": [{"ref": "a", "price": 5}, {"ref": "b", "price": 6}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    rows = readers.envelope(spark, str(tmp_path / "d.json"), "sales", "struct<ref:string,price:int>").orderBy("position").collect()
    assert [(r.ref, r.price) for r in rows] == [("a", 5), ("b", 6)] and readers.coverage_rows(spark, str(tmp_path / "d.json")).first().borough_id == "camden"
    known = spark.createDataFrame([("camden",), ("barnet",)], "borough_id string")
    assert readers.coverage_rows(spark, str(tmp_path / "d.json"), known).count() == readers.coverage_rows(spark, str(tmp_path / "d.json")).count()
    with pytest.raises(Exception, match="unknown borough 'camden'"):
        readers.coverage_rows(spark, str(tmp_path / "d.json"), known.where("borough_id = 'barnet'")).count()
    geo = {"features": [{"properties": {"name": "A"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]]]}}, {"properties": {"name": "B"}, "geometry": {"type": "Point", "coordinates": [1, 1]}}]}
    (tmp_path / "g.json").write_text(json.dumps(geo))
    rows = readers.features(spark, str(tmp_path / "g.json"), "name string").orderBy("position").collect()
    assert [(r.name, [len(x) for x in r.shape]) for r in rows] == [("A", [3]), ("B", [1])]
    for i, text in enumerate(('[{"a": "1"}]', '{"items": [{"a": "1"}]}')):
        (tmp_path / f"f{i}.json").write_text(text)
        assert readers.feed(spark, str(tmp_path / f"f{i}.json"), "json").first().row == {"a": "1"}
    sale = readers.sales(spark.createDataFrame([("t1", "2024-01-02", "100000", "F", "nw1 2ab", "12", "High St")], "transaction_id string, date string, price string, duration string, postcode string, paon string, street string")).first()
    assert (sale.transaction_ref, sale.price_gbp, sale.tenure, sale.postcode_district, sale.address_text) == ("t1", 100_000, "FREEHOLD", "NW1", "12, High St, nw1 2ab")


def test_gml_rows_that_hold_a_point(spark, tmp_path):
    (tmp_path / "t.xml").write_text("<all><parcel><id>a</id><pos>0 0 10 0 10 10 0 10</pos></parcel><parcel><id>b</id><pos>20 0 30 0 30 10 20 10</pos></parcel></all>")
    assert [r.id for r in readers.polygons_with_point(spark, str(tmp_path / "t.xml"), "parcel", "pos", 25.0, 5.0).collect()] == ["b"]


def test_spatial_matches(spark):
    own = spark.createDataFrame([("s", ring(0, 0, 10))], f"site_id string, shape {G.SHAPE}")
    others = [("in", ring(5, 5, 10)), ("touch", ring(10, 0, 5)), ("far", ring(100, 0, 5)), ("point", spot(3, 3)), ("near", spot(40, 5)), ("off", spot(80, 5)), ("triangle", [[*spot(0, 0)[0], *spot(10, 0)[0], *spot(0, 10)[0]]])]
    got = planning.spatial_matches(own, spark.createDataFrame(others, f"feature_id string, shape {G.SHAPE}"), 50.0)
    rows = {r.feature_id: (r.link_type, round(r.overlap_sqm, 6), round(r.overlap_pct, 6), r.distance_m) for r in got.collect()}
    assert rows == {
        "in": ("POLYGON_INTERSECTS", 25, 0.25, 0), "touch": ("POLYGON_INTERSECTS", 0, 0, 0), "point": ("POINT_WITHIN_SITE", 0, 0, 0), "near": ("POINT_NEAR_SITE", 0, 0, 30), "triangle": ("POLYGON_INTERSECTS", 50, 0.5, 0),
    }


def test_title_candidates(spark):
    s = spark.createDataFrame([(1, "12 high street camden", None), (2, "flat 3 12 high street camden london", None), (3, None, {"x": 5.0, "y": 5.0}), (4, "7 elm road", None), (5, "1 high road", None), (6, "", None)], "site_id int, address string, spot struct<x:double,y:double>")
    t = spark.createDataFrame([("A", "12 high street camden", ring(0, 0, 10)), ("B", "12 high street", ring(50, 50, 10)), ("C", "flat 11 high road", ring(70, 50, 10)), ("D", "elm", None), ("E", None, ring(90, 90, 5)), ("F", "", None)], f"title_number string, address string, shape {G.SHAPE}")
    got = {(r.site_id, r.title_number): r.score for r in planning.title_candidates(s, t).collect()}
    assert got == {(1, "A"): 0.95, (1, "B"): 0.8, (2, "A"): 0.8, (2, "B"): 0.8, (3, "A"): 1.0, (5, "C"): 0.8, (4, "D"): 0.8}


def test_strings_within_strings(spark):
    chance = random.Random(3)
    word = lambda n: "".join(chance.choice("ab 1é") for _ in range(n))
    parts = [word(chance.randrange(0, 9)) for _ in range(150)] + ["a", "a", "zz", "zzzzz"]
    wholes = [word(chance.randrange(0, 25)) for _ in range(150)] + ["a"]
    want = {(p, w) for p in parts for w in wholes if p and p in w and p != w}
    got = containment.contained(spark.createDataFrame([(x,) for x in [*parts, None]], "part string"), spark.createDataFrame([(x,) for x in [*wholes, None]], "whole string")).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


@pytest.mark.parametrize("decision,status,want", [("Conditional Grant", "x", "APPROVED"), ("Disapproved", None, "APPROVED"), ("REFUSED", None, "REFUSED"), ("", "withdrawn by applicant", "WITHDRAWN"), (None, None, "")])
def test_decisions(spark, decision, status, want):
    assert spark.createDataFrame([(decision, status)], "d string, s string").select(planning.normalized_decision(F.col("d"), F.col("s"))).first()[0] == want


def test_labels_of_duplicates_by_priority(spark):
    base = dict(borough_id="b", units=3, route="FULL", decision="Approved", decision_type="FULL_RESIDENTIAL", status="DONE", use=None, description="three flats", valid_date=DAY, decision_date=days(100))
    rows = [
        base | dict(case_id=1, priority=100, shape=ring(0, 0, 10)), base | dict(case_id=2, priority=50, valid_date=days(45), shape=ring(2, 0, 10)), base | dict(case_id=3, priority=50, valid_date=days(46), shape=ring(0, 0, 10)),
        base | dict(case_id=4, priority=50, shape=ring(40, 0, 10)), base | dict(case_id=5, priority=50, shape=spot(30, 5), description="other"), base | dict(case_id=6, priority=50, shape=spot(500, 5)),
        base | dict(case_id=7, priority=100, decision_date=days(700), shape=ring(0, 100, 10)), base | dict(case_id=8, priority=50, shape=ring(0, 100, 10)), base | dict(case_id=9, priority=100, decision="Refused", shape=ring(900, 0, 10)),
        base | dict(case_id=10, priority=50, route="PRIOR_APPROVAL", shape=ring(0, 0, 10)), base | dict(case_id=11, priority=50, shape=spot(600, 600), description="none alike"),
    ]
    schema = f"case_id int, external_ref string, priority int, borough_id string, units int, route string, decision string, decision_type string, status string, use string, valid_date date, decision_date date, description string, shape {G.SHAPE}"
    names = [x.strip().split()[0] for x in schema.split(", ")]
    df = spark.createDataFrame([tuple((r | dict(external_ref=str(r["case_id"])))[n] for n in names) for r in rows], schema)
    got = {r.case_id: (r.label_class, r.stronger_id) for r in planning.label_cases(df).collect()}
    assert got == {
        1: ("POSITIVE", None), 2: ("EXCLUDED", 1), 3: ("POSITIVE", None), 4: ("POSITIVE", None), 5: ("EXCLUDED", 1), 6: ("EXCLUDED", 1), 7: ("CENSORED", None), 8: ("POSITIVE", None), 9: ("NEGATIVE", None),
        10: ("EXCLUDED", None), 11: ("POSITIVE", None),
    }


def test_bands(spark):
    rows = [("PASS", 0.1, "HIGH", True, "Band B"), ("PASS", 0.9, "LOW", False, "Band D"), ("PASS", 0.7, "MEDIUM", False, "Band A"), ("PASS", 0.55, "LOW", None, "Band B"), ("PASS", 0.4, "LOW", False, "Band C"), ("FAIL", 0.9, "HIGH", True, "Hold"), ("PASS", None, "HIGH", True, "Hold")]
    df = spark.createDataFrame(rows, "e string, p double, q string, m boolean, want string")
    assert df.where(ranking.band(F.col("e"), F.col("p"), F.col("q"), F.col("m")) != F.col("want")).count() == 0


def test_distance_bands_share_their_ends(spark):
    rows = [("s", DAY, float(d), "POSITIVE", True) for d in (0, 50, 250, 500, 501)] + [("s", DAY, 50.0, "NEGATIVE", False)]
    r = features.band_counts(spark.createDataFrame(rows, "site_id string, as_of date, distance_m double, label_class string, same_template boolean")).first()
    assert (r.adjacent_approved_0_50m, r.local_precedent_approved_50_250m, r.local_context_approved_250_500m, r.adjacent_refused_0_50m, r.local_precedent_refused_50_250m, r.same_template_positive_500m) == (2, 2, 2, 1, 1, 4)


def test_snapshot_fills_counts_and_flags(spark):
    spine = spark.createDataFrame([("a", DAY), ("b", DAY)], "site_id string, as_of date")
    one = spark.createDataFrame([("a", DAY, 3, 7)], "site_id string, as_of date, onsite_positive_count int, onsite_max_units_approved int")
    rows = {r.site_id: r for r in features.snapshot(spine, [one]).collect()}
    assert (rows["b"].onsite_positive_count, rows["b"].onsite_max_units_approved, rows["b"].onsite_max_units_approved_missing, rows["a"].onsite_max_units_approved_missing) == (0, None, True, False)


def slow_fit(x, y):
    w, rate = np.zeros(x.shape[1] + 1), 0.18
    for step in range(2400):
        rate = 0.18 * 0.55 ** ((step >= 800) + (step >= 1600))
        g = np.zeros_like(w)
        for row, t in zip(x, y):
            p = 1 / (1 + np.exp(-(w[0] + row @ w[1:])))
            g += (p - t) * np.concatenate([[1], row])
        g /= len(y)
        g[1:] += 0.04 * w[1:]
        w = w - rate * g
    return w


def test_fits_and_cross_validation(spark):
    chance = np.random.default_rng(3)
    x = chance.normal(size=(9, 2))
    y = (x[:, 0] + 0.3 * chance.normal(size=9) > 0).astype(int)
    assert scoring.fit_logistic(x, y) == pytest.approx(slow_fit(x, y))
    rows = spark.createDataFrame([("t", i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))], "template string, case_id int, vector array<double>, label int")
    model = scoring.models(rows).first()
    assert model.weights == pytest.approx(slow_fit(x, y).tolist())
    raw = rows.select(scoring.raw_probability(F.array(*[F.lit(w) for w in model.weights]), F.col("vector")).alias("p")).first().p
    assert raw == pytest.approx(1 / (1 + np.exp(-(model.weights[0] + x[0] @ model.weights[1:]))))
    held = {r.case_id: r.probability for r in scoring.cross_validated(rows).collect()}
    w = slow_fit(np.delete(x, 4, 0), np.delete(y, 4))
    p = 1 / (1 + np.exp(-(w[0] + np.delete(x, 4, 0) @ w[1:])))
    a, b = scoring.fit_platt(p, np.delete(y, 4))
    q = 1 / (1 + np.exp(-(w[0] + x[4] @ w[1:])))
    assert len(held) == 9 and held[4] == pytest.approx(1 / (1 + np.exp(-(a + b * np.log(q / (1 - q))))))
    assert scoring.readiness(rows.withColumn("borough_id", F.lit(None).cast("string"))).first().is_ready == (min(y.sum(), 9 - y.sum()) >= 3)


def test_spec_and_encoding(spark):
    df = spark.createDataFrame([(1.0, "a", True), (None, "b", None), (3.0, None, False)], "n double, c string, b boolean")
    spec = {r.feature: r.asDict() for r in scoring.transform_spec(df, ["n"]).collect()}
    assert spec["n"]["median"] == 2 and spec["n"]["mean"] == 2 and spec["n"]["std"] == pytest.approx(np.std([1, 2, 3])) and spec["n"]["any_missing"]
    names = {r.feature: r.categories for r in scoring.categories(df, ["c"]).collect()}
    vector, base = scoring.encoded(spec, names, ["b"])
    rows = [r.v for r in df.select(vector.alias("v")).collect()]
    assert base == ["n", "n", "c", "c", "b"] and rows[1] == [0.0, 1.0, 0.0, 1.0, 0.0] and rows[2][2:4] == [0.0, 0.0]


def test_comparables_do_not_repeat_over_tiers(spark):
    own = spark.createDataFrame([("s", "b1", "f1", 5, 100.0, "k1", ["x"], DAY, "t")], "site_id string, borough_id string, form string, units int, area double, archetype string, tokens array<string>, as_of date, template string")
    cases = [(i, b, f, 5, a, k, ["x"], d, None, "POSITIVE", r, "t") for i, b, f, a, k, d, r in [(1, "b1", "f1", 100.0, "k1", days(-9), None), (2, "b2", "f1", 100.0, "k1", days(-9), None), (3, "b2", "f2", 0.0, "k1", None, None), (4, "b1", "f1", 1.0, "k9", days(5), None), (5, "b1", "f1", 1.0, "k9", days(-5), "EXCLUDED"), (6, "b3", "f3", 1.0, "k9", days(-5), None)]]
    df = spark.createDataFrame(cases, "case_id int, borough_id string, form string, units int, area double, archetype string, tokens array<string>, decision_date date, valid_date date, label_class string, review_status string, template string")
    got = [(r["rank"], r.tier, r.case_id, round(r.score, 4)) for r in comparables.comparable_members(own, df).orderBy("rank").collect()]
    fresh = 10 * np.exp(-9 / 365.25 / 6)
    assert got == [(1, 0, 1, round(90 + fresh, 4)), (2, 1, 2, round(65 + fresh, 4)), (3, 2, 3, round(20 + 7.5 + 10 + 10 * np.exp(-10 / 6), 4))]
    linked = spark.createDataFrame([("s", 1)], "site_id string, case_id int")
    assert [r.case_id for r in comparables.comparable_members(own, df, linked).orderBy("rank").collect()] == [2, 3]


def test_apportionment(spark):
    rows = [(i, n, u, s) for i, n in enumerate((1, 5, 7, 10, 49)) for u, s in (("1_bed", 0.25), ("2_bed", 0.5), ("3_bed", 0.25))]
    got = {}
    for r in valuation.apportion(spark.createDataFrame(rows, "k int, units int, unit_type string, share double"), ["k"], "units", "share", "unit_type").orderBy("unit_type").collect():
        got.setdefault(r.units, []).append(r.unit_count)
    assert all(sum(v) == n for n, v in got.items()) and got[1] == [0, 1, 0] and got[10] == [3, 5, 2]


def test_kinds_have_the_counts_of_their_rows(spark):
    rows = [(i, u, "resi_1_4_full" if u and u <= 4 else "resi_5_9_full" if u and u <= 9 else "resi_10_49_outline") for i, u in enumerate([*range(1, 50)] * 2 + [None, None])]
    df = spark.createDataFrame(rows, "k int, units int, template string")
    shares = spark.createDataFrame([(t, n, s) for t, mix in valuation.MIXES.items() for n, s in mix.items()], "template string, unit_type string, share double")
    columns = ["k", "units", "template", "unit_type", "unit_count"]
    want = valuation.apportion(df.join(shares, "template"), ["k"], "units", "share", "unit_type").select(*columns)
    kinds = valuation.kind_counts(df)
    got = valuation.of_kind(df, kinds).select(*columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert kinds.count() == 4 * 2 + 5 * 3 + 40 * 3 + 3  # of 1 to 4, 5 to 9 and 10 to 49 units, and of none given


def test_assessment_valuation(spark):
    columns = dict(run_id=1, nsa=500.0, gia=575.0, template="resi_5_9_full", borough_id="camden", units=7, price_low=7000.0, price_mid=8000.0, price_high=9000.0, basis_gbp=500_000.0, second_low=1e6, second_mid=3e6, second_high=4e6, sales_count=6, land_count=3, policy_known=True, is_stable=True, probability=0.5)
    df = spark.createDataFrame([tuple(columns.values()), *[(2, None, *list(columns.values())[2:])]], "run_id int, nsa double, gia double, template string, borough_id string, units int, price_low double, price_mid double, price_high double, basis_gbp double, second_low double, second_mid double, second_high double, sales_count int, land_count int, policy_known boolean, is_stable boolean, probability double")
    rows = {r.run_id: r for r in assessments.valued(df).collect()}
    gdv = 500 * 8000
    subtotal = 575 * 2375 * 1.26 + 575 * (60 + 35)
    land = max(gdv - subtotal * 1.06 - 0.18 * gdv, 0)
    r = rows[1]
    assert r.land_mid == pytest.approx(land) and r.diverges and r.final_mid == pytest.approx((land + 3e6) / 2) and r.valuation_quality == "LOW" and r.valuation_review
    assert r.expected_uplift == pytest.approx(0.5 * ((land + 3e6) / 2 - 500_000)) and r.final_low == min(r.land_low, 1e6)
    assert rows[2].land_mid is None and not rows[2].diverges and rows[2].uplift_mid is None


def test_control(spark):
    log = spark.createDataFrame([("i1", "s1", "OPEN", 1, 1), ("i1", "s1", "RESOLVED", 2, 2), ("i2", "s1", "OPEN", 1, 3), ("i3", "s2", "OPEN", 1, 4), ("i3", "s2", "RESOLVED", 3, 5)], "incident_id string, scope string, status string, changed_at int, change_id int")
    incidents = control.open_incidents(log)
    assert {r.scope: r.open_incidents for r in incidents.collect()} == {"s1": 1}
    runs = spark.createDataFrame([(1, "s1", "OK", True), (2, "s2", "OK", True), (3, "s3", "FAILED", False)], "run_id int, scope string, replay_status string, hash_ok boolean")
    scopes = control.scope_states(spark.createDataFrame([("s1", "VISIBLE", 1, 1), ("s2", "DISABLED", 1, 2), ("s2", "HIDDEN_ONLY", 2, 3)], "scope string, mode string, changed_at int, change_id int"))
    analyst = {r.run_id: (r.codes, r.blocked) for r in control.visibility(runs, scopes, incidents, "ANALYST").collect()}
    assert analyst == {1: (["OUTPUT_BLOCKED", "ROLE_REDACTED"], True), 2: (["HIDDEN_MODE", "ROLE_REDACTED"], True), 3: (["OUTPUT_BLOCKED", "ROLE_REDACTED"], True)}
    admin = {r.run_id: (r.codes, r.blocked) for r in control.visibility(runs, scopes, incidents, "ADMIN", True).collect()}
    assert admin == {1: (["INCIDENT_OPEN"], True), 2: ([], False), 3: (["SCOPE_DISABLED", "REPLAY_FAILED", "HASH_MISMATCH"], True)}
    held = control.ledger_rows(runs.withColumn("probability", F.lit(0.5)), ["run_id", "scope"])
    assert control.append_ledger(held, runs.withColumn("probability", F.lit(0.5)), ["run_id", "scope"]).count() == 3
    assert control.audit_manifest(runs, ["run_id", "scope"]).select("manifest_hash").distinct().count() == 3


def test_state_logs(spark):
    s = spark.createDataFrame([(1, "a", "t", 1, "SUGGESTED", True, False), (2, "a", "t", 2, "SUGGESTED", True, False)], "scenario_id int, site_id string, template string, revision int, status string, is_current boolean, is_stale boolean")
    reviews = spark.createDataFrame([(1, 1, "REJECTED", 1), (1, 2, "CONFIRMED", 2), (2, 3, "CONFIRMED", 1)], "scenario_id int, review_id int, status string, reviewed_at int")
    after = scenarios.superseded(scenarios.state_after(s, reviews))
    assert {r.scenario_id: (r.status, r.is_current) for r in after.collect()} == {1: ("CONFIRMED", False), 2: ("CONFIRMED", True)}
    log = spark.createDataFrame([("t", "x", 1, "ACTIVATE", 1, 1), ("t", "x", 2, "ACTIVATE", 2, 2), ("t", "y", 1, "ACTIVATE", 1, 3), ("t", "y", 1, "RETIRE", 2, 4)], "template string, scope string, release_id int, action string, changed_at int, change_id int")
    assert {r.scope: (r.release_id, r.is_active) for r in readback.release_states(log).collect()} == {"x": (2, True), "y": (1, False)}
    live, held = spark.createDataFrame([(1, "now"), (2, "now")], "id int, v string"), spark.createDataFrame([(1, None)], "id int, v string")
    assert {r.id: r.v for r in readback.snapshot_first(live, held, "id", ["v"]).collect()} == {1: None, 2: "now"}
    assert {r.id for r in readback.changes(live, spark.createDataFrame([(1, "now"), (3, "x")], "id int, v string"), "id").collect()} == {2, 3}


def test_site_build(spark):
    null = None
    schema = f"site_id string, polygon {G.SHAPE}, box {G.SHAPE}, official {G.SHAPE}, titles {G.SHAPE}, spot struct<x:double,y:double>"
    rows = [("a", ring(0, 0, 10), ring(0, 0, 99), null, null, null), ("b", null, null, null, null, {"x": 5.0, "y": 5.0}), ("c", ring(95, 0, 100), null, null, null, null), ("d", null, null, null, null, null)]
    lpas = spark.createDataFrame([("l1", "One", ring(-50, -50, 150, 500)), ("l2", "Two", ring(100, -50, 150, 500))], f"lpa_id string, name string, shape {G.SHAPE}")
    got = {r.site_id: (r.source_type, r.borough_id, r.crossing, r.status) for r in sites.build(spark.createDataFrame(rows, schema), lpas).collect()}
    assert got == {"a": ("SOURCE_POLYGON", "l1", "NONE", "ACTIVE"), "b": ("POINT_ONLY", "l1", "NONE", "INSUFFICIENT_GEOMETRY"), "c": ("SOURCE_POLYGON", None, "MATERIAL", "MANUAL_REVIEW")}
    held = spark.createDataFrame([("a", 1, "old")], "site_id string, revision int, geometry_hash string")
    now = spark.createDataFrame([("a", "new"), ("b", "x")], "site_id string, geometry_hash string")
    again = sites.revisions(now, sites.revisions(now, held))
    assert sorted((r.site_id, r.revision, r.geometry_hash) for r in again.collect()) == [("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x")]


def test_upserts(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("m", 1, "c")], "key string, seq int, v string")
    assert {r.key: r.v for r in latest.last_wins(rows, ["key"], "seq").collect()} == {"k": "b", "m": "c"}
    held = spark.createDataFrame([("p1", "h1")], "path string, h string")
    new = spark.createDataFrame([("p1", "h1"), ("p2", "h2"), ("p2", "h2"), ("p1", "h9")], "path string, h string")
    assert latest.append_unseen(new, held, "h").count() == 3 and latest.conflicts(new, held, "path", "h").collect()[0].path == "p1"
    seen = spark.createDataFrame([("s", "1", 5, "late"), ("s", "1", 2, "early")], "source_id string, source_listing_id string, observed_at int, v string")
    assert listings.merge_observations(seen).first().asDict() == {"source_id": "s", "source_listing_id": "1", "first_seen_at": 2, "last_seen_at": 5, "v": "late"}


def test_streams(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 12, m)
    rows = [("k1", "pull", "FAILED", at(0)), ("k1", "pull", "DONE", at(1)), ("k2", "pull", "DONE", at(2)), ("k3", "push", "DEAD", at(50))]
    schema = "dedupe_key string, job_type string, status string, created_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = jobs.deduplicated(jobs.read(spark, str(tmp_path / "in"), schema))
    writer = jobs.once_per_batch(stream, lambda b: seen.extend(r.dedupe_key for r in b.collect()), str(tmp_path / "cp"), str(tmp_path / "out"))
    jobs.drain(writer)
    assert sorted(seen) == ["k1", "k2", "k3"] and spark.read.parquet(str(tmp_path / "out")).count() == 3
    counted = jobs.failures(jobs.read(spark, str(tmp_path / "in"), schema), at="created_at", late="1 minute")
    query = jobs.drain(counted.writeStream.format("memory").queryName("failed_jobs").outputMode("append"))
    assert query.exception() is None
    assert [(r.job_type, r.job_count, r.failed_count) for r in spark.table("failed_jobs").collect()] == [("pull", 3, 1)]
    last = jobs.last_seen(jobs.read(spark, str(tmp_path / "in"), schema), ["job_type"], "created_at")
    jobs.drain(last.writeStream.format("memory").queryName("sightings").outputMode("complete"))
    assert {r.job_type: r.times_seen for r in spark.table("sightings").collect()} == {"pull": 3, "push": 1}


def test_crawl_and_relink(spark):
    pages = spark.createDataFrame([("s", "http://a/list", '<a href="/lot/2">x</a><a href="/about">y</a><a href="/lot/1#f">z</a><a href="/lot/2/">again</a>')], "source string, url string, html string")
    maps = spark.createDataFrame([("s", "<loc>http://a/lot/9</loc><loc>http://a/lot/1</loc><loc>http://a/lot/8</loc>")], "source string, xml string")
    found = listings.crawl_candidates(pages, maps, r"/lot/\d+$", 3).orderBy("place").collect()
    assert [r.url for r in found] == ["http://a/lot/2", "http://a/lot/1", "http://a/lot/9"]
    own = spark.createDataFrame([("x", "c1", 1), ("y", "c2", 2), ("z", "c3", 9)], "site_id string, cluster_id string, current_listing_id int")
    members = spark.createDataFrame([(1, "c7"), (2, "c2")], "listing_id int, cluster_id string")
    assert {r.site_id: (r.cluster_id, r.moved) for r in listings.relinked(own, members).collect()} == {"x": ("c7", True), "y": ("c2", False), "z": ("c3", False)}
    assert [r.cluster_id for r in listings.obsolete(own, members).orderBy("cluster_id").collect()] == ["c1", "c3"]


def test_schedule(spark):
    from fieldstone.operators import schedule

    t = lambda h: dt.datetime(2024, 1, 1, h)
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    sources = spark.createDataFrame([("a", True, "COMPLIANT_AUTOMATED", 6), ("b", True, "COMPLIANT_AUTOMATED", 2), ("c", True, "COMPLIANT_AUTOMATED", 1), ("d", False, "COMPLIANT_AUTOMATED", 1), ("e", True, "MANUAL_ONLY", 1)], "source_id string, is_active boolean, mode string, interval_hours int")
    runs = spark.createDataFrame([("a", t(8)), ("b", t(1)), ("b", t(9))], "source_id string, created_at timestamp")
    assert sorted(r.source_id for r in schedule.due_sources(sources, runs, now).collect()) == ["b", "c"]
    rows = [(1, "QUEUED", t(11), None, t(1), "x", "k"), (2, "QUEUED", t(13), None, t(1), "x", "m"), (3, "RUNNING", t(9), t(9), t(1), "x", "k"), (4, "RUNNING", t(9), t(12), t(1), "x", "n"), (5, "DEAD", t(1), None, t(1), "x", "k")]
    queue = spark.createDataFrame(rows, "job_id int, status string, next_run_at timestamp, locked_at timestamp, created_at timestamp, job_type string, dedupe_key string")
    assert [r.job_id for r in schedule.claimable(queue, now).collect()] == [3, 1]
    assert sorted(r.job_id for r in schedule.deduplicated(queue).collect()) == [1, 2, 4]
    after = queue.where("job_id <= 2").select("job_id", schedule.after_failure(F.col("job_id") + 1, now).alias("s")).orderBy("job_id").collect()
    assert [r.s.status for r in after] == ["QUEUED", "DEAD"] and after[1].s.next_run_at is None


def test_site_candidates_of_clusters(spark):
    rows = [("c1", "1", 5, 0.9, "LAND", "LIVE", 51.0, 0.1, None), ("c1", "2", 6, 0.9, "LAND", "SOLD_STC", 51.0, 0.1, None), ("c2", "3", 5, 0.9, "LAND", "AUCTION", None, None, "x road"), ("c3", "4", 5, 1.0, "GARAGE_COURT", "LIVE", 51.0, 0.1, None), ("c4", "5", 5, 1.0, "LAND", "LIVE", 51.0, None, None)]
    df = spark.createDataFrame(rows, "cluster_root string, id string, last_seen_at int, confidence double, listing_type string, status string, lat double, lon double, normalized_address string")
    assert [r.cluster_root for r in listings.build_candidates(df).collect()] == ["c2"]


def test_citations(spark):
    kind = "array<struct<label:string,source_family:string,effective_date:date,url:string>>"
    for value, want in (([("a", "b", DAY, "u")], True), ([("a", "b", DAY, "u"), ("a", "b", None, "u")], False), ([("", "b", DAY, "u")], False), ([], False), (None, False)):
        assert spark.createDataFrame([(value,)], f"c {kind}").select(scenarios.citations_complete(F.col("c"))).first()[0] == want


def test_gold_set_and_stale_marks(spark):
    labels = spark.createDataFrame([(1, "PENDING", "t", DAY, None, None), (2, "PENDING", "t", None, DAY, None), (3, "CONFIRMED", "u", DAY, DAY, None)], "case_id int, review_status string, template string, valid_date date, first_decision_date date, notes string")
    assert [r.case_id for r in readback.gold_set(labels).collect()] == [3, 1, 2] and [r.case_id for r in readback.gold_set(labels, "PENDING").collect()] == [1, 2]
    done = readback.reviewed(labels, spark.createDataFrame([(1, 1, "EXCLUDED", "old", 1), (1, 2, "CONFIRMED", "new", 2)], "case_id int, review_id int, review_status string, notes string, reviewed_at int"))
    assert {r.case_id: (r.review_status, r.notes) for r in done.collect()} == {1: ("CONFIRMED", "new"), 2: ("PENDING", None), 3: ("CONFIRMED", None)}
    s = spark.createDataFrame([(1, "a", "b1", "t", "g1", "r1", False), (2, "b", "b2", "t", "g1", "r1", False)], "scenario_id int, site_id string, borough_id string, template string, geometry_hash string, rulepack_hash string, is_stale boolean")
    moved = scenarios.stale_for_geometry(s, spark.createDataFrame([("a", "g2"), ("b", "g1")], "site_id string, geometry_hash string"))
    assert {r.scenario_id: r.is_stale for r in moved.collect()} == {1: True, 2: False}
    ruled = scenarios.stale_for_rulepacks(s, spark.createDataFrame([("b2", "t", "r2")], "borough_id string, template string, rulepack_hash string"))
    assert {r.scenario_id: r.is_stale for r in ruled.collect()} == {1: False, 2: True}


def test_permissions(spark):
    rows = [("FULL", "FULL_RESIDENTIAL", "ACTIVE", "C3", None, None, True), ("FULL", "FULL_RESIDENTIAL", "ACTIVE", "C3", days(-1), None, False), ("FULL", "COMMERCIAL", "ACTIVE", "C3", None, None, False), ("FULL", "FULL_RESIDENTIAL", "APPROVED", "resi", days(0), True, True), (None, None, None, None, None, None, False), ("FULL", "FULL_RESIDENTIAL", "ACTIVE", "C3", None, False, False)]
    df = spark.createDataFrame(rows, "r string, d string, s string, u string, x date, a boolean, want boolean")
    assert df.where(planning.active_permission(*(F.col(c) for c in "rdsuxa"), F.lit(DAY)) != F.col("want")).count() == 0
    brown = spark.createDataFrame([("PART_1", "ACTIVE", "ACTIVE", None, False), ("PART_2", "ACTIVE", None, None, True), ("PART_2", None, "active", days(1), True), ("PART_2", "ACTIVE", None, days(-1), False), ("PART_2", None, None, None, False)], "p string, i string, t string, e date, want boolean")
    assert brown.where(planning.active_brownfield(F.col("p"), F.col("i"), F.col("t"), F.lit(None).cast("date"), F.col("e"), F.lit(DAY)) != F.col("want")).count() == 0
    over = spark.createDataFrame([(0.1, 1.0, True), (0.05, 100.0, True), (0.05, 99.0, False), (None, None, False)], "p double, s double, want boolean")
    assert over.where(planning.material_overlap(F.col("p"), F.col("s"), F.lit(None).cast("boolean"), F.lit(False)) != F.col("want")).count() == 0


def test_running_sums_and_percentiles_by_ranges(spark, monkeypatch):
    chance = np.random.default_rng(3)
    values = [(int(v), int(w)) for v, w in zip(chance.integers(0, 400, 3000), chance.integers(0, 9, 3000))]
    df = spark.createDataFrame([(i, v, w) for i, (v, w) in enumerate(values)], "id int, v int, w int").repartition(6)
    few = {r.id: r.s for r in ranges.running(df, [F.col("v"), F.col("id")], {"s": F.col("w")}, 3000).collect()}
    middle = scoring.nearest_rank(df, "v", 0.5).first().percentile
    monkeypatch.setattr(ranges, "FEW_ROWS", 5)
    assert {r.id: r.s for r in ranges.running(df, [F.col("v"), F.col("id")], {"s": F.col("w")}, 3000).collect()} == few
    order, total = sorted(range(3000), key=lambda i: (values[i][0], i)), 0
    for i in order:
        assert few[i] == total
        total += values[i][1]
    assert scoring.nearest_rank(df, "v", 0.5).first().percentile == middle == sorted(v for v, _ in values)[round(2999 * 0.5)]
    assert scoring.nearest_rank(df.where("false"), "v", 0.5).first().percentile is None


@pytest.mark.parametrize("n", [1, 40, 900])
def test_nearest_distance_is_exact(spark, n):
    chance = np.random.default_rng(n)
    x = np.round(chance.normal(size=(n, 5)) + 3 * chance.integers(0, 4, (n, 1)), 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vector array<double>")
    got = {r.id: r.nearest_distance for r in scoring.nearest_distance(df, df, size=40).collect()}
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) + np.where(np.eye(n) > 0, np.inf, 0)
    assert got == pytest.approx({i: gap[i].min() for i in range(n) if np.isfinite(gap[i].min())})
    assert scoring.nearest_distance(df, df.where("false")).count() == 0


def test_cases_of_any_priority_are_labelled(spark):
    base = dict(external_ref="x", borough_id="b", units=3, route="FULL", decision="Approved", decision_type="RESIDENTIAL", status="x", use=None, valid_date=DAY, decision_date=days(9), description="homes", shape=None)
    rows = [base | dict(case_id=i, priority=None if i % 80 == 0 else i % 80, units=i % 4 + 1, description=f"homes {i}") for i in range(160)]
    schema = f"case_id int, external_ref string, priority int, borough_id string, units int, route string, decision string, decision_type string, status string, use string, valid_date date, decision_date date, description string, shape {G.SHAPE}"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ", 13)) for r in rows if r["priority"] in (None, 1, 70, 71)], schema)
    assert {r.case_id: r.label_class for r in planning.label_cases(df).collect()} == dict.fromkeys((0, 80, 1, 81, 70, 150, 71, 151), "POSITIVE")


def test_counted_vectors_fit_like_repeated_ones():
    chance = np.random.default_rng(5)
    x, y, n = chance.normal(size=(12, 2)), chance.integers(0, 2, 12).astype(float), chance.integers(1, 4, 12)
    w = scoring.fit_logistic(x, y, n[:, None].astype(float))[:, 0]
    assert w == pytest.approx(scoring.fit_logistic(np.repeat(x, n, axis=0), np.repeat(y, n)), abs=1e-9)
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert scoring.fit_platt(p, y, n[:, None].astype(float))[:, 0] == pytest.approx(scoring.fit_platt(np.repeat(p, n), np.repeat(y, n)), abs=1e-9)


def optimum(x, y, l2, start, n=None):
    """Newton's method on all rows, by the book."""
    one, w, n = np.column_stack([np.ones(len(x)), x]), np.array(start, float), np.ones(len(y)) if n is None else n
    shrink = np.append(0.0, np.full(len(w) - 1, l2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-one @ w))
        w = w - np.linalg.solve((one * (n * p * (1 - p))[:, None]).T @ one / n.sum() + np.diag(shrink), one.T @ (n * (p - y)) / n.sum() + shrink * w)
    return w


def logit(p):
    q = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def test_refits_of_large_templates_leave_each_case_out(spark, monkeypatch):
    """300 and 240 cases, many equal, in blocks of few rows and models: each probability is that of a plain refit without the case."""
    monkeypatch.setattr(refits, "ROW_BLOCK", 90)
    monkeypatch.setattr(refits, "MODEL_BLOCK", 50)
    chance, rows, want = np.random.default_rng(8), [], {}
    for template, size, places in (("t", 300, 2), ("u", 240, 5)):
        x = np.round(chance.normal(size=(size, places)), 1)
        x[-40:] = x[:40]
        y = (x[:, 0] - 0.3 * x[:, 1] + chance.normal(size=size) > 0).astype(int)
        rows += [(template, i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
        for i in range(0, size, 9):
            a, b = np.delete(x, i, 0), np.delete(y, i)
            w = optimum(a, b, 0.04, np.zeros(places + 1))
            platt = optimum(logit(1 / (1 + np.exp(-(w[0] + a @ w[1:]))))[:, None], b, 0.02, [0.0, 1.0])
            want[template, i] = 1 / (1 + np.exp(-(platt[0] + platt[1] * logit(1 / (1 + np.exp(-(w[0] + x[i] @ w[1:])))))))
            if i == 9:  # the schedule gets there too, at this size
                assert scoring.fit_logistic(a, b) == pytest.approx(w, abs=1e-6)
    df = spark.createDataFrame([*rows, ("few", 1, [0.0], 1), ("few", 2, [1.0], 0), ("few", 3, [2.0], 0)], "template string, case_id int, vector array<double>, label int")
    got = {(r.template, r.case_id): r.probability for r in scoring.cross_validated(df).collect()}
    assert len(got) == 543 and {k: got[k] for k in want} == pytest.approx(want, abs=1e-9)


def test_whole_fits_of_large_templates(spark, monkeypatch):
    monkeypatch.setattr(scoring, "MOST_VECTORS", 100)
    chance = np.random.default_rng(4)
    x = chance.normal(size=(500, 3))
    y = (x[:, 0] + chance.normal(size=500) > 0.8).astype(int)
    df = spark.createDataFrame([("big" if i < 450 else "small", v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "template string, vector array<double>, label int")
    got = {r.template: r for r in scoring.models(df).collect()}
    w = optimum(x[:450], y[:450], 0.04, np.zeros(4))
    assert got["big"].weights == pytest.approx(w, abs=1e-9) and got["big"].n == 450
    assert got["big"].platt == pytest.approx(optimum((w[0] + x[:450] @ w[1:])[:, None], y[:450], 0.02, [0.0, 1.0]), abs=1e-9)
    assert got["big"].weights == pytest.approx(scoring.fit_logistic(x[:450], y[:450]), abs=1e-6) and got["small"].weights == pytest.approx(scoring.fit_logistic(x[450:], y[450:]), abs=1e-12)


def test_large_templates_of_one_class_have_no_refits(spark):
    rows = [("t", i, [float(i % 7)], int(i == 0)) for i in range(230)]
    got = {r.case_id: r.probability for r in scoring.cross_validated(spark.createDataFrame(rows, "template string, case_id int, vector array<double>, label int")).collect()}
    assert got[0] is None and all(0 < got[i] < 1 for i in range(1, 230))


def test_alike_listings_make_a_star(spark):
    same = ("1 high street", ["land", "plot"], 100.0, None, None)
    rows = [(i, f"u{i}", [], *same) for i in range(30)] + [(90, "v", [], "1 high street", ["plot", "land"], 101.0, None, None), (91, "w", [], "1 high street", [], None, None, None), (92, "x", [], "1 high street", [], None, None, None)]
    df = spark.createDataFrame(rows, "id int, url string, hashes array<string>, address string, words array<string>, price double, lat double, lon double")
    edges = resolution.links(df)
    assert {(r.left_id, r.right_id) for r in edges.collect()} >= {(0, i) for i in range(1, 30)} and edges.count() < 60
    assert {r.id: r.cluster_root for r in listings.clusters(df, edges).collect()} == dict.fromkeys([*range(30), 90], 0) | {91: 91, 92: 92}


def test_entry_without_what_the_corpus_operators_need():
    code = "import sys, re; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; names = e.queries(); assert len(names) > 60 and not any(re.match(r'op[0-9]+_|pipeline', n) for n in names); assert e.oracle_sql().keys() <= names.keys()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0


def test_rows_of_one_shape_are_measured_once(spark):
    own = spark.createDataFrame([(i, ring(0, 0, 10)) for i in range(30)], f"site_id int, shape {G.SHAPE}")
    features_ = spark.createDataFrame([(i, ring(5, 5, 10) if i % 2 else spot(40, 5)) for i in range(40)], f"feature_id int, shape {G.SHAPE}")
    found = G.near_shapes(own, features_, 50.0)
    assert found.count() == 2
    assert G.with_ids(found.select(*G.MARKS), own, features_, "site_id", "feature_id").distinct().count() == 30 * 40
    rows = planning.spatial_matches(own, features_, 50.0).collect()
    assert len(rows) == 30 * 40 and {(r.feature_id % 2, r.overlap_sqm, r.distance_m) for r in rows} == {(1, 25.0, 0.0), (0, 0.0, 30.0)}


def test_nearby_history_counts_cases_and_takes_linked_ones_off(spark):
    sites = spark.createDataFrame([(i, ring(0, 0, 10), DAY, "t" if i else None) for i in range(3)], f"site_id int, shape {G.SHAPE}, as_of date, template string")
    cases = spark.createDataFrame([(i, spot(40, 5), "POSITIVE" if i % 2 else "NEGATIVE", "t", days(-1)) for i in range(6)] + [(9, spot(40, 5), "POSITIVE", "t", days(1))], f"case_id int, shape {G.SHAPE}, label_class string, template string, decision_date date")
    linked = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (1, 9), *((2, i) for i in range(6))], "site_id int, case_id int")
    got = {r.site_id: (r.adjacent_approved_0_50m, r.adjacent_refused_0_50m, r.same_template_positive_500m) for r in features.nearby_history(sites, cases, linked).collect()}
    assert got == {0: (3, 3, 0), 1: (2, 2, 2)}


def test_sites_of_one_description_are_compared_once(spark):
    sites = spark.createDataFrame([(i, "b" if i < 8 else None, "f", 5, 100.0, "k", ["x"], DAY, "t") for i in range(10)], "site_id int, borough_id string, form string, units int, area double, archetype string, tokens array<string>, as_of date, template string")
    cases = spark.createDataFrame([(i, "b" if i % 2 else "c", "f", 5, 100.0, "k", ["x"], days(-i), None, "POSITIVE" if i < 12 else "NEGATIVE", None, "t") for i in range(14)], "case_id int, borough_id string, form string, units int, area double, archetype string, tokens array<string>, decision_date date, valid_date date, label_class string, review_status string, template string")
    linked = spark.createDataFrame([(0, 1), (0, 3)], "site_id int, case_id int")
    got = {}
    for r in comparables.comparable_members(sites, cases, linked).orderBy("site_id", "outcome", "rank").collect():
        got.setdefault((r.site_id, r.outcome), []).append((r.tier, r.case_id))
    assert got[0, "POSITIVE"] == [(0, 5), (0, 7), (0, 9)] and got[9, "POSITIVE"] == [(1, 0), (1, 1), (1, 2)]
    assert all(got[i, "POSITIVE"] == [(0, 1), (0, 3), (0, 5)] and got[i, "NEGATIVE"] == [(0, 13), (1, 12)] for i in range(1, 8)) and len(got) == 20
    met = comparables.descriptions(sites).distinct().count()
    assert met == 2


def test_probes_come_in_bounded_tables(spark, monkeypatch):
    monkeypatch.setattr(scoring, "PROBES", 25)
    rows = np.random.default_rng(4).normal(size=(120, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id int, vector array<double>")
    gaps = np.linalg.norm(rows[:, None] - rows[None], axis=2) + np.where(np.eye(120), np.inf, 0)
    got = {r.id: r.nearest_distance for r in scoring.nearest_distance(df, df, size=10).collect()}
    assert len(got) == 120 and all(abs(got[i] - gaps[i].min()) < 1e-9 for i in got)


def test_vectors_travel_once_a_block(spark, monkeypatch):
    chance = np.random.default_rng(8)
    x = chance.normal(size=(300, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vector array<double>")
    counts, one = {}, scoring.written

    def counted(of, label):
        out = one(of, label)
        counts[label] = max(counts.get(label, 0), out.count())
        return out

    monkeypatch.setattr(scoring, "written", counted)
    got = {r.id: r.nearest_distance for r in scoring.nearest_distance(df, df, size=10).collect()}
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) + np.diag([np.inf] * 300)
    assert got == pytest.approx({i: gaps[i].min() for i in range(300)}, rel=1e-12)
    assert max(counts.values()) <= 300  # there were thousands, a row for each list that a vector looks into


@pytest.mark.parametrize("offset", [0.0, 1e7])
def test_nearest_distance_in_many_blocks(spark, monkeypatch, offset):
    for name, value in (("BLOCK_VALUES", 160), ("LEAST_BLOCK", 1), ("TILE_ROWS", 7), ("TILE", 5), ("EXACT", 3), ("PROBES", 50)):
        monkeypatch.setattr(scoring, name, value)
    chance = np.random.default_rng(9)
    x = offset + chance.integers(-2, 3, (200, 4)) * np.where(chance.random((200, 4)) < 0.5, 1.0, 1e-3)
    x[150:] = x[chance.integers(0, 4, 50)]  # copies, and many of few
    ids = [f"i{i if i % 11 else i - 1}" for i in range(200)]  # some ids have two vectors
    odd = [("o1", None), ("o2", [float("nan"), 0.0, 0.0, 0.0]), ("o3", [None, 0.0, 0.0, 0.0]), ("o4", [float("inf"), 0.0, 0.0, 0.0])]
    schema = "id string, vector array<double>"
    every = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + odd, schema)
    some = spark.createDataFrame([(i, v.tolist()) for i, v in list(zip(ids, x, strict=True))[::3]] + odd, schema)

    def brute(rows, training):
        best = {}
        for i in rows:
            gaps = [np.sqrt(((x[i] - x[j]) ** 2).sum()) for j in training if ids[j] != ids[i]]
            best[ids[i]] = min(gaps + [best.get(ids[i], np.inf)])
        return best

    for a, b, want in ((every, every, brute(range(200), range(200))), (every, some, brute(range(200), range(0, 200, 3))), (some, every, brute(range(0, 200, 3), range(200)))):
        assert {r.id: r.nearest_distance for r in scoring.nearest_distance(a, b, size=15).collect()} == want
    alone = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [5.0, 2.0])], schema)
    assert scoring.nearest_distance(alone, alone).count() == 0


def test_titles_of_rows_alike_are_found_once(spark):
    s = spark.createDataFrame([(i, "1 high road", None) for i in range(20)] + [(99, None, {"x": 5.0, "y": 5.0}), (99, "1 high road", None)], "site_id int, address string, spot struct<x:double,y:double>")
    t = spark.createDataFrame([(i, "1 high road", ring(0, 0, 10)) for i in range(30)] + [(77, "flat 1 high road", None)], f"title_number int, address string, shape {G.SHAPE}")
    different, ids = planning.kinds(s, "site_id")
    assert different.count() == 2 and ids.count() == 22
    got = {(r.site_id, r.title_number): r.score for r in planning.title_candidates(s, t).collect()}
    assert got == {(i, j): 0.95 for i in range(20) for j in range(30)} | {(99, j): 1.0 for j in range(30)} | {(i, 77): 0.8 for i in (*range(20), 99)}
    assert planning.title_candidates(s, t).count() == len(got)


def test_titles_come_in_blocks_on_all_cores(spark, monkeypatch):
    monkeypatch.setattr(kinds, "BLOCK", 4)
    monkeypatch.setattr(kinds, "AT_ONCE", 2)
    s = spark.createDataFrame([(i, f"{i % 2 + 1} high road", None) for i in range(50)], "site_id int, address string, spot struct<x:double,y:double>")
    t = spark.createDataFrame([(i, f"{i % 3 + 1} high road", ring(0, 0, 10)) for i in range(60)], f"title_number int, address string, shape {G.SHAPE}")
    want = sorted((i, j, 0.95) for i in range(50) for j in range(60) if i % 2 == j % 3)
    found = planning.title_candidates(s, t)
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "slice(" in plan and "HashAggregate" not in plan
    # ids with several rows: the best score of each pair, and each pair once
    twice = s.unionByName(s.where("site_id < 9").withColumn("address", F.lit(None).cast("string")).withColumn("spot", F.expr("named_struct('x', 5d, 'y', 5d)")))
    best = {(i, j): 0.95 for i, j, _ in want} | {(i, j): 1.0 for i in range(9) for j in range(60)}
    assert sorted(map(tuple, planning.title_candidates(twice, t).collect())) == sorted((*k, v) for k, v in best.items())
