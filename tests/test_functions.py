import datetime
import decimal
import hashlib
import json
import math
import random
import time
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldstone.functions import geo as G
from fieldstone.functions import html as H
from fieldstone.functions import markup
from fieldstone.functions import numeric as N
from fieldstone.functions import shapes
from fieldstone.functions import text as T
from fieldstone.functions.shapes import dissolve, overlaps
from fieldstone.operators import listings, planning


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize("text,want", [("£1.5 million", 2), ("£1.5million", 1_500_000), ("Guide £ 450,000", 450_000), ("£2.5k", 2_500), ("£0.5", 0), ("£1.5", 2), ("£2.5", 2), ("no price", None), (None, None), ("£750K plus", 750_000)])
def test_price(spark, text, want):
    assert one(spark, text, T.parse_price) == want


@pytest.mark.parametrize("text,want", [("on 12 June 2026", datetime.date(2026, 6, 12)), ("31 Feb 2024", None), ("1 Sept 2020", datetime.date(2020, 9, 1)), ("12 Foo 2020", None), ("", None), (None, None)])
def test_date(spark, text, want):
    assert one(spark, text, T.parse_date) == want


@pytest.mark.parametrize("text,want", [("Guide Price at auction", "AUCTION_GUIDE"), ("guide price", "GUIDE_PRICE"), ("Spoa resort", "PRICE_ON_APPLICATION"), ("offers over", "OFFERS_OVER"), (None, "UNKNOWN")])
def test_price_basis(spark, text, want):
    assert one(spark, text, T.price_basis) == want


@pytest.mark.parametrize("text,want", [("12 High St, Camden Rd", "12 high street camden road"), ("St John St", "street john street"), ("  ", None), (None, None)])
def test_address(spark, text, want):
    assert one(spark, text, T.normalize_address) == want


@pytest.mark.parametrize("url,want", [("http://a.b/c/#x", "http://a.b/c"), ("http://a.b/", "http://a.b/"), ("http://a.b", "http://a.b"), ("http://a.b/c//", "http://a.b/c"), (None, None)])
def test_url(spark, url, want):
    assert one(spark, url, T.normalize_url) == want


def test_canonical_json_is_that_of_sorted_compact_dumps(spark):
    day, moment = datetime.date(2024, 2, 29), datetime.datetime(2024, 2, 29, 13, 5, 7, 120)
    rows = [
        (1, "plain", 0.1, True, {"b": 1, "a": None}, [3, None], ("x", 1e16, decimal.Decimal("12.50")), day, moment),
        (2, 'q"uo\\te\n\t\x01\x7f é😀', 1e-5, False, {"é": 2, "z": 3, "A": 4}, [], ("", -0.0, None), None, datetime.datetime(2024, 1, 1)),
        (2**60 + 1, None, 123456789.123, None, {}, None, None, day, None), (4, "", 1e22, None, None, [0], ("y", 5.684341886080802e-14, decimal.Decimal("-1.00")), None, None),
    ]
    schema = "z long, b string, f double, t boolean, m map<string,int>, a array<int>, s struct<s2:string,s1:double,s0:decimal(9,2)>, d date, w timestamp_ntz"
    df = spark.createDataFrame(rows, schema)
    names = ["w", "z", "b", "f", "t", "m", "a", "s", "d"]
    got = {r.z: r for r in df.select("z", T.canonical_json(df, *names).alias("text"), T.content_hash(df, *reversed(names)).alias("hash")).collect()}
    for z, b, f, t, m, a, st, d, w in rows:
        payload = {"z": z, "b": b, "f": f, "t": t, "m": m, "a": a, "s": st and dict(zip(("s2", "s1", "s0"), st, strict=True)), "d": d, "w": w}
        want = json.dumps(payload, sort_keys=True, separators=(",", ":"), default=str)
        assert got[z].text == want and got[z].hash == hashlib.sha256(want.encode()).hexdigest()


def test_ids_and_hashes(spark):
    assert one(spark, "listing-1", lambda c: T.uuid5(uuid.NAMESPACE_URL.hex, c)) == str(uuid.uuid5(uuid.NAMESPACE_URL, "listing-1"))
    df = spark.createDataFrame([(None,)], "v string")
    assert df.select(T.content_hash(df, "v").alias("x")).first().x == hashlib.sha256(b'{"v":null}').hexdigest()
    path = one(spark, "a b/c" + "x" * 100, lambda c: T.storage_path(F.lit("My Source"), F.lit("id1"), c))
    assert path.startswith("my-source/id1/a-b-c") and len(path.split("/")[-1]) == 64


def test_text_sets(spark):
    assert one(spark, "The erection of 3 units, of THREE flats", T.signature) == ["3", "erection", "flats", "three"]
    for left, right, want in ((["a", "b"], ["b", "c"], 1 / 3), ([], ["a"], 0.0), (None, ["a"], 0.0)):
        assert spark.createDataFrame([(left, right)], "l array<string>, r array<string>").select(T.jaccard(F.col("l"), F.col("r"))).first()[0] == want
    assert [one(spark, v, T.yes) for v in (None, "", "false", "0", "true", "1", "x")] == [False] * 4 + [True] * 3
    assert one(spark, "near 51.5012, -0.1419 today", T.coordinates).asDict() == {"lat": 51.5012, "lon": -0.1419}


def test_numbers(spark):
    assert one(spark, 0.0, lambda c: N.haversine_m(F.lit(51.5), c, F.lit(51.5), c + 0.001), "double") == pytest.approx(6_371_000 * math.radians(0.001) * math.cos(math.radians(51.5)), rel=1e-6)
    assert [one(spark, p, N.display_probability, "double") for p in (0.0, 0.024, 0.025, 0.975, 1.0)] == ["0%", "0%", "5%", "100%", "100%"]
    assert [one(spark, p, N.calibration_band, "double") for p in (0.025, 0.075, 0.5)] == [0, 10, 50]
    assert [one(spark, x, N.sigmoid, "double") for x in (-800.0, 0.0, 800.0)] == [0.0, 0.5, 1.0]
    assert one(spark, 0.0, lambda c: N.or_default(c, 0.5), "double") == 0.5
    assert [one(spark, -2.345, lambda c: N.round_half_up(c, 2), "double"), one(spark, 2.5, lambda c: N.round_half_up(c, 0), "double")] == [-2.35, 3.0]
    assert one(spark, {"a": 1.0, "b": 3.0, "c": -2.0}, N.normalized_mix, "map<string,double>") == {"a": 0.25, "b": 0.75, "c": 0.0}
    pair = spark.createDataFrame([(95.0, 100.0), (94.0, 100.0), (0.0, 0.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in pair.select(N.prices_close(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]
    assert one(spark, datetime.date(2024, 8, 31), lambda c: N.add_months(c, 18), "date") == datetime.date(2026, 2, 28)
    assert one(spark, datetime.date(2026, 4, 15), lambda c: N.comp_window_start(c, 30), "date") == datetime.date(2024, 4, 1)


PAGE = """<html><head><title>T &amp; x</title><meta property="og:title" content="Big  plot"><script>var a = "<p>no</p>";</script>
<script type="application/ld+json">{"name": "From LD", "geo": {"latitude": 51.5, "longitude": -0.1}}</script></head>
<body><h1>Head <b>line</b></h1><p>Land at 51.5012, -0.1419 for &pound;450,000</p><a href="/docs/site-plan.pdf">click here</a> <a href="docs/b.pdf#p2">Sales brochure</a> <a href='b.html'>x</a> <a href="/docs/site-plan.pdf">The plan</a></body></html>"""


def test_html(spark):
    assert one(spark, PAGE, H.headline) == "Big plot" and one(spark, PAGE, lambda c: H.element_text(c, "h1")) == "Head line"
    assert "no" not in one(spark, PAGE, H.text_content).split() and "£450,000" in one(spark, PAGE, H.text_content)
    pages = spark.createDataFrame([("http://x.y/lots/1", PAGE)], "url string, html string")
    assert [r.target for r in H.links(pages).orderBy("position").collect()] == ["http://x.y/docs/site-plan.pdf", "http://x.y/lots/docs/b.pdf", "http://x.y/lots/b.html", "http://x.y/docs/site-plan.pdf"]
    assert {(r.target.split("/")[-1], r.label, r.kind) for r in H.document_links(pages).collect()} == {("site-plan.pdf", "click here", "BROCHURE"), ("b.pdf", "Sales brochure", "BROCHURE")}
    assert one(spark, "<urlset><url><loc> http://a/1 </loc></url><url><loc>http://a/2?x=1&amp;y=2</loc></url></urlset>", H.sitemap_urls) == ["http://a/1", "http://a/2?x=1&y=2"]


def test_document_links_by_target_or_label(spark):
    a = lambda href, label: f'<a href="{href}">{label}</a>'
    html = a("x.pdf", "") + a("x.pdf", "Details") + a("x.pdf", "Floor plan") + a("get?id=1", "Brochure (.PDF)") + a("pdf.php?3", "View") + a("common_conditions.pdf", "C") + a("y.pdf", "Terms_and_conditions") + a("about", "About")
    rows = H.document_links(spark.createDataFrame([("http://a/b", html)], "url string, html string")).orderBy("position").collect()
    assert [(r.target, r.label, r.kind) for r in rows] == [("http://a/x.pdf", "Floor plan", "MAP"), ("http://a/get?id=1", "Brochure (.PDF)", "BROCHURE"), ("http://a/pdf.php?3", "View", "BROCHURE")]


def test_places_and_records_of_pages(spark):
    for html, want in (('x "long_lat":"{\\"lat\\":51.5,\\"lng\\":-0.12}"', (51.5, -0.12)), ("<i data-lat='51.25' data-lon='0.5'>", (51.25, 0.5)), ("near 51.501, -0.125 and", (51.501, -0.125)), ("nowhere", None)):
        found = one(spark, html, H.place)
        assert (found and (found.lat, found.lon)) == want
    ld = '<script type="application/ld+json">{"a": 1}</script><script type="application/ld+json">[{"name": " X "}, 3, {"name": "Y"}]</script><script type="application/ld+json">{bad</script>'
    assert len(one(spark, ld, H.json_ld)) == 3 and one(spark, ld, lambda c: H.first_field(H.json_ld(c), "$.name")) == "X" and one(spark, "<p>", H.json_ld) == []
    assert one(spark, "<h1>EPC rating</h1><h1>Land</h1>", H.headline) == "Land"


def ring(*corners):
    return [{"x": float(x), "y": float(y)} for x, y in corners]


def ring_row(spark, corners, column):
    return one(spark, [corners], column, G.SHAPE)


def test_measures(spark):
    square = ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))
    assert ring_row(spark, square, G.area) == 100 and ring_row(spark, square[::-1], G.area) == 100 and ring_row(spark, square, G.perimeter) == 40
    assert ring_row(spark, square, G.compactness) == pytest.approx(math.pi / 4) and ring_row(spark, ring((1, 1)), G.area) == 0
    assert ring_row(spark, square, G.geometry_hash) == ring_row(spark, square[2:-1][::-1] + square[:2][::-1], G.geometry_hash)
    for p, inside, distance in (((5, 5), True, 0), ((15, 5), False, 5), ((13, 14), False, 5), ((-3, 5), False, 3)):
        at = G.point(F.lit(p[0]), F.lit(p[1]))
        assert ring_row(spark, square, lambda r: G.contains(r, at)) == inside and ring_row(spark, square, lambda r: G.distance_to(r, at)) == pytest.approx(distance)
    assert one(spark, "POLYGON ((0 0, 10 0, 10 10, 0 0))", lambda c: G.area(G.shape_from_wkt(c))) == 50 and one(spark, "LINESTRING (0 0, 1 1)", G.shape_from_wkt) is None
    assert one(spark, '{"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 0]]]}', lambda c: G.area(G.shape_from_geojson(c))) == 8


def test_overlap_of_simple_polygons():
    chance = random.Random(4)

    def star(cx, cy):
        """A simple polygon that need not be convex."""
        return ring(*((cx + chance.uniform(2, 9) * math.cos(a), cy + chance.uniform(2, 9) * math.sin(a)) for a in (2 * math.pi * i / 9 for i in range(9))))

    def inside(corners, x, y):
        hit = np.zeros(x.shape, bool)
        for a, b in zip(corners, corners[1:] + corners[:1]):
            cross = (a["y"] > y) != (b["y"] > y)
            if a["y"] != b["y"]:
                hit ^= cross & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])
        return hit

    step = 0.02
    x, y = np.meshgrid(np.arange(-10, 20, step), np.arange(-10, 20, step))
    shared = lambda a, b: overlaps([G.corners([a])], [G.corners([b])])[0]
    for _ in range(12):
        a, b = star(0, 0), star(chance.uniform(-6, 6), chance.uniform(-6, 6))
        assert shared(a, b) == pytest.approx((inside(a, x, y) & inside(b, x, y)).sum() * step**2, abs=0.4)
    square = ring((0, 0), (10, 0), (10, 10), (0, 10))
    assert shared(square, ring((5, 5), (15, 5), (15, 15), (5, 15))) == pytest.approx(25) and shared(square, ring((10, 0), (20, 0), (20, 9))) == 0


def test_shapes_of_several_rings(spark):
    """Parts and holes from text: nothing of them is lost."""
    wkt = ["POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))", "MULTIPOLYGON (((0 0, 0 10, 10 10, 10 0, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2)), ((20 0, 30 0, 30 10, 20 0)))",
           "GEOMETRYCOLLECTION (POINT (1 1), POLYGON Z ((0 0 5, 4 0 5, 4 4 5, 0 0 5)), LINESTRING (0 0, 9 9), MULTIPOINT ((1 1), (2 2)))", "POINT Z (3 4 9)", "POLYGON EMPTY", "LINESTRING (0 0, 1 1)", "POLYGON ((0 0, x 1, 2 2, 0 0))", None]
    rows = spark.createDataFrame([(w,) for w in wkt], "w string").select(G.shape_from_wkt(F.col("w")).alias("s")).select("s", G.area(F.col("s")).alias("area"), G.perimeter(F.col("s")).alias("perimeter"), G.contains(F.col("s"), G.point(F.lit(3), F.lit(3))).alias("holds")).collect()
    assert [r.s is None for r in rows] == [False] * 4 + [True] * 4
    assert [r.area for r in rows[:4]] == [96, 146, 8, 0] and [r.holds for r in rows[:4]] == [False, False, True, False] and rows[0].perimeter == 48
    assert [len(r.s) for r in rows[:4]] == [2, 3, 1, 1] and rows[3].s[0][0].x == 3
    square, hole = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[2, 2], [4, 2], [4, 4], [2, 4], [2, 2]]
    geo = [{"type": "Polygon", "coordinates": [square, hole]}, {"type": "MultiPolygon", "coordinates": [[square, hole], [[[20, 0], [30, 0], [30, 10], [20, 0]]]]},
           {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 1]}, {"type": "Polygon", "coordinates": [hole]}]}, {"type": "Point", "coordinates": [1, 2]}, {"type": "Polygon", "coordinates": []}]
    rows = spark.createDataFrame([(json.dumps(g),) for g in geo], "g string").select(G.shape_from_geojson(F.col("g")).alias("s")).select("s", G.area(F.col("s")).alias("area"), G.distance_to(F.col("s"), G.point(F.lit(3), F.lit(3))).alias("gap")).collect()
    assert [r.area for r in rows[:4]] == [96, 146, 4, 0] and [r.gap for r in rows[:3]] == [1, 1, 0] and rows[4].s is None
    same = "MULTIPOLYGON (((20 0, 30 0, 30 10, 20 0)), ((0 10, 10 10, 10 0, 0 0, 0 10), (2 4, 2 2, 4 2, 4 4, 2 4)))"
    assert one(spark, same, lambda c: G.geometry_hash(G.shape_from_wkt(c))) == one(spark, wkt[1], lambda c: G.geometry_hash(G.shape_from_wkt(c)))


def test_repair_and_union(spark):
    area = lambda text: one(spark, text, lambda c: G.area(G.repaired(G.shape_from_wkt(c))))
    assert area("POLYGON ((0 0, 10 10, 10 0, 0 10, 0 0))") == 50 and area("MULTIPOLYGON (((0 0, 10 0, 10 10, 0 10, 0 0)), ((5 5, 15 5, 15 15, 5 15, 5 5)))") == 175
    assert area("POLYGON ((0 0, 5 0, 9 0, 0 0))") is None and one(spark, "POINT (1 1)", lambda c: F.size(G.repaired(G.shape_from_wkt(c)))) == 1
    rows = [("a", f"POLYGON (({x} 0, {x + 10} 0, {x + 10} 10, {x} 10, {x} 0))") for x in (0, 10, 20, 25)] + [("a", "POINT (99 9)"), ("b", "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (3 3, 6 3, 6 6, 3 6, 3 3))"), ("b", "POLYGON ((20 0, 30 10, 30 0, 20 10, 20 0))"), ("c", None)]
    df = spark.createDataFrame(rows, "k string, w string").select("k", G.shape_from_wkt(F.col("w")).alias("shape"))
    got = {r.k: (r.area, r.rings) for r in G.union_shapes(df, "k").select("k", G.area(F.col("shape")).alias("area"), F.size("shape").alias("rings")).collect()}
    assert got == {"a": (350, 1), "b": (pytest.approx(122), 4)}


def test_union_and_overlap_add_up():
    """Area of either is area of both less what they share, for shapes with holes."""
    chance = random.Random(6)
    size = lambda rings: sum(float(r[:, 0] @ np.roll(r[:, 1], -1) - r[:, 1] @ np.roll(r[:, 0], -1)) / 2 for r in rings)

    def star(cx, cy, n=9, least=4, most=9):
        return np.array([(cx + r * math.cos(a), cy + r * math.sin(a)) for a, r in ((2 * math.pi * i / n, chance.uniform(least, most)) for i in range(n))])

    for _ in range(100):
        x, y = chance.uniform(-6, 6), chance.uniform(-6, 6)
        a, b = [star(0, 0), star(0, 0, 5, 1, 2)[::-1]], [star(x, y), star(x, y, 4, 1, 2)[::-1]]
        whole = dissolve([*a, *b])
        assert size(whole) <= size(a) + size(b) + 1e-6
        outer = dissolve([a[0], b[0]])
        assert size(outer) == pytest.approx(size(a[:1]) + size(b[:1]) - overlaps([a[:1]], [b[:1]])[0], abs=1e-3)
        assert overlaps([a], [b])[0] == pytest.approx(overlaps([b], [a])[0], abs=1e-6) and overlaps([a], [a])[0] == pytest.approx(size(a), abs=1e-6)


def test_pairs_of_ids_with_several_shapes(spark):
    box = lambda x, w: [ring((x, 0), (x + w, 0), (x + w, 10), (x, 10))]
    a = spark.createDataFrame([("s", box(0, 10))], f"id string, shape {G.SHAPE}")
    b = spark.createDataFrame([("t", box(5, 10)), ("t", box(-4, 6)), ("t", box(-4, 6)), ("t", box(50, 5)), ("u", None)], f"id string, shape {G.SHAPE}")
    got = G.near_pairs(a, b, "id", "id", 0.0).select("right_id", G.pair_overlap().alias("sqm")).collect()
    assert sorted((r.right_id, r.sqm) for r in got) == [("t", 20.0), ("t", 50.0)]


def test_grid_of_a_known_place(spark):
    """The example of a public guide to the grid: 52 39 27.2531 N, 1 43 4.5177 E in Airy terms; here through WGS84, to some metres."""
    p = spark.range(1).select(G.to_grid(F.lit(-0.1276), F.lit(51.5072)).alias("p")).first().p
    assert p.x == pytest.approx(530_034, abs=60) and p.y == pytest.approx(180_381, abs=60)


def test_near_pairs_are_complete_and_single(spark):
    chance = random.Random(9)
    boxes = [(i, [ring((x, y), (x + w, y), (x + w, y + w), (x, y + w))]) for i in range(120) for x, y, w in [(chance.uniform(-500, 500), chance.uniform(-500, 500), chance.choice([1, 30, 200]))]]
    df = spark.createDataFrame(boxes, f"id int, shape {G.SHAPE}")
    got = sorted((r.left_id, r.right_id) for r in G.near_pairs(df, df, "id", "id", 20.0, cell=50.0).collect())
    gap = lambda a, b: max(max(min(p[k] for p in b[0]) - max(p[k] for p in a[0]), min(p[k] for p in a[0]) - max(p[k] for p in b[0])) for k in "xy")
    assert got == sorted((i, j) for i, a in boxes for j, b in boxes if gap(a, b) <= 20)


def wavy(corners, seed=3, size=1000.0, noise=0.002):
    chance = np.random.default_rng(seed)
    turn = np.sort(chance.random(corners)) * 2 * np.pi
    far = size * (1 + noise * chance.normal(size=corners))
    return np.stack([far * np.cos(turn), far * np.sin(turn)], axis=1)


def signed_area(rings):
    return sum((x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2 for x, y in (r.T for r in rings))


def as_rows(rings):
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]


def test_large_rings_are_repaired_soon():
    ring = wavy(20_000)
    began = time.time()
    assert shapes.repair([ring])[0] is ring and time.time() - began < 2
    bow = np.concatenate([ring[:5000], ring[5000:10_000][::-1], ring[10_000:]])  # a quarter runs backwards
    out = shapes.repair([bow])
    assert signed_area(shapes.dissolve(out)) == pytest.approx(signed_area(out), rel=1e-9) and time.time() - began < 20


def test_crossings_are_those_of_all_pairs():
    chance = np.random.default_rng(2)
    for n in (0, 1, 40, 700):
        a = chance.normal(size=(n, 2))
        edges = np.concatenate([a, a + chance.normal(size=(n, 2)) * chance.choice([0.02, 0.3, 3.0], size=(n, 1))], axis=1)
        edges[::7, 2] = edges[::7, 0]
        got = {(min(i, j), max(i, j)) for x, y in shapes.near_edges(edges) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
        for i in range(n):
            d, u = edges[:, 2:] - edges[:, :2], edges[i, 2:] - edges[i, :2]
            base, gap = u[0] * d[:, 1] - u[1] * d[:, 0], edges[:, :2] - edges[i, :2]
            with np.errstate(divide="ignore", invalid="ignore"):
                t, s = (gap[:, 0] * d[:, 1] - gap[:, 1] * d[:, 0]) / base, (gap[:, 0] * u[1] - gap[:, 1] * u[0]) / base
            assert {(min(i, j), max(i, j)) for j in np.flatnonzero((base != 0) & (t > 0) & (t < 1) & (s > 0) & (s < 1)).tolist()} <= got


@pytest.mark.parametrize("seed", range(4))
def test_outlines_of_tangles_keep_their_area(seed):
    steps = np.random.default_rng(seed).normal(size=(400, 2))
    walk = np.cumsum(steps, axis=0) - np.linspace(0, 1, 400)[:, None] * steps.sum(axis=0)
    out = shapes.dissolve([walk])
    assert signed_area(shapes.dissolve(out)) == pytest.approx(signed_area(out), rel=1e-7)
    grid = np.random.default_rng(9).uniform(walk.min(axis=0), walk.max(axis=0), size=(300, 2))

    def winds(rings, p):
        total = 0.0
        for r in rings:
            a = np.arctan2(*(r - p).T)
            total += ((np.diff(np.append(a, a[0])) + np.pi) % (2 * np.pi) - np.pi).sum()
        return round(total / (2 * np.pi)) != 0

    assert all(winds([walk], p) == winds(out, p) for p in grid)


def test_pieces_make_up_the_whole():
    outer, hole = wavy(3000), wavy(900, seed=5, size=300.0)[::-1]
    found = shapes.pieces([outer, hole], 200)
    assert len(found) > 15 and max(sum(map(len, x)) for x in found) < 400
    assert sum(map(signed_area, found)) == pytest.approx(signed_area([outer, hole]), rel=1e-9)
    assert shapes.overlaps(found[:-1], found[1:]).max() < 1e-3
    assert shapes.pieces([outer], 3000)[0][0] is outer


def test_large_polygons_meet_in_pieces(spark):
    """A boundary of 6,000 corners against many sites: areas, distances and containment as for the whole polygon."""
    outer, hole = wavy(6000), wavy(500, seed=5, size=300.0)[::-1]
    chance = np.random.default_rng(8)
    spots = chance.uniform(-1200, 1200, size=(120, 2))
    boxes = [np.array([(x, y), (x + w, y), (x + w, y + w), (x, y + w)]) for (x, y), w in zip(spots, chance.uniform(1, 300, 120), strict=True)]
    kind = f"id int, shape {G.SHAPE}"
    whole, own = spark.createDataFrame([(1, as_rows([outer, hole]))], kind), spark.createDataFrame([(i, as_rows([b])) for i, b in enumerate(boxes)], kind)
    rows = G.near_pairs(own, whole, "id", "id", 0.0)
    got = {r.left_id: r.sqm for r in G.shared_areas(rows).collect()}
    want = shapes.overlaps([[b] for b in boxes], [[outer, hole]] * 120)
    assert all(got.get(i, 0.0) == pytest.approx(w, abs=1e-6 * max(1.0, w)) for i, w in enumerate(want)) and (want > 0).sum() > 60
    assert rows.select(F.max(F.size(F.flatten("right_shape")))).first()[0] < 600
    matches = planning.spatial_matches(whole.withColumnRenamed("id", "site_id"), spark.createDataFrame([(i, as_rows([np.array([p])])) for i, p in enumerate(spots)], kind.replace("id", "feature_id")), 50.0)
    exact = spark.createDataFrame([(i, as_rows([outer, hole]), {"x": float(x), "y": float(y)}) for i, (x, y) in enumerate(spots)], f"id int, shape {G.SHAPE}, p struct<x:double,y:double>")
    exact = {r.id: r.d for r in exact.select("id", G.distance_to(F.col("shape"), F.col("p")).alias("d")).collect()}
    found = {r.feature_id: r.distance_m for r in matches.collect()}
    assert found == pytest.approx({i: d for i, d in exact.items() if d <= 50.0}, abs=1e-6) and 0.0 in found.values() and max(found.values()) > 1


def test_union_of_many_shapes_under_one_key(spark):
    """A tree of unions: 3,000 boxes and wedges of one key, some repeated, against one union of all."""
    rows = [("a", i, i % 60 * 10.0, i // 60 * 10.0) for i in range(2990)] + [("a", 7, 70.0, 0.0)] * 10 + [("b", 1, 0.0, 0.0), (None, 1, 5.0, 5.0)]
    ring = lambda i, x, y: np.array([(x, y), (x + 11, y), (x + 11, y + 11 if i % 3 else y + 5.0), (x, y + 11)])
    df = spark.createDataFrame([(k, as_rows([ring(i, x, y)])) for k, i, x, y in rows], f"owner string, shape {G.SHAPE}").repartition(5)
    got = {r.owner: r.area for r in G.union_shapes(df, "owner", fan=8).select("owner", G.area(F.col("shape")).alias("area")).collect()}
    want = signed_area(shapes.dissolve([ring(i, x, y) for k, i, x, y in rows if k == "a"]))
    assert got == {"a": pytest.approx(want, rel=1e-9), "b": 121.0, None: 121.0}


def test_markup_is_read_as_a_tree():
    html = """<html><head><title>A &amp; B</title><meta name=Description content='d "q"'><meta property="og:title" content=T></head><body>
      <!-- <a href="/no">no</a> --><ul class="lots big"><li>one<li id=x>two <b>bold</b><ul><li>in</ul></ul>
      <div id=main><div class=card><div>deep <a href=/p?a=1&amp;b=2>L &pound;5 &mdash; x</a></div>after</div><p>x<p>y</div><br/><a href='out' title="a > b">o</a>
      <script>var a = "<a href=/script>";</script><script type="application/ld+json">{"name": "x < y"}</script><noscript><a href=/ns>ns</a></noscript></span></body>"""
    tree = markup.Tree(html)
    texts = lambda selector: [" ".join(t.split()) for t in tree.texts(tree.select(selector))]
    assert texts("ul.lots > li") == ["one", "two bold in"] and texts("ul.big.lots li li") == ["in"] and texts("li#x b") == ["bold"]
    assert texts("#main .card") == ["deep L £5 — x after"] and texts("#main > p, title") == ["A & B", "x", "y"] and texts("a[title], [href=out]") == ["o"] and texts(".none *") == []
    found = markup.page_of(html)
    assert [x["href"] for x in found["links"]] == ["/p?a=1&b=2", "out", "/ns"] and found["title"] == "A & B" and dict(found["metas"]) == {"description": 'd "q"', "og:title": "T"}
    assert found["records"] == ['{"name": "x < y"}'] and "script" not in found["text"] and "ns" not in found["text"].split() and markup.page_of(None) is None and markup.page_of("")["links"] == []
    with pytest.raises(ValueError):
        markup.compounds("a:hover")


def test_links_of_a_scope(spark):
    html = "<nav><a href=/home>Home</a></nav><div class=results><div><a href='/lot/1'>One</a></div><a class=x href=/lot/2>Two</a></div>"
    pages = spark.createDataFrame([("s", "http://a.b/list", html), ("s", "http://a.b/none", None)], "source string, url string, html string")
    assert [r.target for r in H.links(pages, scope=".results").orderBy("position").collect()] == ["http://a.b/lot/1", "http://a.b/lot/2"]
    assert [r.label for r in H.links(pages, scope="a.x, nav > a").orderBy("position").collect()] == ["Home", "Two"]
    maps = spark.createDataFrame([("s", "<loc>http://a.b/lot/3</loc>")], "source string, xml string")
    found = listings.crawl_candidates(pages, maps, "http://a.b/.*", 9, scope="div.results").orderBy("place")
    assert [r.url for r in found.collect()] == ["http://a.b/lot/1", "http://a.b/lot/2", "http://a.b/lot/3"]


def test_an_entity_that_is_cut_off_stays_as_it_is_written(spark):
    read = lambda text: one(spark, text, lambda c: H.headline(H.whole_entities(c)))
    assert read("<title>A &amp;&amp</title>") == "A &&amp" and read("<h1>B &amp; &lt;c&gt; &#39;d&#x27; & e &ltf</h1>") == "B & <c> 'd' & e &ltf"
    assert one(spark, "<h1>A &amp</h1>", H.headline) == "A &"


def test_repeated_shapes_are_repaired_once():
    calls = []
    shapes = [[np.array([(0, 0), (w, w), (w, 0), (0, w)], float)] for w in (1, 2, 1, 2, 1)]
    got = list(G.each_once(shapes, lambda rings: calls.append(1) or rings))
    assert len(calls) == 2 and [float(x[0].max()) for x in got] == [1, 2, 1, 2, 1]


def test_pages_are_read_some_at_once(spark):
    pages = [None if i % 50 == 7 else f"<title>{i}</title><a href='/{i}'>l {i}</a><a>no</a>" for i in range(2 * markup.SOME + 3)]
    most = []
    got = markup.in_parts(pa.array(pages), lambda texts: most.append(len(texts)) or pa.array(texts), pa.string())
    assert got.to_pylist() == pages and max(most) == markup.SOME
    df = spark.createDataFrame([(i, x) for i, x in enumerate(pages)], "id int, html string").coalesce(1)
    rows = df.select("id", markup.page(F.col("html"))["links"].alias("a"), markup.page_links(F.col("html")).alias("b")).collect()
    assert len(rows) == len(pages) and all(r.a == r.b for r in rows) and rows[9].b[0].href == "/9"
