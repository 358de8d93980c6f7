"""Plane geometry on columns: shapes as arrays of rings of struct(x, y) in metres; boxes, area, distance, containment, overlap, repair, union.

A point is one ring of one corner. A polygon is its outer ring and its holes, a multipolygon the rings of all its parts: outer rings run
counter-clockwise and holes clockwise (a single ring may run either way); rings are open or closed. The readers below and repair() give shapes of
this form. Measures are built-in expressions. The overlap of two general polygons splits both into signed triangles and adds the signed areas of the
triangles' overlaps; that, repair and union run on Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..sources.scratch import superseded, written
from .shapes import dissolve, overlaps, pieces, repair

SHAPE = "array<array<struct<x:double,y:double>>>"
SHAPE_TYPE = ArrayType(ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])))
#: Corners from which on a polygon is cut into pieces before it meets others; shapes that are united at once, at most, and corners, beyond two shapes.
MOST_CORNERS, FAN, MOST_UNITED = 256, 64, 20_000
POLYGON_SOURCES_HIGH, POLYGON_SOURCES_MEDIUM = ("SOURCE_POLYGON", "ANALYST_DRAWN"), ("SOURCE_MAP_DIGITISED", "TITLE_UNION")


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def point_shape(p: Column) -> Column:
    return F.when(p.isNotNull(), F.array(F.array(p)))


def box_shape(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return F.array(F.array(point(minx, miny), point(maxx, miny), point(maxx, maxy), point(minx, maxy)))


def oriented(rings: Column) -> Column:
    """Rings (struct of outer and ring) with outer ones counter-clockwise and holes clockwise, open, those of under three corners left out."""
    def turned(r: Column) -> Column:
        ring = r["ring"]
        opened = F.when((F.size(ring) > 1) & (ring[0] == F.element_at(ring, -1)), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
        return F.when((ring_area(ring) >= 0) == r["outer"], opened).otherwise(F.reverse(opened))

    return F.filter(F.transform(rings, turned), lambda r: F.size(r) >= 3)


def sound(shape: Column) -> Column:
    """The shape, or null if it has no ring or a corner without numbers."""
    return F.when((F.size(shape) > 0) & F.forall(F.flatten(shape), lambda p: p["x"].isNotNull() & p["y"].isNotNull()), shape)


def shape_from_wkt(wkt: Column) -> Column:
    """All rings of a POLYGON or MULTIPOLYGON, those of a GEOMETRYCOLLECTION's polygons, or the first point of a POINT; null for anything else and empty ones."""
    bare = F.regexp_replace(wkt, r"(?is)\b(?:MULTI)?(?:POINT|LINESTRING)\s*(?:[ZM]+\s*)?\((?:[^()]|\([^()]*\))*\)", "")
    pattern = r"(\(?)\s*\(([^()]*)\)"
    found = F.arrays_zip(F.regexp_extract_all(bare, F.lit(pattern), F.lit(1)).alias("open"), F.regexp_extract_all(bare, F.lit(pattern), F.lit(2)).alias("text"))
    number = lambda pair, i: F.get(F.split(F.trim(pair), r"\s+"), F.lit(i)).try_cast("double")
    corners = lambda text: F.transform(F.split(text, ","), lambda p: point(number(p, 0), number(p, 1)))
    rings = F.transform(found, lambda r: F.struct((r["open"] == "(").alias("outer"), corners(r["text"]).alias("ring")))
    spot = F.regexp_extract(wkt, r"(?is)\bPOINT\s*(?:[ZM]+\s*)?\(\s*([^()]*)\)", 1)
    polygon = bare.rlike(r"(?i)POLYGON")
    return F.when(polygon, sound(oriented(rings))).when((spot != "") & ~F.upper(wkt).contains("MULTIPOINT"), sound(F.array(corners(spot))))


def shape_from_geojson(geometry: Column) -> Column:
    """All rings of a Polygon, MultiPolygon or of a GeometryCollection's polygons, or the one point of a Point, from its JSON text; null for anything else."""
    corners = lambda ring: F.transform(ring, lambda p: point(p[0], p[1]))
    polygon = lambda rings: F.transform(rings, lambda ring, i: F.struct((i == 0).alias("outer"), corners(ring).alias("ring")))

    def polygons(text: Column) -> Column:
        kind, coordinates = F.get_json_object(text, "$.type"), F.get_json_object(text, "$.coordinates")
        one = polygon(F.from_json(coordinates, "array<array<array<double>>>"))
        many = F.flatten(F.transform(F.from_json(coordinates, "array<array<array<array<double>>>>"), polygon))
        return F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)

    parts = F.from_json(F.get_json_object(geometry, "$.geometries"), "array<string>")
    gathered = F.flatten(F.filter(F.transform(parts, polygons), lambda r: r.isNotNull()))
    single = F.from_json(F.get_json_object(geometry, "$.coordinates"), "array<double>")
    kind = F.get_json_object(geometry, "$.type")
    return F.when(kind == "Point", sound(F.array(F.array(point(single[0], single[1]))))).otherwise(sound(oriented(F.when(kind == "GeometryCollection", gathered).otherwise(polygons(geometry)))))


def is_point(shape: Column) -> Column:
    return (F.size(shape) == 1) & (F.size(F.get(shape, F.lit(0))) == 1)


def first_corner(shape: Column) -> Column:
    """The corner of a point, or a polygon's first one."""
    return F.get(F.get(shape, F.lit(0)), F.lit(0))


def ring_edges(ring: Column) -> Column:
    """Each corner with the next one, around."""
    nexts = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("a"), nexts.alias("b"))


def edges(shape: Column) -> Column:
    return F.flatten(F.transform(shape, ring_edges))


def doubled_area(edge_list: Column) -> Column:
    return F.aggregate(edge_list, F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))


def ring_area(ring: Column) -> Column:
    """Positive for a ring that runs counter-clockwise."""
    return doubled_area(ring_edges(ring)) / 2


def area(shape: Column) -> Column:
    """Square metres without holes; 0 for points and lines."""
    return F.abs(doubled_area(edges(shape))) / 2


def perimeter(shape: Column) -> Column:
    """Metres around all rings."""
    step = lambda e: F.sqrt(F.pow(e["b"]["x"] - e["a"]["x"], 2) + F.pow(e["b"]["y"] - e["a"]["y"], 2))
    return F.aggregate(edges(shape), F.lit(0.0), lambda s, e: s + step(e))


def compactness(shape: Column) -> Column:
    """4 pi area / perimeter^2: 1 for a circle."""
    return F.when(perimeter(shape) > 0, 4 * math.pi * area(shape) / F.pow(perimeter(shape), 2))


def bounds(shape: Column) -> Column:
    xs, ys = F.transform(F.flatten(shape), lambda p: p["x"]), F.transform(F.flatten(shape), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def point_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))


def contains(shape: Column, p: Column) -> Column:
    """Whether a point is inside, by crossings of a ray with all rings; false for shapes that are points and inside holes."""
    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        apart = (a["y"] > p["y"]) != (b["y"] > p["y"])
        at = F.try_divide((b["x"] - a["x"]) * (p["y"] - a["y"]), b["y"] - a["y"]) + a["x"]
        return apart & (p["x"] < at)

    return F.size(F.filter(edges(shape), crosses)) % 2 == 1


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    along = F.try_divide((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy, dx * dx + dy * dy)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    return F.sqrt(F.pow(p["x"] - (a["x"] + t * dx), 2) + F.pow(p["y"] - (a["y"] + t * dy), 2))


def distance_to(shape: Column, p: Column) -> Column:
    """Metres from a point to a polygon (0 inside) or to a point."""
    nearest = F.aggregate(edges(shape), F.lit(float("inf")), lambda s, e: F.least(s, segment_distance(p, e["a"], e["b"])))
    return F.when(contains(shape, p), 0.0).otherwise(nearest)


def geometry_hash(shape: Column) -> Column:
    """SHA-256 of the rings rounded to millimetres, each begun at its least corner and all in one order, so that equal shapes agree."""
    alone = (F.size(shape) == 1) & (doubled_area(edges(shape)) < 0)

    def canonical(ring: Column) -> Column:
        milli = F.transform(ring, lambda p: F.struct(F.round(p["x"] * 1000).cast("long").alias("x"), F.round(p["y"] * 1000).cast("long").alias("y")))
        opened = F.when((F.size(milli) > 1) & (milli[0] == F.element_at(milli, -1)), F.slice(milli, 1, F.size(milli) - 1)).otherwise(milli)
        turned = F.when(alone, F.reverse(opened)).otherwise(opened)
        start = F.array_position(turned, F.array_min(turned)).cast("int")
        return F.concat(F.slice(turned, start, F.size(turned)), F.slice(turned, F.lit(1), start - 1))

    return F.sha2(F.to_json(F.array_sort(F.transform(shape, canonical))), 256)


def box_overlap(a: Column, b: Column) -> Column:
    """Shared square metres of two boxes."""
    wide = F.least(a["maxx"], b["maxx"]) - F.greatest(a["minx"], b["minx"])
    high = F.least(a["maxy"], b["maxy"]) - F.greatest(a["miny"], b["miny"])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def is_box(shape: Column) -> Column:
    """Whether a polygon of one ring fills its bounds."""
    b = bounds(shape)
    whole = (b["maxx"] - b["minx"]) * (b["maxy"] - b["miny"])
    return (F.size(shape) == 1) & (F.size(F.get(shape, F.lit(0))) >= 3) & (whole > 0) & (F.abs(area(shape) - whole) <= 1e-9 * whole)


def box_distance(box: Column, p: Column) -> Column:
    dx = F.greatest(F.lit(0.0), box["minx"] - p["x"], p["x"] - box["maxx"])
    dy = F.greatest(F.lit(0.0), box["miny"] - p["y"], p["y"] - box["maxy"])
    return F.sqrt(dx * dx + dy * dy)


def pair_overlap() -> Column:
    """Shared square metres of a row of near_pairs(): built in for two boxes, else by overlap_area(). Of a pair in pieces, sum it as shared_areas() does."""
    boxes = F.col("left_is_box") & F.col("right_is_box")
    other = overlap_area(F.when(~boxes, F.col("left_shape")), F.when(~boxes, F.col("right_shape")))
    return F.when(boxes, box_overlap(F.col("left_box"), F.col("right_box"))).otherwise(other)


def shared_areas(pairs: DataFrame) -> DataFrame:
    """PAIR, or MARKS, left_area and sqm (shared square metres) of the pairs of near_pairs(), or near_shapes(), all pieces together."""
    return pairs.withColumn("sqm", pair_overlap()).groupBy(*(c for c in PAIR if c in pairs.columns)).agg(F.first("left_area").alias("left_area"), F.sum("sqm").alias("sqm"))


def pair_distance() -> Column:
    """Metres from the left polygon of a row of near_pairs() to the right point."""
    p = first_corner(F.col("right_shape"))
    return F.when(F.col("left_is_box"), box_distance(F.col("left_box"), p)).otherwise(distance_to(F.col("left_shape"), p))


def corners(rings: Iterable | None) -> list[np.ndarray]:
    """The rings of a value of a shape column as arrays of corners; points and lines left out."""
    found = [np.array([(p["x"], p["y"]) for p in ring], float) for ring in (rings if rings is not None else [])]
    return [r for r in found if len(r) > 2]


def as_shapes(found: Iterable[list[np.ndarray]]) -> pa.Array:
    rows = [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings] or None for rings in found]
    return pa.array(rows, pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))


def each_once(found: Iterable[list[np.ndarray]], work: Callable[[list[np.ndarray]], list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """What work gives for each polygon, in order; those that repeat are worked out once."""
    done: dict[tuple[bytes, ...], list[np.ndarray]] = {}
    for rings in found:
        key = tuple(r.tobytes() for r in rings)
        if key not in done:
            done[key] = work(rings)
        yield done[key]


@F.arrow_udf(DoubleType())
def overlap_area(left: pa.Array, right: pa.Array) -> pa.Array:
    """Shared square metres of two polygons; 0 if either is a point."""
    return pa.array(overlaps([corners(x) for x in left.to_pylist()], [corners(x) for x in right.to_pylist()]))


@F.arrow_udf(SHAPE_TYPE)
def dissolved(shapes: pa.Array) -> pa.Array:
    return as_shapes(dissolve(corners(x)) for x in shapes.to_pylist())


@F.arrow_udf(SHAPE_TYPE)
def made_simple(shapes: pa.Array) -> pa.Array:
    return as_shapes(each_once(map(corners, shapes.to_pylist()), repair))


def repaired(shape: Column) -> Column:
    """The shape with crossing or overlapping rings made simple; null if nothing of it has an area. Points, boxes and triangles stay as they are."""
    plain = is_point(shape) | is_box(shape)
    return F.when(plain, shape).otherwise(made_simple(F.when(~plain, shape)))


def space_order(shape: Column) -> Column:
    """The place of a shape's middle on a Z-shaped curve over squares of one metre."""
    box = bounds(shape)

    def spread(low: Column, high: Column) -> Column:
        v = F.pmod(F.floor((low + high) / 2) + (1 << 30), F.lit(1 << 31))
        for step, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, step)).bitwiseAND(F.lit(mask))
        return v

    return spread(box["minx"], box["maxx"]).bitwiseOR(F.shiftleft(spread(box["miny"], box["maxy"]), 1))


def union_shapes(rows: DataFrame, key: str, shape: str = "shape", fan: int = FAN) -> DataFrame:
    """key and the union of its shapes (points left out), by a tree: in each round neighbours in space order, `fan` at most, become one shape.

    Rounds are dealt out by ranges of key and space order, so a key may have any number of shapes; those that repeat count once.
    """
    own = rows.where(F.col(shape).isNotNull() & ~is_point(F.col(shape))).select(F.col(key).alias("key"), repaired(F.col(shape)).alias("shape")).where("shape is not null")
    placed = lambda df: df.select("key", "shape", space_order(F.col("shape")).alias("z"), F.xxhash64("shape").alias("mark"))
    held = written(placed(own).dropDuplicates(["key", "mark"]), "shapes")
    kind = held.schema["key"].dataType.simpleString()

    def unite(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        group: list[tuple[object, list[np.ndarray]]] = []
        size = 0

        def settle() -> pa.RecordBatch:
            rings = [r for _, x in group for r in x]
            return pa.RecordBatch.from_arrays([pa.array([group[0][0]], key_type), as_shapes([dissolve(rings) if len(group) > 1 else rings])], names=["key", "shape"])

        for batch in batches:
            key_type = batch.schema.field("key").type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for own_key, rings in zip(part.column("key").to_pylist(), part.column("shape").to_pylist(), strict=True):
                    if group and (own_key != group[0][0] or len(group) >= fan or (len(group) > 1 and size > MOST_UNITED)):
                        yield settle()
                        group, size = [], 0
                    group.append((own_key, corners(rings)))
                    size += sum(map(len, group[-1][1]))
        if group:
            yield settle()

    while True:
        most, n = held.groupBy("key").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
        if most <= fan:
            break
        dealt = held.repartitionByRange(max(1, n // (16 * fan)), "key", "z", "mark").sortWithinPartitions("key", "z", "mark")
        last, held = held, written(placed(dealt.select("key", "shape").mapInArrow(unite, f"key {kind}, shape {SHAPE}")), "shapes")
        superseded(last)
    return held.groupBy("key").agg(dissolved(F.flatten(F.collect_list("shape"))).alias("shape")).withColumnRenamed("key", key)  # `fan` shapes at most


def within(inner: Column, outer: Column) -> Column:
    """Whether a polygon lies inside another one."""
    return F.abs(overlap_area(inner, outer) - area(inner)) <= 1e-6 * F.greatest(area(inner), F.lit(1.0))


def to_grid(lon: Column, lat: Column) -> Column:
    """struct(x, y): British National Grid metres (EPSG:27700) of WGS84 degrees, by a seven-parameter shift and transverse Mercator; some metres off a grid-shift transform."""
    # fixed values: ellipsoids WGS84 and Airy 1830, the shift between them, the projection's origin
    a1, b1, a, b = 6378137.0, 6356752.314245, 6377563.396, 6356256.909
    tx, ty, tz, s, rx, ry, rz = -446.448, 125.157, -542.060, 20.4894e-6, *(math.radians(v / 3600) for v in (-0.1502, -0.2470, -0.8421))
    f0, lat0, lon0, e0, n0 = 0.9996012717, math.radians(49), math.radians(-2), 400000.0, -100000.0
    e1, e2, n = 1 - (b1 / a1) ** 2, 1 - (b / a) ** 2, (a - b) / (a + b)
    phi, lam = F.radians(lat), F.radians(lon)
    nu = a1 / F.sqrt(1 - e1 * F.pow(F.sin(phi), 2))
    x, y, z = nu * F.cos(phi) * F.cos(lam), nu * F.cos(phi) * F.sin(lam), nu * (1 - e1) * F.sin(phi)
    x, y, z = tx + (1 + s) * x - rz * y + ry * z, ty + rz * x + (1 + s) * y - rx * z, tz - ry * x + rx * y + (1 + s) * z
    p = F.sqrt(x * x + y * y)
    phi = F.atan2(z, p * (1 - e2))
    for _ in range(4):
        phi = F.atan2(z + e2 * a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2)) * F.sin(phi), p)
    d = F.atan2(y, x) - lon0
    nu = a * f0 / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    rho = a * f0 * (1 - e2) / F.pow(1 - e2 * F.pow(F.sin(phi), 2), 1.5)
    eta, t, c = nu / rho - 1, F.pow(F.tan(phi), 2), F.cos(phi)
    minus, plus = phi - lat0, phi + lat0
    m = b * f0 * (
        (1 + n + 1.25 * n**2 + 1.25 * n**3) * minus
        - (3 * n + 3 * n**2 + 2.625 * n**3) * F.sin(minus) * F.cos(plus)
        + (1.875 * n**2 + 1.875 * n**3) * F.sin(2 * minus) * F.cos(2 * plus)
        - 35 / 24 * n**3 * F.sin(3 * minus) * F.cos(3 * plus)
    )
    north = m + n0 + nu / 2 * F.sin(phi) * c * d**2 + nu / 24 * F.sin(phi) * F.pow(c, 3) * (5 - t + 9 * eta) * d**4 + nu / 720 * F.sin(phi) * F.pow(c, 5) * (61 - 58 * t + t * t) * d**6
    east = e0 + nu * c * d + nu / 6 * F.pow(c, 3) * (nu / rho - t) * d**3 + nu / 120 * F.pow(c, 5) * (5 - 18 * t + t * t + 14 * eta - 58 * t * eta) * d**5
    return point(east, north)


def confidence(source_type: Column, shape: Column) -> Column:
    return (
        F.when(is_point(shape) | (source_type == "POINT_ONLY"), "INSUFFICIENT")
        .when(source_type.isin(*POLYGON_SOURCES_HIGH), "HIGH")
        .when(source_type.isin(*POLYGON_SOURCES_MEDIUM), "MEDIUM")
        .when(source_type == "APPROXIMATE_BBOX", "LOW")
        .otherwise("INSUFFICIENT")
    )


def site_status(geom_confidence: Column, manual_review: Column) -> Column:
    return F.when(geom_confidence == "INSUFFICIENT", "INSUFFICIENT_GEOMETRY").when(F.coalesce(manual_review, F.lit(False)) | (geom_confidence == "LOW"), "MANUAL_REVIEW").otherwise("ACTIVE")


def cells(box: Column, size: float, margin: float = 0.0) -> Column:
    """The grid cells (struct(cx, cy)) that a box with a margin touches."""
    lo = lambda v: F.floor((v - margin) / size)
    hi = lambda v: F.floor((v + margin) / size)
    return F.flatten(F.transform(F.sequence(lo(box["minx"]), hi(box["maxx"])), lambda x: F.transform(F.sequence(lo(box["miny"]), hi(box["maxy"])), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


@F.arrow_udf(ArrayType(SHAPE_TYPE))
def cut_up(shapes: pa.Array) -> pa.Array:
    found = [None if x is None else as_shapes(pieces(corners(x), MOST_CORNERS)).to_pylist() for x in shapes.to_pylist()]
    return pa.array(found, pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))))


def in_pieces(shape: Column) -> Column:
    """The shape as an array of pieces of at most about MOST_CORNERS corners that together are the shape; mostly of itself alone."""
    many = F.size(F.flatten(shape)) > MOST_CORNERS
    found = cut_up(F.when(many, shape))
    return F.when(F.size(found) > 0, found).otherwise(F.array(shape))


#: What tells apart the pairs of near_pairs(), ids and marks of the whole shapes, and those of near_shapes().
PAIR = ["left_id", "left_mark", "right_id", "right_mark"]
MARKS = ["left_mark", "right_mark"]


def mark(shape: Column) -> Column:
    """What tells apart different shapes: two hashes, 128 bits together."""
    return F.struct(F.xxhash64(shape).alias("a"), F.xxhash64(F.lit(1), shape).alias("b"))


def near_shapes(left: DataFrame, right: DataFrame, within: float, cell: float = 1000.0) -> DataFrame:
    """Candidate pairs of different shapes (rows' column shape) whose boxes come within a distance: an equi-join on grid cells, each pair once.

    Rows of one shape count once, so the work follows the different shapes; with_ids() gives what was found to their rows. A pair is taken in the one
    cell that holds the lower left corner of the two boxes' shared part, so nothing has to be made distinct. Marks and boxes meet in the cells; shapes
    are joined to the pairs that are left.

    Large polygons meet in pieces, as rows of their own with the same MARKS: a shared area is the sum over a pair's rows, a distance the least of
    them, and a point is within if it is within any. left_area and right_area are those of the whole shapes.
    """
    def described(df: DataFrame, side: str) -> DataFrame:
        own = df.where(F.size("shape") >= 1).select(mark(F.col("shape")).alias(f"{side}_mark"), "shape").dropDuplicates([f"{side}_mark"]).withColumn(f"{side}_area", area(F.col("shape")))
        each = own.select(f"{side}_mark", f"{side}_area", F.posexplode(in_pieces(F.col("shape"))).alias(f"{side}_piece", f"{side}_shape"))
        return written(each.withColumns({f"{side}_box": bounds(F.col(f"{side}_shape")), f"{side}_is_box": is_box(F.col(f"{side}_shape"))}), f"{side}-shapes")

    a, b = described(left, "left"), described(right, "right")
    meet = [
        (F.col("left_box.minx") - within <= F.col("right_box.maxx")) & (F.col("right_box.minx") <= F.col("left_box.maxx") + within),
        (F.col("left_box.miny") - within <= F.col("right_box.maxy")) & (F.col("right_box.miny") <= F.col("left_box.maxy") + within),
    ]
    corner = [F.floor(F.greatest(F.col(f"left_box.{v}") - within, F.col(f"right_box.{v}")) / cell) for v in ("minx", "miny")]
    in_cells = a.drop("left_shape").withColumn("cell", F.explode(cells(F.col("left_box"), cell, within)))
    others = b.drop("right_shape").withColumn("cell", F.explode(cells(F.col("right_box"), cell)))
    pairs = in_cells.join(others, "cell").where(meet[0] & meet[1] & (F.col("cell.cx") == corner[0]) & (F.col("cell.cy") == corner[1])).drop("cell")
    keys = [[f"{side}_mark", f"{side}_piece"] for side in ("left", "right")]
    whole = pairs.join(a.select(*keys[0], "left_shape"), keys[0]).join(b.select(*keys[1], "right_shape"), keys[1])
    return whole.drop("left_piece", "right_piece")


def with_ids(found: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """found (MARKS and what was measured) for each pair of rows of these shapes: left_id and right_id are added. Rows alike in id and shape count once."""
    for df, key, side in ((left, left_id, "left"), (right, right_id, "right")):
        own = df.where(F.size("shape") >= 1).select(F.col(key).alias(f"{side}_id"), mark(F.col("shape")).alias(f"{side}_mark")).distinct()
        found = found.join(own, f"{side}_mark")
    return found


def near_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, within: float, cell: float = 1000.0) -> DataFrame:
    """The pairs of near_shapes() for each pair of rows, with left_id and right_id: an id may have several shapes, each a row of its own.

    As many rows as there are pairs, each with its shapes: what depends on shapes alone is better measured on near_shapes() first.
    """
    return with_ids(near_shapes(left, right, within, cell), left, right, left_id, right_id)
