"""Containment of polygons of any shape, areas and cells, against cases and against plain loops."""

import math
import random

from pyspark.sql import functions as F

from wayfold.operators import polygons

RINGS = "array<array<struct<x:double,y:double>>>"


def ring(*at):
    return [(float(x), float(y)) for x, y in (*at, at[0])]


def box(x1, y1, x2, y2):
    return ring((x1, y1), (x2, y1), (x2, y2), (x1, y2))


L = [ring((0, 0), (8, 0), (8, 4), (4, 4), (4, 8), (0, 8))]
HOLED = [box(0, 0, 10, 10), box(4, 4, 6, 6)]
CASES = [
    (L, [box(0, 0, 4, 4)], True), (L, [box(4, 0, 8, 4)], True), (L, [box(3, 3, 5, 5)], False), (L, [box(4, 4, 6, 6)], False), (L, [ring((0, 8), (4, 8), (8, 4), (8, 0))], False), (L, L, True), (L, [ring((0, 0), (8, 0), (0, 8))], True), (L, [ring((0, 8), (4, 4), (8, 4), (0, 0))], True),
    (HOLED, [box(0, 0, 4, 10)], True), (HOLED, [box(1, 1, 9, 9)], False), (HOLED, [box(1, 1, 9, 9), box(4, 4, 6, 6)], True), (HOLED, [box(1, 1, 9, 9), box(3, 3, 7, 7)], True), (HOLED, [box(1, 1, 9, 9), box(4.5, 4.5, 5.5, 5.5)], False), (HOLED, [box(4, 4, 6, 6)], False), (HOLED, [box(4.5, 4.5, 5.5, 5.5)], False), (HOLED, HOLED, True),
    (HOLED, [box(2, 2, 6, 4)], True), (HOLED, [box(-1, 1, 2, 2)], False), (HOLED, [box(20, 20, 21, 21)], False), ([ring((0, 0), (10, 0), (10, 10), (5, 1), (0, 10))], [ring((1, 1), (9, 1), (5, 0.5))], True), ([ring((0, 0), (10, 0), (10, 10), (5, 1), (0, 10))], [ring((1, 2), (9, 2), (5, 0.5))], False),
]


def test_containment_cases(spark):
    rows = [(i, a, b) for i, (a, b, _) in enumerate(CASES)]
    found = spark.createDataFrame(rows, f"k int, a {RINGS}, b {RINGS}").select("k", polygons.contains(F.col("a"), F.col("b")).alias("c")).collect()
    assert {r.k: r.c for r in found} == {i: c for i, (_, _, c) in enumerate(CASES)}


def test_containment_equals_many_places(spark):
    """Stars inside stars: a polygon is contained if none of many places along and inside it lies outside the other."""
    rng = random.Random(8)

    def star(n, low, high, at=(0.0, 0.0)):
        return ring(*((at[0] + r * math.cos(2 * math.pi * i / n), at[1] + r * math.sin(2 * math.pi * i / n)) for i in range(n) for r in [rng.uniform(low, high)]))

    def within(x, y, shape):
        return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for r in shape for a, b in zip(r, r[1:])) % 2 == 1

    pairs = [([star(9, 5, 10), star(5, 0.5, 1.5, (2, 0))], [star(7, 0.5, rng.choice([1.0, 3.0, 6.0]), (rng.uniform(-3, 3), rng.uniform(-3, 3)))]) for _ in range(120)]
    found = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], f"k int, a {RINGS}, b {RINGS}").select("k", polygons.contains(F.col("a"), F.col("b")).alias("c"), polygons.area(F.col("b")).alias("area")).collect()
    for r in found:
        a, b = pairs[r.k]
        edge = [(p[0] + t / 400 * (q[0] - p[0]), p[1] + t / 400 * (q[1] - p[1])) for p, q in zip(b[0], b[0][1:]) for t in range(400)]
        inner = [(x, y) for x, y in ((rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(4000)) if within(x, y, b)]
        assert r.c == all(within(x, y, a) for x, y in edge + inner), r.k
        assert abs(r.area - abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(b[0], b[0][1:]))) / 2) < 1e-9
    assert 10 < sum(r.c for r in found) < 110


def test_parts_of_relations_come_first(spark):
    frame = lambda rows: spark.createDataFrame(rows, f"id long, rings {RINGS}")
    buildings = frame([(1, [box(0, 0, 10, 10)]), (2, [box(0, 0, 10, 10)]), (3, [box(20, 0, 30, 10)]), (4, [box(40, 0, 50, 10)])])
    parts = frame([(10, [box(1, 1, 2, 2)]), (11, [box(3, 3, 4, 4)]), (12, [box(20, 0, 30, 10)]), (13, [box(60, 0, 61, 1)]), (14, [box(39, 0, 41, 1)]), (15, [box(41, 1, 42, 2)])])
    members = spark.createDataFrame([(7, 2, "outline"), (7, 10, "part"), (8, 4, "outline"), (8, 3, "outline"), (8, 14, "part"), (9, 4, "outline"), (6, 99, "outline"), (6, 15, "part")], "relation_id long, member_id long, role string")
    got = {(r.part_id, r.building_id, r.explicit) for r in polygons.parts_of_buildings(buildings, parts, members, 7.0).collect()}
    # 10 is named; 11 lies in that outline, too; 12 is its building's only part and the same; 13 and 14 have no building; 15's relation has no such outline.
    assert got == {(10, 2, True), (11, 2, True), (15, 4, False)}


def test_tables_of_cells_equal_arrays_of_cells(spark):
    from wayfold.functions import lines

    shapes = [(0, L), (1, HOLED), (2, [ring((0.3, 0.2), (9.7, 3.1), (2.2, 8.8))]), (3, [ring((-3.5, -2.5), (4, -1), (0.5, 0.5), (-1, 6))])]
    frame = spark.createDataFrame(shapes, f"k int, rings {RINGS}")
    got = {(r.k, r.cx, r.cy) for r in polygons.covered_cells(frame, "k", "rings", 0.7).collect()}
    want = frame.select("k", F.explode(lines.polygon_cells(F.col("rings"), F.lit(0.7))).alias("c")).select("k", "c.*")
    assert got == {(r.k, r.cx, r.cy) for r in want.collect()} and len(got) > 100


def test_references_of_documents(spark):
    from wayfold.operators import references

    rows = [
        ("s1", "segment", '{"connectors":[{"connector_id":"c1","at":0},{"connector_id":"c9"}],"sources":[{"property":""},{"property":"/properties/connectors/0"},{"property":"/properties/level"},{"property":"/geometry"}]}'),
        ("c1", "connector", "{}"), ("d1", "division", '{"parent_division_id":null,"hierarchies":[[{"division_id":"d1"}],[{"division_id":"d1"},{"division_id":"d2"}]]}'), ("x", "place", None), ("y", "division", "no json"), ("b", "division_boundary", '{"division_ids":["d1","c1"]}'),
    ]
    frame = spark.createDataFrame(rows, "id string, type string, properties string")
    assert {tuple(r) for r in references.unresolved(frame).collect()} == {("segment", "s1", "connectors[].connector_id", "connector", "c9"), ("division", "d1", "hierarchies[][].division_id", "division", "d2"), ("division_boundary", "b", "division_ids[]", "division", "c1")}
    assert {tuple(r) for r in references.sources_without_property(frame).collect()} == {("s1", "/properties/level"), ("s1", "/geometry")}


def test_cells_equal_a_test_of_every_centre(spark):
    """Centres inside by parity over all rings, and the cells that the outer ring crosses."""
    from wayfold.functions import lines

    shapes = [(0, L), (1, HOLED), (2, [ring((0.3, 0.2), (9.7, 3.1), (2.2, 8.8))]), (3, [ring((-3.5, -2.5), (4, -1), (0.5, 0.5), (-1, 6))])]
    frame = spark.createDataFrame(shapes, f"k int, rings {RINGS}")
    got = {(r.k, r.cx, r.cy) for r in frame.select("k", F.explode(lines.polygon_cells(F.col("rings"), F.lit(0.7))).alias("c")).select("k", "c.*").collect()}
    border = {(r.k, r.cx, r.cy) for r in frame.select("k", F.explode(lines.line_cells(F.col("rings")[0], F.lit(0.7))).alias("c")).select("k", "c.*").collect()}

    def within(x, y, shape):
        return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for r in shape for a, b in zip(r, r[1:])) % 2 == 1

    inside = {(k, i, j) for k, shape in shapes for i in range(-10, 20) for j in range(-10, 20) if within((i + 0.5) * 0.7, (j + 0.5) * 0.7, shape)}
    assert got == inside | border
