"""Polygons of any shape: containment with holes and touching edges, areas, parts of buildings, and the cells that they cover.

A polygon is an array of rings (array of struct(x, y)), the first one outside; rings end where they begin. Tests of a pair are
expressions over the two polygons' edges; pairs are found by grid cells and boxes, so no polygon meets another one far off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bound
from ..functions.lines import bbox, crossings, edge_cells, edges
from ..sources.storage import checkpointed

#: Of a unit square of the edge's length: how far off a place may lie and still be on an edge.
TOLERANCE = 1e-9


def area(rings: Column) -> Column:
    """Area without holes, whatever the rings' directions."""

    def of(ring):
        doubled = F.aggregate(edges(F.array(ring)), F.lit(0.0), lambda s, e: s + e["ax"] * e["by"] - e["bx"] * e["ay"])
        return F.abs(doubled) / 2

    whole = F.transform(rings, of)
    return F.aggregate(whole, F.lit(0.0), lambda s, a: s - a) + 2 * F.get(whole, F.lit(0))


def inside_or_on(x: Column, y: Column, of: Column) -> Column:
    """Whether a place lies in a polygon, given by its edges, or on one of them. Holes count by parity."""

    def on(e):
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        off = F.abs(dx * (y - e["ay"]) - dy * (x - e["ax"]))
        slack = TOLERANCE * (dx * dx + dy * dy)
        along = (x - e["ax"]) * dx + (y - e["ay"]) * dy
        return (off <= slack) & (along >= -slack) & (along <= dx * dx + dy * dy + slack)

    def crossed(e):
        return ((e["ay"] > y) != (e["by"] > y)) & (x < e["ax"] + (y - e["ay"]) * (e["bx"] - e["ax"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)))

    return F.exists(of, on) | (F.size(F.filter(of, crossed)) % 2 == 1)


def meetings(e: Column, f: Column) -> Column:
    """Where edge e, from 0 to 1, meets edge f: the place of a crossing or touch, or both ends of a common stretch."""
    rx, ry, sx, sy = e["bx"] - e["ax"], e["by"] - e["ay"], f["bx"] - f["ax"], f["by"] - f["ay"]
    qx, qy = f["ax"] - e["ax"], f["ay"] - e["ay"]
    d, length = rx * sy - ry * sx, rx * rx + ry * ry
    t, u = (qx * sy - qy * sx) / F.nullif(d, F.lit(0.0)), (qx * ry - qy * rx) / F.nullif(d, F.lit(0.0))
    common = [(qx * rx + qy * ry) / F.nullif(length, F.lit(0.0)), ((qx + sx) * rx + (qy + sy) * ry) / F.nullif(length, F.lit(0.0))]
    one_line = (d == 0) & (F.abs(qx * ry - qy * rx) <= TOLERANCE * length)
    return F.when((u >= -TOLERANCE) & (u <= 1 + TOLERANCE), F.array(t)).when(one_line, F.array(*common)).otherwise(F.array().cast("array<double>"))


def inner_place(ring: Column) -> Column:
    """struct(x, y) strictly inside a ring: halfway through the first stretch inside along a line between two of its heights."""
    of = edges(F.array(ring))
    heights = F.array_sort(F.array_distinct(F.transform(ring, lambda p: p["y"])))
    y = (F.get(heights, F.lit(0)) + F.get(heights, F.lit(1))) / 2
    xs = crossings(of, y)
    return F.struct(((F.get(xs, F.lit(0)) + F.get(xs, F.lit(1))) / 2).alias("x"), y.alias("y"))


def hole_places(rings: Column) -> Column:
    """A place strictly inside each hole."""
    return F.transform(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), inner_place)


def covers(of: Column, own: Column, holes: Column) -> Column:
    """contains() of polygons given by their edges, and the outer one's hole_places()."""

    def stretches(e):
        met = F.flatten(F.transform(of, lambda f: meetings(e, f)))
        at = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.filter(met, lambda t: (t > 0) & (t < 1)))))
        middles = F.flatten(F.transform(F.array(at), lambda s: F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: (a + b) / 2)))
        return F.forall(middles, lambda t: inside_or_on(e["ax"] + t * (e["bx"] - e["ax"]), e["ay"] + t * (e["by"] - e["ay"]), of))

    return F.forall(own, stretches) & ~F.exists(holes, lambda h: inside_or_on(h["x"], h["y"], own))


def contains(outer: Column, inner: Column) -> Column:
    """Whether every place of the polygon inner is one of outer; common edges and corners are allowed.

    All stretches of inner's edges between their meetings with outer's must lie in outer, and no hole of outer in inner.
    """
    return covers(edges(outer), edges(inner), hole_places(outer))


def contained(parts: DataFrame, buildings: DataFrame, cell: float) -> DataFrame:
    """part_id, building_id, same: pairs whose building contains the part whole; same if both cover the same places.

    parts and buildings: id, rings. A part meets buildings in the grid cell of its box's lower corner; boxes are compared before shapes.
    """
    read = lambda rows, p: rows.select(F.col("id").alias(f"{p}_id"), edges(F.col("rings")).alias(f"{p}_edges"), hole_places(F.col("rings")).alias(f"{p}_holes"), area(F.col("rings")).alias(f"{p}_area"), bbox(F.get("rings", F.lit(0))).alias(p))
    p, b = read(parts, "part").drop("part_holes"), read(buildings, "building")
    at = lambda c: F.floor(F.col(c) / cell)
    spread = b.withColumn("cx", F.explode(F.sequence(at("building.xmin"), at("building.xmax")))).withColumn("cy", F.explode(F.sequence(at("building.ymin"), at("building.ymax"))))
    met = p.withColumns({"cx": at("part.xmin"), "cy": at("part.ymin")}).join(spread, ["cx", "cy"])
    boxed = met.where("building.xmin <= part.xmin and part.xmax <= building.xmax and building.ymin <= part.ymin and part.ymax <= building.ymax")
    whole = boxed.where(covers(F.col("building_edges"), F.col("part_edges"), F.col("building_holes")))
    return whole.select("part_id", "building_id", (F.abs(F.col("building_area") - F.col("part_area")) <= TOLERANCE * F.col("building_area")).alias("same"))


def parts_of_buildings(buildings: DataFrame, parts: DataFrame, members: DataFrame, cell: float) -> DataFrame:
    """part_id, building_id, explicit: each part's building.

    members: relation_id, member_id, role. A relation counts if it has exactly one outline, which must be a building, and at least one part:
    its parts belong to the outline, and so do other parts that the outline contains. All other parts belong to the
    building, of those that no relation took, that contains them; the smallest id of several. Parts without a building are left out, and so is a
    building's only part if it has the building's shape.
    """
    roles = members.groupBy("relation_id").agg(F.count(F.when(F.col("role") == "outline", 1)).alias("outlines"), F.count(F.when(F.col("role") == "part", 1)).alias("n"), F.min(F.when(F.col("role") == "outline", F.col("member_id"))).alias("building_id"))
    good = roles.where("outlines = 1 and n > 0").join(buildings.select(F.col("id").alias("building_id")), "building_id", "left_semi").select("relation_id", "building_id")
    named = members.where("role = 'part'").join(good, "relation_id").groupBy(F.col("member_id").alias("part_id")).agg(F.min("building_id").alias("building_id"))
    named = named.join(parts.select(F.col("id").alias("part_id")), "part_id", "left_semi")
    pairs = checkpointed(contained(parts, buildings, cell))
    taken = good.select("building_id", F.lit(True).alias("taken")).distinct()
    told = named.join(pairs, ["part_id", "building_id"], "left").select("part_id", "building_id", F.coalesce("same", F.lit(False)).alias("same"), F.lit(True).alias("explicit"))
    rest = pairs.join(named.select("part_id"), "part_id", "left_anti").join(taken, "building_id", "left")
    # Outlines of relations come before other buildings.
    best = rest.groupBy("part_id").agg(F.min(F.struct(F.col("taken").isNull().alias("free"), "building_id", "same")).alias("m")).select("part_id", "m.building_id", "m.same", (~F.col("m.free")).alias("explicit"))
    every = told.unionByName(best)
    counts = every.groupBy("building_id").agg(F.count("*").alias("n"))
    return every.join(counts, "building_id").where("not (n = 1 and same)").select("part_id", "building_id", "explicit")


def covered_cells(shapes: DataFrame, key: str, rings: str, cell: float) -> DataFrame:
    """key, cx, cy: the cells whose centre lies inside a polygon, and those that its outer ring crosses, each once.

    By scan lines: each row of cells is a row of the table, whose sorted crossings with the rings give the stretches inside. Work grows with
    the boundary's edges for each row and with the result, never with the box.
    """
    shapes = bound(shapes.select(key, rings), box=bbox(F.get(rings, F.lit(0))), e=edges(F.col(rings)))
    rows = shapes.select(key, "e", F.explode(F.sequence(F.floor(F.col("box.ymin") / cell), F.floor(F.col("box.ymax") / cell))).alias("cy"))
    y = (F.col("cy") + 0.5) * cell
    rows = bound(rows, xs=crossings(F.col("e"), y)).where("size(xs) > 1").select(key, "cy", "xs")
    first = lambda i: F.ceil(F.get("xs", i) / cell - 0.5)
    spans = F.transform(F.sequence(F.lit(0), (F.size("xs") - 2).cast("int"), F.lit(2)), lambda i: F.struct(first(i).alias("low"), (first(i + 1) - 1).alias("high")))
    spans = rows.select(key, "cy", F.explode(spans).alias("s")).where("s.low <= s.high")
    inside = spans.select(key, F.explode(F.sequence(F.col("s.low"), F.col("s.high"))).alias("cx"), "cy")
    border = shapes.select(key, F.explode(edge_cells(F.get(rings, F.lit(0)), F.lit(cell))).alias("c")).select(key, "c.cx", "c.cy")
    return inside.unionByName(border).distinct()
