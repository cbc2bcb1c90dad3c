"""Column functions on whole geometries: arrays of struct(x, y) in degrees, WKT and GeoJSON text."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType

from .columns import let
from .geo import EARTH_RADIUS

COORDINATES = "array<struct<x:double,y:double>>"


def metres(a: Column, b: Column) -> Column:
    """Great-circle metres between two struct(x, y) in degrees, not rounded."""
    p, q = F.radians(a["y"]), F.radians(b["y"])
    s, t = F.sin((q - p) / 2), F.sin((F.radians(b["x"]) - F.radians(a["x"])) / 2)
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(s * s + F.cos(p) * F.cos(q) * t * t))


def edge_lengths(line: Column) -> Column:
    """Metres of each edge of a line; an empty array for lines of fewer than two points."""
    n = F.size(line)
    return F.zip_with(F.slice(line, 1, F.greatest(n - 1, F.lit(0))), F.slice(line, 2, F.greatest(n - 1, F.lit(0))), metres)


def line_length(line: Column) -> Column:
    """Metres of a line, rounded to 2 places after the sum; null for a null line."""
    return F.round(F.aggregate(edge_lengths(line), F.lit(0.0), lambda total, x: total + x), 2)


def bbox(line: Column) -> Column:
    """struct(xmin, ymin, xmax, ymax); null members for an empty line."""
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def is_loop(line: Column) -> Column:
    """Whether the first and last of at least three points are equal."""
    return (F.size(line) > 2) & (F.get(line, F.lit(0)) == F.get(line, F.size(line) - 1))


def repeats_a_point(line: Column) -> Column:
    """Whether a point comes twice, apart from the closing one of a loop."""
    return F.size(F.array_distinct(line)) < F.size(line) - F.when(is_loop(line), 1).otherwise(0)


def point_at(line: Column, share: Column) -> Column:
    """struct(x, y) at a share (0 to 1) of the line's length; straight in degrees within an edge; null for empty lines."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("before"), F.lit(None).cast("int").alias("edge"), F.lit(0.0).alias("along"))

    def found(lengths, wanted):
        def step(state, length):
            here = state["edge"].isNull() & (state["before"] + length >= wanted)
            return F.struct((state["i"] + 1).alias("i"), (state["before"] + length).alias("before"), F.when(here, state["i"]).otherwise(state["edge"]).alias("edge"), F.when(here, F.coalesce((wanted - state["before"]) / F.nullif(length, F.lit(0.0)), F.lit(0.0))).otherwise(state["along"]).alias("along"))

        return F.aggregate(lengths, start, step)

    def place(state):
        edge = F.coalesce(state["edge"], F.greatest(F.size(line) - 2, F.lit(0)))
        ends = F.struct(F.get(line, edge).alias("a"), F.coalesce(F.get(line, edge + 1), F.get(line, edge)).alias("b"), F.when(state["edge"].isNull(), 1.0).otherwise(state["along"]).alias("along"))
        return let(ends, lambda e: F.struct(*((e["a"][c] + e["along"] * (e["b"][c] - e["a"][c])).alias(c) for c in ("x", "y"))))

    # Each value is bound once: a plain reference would repeat all that it is made of, for every edge.
    measured = let(edge_lengths(line), lambda lengths: let(share * F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x), lambda wanted: found(lengths, wanted)))
    return F.when(F.size(line) > 0, let(measured, place))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies inside a closed ring, by the parity of the edges that a ray to the right crosses."""
    n = F.size(ring)
    crossed = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))))
    return F.when(n < 4, False).otherwise(F.size(F.filter(crossed, lambda c: F.coalesce(c, F.lit(False)))) % 2 == 1)


def line_cells(line: Column, cell: Column) -> Column:
    """struct(cx, cy) of the square cells that a line's edges cross, corner touches included."""
    return F.array_distinct(edge_cells(line, cell))


def edge_cells(line: Column, cell: Column) -> Column:
    """line_cells() of each edge in turn: cells that several edges cross are repeated."""
    n = F.size(line)
    at = lambda v: F.floor(v / cell)

    def crossed(a, b):
        edge = F.struct(F.least(a["x"], b["x"]).alias("low"), F.greatest(a["x"], b["x"]).alias("high"), ((b["y"] - a["y"]) / F.nullif(b["x"] - a["x"], F.lit(0.0))).alias("slope"))

        def columns(e):
            def column(cx):
                # The part of the edge inside the column of cells; a vertical edge lies in it whole.
                left, right = F.greatest(e["low"], cx * cell), F.least(e["high"], (cx + 1) * cell)
                p = F.coalesce(a["y"] + e["slope"] * (left - a["x"]), a["y"])
                q = F.coalesce(a["y"] + e["slope"] * (right - a["x"]), b["y"])
                rows = let(F.struct(p.alias("p"), q.alias("q")), lambda s: F.sequence(at(F.least(s["p"], s["q"])), at(F.greatest(s["p"], s["q"]))))
                return F.transform(rows, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

            return F.flatten(F.transform(F.sequence(at(e["low"]), at(e["high"])), column))

        return let(edge, columns)

    return F.flatten(F.zip_with(F.slice(line, 1, n - 1), F.slice(line, 2, n - 1), crossed))


def edges(rings: Column) -> Column:
    """struct(ax, ay, bx, by) of all edges of an array of rings."""

    def of(ring):
        n = F.greatest(F.size(ring) - 1, F.lit(0))
        return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))

    return F.flatten(F.transform(rings, of))


def crossings(of: Column, y: Column) -> Column:
    """Sorted places where a level line crosses edges; every other stretch between them lies inside their polygon."""
    crossed = F.filter(of, lambda e: (e["ay"] > y) != (e["by"] > y))
    return F.array_sort(F.transform(crossed, lambda e: e["ax"] + (y - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"])))


def polygon_cells(rings: Column, cell: Column) -> Column:
    """struct(cx, cy) of the cells whose centre lies inside a polygon (an array of closed rings, the first one outside) and of those that its outer ring crosses.

    By scan lines: work grows with the rows' edges and with the result. See polygons.covered_cells() for a table of cells.
    """
    outer, of = F.get(rings, F.lit(0)), edges(rings)
    box = bbox(outer)

    def row(cy):
        xs = crossings(of, (cy + 0.5) * cell)
        first = F.transform(xs, lambda x: F.ceil(x / cell - 0.5))
        spans = F.filter(F.transform(first, lambda low, i: F.struct(low.alias("low"), (F.get(first, i + 1) - 1).alias("high"), i.alias("i"))), lambda s: (s["i"] % 2 == 0) & (s["low"] <= s["high"]))
        return F.flatten(F.transform(spans, lambda s: F.transform(F.sequence(s["low"], s["high"]), lambda cx: F.struct(cx.alias("cx"), cy.alias("cy")))))

    inside = F.flatten(F.transform(F.sequence(F.floor(box["ymin"] / cell), F.floor(box["ymax"] / cell)), row))
    return F.array_union(inside, line_cells(outer, cell))


def multi_cells(parts: Column, cells_of) -> Column:
    """The cells of all parts of a multi-geometry, each once."""
    return F.array_distinct(F.flatten(F.transform(parts, cells_of)))


def ring_of_cells(cells: Column, k: int = 1) -> Column:
    """cells with all cells up to k steps away; k of 0 leaves them."""
    offsets = [(i, j) for i in range(-k, k + 1) for j in range(-k, k + 1)]
    around = lambda c: F.array(*(F.struct((c["cx"] + i).alias("cx"), (c["cy"] + j).alias("cy")) for i, j in offsets))
    return F.array_distinct(F.flatten(F.transform(cells, around)))


def wkt_line(line: Column) -> Column:
    """LINESTRING text with 6 places."""
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(line, lambda p: F.format_string("%.6f %.6f", p["x"], p["y"])), ", "), F.lit(")"))


_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
#: Names of geometry types as GeoJSON spells them, by their upper-case form in WKT.
GEOMETRY_TYPES = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")


def geojson_of_wkt(text: Column) -> Column:
    """GeoJSON geometry text of well-known text of any type but collections, its third and fourth coordinates left out; null for other text and for empty geometries."""
    kind = F.upper(F.regexp_extract(text, r"(?i)^\s*([a-z]+)\s*(?:Z|M|ZM)?\s*\(", 1))
    name = F.element_at(F.create_map(*(F.lit(x) for n in GEOMETRY_TYPES for x in (n.upper(), n))), kind)
    pairs = F.regexp_replace(F.regexp_extract(text, r"^[^(]*(\(.*\))\s*\z", 1), rf"({_NUMBER})\s+({_NUMBER})(?:\s+{_NUMBER}){{0,2}}", "[$1,$2]")
    bare = F.regexp_replace(pairs, r"\(\s*(\[[^\[\]]*\])\s*\)", "$1")  # a multi-point may put each point in brackets of its own
    listed = F.translate(F.when(kind.isin("POINT", "MULTIPOINT"), bare).otherwise(pairs), "()", "[]")
    listed = F.when((kind == "MULTIPOINT") & ~F.startswith(listed, F.lit("[[")), F.concat(F.lit("["), listed, F.lit("]"))).otherwise(listed)
    for spelled, plain in ((r"([\[,])\s*\+", "$1"), (r"([\[,]-?)\.", "$10."), (r"([0-9])\.(?=[,\]eE])", "$1")):  # numbers as JSON spells them
        listed = F.regexp_replace(listed, spelled, plain)
    valid = F.try_parse_json(listed).isNotNull()
    return F.when(name.isNotNull() & valid, F.concat(F.lit('{"type":"'), name, F.lit('","coordinates":'), listed, F.lit("}")))


def from_wkt(text: Column) -> Column:
    """Coordinates of a POINT or LINESTRING text in order; null for other text."""
    pairs = F.regexp_extract_all(text, F.lit(rf"({_NUMBER})\s+({_NUMBER})"), F.lit(0))
    points = F.transform(pairs, lambda p: F.struct(F.split(p, r"\s+")[0].try_cast("double").alias("x"), F.split(p, r"\s+")[1].try_cast("double").alias("y")))
    return F.when(text.rlike(r"(?i)^\s*(POINT|LINESTRING)\b[^()]*\([^()]+\)\s*\z"), points)


POLYGONS = f"array<array<{COORDINATES}>>"


def parts_from_geojson(geometry: Column) -> Column:
    """Any GeoJSON geometry text as polygons or lines: an array of parts, each an array of rings or of one line or point."""
    pair = lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"))
    line = lambda c: F.transform(c, pair)

    def parts(g):
        kind = g["kind"]
        read = lambda depth: F.from_json(g["raw"], "array<" * depth + "double" + ">" * depth)
        return (
            F.when(kind == "Point", let(read(1), lambda c: F.array(F.array(F.array(pair(c))))))
            .when(kind == "MultiPoint", F.transform(read(2), lambda c: F.array(F.array(pair(c)))))
            .when(kind == "LineString", F.array(F.array(line(read(2)))))
            .when(kind == "MultiLineString", F.transform(read(3), lambda c: F.array(line(c))))
            .when(kind == "Polygon", F.array(F.transform(read(3), line)))
            .when(kind == "MultiPolygon", F.transform(read(4), lambda c: F.transform(c, line)))
        )

    return let(F.struct(F.get_json_object(geometry, "$.type").alias("kind"), F.get_json_object(geometry, "$.coordinates").alias("raw")), parts)


def from_geojson(geometry: Column) -> Column:
    """Coordinates of a GeoJSON Point or LineString text; null for other types and for text that is not JSON."""
    kind = F.get_json_object(geometry, "$.type")
    raw = F.get_json_object(geometry, "$.coordinates")
    pair = lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"))
    line = F.transform(F.from_json(raw, "array<array<double>>"), pair)
    return F.when(kind == "LineString", line).when(kind == "Point", F.array(pair(F.from_json(raw, "array<double>"))))


def kind_of_geojson(geometry: Column) -> Column:
    """The type of a geometry whose coordinates can be read, else null."""
    return let(parts_from_geojson(geometry), lambda parts: F.when(can_be_read(parts), F.get_json_object(geometry, "$.type")))


def can_be_read(parts: Column) -> Column:
    """Whether parts_from_geojson() found coordinates, all of them whole."""
    return (F.size(parts) > 0) & ~F.exists(F.flatten(F.flatten(parts)), lambda p: p["x"].isNull() | p["y"].isNull())


def geojson_of_parts(kind: Column, parts: Column) -> Column:
    """GeoJSON geometry text of a type and parts_from_geojson()'s arrays."""
    pair = lambda p: F.array(p["x"], p["y"])
    nested = F.transform(parts, lambda part: F.transform(part, lambda ring: F.transform(ring, pair)))
    coordinates = (
        F.when(kind == "Point", F.to_json(F.get(F.get(F.get(nested, F.lit(0)), F.lit(0)), F.lit(0))))
        .when(kind == "LineString", F.to_json(F.get(F.get(nested, F.lit(0)), F.lit(0))))
        .when(kind.isin("MultiPoint"), F.to_json(F.transform(nested, lambda part: F.get(F.get(part, F.lit(0)), F.lit(0)))))
        .when(kind == "Polygon", F.to_json(F.get(nested, F.lit(0))))
        .when(kind == "MultiLineString", F.to_json(F.transform(nested, lambda part: F.get(part, F.lit(0)))))
        .otherwise(F.to_json(nested))
    )
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}"))


def to_geojson(line: Column) -> Column:
    """A GeoJSON LineString text."""
    return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(line, lambda p: F.array(p["x"], p["y"])).alias("coordinates")))


@F.pandas_udf(BinaryType())
def _wkb(xs: pd.Series, ys: pd.Series) -> pd.Series:
    def one(x, y):
        if x is None or not len(x):
            return None
        head = struct.pack("<BI", 1, 1) if len(x) == 1 else struct.pack("<BII", 1, 2, len(x))
        return head + np.column_stack([x, y]).astype("<f8").tobytes()

    return pd.Series([one(x, y) for x, y in zip(xs, ys, strict=True)], dtype=object)


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def _from_wkb(raws: pd.Series) -> pd.Series:
    def one(raw):
        if raw is None or len(raw) < 5 or raw[0] > 1:
            return None
        end = "<" if raw[0] else ">"
        kind = struct.unpack_from(end + "I", raw, 1)[0]
        head = {1: 5, 2: 9}.get(kind)
        if head is None or len(raw) < head:
            return None
        n = 1 if kind == 1 else struct.unpack_from(end + "I", raw, 5)[0]
        return np.frombuffer(raw, end + "f8", 2 * n, head).reshape(n, 2).astype(float).tolist() if len(raw) == head + 16 * n else None

    return pd.Series([one(r) for r in raws], dtype=object)


def to_wkb(line: Column) -> Column:
    """Well-known binary (little-endian) of a point or line; null for null or empty geometries. Spark has no function for it."""
    return _wkb(F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"]))


def from_wkb(raw: Column) -> Column:
    """Coordinates of a Point or LineString in well-known binary, either byte order; null for other types and for cut bytes."""
    return F.transform(_from_wkb(raw), lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))
