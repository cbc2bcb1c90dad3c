"""Candidate joins between points and road segments over a square grid, nearest segments, and adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bound
from ..functions.geo import edge_gap, fraction_along, haversine, lat, local, lon, meets_box, metres, planar_square, projected, reach, transverse_mercator

#: Edge of a grid cell in micro-degrees.
CELL = 2000
MOST_METRES = 30.0


def cells_of_segments(segs: DataFrame, most_metres: float = MOST_METRES, cell: int = CELL) -> DataFrame:
    """segs with cx, cy: every cell that its box, widened by most_metres, touches. Points then need their own cell only."""
    east, north = reach(most_metres, F.col("y1"), F.col("y2"))
    held = bound(segs, _wide=east, _tall=north)
    for low, high, a, b, by in (("_left", "_right", "x1", "x2", "_wide"), ("_low", "_high", "y1", "y2", "_tall")):
        held = bound(held, **{low: F.floor((F.least(a, b) - F.col(by)) / cell), high: F.floor((F.greatest(a, b) + F.col(by)) / cell)})
    span = lambda low, high: F.explode(F.sequence(low, high))
    return held.withColumn("cx", span("_left", "_right")).withColumn("cy", span("_low", "_high")).select(*segs.columns, "cx", "cy")


def candidates(points: DataFrame, segs: DataFrame, most_metres: float = MOST_METRES) -> DataFrame:
    """Pairs of a point and the segments within most_metres of its cell: an equi-join on the cell, never a cross join."""
    located = points.withColumns({"cx": F.floor(F.col("x") / CELL), "cy": F.floor(F.col("y") / CELL)})
    return located.join(cells_of_segments(segs, most_metres), ["cx", "cy"])


def snapped(points: DataFrame, segs: DataFrame, most_metres: float = MOST_METRES) -> DataFrame:
    """candidates() with at, sx, sy: where on the segment its nearest place to the point lies; far ones are mostly left out.

    Pairs are first tested by the segment's widened box, within the join, before any place is computed.
    """
    east, north = reach(most_metres, F.col("y1"), F.col("y2"))
    boxed = segs.withColumns({"_west": F.least("x1", "x2") - east, "_east": F.greatest("x1", "x2") + east, "_south": F.least("y1", "y2") - north, "_north": F.greatest("y1", "y2") + north})
    inside = candidates(points, boxed, most_metres).where("x between _west and _east and y between _south and _north").drop("_west", "_east", "_south", "_north")
    placed = bound(inside, at=fraction_along(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    placed = bound(placed, sx=F.col("x1") + F.col("at") * (F.col("x2") - F.col("x1")), sy=F.col("y1") + F.col("at") * (F.col("y2") - F.col("y1")))
    return placed.where(planar_square(F.col("x"), F.col("y"), F.col("sx"), F.col("sy")) <= (1.01 * most_metres + 0.1) ** 2)


def near(points: DataFrame, segs: DataFrame, most_metres: float = MOST_METRES) -> DataFrame:
    """snapped() with distance (metres, rounded to 2 places), only segments within most_metres."""
    return bound(snapped(points, segs, most_metres), distance=haversine(F.col("x"), F.col("y"), F.col("sx"), F.col("sy"))).where(F.col("distance") <= most_metres)


def near_or_none(points: DataFrame, segs: DataFrame, most_metres: float = MOST_METRES) -> DataFrame:
    """near() by an outer join: every point has a row at least, and in rows of segments further off segment_id, distance, sx and sy are null.

    Points (one row a trace_id and idx) then need not be joined with what was found for them.
    """
    east, north = reach(most_metres, F.col("y1"), F.col("y2"))
    boxed = segs.select("segment_id", "x1", "y1", "x2", "y2", *(c.alias(n) for n, c in (("_west", F.least("x1", "x2") - east), ("_east", F.greatest("x1", "x2") + east), ("_south", F.least("y1", "y2") - north), ("_north", F.greatest("y1", "y2") + north))))
    located, spread = points.withColumns({"cx": F.floor(F.col("x") / CELL), "cy": F.floor(F.col("y") / CELL)}), cells_of_segments(boxed, most_metres)
    inside = (located["cx"] == spread["cx"]) & (located["cy"] == spread["cy"]) & F.col("x").between(F.col("_west"), F.col("_east")) & F.col("y").between(F.col("_south"), F.col("_north"))
    met = located.join(spread, inside, "left").select(*points.columns, "segment_id", "x1", "y1", "x2", "y2")
    placed = bound(met, at=fraction_along(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    placed = bound(placed, _x=F.col("x1") + F.col("at") * (F.col("x2") - F.col("x1")), _y=F.col("y1") + F.col("at") * (F.col("y2") - F.col("y1")))
    close = planar_square(F.col("x"), F.col("y"), F.col("_x"), F.col("_y")) <= (1.01 * most_metres + 0.1) ** 2
    placed = bound(placed, _d=F.when(close, haversine(F.col("x"), F.col("y"), F.col("_x"), F.col("_y"))))
    found = lambda c: F.when(F.col("_d") <= most_metres, F.col(c))
    return placed.select(*points.columns, found("segment_id").alias("segment_id"), found("_d").alias("distance"), found("_x").alias("sx"), found("_y").alias("sy"))


def nearest_or_none(points: DataFrame, segs: DataFrame, most_metres: float = MOST_METRES) -> DataFrame:
    """points (one row a trace_id and idx), each once, with segment_id, distance, sx, sy of the nearest segment within most_metres, ties to the smaller id; nulls without one."""
    w = Window.partitionBy("trace_id", "idx").orderBy(F.asc_nulls_last("distance"), "segment_id")
    return near_or_none(points, segs, most_metres).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def within_buffer(points: DataFrame, segs: DataFrame, metres_: float = 20.0) -> DataFrame:
    """trace_id, segment_id: the segments that come within metres_ of a trace's line, each once; a trace without any has one row with null.

    Edges and segments meet by grid cell. The buffer has round ends: a flat cap differs only beyond a trace's two ends.
    """
    w = Window.partitionBy("trace_id").orderBy("idx")
    steps = points.select("trace_id", F.lag("x").over(w).alias("ax"), F.lag("y").over(w).alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by")).where("ax is not null")
    east, north = reach(metres_, F.col("ay"), F.col("by"))
    span = lambda a, b, by: F.sequence(F.floor((F.least(a, b) - by) / CELL), F.floor((F.greatest(a, b) + by) / CELL))
    spread = steps.withColumn("cx", F.explode(span(F.col("ax"), F.col("bx"), east))).withColumn("cy", F.explode(span(F.col("ay"), F.col("by"), north)))
    met = spread.join(cells_of_segments(segs, 0.0), ["cx", "cy"])
    edge = lambda *c: tuple(v for i in (0, 2) for v in local(F.col(c[i]), F.col(c[i + 1]), F.col("y1")))
    close = met.where(edge_gap(edge("ax", "ay", "bx", "by"), edge("x1", "y1", "x2", "y2")) <= metres_ * metres_)
    return points.select("trace_id").distinct().join(close.select("trace_id", "segment_id").distinct(), "trace_id", "left")


def within_flat_buffer(points: DataFrame, segs: DataFrame, metres_: float = 20.0, meridian: float = -81.0) -> DataFrame:
    """within_buffer() on the UTM grid and with flat caps: the buffer ends where a trace ends, and is round where its edges join.

    Traces and segments are projected once, before they meet by grid cell.
    """

    def projected_(rows: DataFrame, *pairs: tuple[str, str, str, str]) -> DataFrame:
        made = {}
        for x, y, east, north in pairs:
            made[east], made[north] = transverse_mercator(lon(F.col(x)), lat(F.col(y)), meridian)
        return rows.withColumns(made)

    w = Window.partitionBy("trace_id").orderBy("idx")
    placed = projected_(points.select("trace_id", "idx", "x", "y"), ("x", "y", "e", "n"))
    steps = placed.select("trace_id", F.lag("x").over(w).alias("ax"), F.lag("y").over(w).alias("ay"), F.lag("e").over(w).alias("ae"), F.lag("n").over(w).alias("an"), F.lag("x", 2).over(w).isNotNull().alias("joined"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("e").alias("be"), F.col("n").alias("bn")).where("ax is not null")
    # Metres of the ellipsoid are up to 0.7 % more of a degree than those of the sphere that reach() takes.
    east, north = reach(1.01 * metres_, F.col("ay"), F.col("by"))
    steps = bound(steps, west=F.least("ax", "bx") - east, east=F.greatest("ax", "bx") + east, south=F.least("ay", "by") - north, north=F.greatest("ay", "by") + north)
    span = lambda low, high: F.sequence(F.floor(F.col(low) / CELL), F.floor(F.col(high) / CELL))
    spread = steps.withColumn("cx", F.explode(span("west", "east"))).withColumn("cy", F.explode(span("south", "north")))
    roads = projected_(segs, ("x1", "y1", "e1", "n1"), ("x2", "y2", "e2", "n2"))
    met = spread.join(cells_of_segments(roads, 0.0), ["cx", "cy"]).where("least(x1, x2) <= east and west <= greatest(x1, x2) and least(y1, y2) <= north and south <= greatest(y1, y2)")
    edge, road = tuple(F.col(c) for c in ("ae", "an", "be", "bn")), tuple(F.col(c) for c in ("e1", "n1", "e2", "n2"))
    close = met.where(meets_box(edge, road, metres_) | (F.col("joined") & (projected(*edge[:2], *road)["d2"] <= metres_ * metres_)))
    return points.select("trace_id").distinct().join(close.select("trace_id", "segment_id").distinct(), "trace_id", "left")


def nearest_segment(points: DataFrame, segs: DataFrame, most_metres: float = MOST_METRES) -> DataFrame:
    """trace_id, idx, segment_id, at, distance: the nearest segment within most_metres; ties to the smaller id.

    The exact distance is taken once, of the candidates that a planar filter leaves, and tested after the aggregation.
    """
    near = snapped(points, segs, most_metres).select("trace_id", "idx", haversine(F.col("x"), F.col("y"), F.col("sx"), F.col("sy")).alias("distance"), "segment_id", "at")
    best = near.groupBy("trace_id", "idx").agg(F.min(F.struct("distance", "segment_id", "at")).alias("b")).where(F.col("b.distance") <= most_metres)
    return best.select("trace_id", "idx", "b.segment_id", F.round("b.at", 6).alias("at"), "b.distance")


def candidate_counts(points: DataFrame, segs: DataFrame) -> DataFrame:
    """trace_id and how many distinct segments share a cell with one of its points."""
    return candidates(points, segs).select("trace_id", "segment_id").distinct().groupBy("trace_id").agg(F.count("*").alias("n_candidates"))


def adjacency(connectors: DataFrame) -> DataFrame:
    """segment_id, neighbour_id, connector_id: other segments at each connector; a pair that shares two connectors is kept twice."""
    other = connectors.select(F.col("segment_id").alias("neighbour_id"), "connector_id")
    return connectors.select("segment_id", "connector_id").join(other, "connector_id").where("segment_id <> neighbour_id").select("segment_id", "neighbour_id", "connector_id")


def connector_check(connectors: DataFrame) -> DataFrame:
    """Per segment: number of connectors, and whether it has them at 0 and at 1 and at least two."""
    c = connectors.groupBy("segment_id").agg(F.count("*").alias("n_connectors"), F.min("at").alias("first"), F.max("at").alias("last"))
    return c.select("segment_id", "n_connectors", ((F.col("first") == 0) & (F.col("last") == 1) & (F.col("n_connectors") >= 2)).alias("ends_connected"))


def placed_connectors(connectors: DataFrame, lines: DataFrame) -> DataFrame:
    """connectors (segment_id, connector_id, x, y) with on_line, and px, py: the connection point on the segment's edge.

    A connector whose coordinates are an end of the segment (segment_id, x1, y1, x2, y2) is on it; otherwise the
    connection point is the nearest place of the segment.
    """
    met = connectors.join(lines.select("segment_id", "x1", "y1", "x2", "y2"), "segment_id")
    x, y, edge = F.col("x"), F.col("y"), [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    on = ((x == edge[0]) & (y == edge[1])) | ((x == edge[2]) & (y == edge[3]))
    place = projected(x, y, *edge)
    return met.select("segment_id", "connector_id", on.alias("on_line"), F.when(on, x * 1.0).otherwise(place["x"]).alias("px"), F.when(on, y * 1.0).otherwise(place["y"]).alias("py"))


def length_share(segs: DataFrame) -> DataFrame:
    """subtype, length in km and its share of all length."""
    by = segs.groupBy("subtype").agg(F.sum(metres(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).alias("metres"))
    total = by.agg(F.sum("metres").alias("total"))  # one row
    return by.crossJoin(F.broadcast(total)).select("subtype", F.round(F.col("metres") / 1000, 2).alias("km"), F.round(F.col("metres") / F.col("total"), 4).alias("share"))


def first_distinct(segs: DataFrame, n: int) -> DataFrame:
    """The n smallest segment ids, after filtering; n of 0 or less means all."""
    ids = segs.select("segment_id").distinct()
    return ids.orderBy("segment_id").limit(n) if n > 0 else ids


def revisits(matched: DataFrame) -> DataFrame:
    """trace_id and how often a trace comes back to a segment that it has left (not its previous one)."""
    w, s = Window.partitionBy("trace_id").orderBy("idx"), Window.partitionBy("trace_id", "segment_id").orderBy("idx")
    seen = matched.withColumns({"before": F.lag("segment_id").over(w), "times": F.row_number().over(s)})
    again = (F.col("times") > 1) & (F.col("before") != F.col("segment_id"))
    return seen.groupBy("trace_id").agg(F.sum(again.cast("int")).cast("long").alias("n_revisits"), F.countDistinct("segment_id").alias("n_segments"))
