"""Registered queries on geometries, properties, scopes and buildings, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hours, lines, scopes
from ..functions.geo import lat, lon
from ..operators import features, matcher, polygons, spatial
from ..sources import adapters, readers
from ..sources.adapters import table
from .sql import METRES_RAW, SEGMENTS


def _bent(spark: SparkSession, d: str) -> DataFrame:
    """segment_id, line: each segment drawn across and then up; every third one is closed."""
    p = lambda x, y: F.struct(lon(x).alias("x"), lat(y).alias("y"))
    x1, y1, x2, y2 = map(F.col, ("x1", "y1", "x2", "y2"))
    first = p(x1, y1)
    tail = F.when(F.col("segment_id") % 3 == 0, F.array(first)).otherwise(F.array().cast(lines.COORDINATES))
    return adapters.segments(table(spark, d, "part")).select("segment_id", F.concat(F.array(first, p(x2, y1), p(x2, y2 + 500)), tail).alias("line"))


def f02_line_length(spark, d):
    return _bent(spark, d).select("segment_id", lines.line_length(F.col("line")).alias("metres"))


def f34_bbox(spark, d):
    b = _bent(spark, d).select("segment_id", lines.bbox(F.col("line")).alias("b"))
    return b.select("segment_id", *(F.round(f"b.{c}", 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))


def f35_point_at(spark, d):
    at = _bent(spark, d).select("segment_id", lines.point_at(F.col("line"), (F.col("segment_id") % 5) / 4.0).alias("p"))
    return at.select("segment_id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def d07_loops(spark, d):
    return _bent(spark, d).select("segment_id", lines.is_loop(F.col("line")).alias("is_loop"), lines.repeats_a_point(F.col("line")).alias("repeats_a_point"))


def s05_wkt_decode(spark, d):
    read = _bent(spark, d).select("segment_id", lines.from_wkt(lines.wkt_line(F.col("line"))).alias("line"))
    return read.select("segment_id", F.size("line").cast("long").alias("n_points"), F.round(F.element_at("line", 2)["x"], 6).alias("x2"))


def s06_geojson_decode(spark, d):
    """Segments as lines of GeoJSON text, every eleventh one broken, read again."""
    text = F.concat(F.lit('{"type":"Feature","id":"'), F.col("segment_id").cast("string"), F.lit('","geometry":'), lines.to_geojson(F.col("line")), F.lit(',"properties":{"level":"'), (F.col("segment_id") % 4).cast("string"), F.lit('"}},'))
    raw = _bent(spark, d).select(F.when(F.col("segment_id") % 11 == 0, F.lit("{broken")).otherwise(text).alias("value"))
    kept = readers.having(readers.features_of(raw, "value"), {"level": "2"})
    return kept.select(F.col("id").cast("long").alias("segment_id"), lines.line_length(F.col("geometry")).alias("metres"))


def a07_cell_index(spark, d):
    """Segments in each cell of the grid of whole micro-degrees."""
    p = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    cells = adapters.segments(table(spark, d, "part")).select("segment_id", F.explode(lines.line_cells(F.array(p("x1", "y1"), p("x2", "y2")), F.lit(spatial.CELL))).alias("c"))
    return cells.groupBy("c.cx", "c.cy").agg(F.count("*").alias("n"))


def f09_ring(spark, d):
    cell = F.array(F.struct(F.col("c_custkey").alias("cx"), F.col("c_nationkey").cast("long").alias("cy")))
    return table(spark, d, "customer").select("c_custkey", F.size(lines.ring_of_cells(cell, 1)).cast("long").alias("n_cells"))


def v10_column_errors(spark, d):
    """Customers as places with a whole-number balance."""
    places = table(spark, d, "customer").select("c_custkey", F.floor("c_acctbal").alias("balance"), F.when(F.col("c_custkey") % 13 != 0, F.col("c_mktsegment")).alias("category"), F.concat(F.when(F.col("c_custkey") % 7 == 0, " ").otherwise(""), "c_name").alias("name"))
    rules = [features.failing("category", "required", None), features.failing("category", "enum", ["FURNITURE", "BUILDING"]), features.failing("balance", "minimum", 0), features.failing("balance", "maximum", 9000), features.failing("name", "pattern", r"^(\S.*)?\S$"), features.failing("name", "maxLength", 18)]
    return features.validated(places, "c_custkey", *rules)


def u06_perspectives(spark, d):
    k = F.col("c_custkey") % 6
    named = table(spark, d, "customer").select("c_custkey", F.when(k == 0, F.array(F.lit("XA"), F.lit("XE"))).when(k == 1, F.array(F.lit("XM"))).alias("accepted_by"), F.when(k == 2, F.array(F.lit("XA"))).when(k == 3, F.array(F.lit("XM"))).alias("disputed_by"))
    return named.where(features.seen_from("XA")).select("c_custkey")


def _tags(spark: SparkSession, d: str) -> DataFrame:
    tags = ["name", "name:en", "official_name", "short_name", "alt_name:fr", "old_name", "ref", "name:de"]
    return table(spark, d, "part").select(F.expr("p_partkey div 8").alias("feature_id"), F.array(*map(F.lit, tags))[(F.col("p_partkey") % 8).cast("int")].alias("tag"), F.col("p_name").alias("value"))


def f29_name_variant(spark, d):
    return _tags(spark, d).select("feature_id", "tag", features.name_variant(F.col("tag")).alias("v")).where("v is not null").select("feature_id", "tag", "v.variant", "v.language")


def f30_names(spark, d):
    return features.names(_tags(spark, d)).select("feature_id", "primary", F.try_element_at("common", F.lit("en")).alias("name_en"), F.size("common").cast("long").alias("n_common"), F.size("rules").cast("long").alias("n_rules"))


def f31_units(spark, d):
    units = F.array(*map(F.lit, ("in", "ft", "yd", "mi", "cm", "m", "km", "stone")))
    unit = units[(F.col("o_orderkey") % 8).cast("int")]
    return table(spark, d, "orders").select("o_orderkey", F.round(scopes.in_metres(F.floor("o_totalprice").cast("double"), unit), 4).alias("metres"))


def r06_travel_modes(spark, d):
    k = F.col("o_orderkey") % 5
    modes = F.when(k == 0, F.array(F.lit("vehicle"))).when(k == 1, F.array(F.lit("bicycle"), F.lit("foot"))).when(k == 2, F.array(F.lit("truck"))).when(k == 3, F.array(F.lit("car"), F.lit("motor_vehicle")))
    return table(spark, d, "orders").select("o_orderkey", scopes.mode_holds(modes, "truck").alias("holds"))


def r10_open_at(spark, d):
    forms = ["Mo-Fr 15:00-18:00", "Sa-Mo 08:00-12:00,13:00-17:00", "Mo,We 09:00-10:00; Su 00:00-24:00", "22:00-06:00", "PH off"]
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", scopes.open_at(F.array(*map(F.lit, forms))[(k % 5).cast("int")], (F.expr("o_orderkey div 5") % 7).cast("int"), ((k * 7) % 1440).cast("int")).alias("is_open"))


def r14_turns(spark, d):
    """Turns into a segment whose id and the other's add up to a multiple of five are prohibited."""
    turns = spatial.adjacency(adapters.connectors(adapters.segments(table(spark, d, "part"))))
    return features.allowed_turns(turns, turns.where("(segment_id + neighbour_id) % 5 = 0")).groupBy("segment_id").agg(F.count("*").alias("n_turns"))


def d10_sources(spark, d):
    prop = F.when(F.col("l_linenumber") == 1, "").otherwise(F.concat(F.lit("/properties/p"), F.col("l_linenumber").cast("string")))
    sources = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("feature_id"), prop.alias("property"), F.concat(F.lit("set"), F.col("l_suppkey").cast("string")).alias("dataset"))
    return features.attributed(sources, "/properties/p2")


def d11_building_parts(spark, d):
    """Parts of the table as buildings on a grid, suppliers as their parts; every fifth supplier is a named member."""
    rect = lambda k, dx, dy, w, h: [((k % 100) * 1000 + dx).alias("x1"), (F.floor(k / 100) * 1000 + dy).alias("y1"), ((k % 100) * 1000 + dx + w).alias("x2"), (F.floor(k / 100) * 1000 + dy + h).alias("y2")]
    buildings = table(spark, d, "part").select(F.col("p_partkey").alias("id"), *rect(F.col("p_partkey"), 0, 0, 800, 800))
    s = F.col("s_suppkey")
    whole = s % 4 == 3
    parts = table(spark, d, "supplier").select(s.alias("id"), *rect(s * 2, F.when(whole, 0).otherwise(s % 3 * 300), 0, F.when(whole, 800).otherwise(300), F.when(whole, 800).otherwise(500)))
    members = table(spark, d, "supplier").where("s_suppkey % 5 = 0").select((s * 2 + 1).alias("building_id"), s.alias("part_id"))
    return features.parts_of_buildings(buildings, parts, members, 1000)


def d11_polygon_parts(spark, d):
    """Parts of the table as L-shaped buildings with a hole, suppliers as parts of many sizes; every seventh is named by a relation, some relations have two outlines."""
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    place = lambda n: ((n % 100) * 1000.0, F.floor(n / 100) * 1000.0)
    ring = lambda o, *at: F.array(*(F.struct((o[0] + a).alias("x"), (o[1] + b).alias("y")) for a, b in (*at, at[0])))
    corner = place(k)
    shape = F.array(ring(corner, (0, 0), (800, 0), (800, 400), (400, 400), (400, 800), (0, 800)), ring(corner, (100, 100), (100, 200), (200, 200), (200, 100)))
    buildings = table(spark, d, "part").select(k.alias("id"), shape.alias("rings"))
    low, x, y, w, h = place(s * 2), s % 7 * 100, s % 5 * 100, 100 + s % 6 * 100, 100 + s % 4 * 200
    box = F.array(ring(low, (x, y), (x + w, y), (x + w, y + h), (x, y + h)))
    whole = F.array(ring(low, (0, 0), (800, 0), (800, 400), (400, 400), (400, 800), (0, 800)), ring(low, (200, 100), (200, 200), (100, 200), (100, 100)))
    parts = table(spark, d, "supplier").select(s.alias("id"), F.when(s % 11 == 0, whole).otherwise(box).alias("rings"))
    named = table(spark, d, "supplier").where("s_suppkey % 7 = 0")
    outlines = named.select(s.alias("relation_id"), F.explode(F.when(s % 3 == 0, F.array(s * 2 + 1, s * 2 + 2)).otherwise(F.array(s * 2 + 1))).alias("member_id"), F.lit("outline").alias("role"))
    members = outlines.unionAll(named.select(s.alias("relation_id"), s.alias("member_id"), F.lit("part").alias("role")))
    return polygons.parts_of_buildings(buildings, parts, members, 1000.0)


def u02_scan_cells(spark, d):
    """Cells of 100 of triangles with a hole, by scan lines."""
    k = F.col("p_partkey")
    x, y, w = (k % 50) * 3700.0, F.floor(k / 50) * 4100.0, 1000.0 + (k % 7) * 300.0
    point = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    outer = F.array(point(F.lit(0.0), F.lit(0.0)), point(w, F.lit(0.0)), point(F.lit(0.0), w), point(F.lit(0.0), F.lit(0.0)))
    hole = F.array(*(point(F.lit(a), F.lit(b)) for a, b in ((100.0, 100.0), (100.0, 300.0), (300.0, 300.0), (300.0, 100.0), (100.0, 100.0))))
    shapes = table(spark, d, "part").select("p_partkey", F.array(outer, hole).alias("rings")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    cells = polygons.covered_cells(shapes, "p_partkey", "rings", 100.0)
    return cells.groupBy("p_partkey").agg(F.count("*").alias("n_cells"), F.sum("cx").cast("long").alias("sum_x"), F.sum("cy").cast("long").alias("sum_y"))


#: Opening hours, and the same as a test of a time ts (DuckDB).
HOURS = [
    ("Mo-Fr 08:00-12:00,13:00-17:30; Sa 09:00-12:00", "(isodow(ts) <= 5 AND (m >= 480 AND m < 720 OR m >= 780 AND m < 1050)) OR (isodow(ts) = 6 AND m >= 540 AND m < 720)"),
    ("24/7; Jan 10-20 off", "NOT (month(ts) = 1 AND day(ts) BETWEEN 10 AND 20)"), ("Fr-Sa 22:00-03:00", "(isodow(ts) IN (5, 6) AND m >= 1320) OR (isodow(ts) IN (6, 7) AND m < 180)"), ("week 01-53/2 10:00-18:00", "weekofyear(ts) % 2 = 1 AND m >= 600 AND m < 1080"),
    ("Nov-Mar Mo-Su,Sa 10:00-16:00; Apr-Oct 09:00+", "CASE WHEN month(ts) IN (11, 12, 1, 2, 3) THEN m >= 600 AND m < 960 ELSE m >= 540 END"), ("Mo[1],Mo[-1] 08:00-20:00 open", "isodow(ts) = 1 AND (day(ts) <= 7 OR month(ts + INTERVAL 7 DAY) <> month(ts)) AND m >= 480 AND m < 1200"),
    ("08:00-18:00; We off, We 10:00-11:00", "m >= CASE WHEN isodow(ts) = 3 THEN 600 ELSE 480 END AND m < CASE WHEN isodow(ts) = 3 THEN 660 ELSE 1080 END"), ("Sa 08:00-10:00 || 12:00-13:00", "CASE WHEN isodow(ts) = 6 THEN m >= 480 AND m < 600 ELSE m >= 720 AND m < 780 END"), ("sunrise-sunset", "NULL"), ("08:00-20:00; 12:00-13:00 off", "m >= 480 AND m < 1200 AND NOT (m >= 720 AND m < 780)"),
]


def r10_opening_hours(spark, d):
    """Events and whether the opening hours that their number names hold at their time."""
    k = F.col("event_id") % len(HOURS)
    rows = table(spark, d, "events").select("event_id", "ts", F.get(F.array(*(F.lit(t) for t, _ in HOURS)), k.cast("int")).alias("hours"))
    return hours.with_open(rows, "hours", F.col("ts").cast("timestamp")).select("event_id", "is_open")


def w04_match(spark, d):
    """No SQL: the best path depends on what it has passed; tests/test_matcher.py compares it with brute force."""
    part = table(spark, d, "part")
    return matcher.match(adapters.trace_points(table(spark, d, "events"), part), adapters.segments(part))


QUERIES = {f.__name__: f for f in (r10_opening_hours, d11_polygon_parts, u02_scan_cells, w04_match, f02_line_length, f34_bbox, f35_point_at, d07_loops, s05_wkt_decode, s06_geojson_decode, a07_cell_index, f09_ring, v10_column_errors, u06_perspectives, f29_name_variant, f30_names, f31_units, r06_travel_modes, r10_open_at, r14_turns, d10_sources, d11_building_parts)}

_L1, _L2 = METRES_RAW("x1", "y1", "x2", "y1"), METRES_RAW("x2", "y1", "x2", "y2 + 500")
_L3 = METRES_RAW("x2", "y2 + 500", "x1", "y1")
_LON, _LAT = "(-83.70::DOUBLE + {} / 1e6)", "(32.80::DOUBLE + {} / 1e6)"
_TAGS = """tags AS (SELECT p_partkey // 8 AS feature_id, ['name', 'name:en', 'official_name', 'short_name', 'alt_name:fr', 'old_name', 'ref', 'name:de'][p_partkey % 8 + 1] AS tag, p_name AS value FROM part),
named AS (SELECT *, CASE tag WHEN 'name' THEN 'common' WHEN 'name:en' THEN 'common' WHEN 'name:de' THEN 'common' WHEN 'official_name' THEN 'official' WHEN 'short_name' THEN 'short' WHEN 'alt_name:fr' THEN 'alternate' WHEN 'old_name' THEN 'alternate' END AS variant,
      CASE WHEN contains(tag, ':') THEN split_part(tag, ':', 2) END AS language FROM tags WHERE tag <> 'ref')"""
ORACLE_SQL = {
    "f02_line_length": f"WITH {SEGMENTS} SELECT segment_id, round({_L1} + {_L2} + CASE WHEN segment_id % 3 = 0 THEN {_L3} ELSE 0 END, 2) AS metres FROM seg",
    "f34_bbox": f"WITH {SEGMENTS} SELECT segment_id, round({_LON.format('x1')}, 6) AS xmin, round({_LAT.format('y1')}, 6) AS ymin, round({_LON.format('x2')}, 6) AS xmax, round({_LAT.format('(y2 + 500)')}, 6) AS ymax FROM seg",
    "f35_point_at": f"""WITH {SEGMENTS}, l AS (SELECT *, {_L1} AS l1, {_L2} AS l2, CASE WHEN segment_id % 3 = 0 THEN {_L3} ELSE 0 END AS l3, (segment_id % 5) / 4.0::DOUBLE AS s FROM seg), q AS (SELECT *, s * (l1 + l2 + l3) AS t, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce((s * (l1 + l2 + l3) - l1 - l2) / nullif(l3, 0), 0))) AS back FROM l)
        SELECT segment_id, round(CASE WHEN t <= l1 THEN {_LON.format('x1')} + coalesce(t / nullif(l1, 0), 0) * ({_LON.format('x2')} - {_LON.format('x1')}) ELSE {_LON.format('x2')} + back * ({_LON.format('x1')} - {_LON.format('x2')}) END, 6) AS x,
        round(CASE WHEN t <= l1 THEN {_LAT.format('y1')} ELSE {_LAT.format('y1')} + (least(1.0::DOUBLE, (t - l1) / l2) - back) * ({_LAT.format('(y2 + 500)')} - {_LAT.format('y1')}) END, 6) AS y FROM q""",
    "d07_loops": f"WITH {SEGMENTS} SELECT segment_id, segment_id % 3 = 0 AS is_loop, x1 = x2 AS repeats_a_point FROM seg",
    "s05_wkt_decode": f"WITH {SEGMENTS} SELECT segment_id, CASE WHEN segment_id % 3 = 0 THEN 4 ELSE 3 END::BIGINT AS n_points, round({_LON.format('x2')}, 6) AS x2 FROM seg",
    "s06_geojson_decode": f"WITH {SEGMENTS} SELECT segment_id, round({_L1} + {_L2} + CASE WHEN segment_id % 3 = 0 THEN {_L3} ELSE 0 END, 2) AS metres FROM seg WHERE segment_id % 11 <> 0 AND segment_id % 4 = 2",
    "a07_cell_index": f"""WITH {SEGMENTS}, c AS (SELECT segment_id, unnest(generate_series(CAST(x1 // 2000 AS BIGINT), CAST(x2 // 2000 AS BIGINT))) AS cx, y1, y2 FROM seg),
        e AS (SELECT cx, unnest(generate_series(CAST(y1 // 2000 AS BIGINT), CAST(y2 // 2000 AS BIGINT))) AS cy FROM c) SELECT cx, cy, count(*) AS n FROM e GROUP BY 1, 2""",
    "f09_ring": "SELECT c_custkey, 9::BIGINT AS n_cells FROM customer",
    "v10_column_errors": r"""WITH p AS (SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS balance, CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END AS category, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE '' END || c_name AS name FROM customer)
        SELECT c_custkey, '/properties/category' AS path, 'required' AS keyword, 'missing property ''category''' AS message FROM p WHERE category IS NULL
        UNION ALL SELECT c_custkey, '/properties/category', 'enum', 'value must be one of ''FURNITURE'', ''BUILDING''' FROM p WHERE category NOT IN ('FURNITURE', 'BUILDING')
        UNION ALL SELECT c_custkey, '/properties/balance', 'minimum', 'minimum: got ' || balance || ', want 0' FROM p WHERE balance < 0
        UNION ALL SELECT c_custkey, '/properties/balance', 'maximum', 'maximum: got ' || balance || ', want 9000' FROM p WHERE balance > 9000
        UNION ALL SELECT c_custkey, '/properties/name', 'pattern', '''' || name || ''' does not match pattern ''^(\S.*)?\S$''' FROM p WHERE name LIKE ' %'
        UNION ALL SELECT c_custkey, '/properties/name', 'maxLength', 'maxLength: got ' || length(name) || ', want 18' FROM p WHERE length(name) > 18""",
    "u06_perspectives": "SELECT c_custkey FROM customer WHERE c_custkey % 6 IN (0, 3, 4, 5)",
    "f29_name_variant": f"WITH {_TAGS} SELECT feature_id, tag, variant, language FROM named",
    "f30_names": f"""WITH {_TAGS} SELECT feature_id, min(CASE WHEN tag = 'name' THEN value END) AS "primary", min(CASE WHEN tag = 'name:en' THEN value END) AS name_en,
        count(DISTINCT CASE WHEN variant = 'common' THEN language END) AS n_common, count(DISTINCT CASE WHEN variant <> 'common' THEN tag || ' ' || value END) AS n_rules FROM named GROUP BY 1""",
    "f31_units": "SELECT o_orderkey, round(floor(o_totalprice) * CASE o_orderkey % 8 WHEN 0 THEN 0.0254::DOUBLE WHEN 1 THEN 0.3048::DOUBLE WHEN 2 THEN 0.9144::DOUBLE WHEN 3 THEN 1609.344::DOUBLE WHEN 4 THEN 0.01::DOUBLE WHEN 5 THEN 1.0::DOUBLE WHEN 6 THEN 1000.0::DOUBLE END, 4) AS metres FROM orders",
    "r06_travel_modes": "SELECT o_orderkey, o_orderkey % 5 <> 1 AS holds FROM orders",
    "r10_open_at": """WITH t AS (SELECT o_orderkey, o_orderkey % 5 AS k, (o_orderkey // 5) % 7 AS day, (o_orderkey * 7) % 1440 AS m FROM orders)
        SELECT o_orderkey, CASE k WHEN 0 THEN day < 5 AND m >= 900 AND m < 1080 WHEN 1 THEN day IN (5, 6, 0) AND ((m >= 480 AND m < 720) OR (m >= 780 AND m < 1020))
        WHEN 2 THEN (day IN (0, 2) AND m >= 540 AND m < 600) OR day = 6 WHEN 3 THEN m >= 1320 OR m < 360 END AS is_open FROM t""",
    "r14_turns": f"WITH {SEGMENTS}, con AS (SELECT segment_id, from_node AS connector_id FROM seg UNION ALL SELECT segment_id, to_node FROM seg) SELECT a.segment_id, count(*) AS n_turns FROM con a JOIN con b USING (connector_id) WHERE a.segment_id <> b.segment_id AND (a.segment_id + b.segment_id) % 5 <> 0 GROUP BY 1",
    "d10_sources": "SELECT l_orderkey AS feature_id, coalesce(min(CASE WHEN l_linenumber = 2 THEN 'set' || l_suppkey END), min(CASE WHEN l_linenumber = 1 THEN 'set' || l_suppkey END)) AS dataset FROM lineitem GROUP BY 1",
    "u02_scan_cells": """WITH t AS (SELECT p_partkey, (p_partkey % 50) * 37 AS x, (p_partkey // 50) * 41 AS y, 10 + (p_partkey % 7) * 3 AS w FROM part),
        c AS (SELECT p_partkey, x + i AS cx, y + j AS cy, i, j, w FROM t, range(-1, 31) a(i), range(-1, 31) b(j))
        SELECT p_partkey, count(*) AS n_cells, sum(cx)::BIGINT AS sum_x, sum(cy)::BIGINT AS sum_y FROM c
        WHERE i >= 0 AND j >= 0 AND i + j <= w AND (i = 0 OR j = 0 OR i + j + 1 >= w OR NOT (i IN (1, 2) AND j IN (1, 2))) GROUP BY 1""",
    "d11_polygon_parts": """WITH b AS (SELECT p_partkey AS id FROM part),
        p AS (SELECT s_suppkey AS id, s_suppkey * 2 AS home, s_suppkey % 7 * 100 AS x, s_suppkey % 5 * 100 AS y, 100 + s_suppkey % 6 * 100 AS w, 100 + s_suppkey % 4 * 200 AS h, s_suppkey % 11 = 0 AS whole FROM supplier),
        q AS (SELECT p.id AS part_id, b.id AS building_id, whole FROM p JOIN b ON b.id = home WHERE whole OR (x + w <= 800 AND y + h <= 800 AND (x + w <= 400 OR y + h <= 400) AND NOT (x < 200 AND x + w > 100 AND y < 200 AND y + h > 100))),
        r AS (SELECT p.id AS part_id, b.id AS building_id FROM p JOIN b ON b.id = p.id * 2 + 1 WHERE p.id % 7 = 0 AND p.id % 3 <> 0),
        e AS (SELECT r.part_id, r.building_id, FALSE AS same, TRUE AS explicit FROM r
              UNION ALL SELECT part_id, building_id, whole, building_id IN (SELECT building_id FROM r) FROM q WHERE part_id NOT IN (SELECT part_id FROM r))
        SELECT part_id, building_id, explicit FROM e QUALIFY NOT (count(*) OVER (PARTITION BY building_id) = 1 AND same)""",
    "r10_opening_hours": f"WITH e AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, hour(CAST(ts AS TIMESTAMP)) * 60 + minute(CAST(ts AS TIMESTAMP)) AS m FROM events) SELECT event_id, CASE event_id % {len(HOURS)} {' '.join(f'WHEN {n} THEN {test}' for n, (_, test) in enumerate(HOURS))} END AS is_open FROM e",
    "d11_building_parts": """WITH b AS (SELECT p_partkey AS id, (p_partkey % 100) * 1000 AS x1, (p_partkey // 100) * 1000 AS y1 FROM part),
        p AS (SELECT s_suppkey AS id, (s_suppkey * 2 % 100) * 1000 + CASE WHEN s_suppkey % 4 = 3 THEN 0 ELSE s_suppkey % 3 * 300 END AS x1, (s_suppkey * 2 // 100) * 1000 AS y1, CASE WHEN s_suppkey % 4 = 3 THEN 800 ELSE 300 END AS w, CASE WHEN s_suppkey % 4 = 3 THEN 800 ELSE 500 END AS h FROM supplier),
        e AS (SELECT p.id AS part_id, b.id AS building_id, p.x1 = b.x1 AND p.y1 = b.y1 AND w = 800 AS same, TRUE AS explicit FROM p JOIN b ON b.id = p.id * 2 + 1 WHERE p.id % 5 = 0
              UNION ALL SELECT p.id, min(b.id), bool_or(p.x1 = b.x1 AND p.y1 = b.y1 AND w = 800), FALSE FROM p JOIN b ON b.x1 <= p.x1 AND p.x1 + w <= b.x1 + 800 AND b.y1 <= p.y1 AND p.y1 + h <= b.y1 + 800 WHERE p.id % 5 <> 0 GROUP BY 1)
        SELECT part_id, building_id, explicit FROM e QUALIFY NOT (count(*) OVER (PARTITION BY building_id) = 1 AND same)""",
}
