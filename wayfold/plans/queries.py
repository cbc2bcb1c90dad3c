"""Registered queries of the map operators over the star-schema tables, with DuckDB SQL for each."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, tags
from ..operators import divisions, rules, spatial, traces
from ..sources import adapters
from ..sources.adapters import table
from ..sources.storage import spread, tasks_for


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return adapters.segments(table(spark, d, "part"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    return adapters.trace_points(table(spark, d, "events"), table(spark, d, "part"))


def _divisions(spark: SparkSession, d: str) -> DataFrame:
    return adapters.divisions(*(table(spark, d, t) for t in ("region", "nation", "customer")))


def _rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules dealt by segment, as _facts() are: joins and groupings by segment need no other exchange, and a task's share does not grow with the table."""
    return adapters.rules(spread(table(spark, d, "lineitem"), "l_orderkey"))


def _matched(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest_segment(_points(spark, d), _segments(spark, d))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    dealt = spread(table(spark, d, "orders"), "o_orderkey", n=tasks_for(table(spark, d, "lineitem")))
    return dealt.select(k.cast("long").alias("segment_id"), (F.pmod(k, F.lit(8)) / 8.0).alias("fact_position"), F.when(F.pmod(k, F.lit(2)) == 0, "forward").otherwise("backward").alias("fact_heading"))


def j04_nearest_segment(spark, d):
    return _matched(spark, d)


def j01_candidates(spark, d):
    return spatial.candidate_counts(_points(spark, d), _segments(spark, d))


def j03_adjacency(spark, d):
    return spatial.adjacency(adapters.connectors(_segments(spark, d)))


def d06_connector_check(spark, d):
    return spatial.connector_check(adapters.connectors(_segments(spark, d)))


def a13_length_share(spark, d):
    return spatial.length_share(_segments(spark, d))


def o04_first_features(spark, d):
    return spatial.first_distinct(_segments(spark, d).where("subtype = 'road'"), 50)


def w02_trace_steps(spark, d):
    return traces.steps(_points(spark, d)).select("trace_id", "idx", "step_m", "step_s")


def d13_trace_parts(spark, d):
    cut = traces.parts(_points(spark, d), gap_m=100.0)
    return cut.groupBy("trace_id", "part").agg(F.count("*").alias("n_points"), F.min("idx").alias("first_idx"))


def a01_trace_metrics(spark, d):
    return traces.metrics(_points(spark, d), _matched(spark, d))


def a02_totals(spark, d):
    return traces.totals(traces.metrics(_points(spark, d), _matched(spark, d)))


def w08_revisits(spark, d):
    return spatial.revisits(_matched(spark, d))


def a03_error_rate(spark, d):
    """Labels: the matched segment, or the next one for every seventh point."""
    m = _matched(spark, d)
    labels = m.select("trace_id", "idx", F.when(F.col("idx") % 7 == 3, F.col("segment_id") + 1).otherwise(F.col("segment_id")).alias("label_id"))
    return traces.error_rate(m, labels, traces.steps(_points(spark, d)))


def d14_segment_speed(spark, d):
    return traces.segment_speed(_points(spark, d), _matched(spark, d))


def r12_speed_limit(spark, d):
    """The determining rule's maximum, minimum and whether the maximum is variable; 50, none and false without a rule."""
    limits = _rules(spark, d).withColumns({"min_speed": F.when(F.col("position") % 3 == 0, F.col("max_speed") - 10), "is_variable": F.col("position") % 4 == 1})
    return rules.deciding(limits, _facts(spark, d), {"max_speed": 50, "min_speed": None, "is_variable": False}).withColumn("min_speed", F.col("min_speed").cast("long"))


def r13_access(spark, d):
    return rules.deciding(_rules(spark, d), _facts(spark, d), {"access_type": "allowed"})


def r16_intervals(spark, d):
    return rules.elementary_intervals(_rules(spark, d), "access_type")


def g05_ancestors(spark, d):
    return divisions.ancestors(_divisions(spark, d))


def d02_norms(spark, d):
    return divisions.inherited(_divisions(spark, d), "driving_side")


def d03_codes(spark, d):
    """Country and region codes: a division's own, else those of the nearest division above it."""
    return divisions.inherited(_divisions(spark, d), "country", "region")


def d03_population(spark, d):
    return divisions.rollup(_divisions(spark, d), "population")


def d04_invariants(spark, d):
    """Hierarchies from the tree, with faults by population: no parent, a path that ends too early, one that starts too late, none, and another parent."""
    divs = divisions.hierarchies(_divisions(spark, d))
    path = F.get("hierarchies", F.lit(0))
    k = F.when(F.col("subtype") == "locality", F.col("population") % 10)
    broken = F.when(k == 1, F.array(F.slice(path, 1, 2))).when(k == 2, F.array(path, F.slice(path, 2, 2))).when(k == 3, F.array().cast(divs.schema["hierarchies"].dataType)).otherwise(F.col("hierarchies"))
    parent = F.when(k == 0, None).when(k == 4, F.get(path, F.lit(0))["division_id"]).otherwise(F.col("parent_id"))
    return divisions.invariants(divs.withColumns({"hierarchies": broken, "parent_id": F.when(F.col("division_id") == "c1", "c2").otherwise(parent)}))


def f26_heights(spark, d):
    return adapters.heights(table(spark, d, "part")).select("feature_id", "height", tags.height_metres(F.col("height")).alias("metres"))


def a12_height_formats(spark, d):
    return adapters.heights(table(spark, d, "part")).groupBy(tags.height_format(F.col("height")).alias("format")).agg(F.count("*").alias("n"))


#: Rules in the published form: key, values, subtype, class; the first that fits decides.
INFRASTRUCTURE = [("highway", ["bus_stop"], "transit", "bus_stop"), ("aeroway", ["gate"], "airport", "airport_gate"), ("amenity", ["clinic", "hospital"], "medical", "hospital"), ("barrier", ["fence"], "barrier", "fence")]


def f25_classes(spark, d):
    """Parts with tags: key and value by their number, some in capitals, with blanks, or with two tags."""
    k = F.col("p_partkey")
    values = F.array(*map(F.lit, ["bus_stop", " GATE ", "Hospital", "clinic", "fence"]))
    keys = F.array(*map(F.lit, ["highway", "aeroway", "amenity", "amenity", "barrier"]))
    own = F.create_map(keys[(k % 5).cast("int")], values[(k % 5).cast("int")])
    both = F.when(k % 3 == 0, F.map_concat(own, F.create_map(F.lit("surface"), F.col("p_brand")))).when(k % 7 == 1, F.create_map(F.lit("barrier"), F.lit("fence"), F.lit("highway"), F.lit("bus_stop"))).when(k % 11 == 2, F.create_map(F.lit("highway"), F.lit("other"))).otherwise(own)
    c = table(spark, d, "part").select(k.alias("feature_id"), both.alias("tags")).select("feature_id", tags.class_of(F.col("tags"), INFRASTRUCTURE).alias("c"), tags.tag(F.col("tags"), "surface").alias("surface"))
    return c.select("feature_id", "c.subtype", "c.class", "surface")


def f12_wkt(spark, d):
    return _segments(spark, d).select("segment_id", geo.wkt_point(F.col("x1"), F.col("y1")).alias("start_wkt"))


QUERIES = {f.__name__: f for f in (j04_nearest_segment, j01_candidates, j03_adjacency, d06_connector_check, a13_length_share, o04_first_features, w02_trace_steps, d13_trace_parts, a01_trace_metrics, a02_totals, w08_revisits, a03_error_rate, d14_segment_speed, r12_speed_limit, r13_access, r16_intervals, g05_ancestors, d02_norms, d03_codes, d03_population, d04_invariants, f26_heights, a12_height_formats, f25_classes, f12_wkt)}

_SEG = """
side AS (SELECT CAST(floor(sqrt(coalesce(max(p_partkey), 0) / 2)) AS BIGINT) + 2 AS n FROM part),
k AS (SELECT CAST(p_partkey AS BIGINT) AS segment_id, n, n * (n - 1) AS m, CAST(p_size AS BIGINT) AS width FROM part, side),
p AS (SELECT *, segment_id < m AS flat, CASE WHEN segment_id < m THEN (segment_id % m) // (n - 1) ELSE (segment_id % m) % (n - 1) END AS r,
      CASE WHEN segment_id < m THEN (segment_id % m) % (n - 1) ELSE (segment_id % m) // (n - 1) END AS c FROM k),
seg AS (SELECT segment_id, c * 2000 AS x1, r * 2000 AS y1, c * 2000 + CASE WHEN flat THEN 2000 ELSE 0 END AS x2, r * 2000 + CASE WHEN flat THEN 0 ELSE 2000 END AS y2,
      r * n + c AS from_node, CASE WHEN flat THEN r * n + c + 1 ELSE (r + 1) * n + c END AS to_node,
      CASE WHEN segment_id % 7 = 0 THEN 'rail' WHEN segment_id % 11 = 0 THEN 'water' ELSE 'road' END AS subtype FROM p)
"""
_POINTS = """
e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events),
pts AS (SELECT CAST(user_id AS BIGINT) AS trace_id, CAST(idx AS BIGINT) AS idx, ts, (idx * 500) % (2000 * (n - 1)) AS x, (user_id % n) * 2000 + ((event_id * 31) % 9 - 4) * 10 AS y FROM e, side)
"""


def _raw(x1: str, y1: str, x2: str, y2: str) -> str:
    lat, lon = (lambda v: f"radians(32.80::DOUBLE + {v} / 1e6)"), (lambda v: f"radians(-83.70::DOUBLE + {v} / 1e6)")
    s = f"sin(({lat(y2)} - {lat(y1)}) / 2)"
    t = f"sin(({lon(x2)} - {lon(x1)}) / 2)"
    return f"12742017.6::DOUBLE * asin(sqrt({s} * {s} + cos({lat(y1)}) * cos({lat(y2)}) * {t} * {t}))"


def _metres(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"round({_raw(x1, y1, x2, y2)}, 2)"


_MATCHED = f"""
near AS (SELECT trace_id, idx, segment_id, "at", x, y, x1 + "at" * (x2 - x1) AS sx, y1 + "at" * (y2 - y1) AS sy FROM (
      SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1))::DOUBLE / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))::DOUBLE)) AS "at"
      FROM pts JOIN seg ON x BETWEEN x1 - 400 AND x2 + 400 AND y BETWEEN y1 - 400 AND y2 + 400)),
dist AS (SELECT trace_id, idx, segment_id, "at", {_metres("x", "y", "sx", "sy")} AS distance FROM near),
matched AS (SELECT trace_id, idx, segment_id, round("at", 6) AS "at", distance FROM dist WHERE distance <= 30 QUALIFY row_number() OVER (PARTITION BY trace_id, idx ORDER BY distance, segment_id) = 1)
"""
_STEPS = f"""
steps AS (SELECT trace_id, idx, {_metres("px", "py", "x", "y")} AS step_m, {_raw("px", "py", "x", "y")} AS raw_m, round((epoch_us(ts) - epoch_us(pt)) / 1e6, 3) AS step_s FROM (
      SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(ts) OVER w AS pt FROM pts WINDOW w AS (PARTITION BY trace_id ORDER BY idx)))
"""
_METRICS = """
metrics AS (SELECT l.trace_id, n_points, length_m, mean_distance_m, coalesce(n_matched, 0) AS n_matched, round(100.0::DOUBLE * coalesce(n_matched, 0) / n_points, 2) AS percent_matched
      FROM (SELECT trace_id, count(*) AS n_points, round(sum(raw_m), 2) AS length_m FROM steps GROUP BY 1) l
      LEFT JOIN (SELECT trace_id, count(*) AS n_matched, round(avg(distance), 2) AS mean_distance_m FROM matched GROUP BY 1) r USING (trace_id))
"""
_RULES = """
rules AS (SELECT CAST(l_orderkey AS BIGINT) AS segment_id, CAST(l_linenumber AS BIGINT) AS position, (l_linenumber - 1) / 8.0::DOUBLE AS low, least(1.0::DOUBLE, (l_linenumber - 1) / 8.0::DOUBLE + floor(l_quantity) / 25.0::DOUBLE) AS high,
      CASE WHEN l_linestatus = 'O' THEN 'forward' WHEN l_quantity < 10 THEN NULL ELSE 'backward' END AS heading,
      CASE WHEN l_returnflag = 'A' THEN 'allowed' WHEN l_returnflag = 'R' THEN 'denied' ELSE 'designated' END AS access_type, CAST(floor(l_quantity) * 2 + 10 AS BIGINT) AS max_speed FROM lineitem),
facts AS (SELECT CAST(o_orderkey AS BIGINT) AS segment_id, (o_orderkey % 8) / 8.0::DOUBLE AS fact_position, CASE WHEN o_orderkey % 2 = 0 THEN 'forward' ELSE 'backward' END AS fact_heading FROM orders)
"""
_DIVISIONS = """
divs AS (SELECT 'c' || r_regionkey AS division_id, NULL::VARCHAR AS parent_id, 'country' AS subtype, 'X' || substring(r_name, 1, 1) AS country, NULL::VARCHAR AS region, CASE WHEN r_regionkey % 2 = 0 THEN 'right' ELSE 'left' END AS driving_side, 0::BIGINT AS population FROM region
      UNION ALL SELECT 'r' || n_nationkey, 'c' || n_regionkey, 'region', NULL, 'X-' || n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'left' END, 0 FROM nation
      UNION ALL SELECT 'l' || c_custkey, 'r' || c_nationkey, 'locality', NULL, NULL, CASE WHEN c_custkey % 97 = 0 THEN 'left' END, CAST(floor(abs(c_acctbal)) AS BIGINT) FROM customer),
up AS (SELECT division_id, division_id AS ancestor_id, parent_id, 0::BIGINT AS depth FROM divs UNION ALL SELECT up.division_id, d.division_id, d.parent_id, depth + 1 FROM up JOIN divs d ON up.parent_id = d.division_id)
"""
_HEIGHTS = """
heights AS (SELECT CAST(p_partkey AS BIGINT) AS feature_id, CASE p_partkey % 13 WHEN 0 THEN s WHEN 1 THEN s || ' m' WHEN 2 THEN s || '.5m' WHEN 3 THEN s || ' ft' WHEN 4 THEN s || '. ''' WHEN 5 THEN ' ' || s || '''  6.5" ' WHEN 6 THEN s || '"' WHEN 7 THEN 'tall' WHEN 8 THEN ' ' || s || '.25 meters ' WHEN 9 THEN s || '.' WHEN 10 THEN s || '. metre' WHEN 11 THEN s || '.65feet ' ELSE s || ' in' END AS height,
      p_size::DOUBLE AS v, p_partkey % 13 AS form FROM (SELECT *, CAST(p_size AS VARCHAR) AS s FROM part))
"""


def _deciding(value: str, default: str) -> str:
    return f"""WITH {_RULES}, hit AS (SELECT segment_id, fact_position, fact_heading, {value} AS v, position FROM facts f JOIN rules r USING (segment_id)
        WHERE low <= fact_position AND fact_position <= high AND (heading IS NULL OR heading = fact_heading) QUALIFY row_number() OVER (PARTITION BY segment_id, fact_position, fact_heading ORDER BY position DESC, {value} DESC) = 1)
        SELECT f.segment_id, f.fact_position, f.fact_heading, coalesce(v, {default}) AS {value} FROM facts f LEFT JOIN hit h ON f.segment_id = h.segment_id AND f.fact_position = h.fact_position AND f.fact_heading = h.fact_heading"""


_NORTH = f"{math.ceil(30.0 / (6371008.8 * math.pi / 180) * 1.001 * 1e6)}"
_EAST = f"ceil({30.0 / (6371008.8 * math.pi / 180) * 1.001 * 1e6!r}::DOUBLE / cos(radians(32.80::DOUBLE + y2 / 1e6 + {30.0 / (6371008.8 * math.pi / 180) * 1.001!r}::DOUBLE)))"
_ALL = f"WITH {_SEG}, {_POINTS}, {_MATCHED}, {_STEPS}, {_METRICS}"
ORACLE_SQL = {
    "j04_nearest_segment": f"WITH {_SEG}, {_POINTS}, {_MATCHED} SELECT trace_id, idx, segment_id, \"at\", distance FROM matched",
    "j01_candidates": f"""WITH {_SEG}, {_POINTS} SELECT trace_id, count(DISTINCT segment_id) AS n_candidates FROM pts JOIN seg
        ON floor(x / 2000) BETWEEN floor((x1 - {_EAST}) / 2000) AND floor((x2 + {_EAST}) / 2000) AND floor(y / 2000) BETWEEN floor((y1 - {_NORTH}) / 2000) AND floor((y2 + {_NORTH}) / 2000) GROUP BY 1""",
    "j03_adjacency": f"WITH {_SEG}, con AS (SELECT segment_id, from_node AS connector_id FROM seg UNION ALL SELECT segment_id, to_node FROM seg) SELECT a.segment_id, b.segment_id AS neighbour_id, connector_id FROM con a JOIN con b USING (connector_id) WHERE a.segment_id <> b.segment_id",
    "d06_connector_check": f"WITH {_SEG} SELECT segment_id, 2::BIGINT AS n_connectors, TRUE AS ends_connected FROM seg",
    "a13_length_share": f"WITH {_SEG}, l AS (SELECT subtype, sum({_raw('x1', 'y1', 'x2', 'y2')}) AS metres FROM seg GROUP BY 1) SELECT subtype, round(metres / 1000, 2) AS km, round(metres / (SELECT sum(metres) FROM l), 4) AS share FROM l",
    "o04_first_features": f"WITH {_SEG} SELECT segment_id FROM seg WHERE subtype = 'road' ORDER BY 1 LIMIT 50",
    "w02_trace_steps": f"WITH {_SEG}, {_POINTS}, {_STEPS} SELECT trace_id, idx, step_m, step_s FROM steps",
    "d13_trace_parts": f"WITH {_SEG}, {_POINTS}, {_STEPS} SELECT trace_id, part, count(*) AS n_points, min(idx) AS first_idx FROM (SELECT trace_id, idx, CAST(sum(CASE WHEN step_m > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY idx) AS BIGINT) AS part FROM steps) GROUP BY 1, 2",
    "a01_trace_metrics": f"{_ALL} SELECT trace_id, n_points, length_m, n_matched, mean_distance_m, percent_matched FROM metrics",
    "a02_totals": f"{_ALL}, t AS (SELECT count(*) AS n_traces, CAST(sum(n_points) AS BIGINT) AS n_points, round(sum(length_m) / 1000, 2) AS km, round(avg(mean_distance_m), 2) AS mean_distance_m, CAST(sum(n_matched) AS BIGINT) AS n_matched FROM metrics) SELECT *, round(n_points / nullif(km, 0), 2) AS points_per_km FROM t",
    "w08_revisits": f"WITH {_SEG}, {_POINTS}, {_MATCHED}, s AS (SELECT trace_id, segment_id, lag(segment_id) OVER (PARTITION BY trace_id ORDER BY idx) AS before, row_number() OVER (PARTITION BY trace_id, segment_id ORDER BY idx) AS times FROM matched) SELECT trace_id, CAST(sum(CASE WHEN times > 1 AND before <> segment_id THEN 1 ELSE 0 END) AS BIGINT) AS n_revisits, count(DISTINCT segment_id) AS n_segments FROM s GROUP BY 1",
    "a03_error_rate": f"""{_ALL}, l AS (SELECT m.trace_id, coalesce(step_m, 0) AS metres, CASE WHEN m.idx % 7 = 3 THEN coalesce(step_m, 0) ELSE 0 END AS wrong FROM matched m JOIN steps s ON m.trace_id = s.trace_id AND m.idx = s.idx),
        t AS (SELECT trace_id, round(sum(metres), 2) AS total_distance, round(sum(wrong), 2) AS wrong_distance FROM l GROUP BY 1) SELECT *, CASE WHEN total_distance = 0 THEN -1.0::DOUBLE ELSE round(wrong_distance / total_distance, 4) END AS error_rate FROM t""",
    "d14_segment_speed": f"{_ALL} SELECT segment_id, count(*) AS n, round(3.6::DOUBLE * sum(step_m) / sum(step_s), 4) AS kmh FROM steps JOIN matched USING (trace_id, idx) WHERE step_s > 0 GROUP BY 1",
    "r12_speed_limit": f"""WITH {_RULES}, hit AS (SELECT segment_id, fact_position, fact_heading, max_speed, CASE WHEN position % 3 = 0 THEN max_speed - 10 END AS min_speed, position % 4 = 1 AS is_variable FROM facts f JOIN rules r USING (segment_id)
        WHERE low <= fact_position AND fact_position <= high AND (heading IS NULL OR heading = fact_heading) QUALIFY row_number() OVER (PARTITION BY segment_id, fact_position, fact_heading ORDER BY position DESC, max_speed DESC) = 1)
        SELECT f.segment_id, f.fact_position, f.fact_heading, coalesce(max_speed, 50) AS max_speed, min_speed, coalesce(is_variable, FALSE) AS is_variable FROM facts f LEFT JOIN hit h ON f.segment_id = h.segment_id AND f.fact_position = h.fact_position AND f.fact_heading = h.fact_heading""",
    "r13_access": _deciding("access_type", "'allowed'"),
    "r16_intervals": f"""WITH {_RULES}, ends AS (SELECT segment_id, low AS e FROM rules UNION SELECT segment_id, high FROM rules), parts AS (SELECT segment_id, e AS f, lead(e) OVER (PARTITION BY segment_id ORDER BY e) AS t FROM ends)
        SELECT segment_id, round(f, 6) AS low, round(t, 6) AS high, access_type FROM parts JOIN rules USING (segment_id) WHERE t IS NOT NULL AND low <= f AND t <= high QUALIFY row_number() OVER (PARTITION BY segment_id, f, t ORDER BY position DESC, access_type DESC) = 1""",
    "g05_ancestors": f"WITH RECURSIVE {_DIVISIONS} SELECT division_id, ancestor_id, depth FROM up",
    "d02_norms": f"WITH RECURSIVE {_DIVISIONS} SELECT up.division_id, arg_min(driving_side, depth) FILTER (driving_side IS NOT NULL) AS driving_side FROM up JOIN divs d ON up.ancestor_id = d.division_id GROUP BY 1",
    "d03_population": f"WITH RECURSIVE {_DIVISIONS} SELECT ancestor_id, CAST(sum(population) AS BIGINT) AS population FROM up JOIN divs d ON up.division_id = d.division_id GROUP BY 1",
    "d03_codes": f"WITH RECURSIVE {_DIVISIONS} SELECT up.division_id, arg_min(country, depth) FILTER (country IS NOT NULL) AS country, arg_min(region, depth) FILTER (region IS NOT NULL) AS region FROM up JOIN divs d ON up.ancestor_id = d.division_id GROUP BY 1",
    "d04_invariants": f"""WITH RECURSIVE {_DIVISIONS}, l AS (SELECT division_id, population % 10 AS k FROM divs WHERE subtype = 'locality')
        SELECT division_id, unnest(CASE k WHEN 0 THEN ['parent differs from the default hierarchy', 'no parent'] WHEN 1 THEN ['does not end at itself', 'parent differs from the default hierarchy'] WHEN 2 THEN ['does not start at a country']
        WHEN 3 THEN ['no hierarchy', 'parent differs from the default hierarchy'] WHEN 4 THEN ['parent differs from the default hierarchy'] END) AS fault FROM l
        UNION ALL SELECT 'c1', unnest(['parent differs from the default hierarchy', 'country with parent'])""",
    "f26_heights": f"WITH {_HEIGHTS} SELECT feature_id, height, CASE form WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN v + 0.5 WHEN 3 THEN round(v * 0.3048::DOUBLE, 2) WHEN 4 THEN round(v * 0.3048::DOUBLE, 2) WHEN 5 THEN round(v * 0.3048::DOUBLE + 6.5 * 0.0254::DOUBLE, 2) WHEN 6 THEN round(v * 0.0254::DOUBLE, 2) WHEN 8 THEN v + 0.25 WHEN 9 THEN v WHEN 10 THEN v WHEN 11 THEN round((v + 0.65) * 0.3048::DOUBLE, 2) END AS metres FROM heights",
    "a12_height_formats": f"WITH {_HEIGHTS} SELECT CASE form WHEN 0 THEN 'X' WHEN 1 THEN 'X m' WHEN 2 THEN 'X m' WHEN 3 THEN 'X ft' WHEN 4 THEN 'X''' WHEN 5 THEN 'X''Y\"' WHEN 6 THEN 'X\"' WHEN 8 THEN 'X meter' WHEN 9 THEN 'X' WHEN 10 THEN 'X metre' WHEN 11 THEN 'X feet' END AS format, count(*) AS n FROM heights GROUP BY 1",
    "f25_classes": """WITH t AS (SELECT p_partkey AS k, p_brand AS c, p_partkey % 3 = 0 AS three, p_partkey % 3 <> 0 AND p_partkey % 7 = 1 AS two, p_partkey % 3 <> 0 AND p_partkey % 7 <> 1 AND p_partkey % 11 = 2 AS none, p_partkey % 5 AS f FROM part)
        SELECT k AS feature_id, CASE WHEN two THEN 'transit' WHEN none THEN NULL WHEN f = 0 THEN 'transit' WHEN f = 1 THEN 'airport' WHEN f IN (2, 3) THEN 'medical' ELSE 'barrier' END AS subtype,
        CASE WHEN two THEN 'bus_stop' WHEN none THEN NULL WHEN f = 0 THEN 'bus_stop' WHEN f = 1 THEN 'airport_gate' WHEN f IN (2, 3) THEN 'hospital' ELSE 'fence' END AS class, CASE WHEN three THEN c END AS surface FROM t""",
    "f12_wkt": f"WITH {_SEG} SELECT segment_id, printf('POINT (%.6f %.6f)', -83.70::DOUBLE + x1 / 1e6, 32.80::DOUBLE + y1 / 1e6) AS start_wkt FROM seg",
}
