"""Registered queries on what is made of matched traces, with DuckDB SQL for each."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import matcher, results, spatial, traces
from ..sources import adapters, readers
from ..sources.adapters import table
from .queries import _MATCHED, _POINTS, _SEG, _STEPS, _metres, _points, _raw, _segments

MOST = 30.0


def _near(spark: SparkSession, d: str) -> DataFrame:
    return spatial.near(_points(spark, d), _segments(spark, d), MOST)


def _best(spark: SparkSession, d: str) -> DataFrame:
    return _first(_near(spark, d))


def _first(near: DataFrame) -> DataFrame:
    return results.ranked(near).where("rank = 1")


def _labels(points: DataFrame) -> DataFrame:
    """Labels from the table: segments by the point's number; traces divisible by 5 have none, others stop at point 40, and some name no segment."""
    p = points.where("trace_id % 5 <> 0 and idx <> 40")
    return p.select("trace_id", "idx", F.when(F.col("idx") % 9 == 4, -1).otherwise(F.col("trace_id") + F.floor(F.col("idx") / 4)).cast("long").alias("label_id"))


def o01_predictions(spark, d):
    return results.ranked(_near(spark, d)).select("trace_id", "idx", "segment_id", "rank", F.round("log_prob", 4).alias("log_prob"))


def j05_transitions(spark, d):
    o = matcher.Options(beta=20.0)
    return results.transitions(_near(spark, d), o).withColumn("log_prob", F.round("log_prob", 4))


def j05_routes(spark, d):
    """Transitions over any number of connectors of the trace's candidate segments."""
    return results.routes(_near(spark, d), matcher.Options(beta=20.0)).withColumn("log_prob", F.round("log_prob", 4))


def j02_buffer_join(spark, d):
    return spatial.within_buffer(_points(spark, d), _segments(spark, d), 20.0)


def j02_flat_buffer(spark, d):
    """Segments in the flat-capped buffers of the traces' first 30 points on the UTM grid: most traces end on the way."""
    return spatial.within_flat_buffer(_points(spark, d).where("idx < 6 + trace_id % 25"), _segments(spark, d), 20.0)


def a04_candidate_lists(spark, d):
    c = results.grouped_candidates(spatial.within_buffer(_points(spark, d), _segments(spark, d), 20.0))
    return c.select("trace_id", "n", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"))


def a05_step_statistics(spark, d):
    s = results.described(traces.steps(_points(spark, d)), "step_m")
    return s.select("n", *(F.round(c, 4).alias(c) for c in s.columns[1:]))


def k01_documents(spark, d):
    """Result documents, read again: how many points they list, the ids, and the prediction of the fourth point."""
    docs = results.documents_of(spatial.near_or_none(_points(spark, d), _segments(spark, d), MOST), diagnostic=True)
    read = F.from_json("json", "id string, point_count long, points_with_matches long, target_ids string, points array<struct<original_point: string, snap_prediction: struct<id: string>, predictions: array<struct<id: string>>>>")
    return docs.select("trace_id", read.alias("d")).select("trace_id", "d.*", F.get("d.points", F.lit(3)).alias("fourth")).select("trace_id", "id", "point_count", F.array_size("points").cast("long").alias("n_listed"), "points_with_matches", "target_ids", F.col("fourth.snap_prediction.id").alias("fourth_id"), F.col("fourth.original_point").alias("fourth_point"), F.array_size("fourth.predictions").cast("long").alias("fourth_predictions"))


def k02_judgments(spark, d):
    return results.judgments(_points(spark, d), _best(spark, d))


def k03_snapped_points(spark, d):
    return results.snapped_points(_points(spark, d), _best(spark, d))


def k04_metric_rows(spark, d):
    return results.metric_rows(_points(spark, d), _best(spark, d), spatial.candidate_counts(_points(spark, d), _segments(spark, d)))


def _compared(spark: SparkSession, d: str) -> DataFrame:
    points, segs = _points(spark, d), _segments(spark, d)
    return results.against_labels(spatial.nearest_or_none(points, segs, MOST), _labels(points), segs)


def k06_compared(spark, d):
    return _compared(spark, d)


def a03_error_rates(spark, d):
    return results.error_rates(_compared(spark, d))


def k09_report(spark, d):
    rows = results.metric_rows(_points(spark, d), _best(spark, d), spatial.candidate_counts(_points(spark, d), _segments(spark, d)))
    return results.report(rows, _segments(spark, d).agg(F.count("*").alias("n")))


def w07_match_metrics(spark, d):
    """No SQL: as w04_match."""
    points = _points(spark, d)
    return matcher.metrics(points, matcher.match(points, _segments(spark, d)))


def d13_thinned(spark, d):
    """Points kept at least 50 m and 1 s from the last kept one."""
    return traces.thinned(_points(spark, d)).select("trace_id", "idx")


def p11_features(spark, d):
    """Suppliers as features: every other column is a property, connectors in either form."""
    k = F.col("s_suppkey")
    ids = F.when(k % 3 == 0, F.array(k.cast("string"), F.lit("c")))
    pairs = F.when(k % 3 == 1, F.array(F.struct(k.cast("string").alias("connector_id"), F.lit(0.0).alias("at"))))
    raw = table(spark, d, "supplier").withColumns({"geometry": F.lit("POINT (1 2)"), "connector_ids": ids, "connectors": pairs})
    feats = readers.as_features(raw, "s_suppkey", "geometry")
    return feats.select("id", F.size(F.array_distinct(F.map_keys("properties"))).cast("long").alias("n_properties"), F.try_element_at("properties", F.lit("s_name")).alias("name"), F.array_join("connector_ids", ",").alias("connector_ids"))


def p01_filter(spark, d):
    """The filter by properties: presence, a value, and an id that ends the list of conditions."""
    feats = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 4 != 0, F.create_map(F.lit("segment"), F.col("c_mktsegment"))).otherwise(F.create_map(F.lit("other"), F.lit("x"))).alias("properties"))
    every = [({"segment": "*"}, "present"), ({"segment": "BUILDING"}, "value"), ({"segment": "BUILDING", "id": "9", "other": "y"}, "id"), ({"id": "12", "segment": "nothing"}, "id first"), (None, "all")]
    parts = [readers.having(feats, w).select("id", F.lit(name).alias("filter")) for w, name in every]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def u04_last_wins(spark, d):
    return readers.last_wins(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("label")), ["l_orderkey"], ["l_linenumber", "label"]).select("l_orderkey", "l_linenumber", "label")


def f04_nearest_points(spark, d):
    """Each segment and the next one by number: where the first comes nearest to the second."""
    s = _segments(spark, d)
    other = s.select((F.col("segment_id") - 1).alias("segment_id"), *(F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")))
    edge = lambda p: tuple(F.col(p + c) for c in ("x1", "y1", "x2", "y2"))
    n = geo.nearest_between(edge(""), edge("b"))
    return s.join(other, "segment_id").select("segment_id", F.round(n["x"], 4).alias("x"), F.round(n["y"], 4).alias("y"), F.round(F.sqrt(n["d2"]), 4).alias("gap"))


def d15_connector_places(spark, d):
    """Connectors, every fifth one moved off its segment."""
    s = _segments(spark, d)
    off = F.when(F.col("segment_id") % 5 == 0, 130).otherwise(0)
    c = s.select("segment_id", F.col("from_node").alias("connector_id"), (F.col("x1") + off).alias("x"), (F.col("y1") + off * 2).alias("y"))
    return spatial.placed_connectors(c, s).select("segment_id", "connector_id", "on_line", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"))


QUERIES = {f.__name__: f for f in (o01_predictions, j05_transitions, j05_routes, j02_buffer_join, j02_flat_buffer, a04_candidate_lists, a05_step_statistics, k01_documents, k02_judgments, k03_snapped_points, k04_metric_rows, k06_compared, a03_error_rates, k09_report, w07_match_metrics, d13_thinned, p11_features, p01_filter, u04_last_wins, f04_nearest_points, d15_connector_places)}

_LOG0 = repr(-math.log(math.sqrt(2 * math.pi) * 4.1)) + "::DOUBLE"
_NEAR = f"""
near0 AS (SELECT trace_id, idx, ts, segment_id, x, y, x1, y1, x2, y2, from_node, to_node, x1 + a * (x2 - x1) AS sx, y1 + a * (y2 - y1) AS sy FROM (
      SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1))::DOUBLE / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))::DOUBLE)) AS a
      FROM pts JOIN seg ON x BETWEEN x1 - 400 AND x2 + 400 AND y BETWEEN y1 - 400 AND y2 + 400)),
near AS (SELECT * FROM (SELECT *, {_metres('x', 'y', 'sx', 'sy')} AS distance FROM near0) WHERE distance <= 30),
ranked AS (SELECT *, {_LOG0} - 0.5 * (distance / 4.1) * (distance / 4.1) AS log_prob, CAST(row_number() OVER (PARTITION BY trace_id, idx ORDER BY distance, segment_id) AS INTEGER) AS rank FROM near),
best AS (SELECT * FROM ranked WHERE rank = 1),
pred AS (SELECT p.*, b.segment_id, b.distance, b.sx, b.sy FROM pts p LEFT JOIN best b USING (trace_id, idx))
"""
_BASE = f"WITH {_SEG}, {_POINTS}, {_NEAR}"
_WKT = "printf('POINT (%.6f %.6f)', -83.70::DOUBLE + {} / 1e6, 32.80::DOUBLE + {} / 1e6)"
_SCALE = repr(6371008.8 * math.pi / 180 / 1e6) + "::DOUBLE"


def _gap2(a: tuple, b: tuple) -> str:
    """The square of the distance between two edges on a plane."""

    def point(px, py, x1, y1, x2, y2):
        t = f"coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({px} - {x1}) * ({x2} - {x1}) + ({py} - {y1}) * ({y2} - {y1})) / nullif(({x2} - {x1}) * ({x2} - {x1}) + ({y2} - {y1}) * ({y2} - {y1}), 0))), 0.0)"
        return f"(pow({px} - ({x1} + {t} * ({x2} - {x1})), 2) + pow({py} - ({y1} + {t} * ({y2} - {y1})), 2))"

    side = lambda p, q, e: f"(({e[2]} - {e[0]}) * ({q} - {e[1]}) - ({e[3]} - {e[1]}) * ({p} - {e[0]}))"
    cross = f"{side(*a[:2], b)} * {side(*a[2:], b)} < 0 AND {side(*b[:2], a)} * {side(*b[2:], a)} < 0"
    return f"CASE WHEN {cross} THEN 0 ELSE least({point(*a[:2], *b)}, {point(*a[2:], *b)}, {point(*b[:2], *a)}, {point(*b[2:], *a)}) END"


_BUFFER = f"""
edges AS (SELECT * FROM (SELECT trace_id, lag(x) OVER w AS ax, lag(y) OVER w AS ay, x AS bx, y AS "by" FROM pts WINDOW w AS (PARTITION BY trace_id ORDER BY idx)) WHERE ax IS NOT NULL),
flat AS (SELECT trace_id, segment_id, k * ax AS ax, {_SCALE} * ay AS ay, k * bx AS bx, {_SCALE} * "by" AS "by", k * x1 AS x1, {_SCALE} * y1 AS y1, k * x2 AS x2, {_SCALE} * y2 AS y2 FROM (
      SELECT *, {_SCALE} * cos(radians(32.80::DOUBLE + y1 / 1e6)) AS k FROM edges JOIN seg ON least(ax, bx) - 300 <= x2 AND x1 <= greatest(ax, bx) + 300 AND least(ay, "by") - 300 <= y2 AND y1 <= greatest(ay, "by") + 300)),
close AS (SELECT DISTINCT trace_id, segment_id FROM flat WHERE {_gap2(("ax", "ay", "bx", '"by"'), ("x1", "y1", "x2", "y2"))} <= 400),
buffered AS (SELECT t.trace_id, segment_id FROM (SELECT DISTINCT trace_id FROM pts) t LEFT JOIN close USING (trace_id))
"""
_COMPARED = f"""
labels AS (SELECT trace_id, idx, CASE WHEN idx % 9 = 4 THEN -1 ELSE trace_id + idx // 4 END AS label_id FROM pts WHERE trace_id % 5 <> 0 AND idx <> 40),
cut AS (SELECT p.trace_id, min(p.idx) AS stop FROM pts p LEFT JOIN labels l USING (trace_id, idx) WHERE l.label_id IS NULL GROUP BY 1),
walk AS (SELECT *, coalesce({_metres("px", "py", "x", "y")}, 0) AS step FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM pred WINDOW w AS (PARTITION BY trace_id ORDER BY idx))),
rows_ AS (SELECT w.*, l.label_id FROM walk w JOIN labels l USING (trace_id, idx) LEFT JOIN cut c USING (trace_id) WHERE c.stop IS NULL OR idx < c.stop),
placed AS (SELECT r.*, s.x1, s.y1, s.x2, s.y2, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1))::DOUBLE / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))::DOUBLE)) AS a FROM rows_ r LEFT JOIN seg s ON s.segment_id = r.label_id),
compared AS (SELECT trace_id, idx AS point_index, CAST(label_id AS VARCHAR) AS label_feature_id, coalesce(CAST(segment_id AS VARCHAR), '') AS prediction_feature_id, CASE WHEN x1 IS NULL THEN '' ELSE {_WKT.format('(x1 + a * (x2 - x1))', '(y1 + a * (y2 - y1))')} END AS label_snapped_wkt,
      CASE WHEN sx IS NULL THEN '' ELSE {_WKT.format('sx', 'sy')} END AS prediction_snapped_wkt, step AS distance_to_prev_point, segment_id IS NOT DISTINCT FROM label_id AS is_correct FROM placed)
"""
_CANDIDATES = """cand AS (SELECT trace_id, count(DISTINCT segment_id) AS target_candidates_count FROM pts JOIN seg
        ON floor(x / 2000) BETWEEN floor((x1 - {e}) / 2000) AND floor((x2 + {e}) / 2000) AND floor(y / 2000) BETWEEN floor((y1 - {n}) / 2000) AND floor((y2 + {n}) / 2000) GROUP BY 1)"""
_METRIC_ROWS = f"""
{{cand}},
walked AS (SELECT trace_id, segment_id, distance, {_raw("px", "py", "x", "y")} AS step FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM pred WINDOW w AS (PARTITION BY trace_id ORDER BY idx))),
mrows AS (SELECT trace_id, round(coalesce(sum(step), 0), 2) AS source_length, count(*) AS points, count(segment_id) AS points_with_match, count(DISTINCT segment_id) AS matched_target_ids_count, round(avg(distance), 2) AS avg_dist_to_road,
      printf('%.2f', 100.0::DOUBLE * count(segment_id) / count(*)) AS percent_points_with_match FROM walked GROUP BY 1),
metric_rows AS (SELECT m.*, coalesce(target_candidates_count, 0) AS target_candidates_count FROM mrows m LEFT JOIN cand USING (trace_id))
"""


def _grid(table: str) -> str:
    """CTEs utm0, utm1 and utm: easting e and northing n of the places (x, y) of a table, by the ellipsoid's series."""
    f = 1 / 298.257223563
    n, ecc = f / (2 - f), math.sqrt(2 * f - f * f)
    scale = repr(0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)) + "::DOUBLE"
    a = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    term = lambda p, q: " + ".join(f"{c!r}::DOUBLE * {p}({2 * k} * xi) * {q}({2 * k} * eta)" for k, c in enumerate(a, 1))
    return f"""utm0 AS (SELECT x, y, sin(radians(32.80::DOUBLE + y / 1e6)) AS s, radians(-83.70::DOUBLE + x / 1e6 + 81) AS o FROM {table}), utm1 AS (SELECT x, y, o, sinh(atanh(s) - {ecc!r}::DOUBLE * atanh({ecc!r}::DOUBLE * s)) AS t FROM utm0),
        utm2 AS (SELECT x, y, atan2(t, cos(o)) AS xi, asinh(sin(o) / sqrt(t * t + cos(o) * cos(o))) AS eta FROM utm1), utm AS (SELECT x, y, 500000 + {scale} * (eta + {term('cos', 'sinh')}) AS e, {scale} * (xi + {term('sin', 'cosh')}) AS n FROM utm2)"""


def _clip(p: str, q: str, low: str, high: str, side: int) -> str:
    """From (0) or to (1) where on the way from p to q a value lies between low and high."""
    one, other = f"(({low}) - {p}) / nullif({q} - {p}, 0)", f"(({high}) - {p}) / nullif({q} - {p}, 0)"
    return f"coalesce({'greatest' if side else 'least'}({one}, {other}), CASE WHEN {p} BETWEEN {low} AND {high} THEN {side} ELSE {-1 if side else 2} END)"


_FLAT = f"""short AS (SELECT * FROM pts WHERE idx < 6 + trace_id % 25), places AS (SELECT x, y FROM short UNION SELECT x1, y1 FROM seg UNION SELECT x2, y2 FROM seg), {_grid('places')},
    walk AS (SELECT trace_id, lag(s.x) OVER w AS ax, lag(s.y) OVER w AS ay, lag(e) OVER w AS ae, lag(n) OVER w AS an, lag(e, 2) OVER w IS NOT NULL AS joined, s.x AS bx, s.y AS "by", e AS be, n AS bn FROM short s JOIN utm u ON u.x = s.x AND u.y = s.y WINDOW w AS (PARTITION BY trace_id ORDER BY idx)),
    road AS (SELECT segment_id, x1, y1, x2, y2, u.e AS e1, u.n AS n1, v.e AS e2, v.n AS n2 FROM seg JOIN utm u ON u.x = x1 AND u.y = y1 JOIN utm v ON v.x = x2 AND v.y = y2),
    met AS (SELECT *, sqrt(pow(be - ae, 2) + pow(bn - an, 2)) AS len FROM walk JOIN road ON least(ax, bx) - 300 <= x2 AND x1 <= greatest(ax, bx) + 300 AND least(ay, "by") - 300 <= y2 AND y1 <= greatest(ay, "by") + 300 WHERE ax IS NOT NULL),
    turned AS (SELECT *, ((e1 - ae) * (be - ae) + (n1 - an) * (bn - an)) / nullif(len, 0) AS u1, ((e2 - ae) * (be - ae) + (n2 - an) * (bn - an)) / nullif(len, 0) AS u2, ((n1 - an) * (be - ae) - (e1 - ae) * (bn - an)) / nullif(len, 0) AS v1, ((n2 - an) * (be - ae) - (e2 - ae) * (bn - an)) / nullif(len, 0) AS v2,
        greatest(0, least(1, ((ae - e1) * (e2 - e1) + (an - n1) * (n2 - n1)) / (pow(e2 - e1, 2) + pow(n2 - n1, 2)))) AS t FROM met),
    hit AS (SELECT DISTINCT trace_id, segment_id FROM turned WHERE (len > 0 AND greatest({_clip('u1', 'u2', '-1e-6', 'len + 1e-6', 0)}, {_clip('v1', 'v2', '-20.000001', '20.000001', 0)}, 0) <= least({_clip('u1', 'u2', '-1e-6', 'len + 1e-6', 1)}, {_clip('v1', 'v2', '-20.000001', '20.000001', 1)}, 1))
        OR (joined AND pow(e1 + t * (e2 - e1) - ae, 2) + pow(n1 + t * (n2 - n1) - an, 2) <= 400))"""


def _sql() -> dict[str, str]:
    from .queries import _EAST, _NORTH

    metric = _METRIC_ROWS.format(cand=_CANDIDATES.format(e=_EAST, n=_NORTH))
    return {
        "o01_predictions": f"{_BASE} SELECT trace_id, idx, segment_id, rank, round(log_prob, 4) AS log_prob FROM ranked",
        "j05_transitions": f"""{_BASE}, pairs AS (SELECT b.trace_id, b.idx, a.segment_id AS from_segment, b.segment_id AS to_segment, {_raw('a.x', 'a.y', 'b.x', 'b.y')} AS step,
            CASE WHEN a.segment_id = b.segment_id THEN {_raw('a.sx', 'a.sy', 'b.sx', 'b.sy')} ELSE least(
              CASE WHEN a.from_node IN (b.from_node, b.to_node) THEN {_raw('a.sx', 'a.sy', 'a.x1', 'a.y1')} + {_raw('a.x1', 'a.y1', 'b.sx', 'b.sy')} END,
              CASE WHEN a.to_node IN (b.from_node, b.to_node) THEN {_raw('a.sx', 'a.sy', 'a.x2', 'a.y2')} + {_raw('a.x2', 'a.y2', 'b.sx', 'b.sy')} END) END AS route
            FROM near a JOIN near b ON a.trace_id = b.trace_id AND a.idx + 1 = b.idx)
            SELECT trace_id, idx, from_segment, to_segment, round(route, 2) AS route_m, round(-ln(20.0::DOUBLE) - abs(step - route) / 20, 4) AS log_prob FROM pairs WHERE abs(step - route) <= 300""",
        "j05_routes": f"""WITH RECURSIVE {_SEG}, {_POINTS}, {_NEAR}, ends AS (SELECT trace_id, idx, segment_id, x, y, sx, sy, unnest([from_node, to_node]) AS node, unnest([x1, x2]) AS nx, unnest([y1, y2]) AS ny FROM near),
            link AS (SELECT DISTINCT trace_id, unnest([from_node, to_node]) AS node, unnest([to_node, from_node]) AS other, {_raw('x1', 'y1', 'x2', 'y2')} AS length FROM near),
            prev AS (SELECT a.trace_id, a.idx + 1 AS idx, a.segment_id AS from_segment, a.node, {_raw('a.sx', 'a.sy', 'a.nx', 'a.ny')} AS m, {_raw('a.x', 'a.y', 'p.x', 'p.y')} AS step FROM ends a JOIN pts p ON p.trace_id = a.trace_id AND p.idx = a.idx + 1),
            way AS (SELECT * FROM prev WHERE m <= step + 300 UNION ALL SELECT w.trace_id, w.idx, w.from_segment, l.other, w.m + l.length, w.step FROM way w JOIN link l ON l.trace_id = w.trace_id AND l.node = w.node WHERE w.m + l.length <= w.step + 300),
            r AS (SELECT w.trace_id, w.idx, w.from_segment, e.segment_id AS to_segment, step, w.m + {_raw('e.nx', 'e.ny', 'e.sx', 'e.sy')} AS route FROM (SELECT trace_id, idx, from_segment, node, step, min(m) AS m FROM way GROUP BY ALL) w JOIN ends e ON e.trace_id = w.trace_id AND e.idx = w.idx AND e.node = w.node AND e.segment_id <> w.from_segment
                  UNION ALL SELECT b.trace_id, b.idx, b.segment_id, b.segment_id, {_raw('a.x', 'a.y', 'b.x', 'b.y')}, {_raw('a.sx', 'a.sy', 'b.sx', 'b.sy')} FROM near a JOIN near b ON a.trace_id = b.trace_id AND a.idx + 1 = b.idx AND a.segment_id = b.segment_id),
            s AS (SELECT trace_id, idx, from_segment, to_segment, step, min(route) AS route FROM r GROUP BY ALL)
            SELECT trace_id, idx, from_segment, to_segment, round(route, 2) AS route_m, round(-ln(20.0::DOUBLE) - abs(step - route) / 20, 4) AS log_prob FROM s WHERE abs(step - route) <= 300""",
        "d13_thinned": f"""WITH RECURSIVE {_SEG}, {_POINTS}, kept AS (SELECT trace_id, min(idx) AS idx FROM pts GROUP BY 1
            UNION ALL SELECT k.trace_id, min(b.idx) FROM kept k JOIN pts a ON a.trace_id = k.trace_id AND a.idx = k.idx JOIN pts b ON b.trace_id = k.trace_id AND b.idx > k.idx AND {_raw('a.x', 'a.y', 'b.x', 'b.y')} >= 50 AND (epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 >= 1 GROUP BY k.trace_id)
            SELECT trace_id, idx FROM kept""",
        "j02_buffer_join": f"WITH {_SEG}, {_POINTS}, {_BUFFER} SELECT trace_id, segment_id FROM buffered",
        "j02_flat_buffer": f"WITH {_SEG}, {_POINTS}, {_FLAT} SELECT t.trace_id, segment_id FROM (SELECT DISTINCT trace_id FROM short) t LEFT JOIN hit USING (trace_id)",
        "a04_candidate_lists": f"WITH {_SEG}, {_POINTS}, {_BUFFER} SELECT trace_id, count(segment_id) AS n, coalesce(string_agg(CAST(segment_id AS VARCHAR), ',' ORDER BY segment_id), '') AS candidates FROM buffered GROUP BY 1",
        "a05_step_statistics": f"WITH {_SEG}, {_POINTS}, {_STEPS} SELECT count(step_m) AS n, round(avg(step_m), 4) AS mean, round(stddev_samp(step_m), 4) AS std, round(min(step_m), 4) AS least, round(quantile_cont(step_m, 0.25), 4) AS q25, round(quantile_cont(step_m, 0.5), 4) AS q50, round(quantile_cont(step_m, 0.75), 4) AS q75, round(max(step_m), 4) AS most FROM steps",
        "k01_documents": f"""{_BASE}, n AS (SELECT trace_id, idx, count(*) AS k FROM ranked GROUP BY 1, 2)
            SELECT trace_id, CAST(trace_id AS VARCHAR) AS id, count(*) AS point_count, count(*) AS n_listed, count(segment_id) AS points_with_matches, '[' || coalesce(array_to_string(list_sort(list(DISTINCT segment_id) FILTER (segment_id IS NOT NULL)), ','), '') || ']' AS target_ids,
            max(CASE WHEN idx = 3 THEN CAST(segment_id AS VARCHAR) END) AS fourth_id, max(CASE WHEN idx = 3 THEN {_WKT.format('x', 'y')} END) AS fourth_point, max(CASE WHEN idx = 3 THEN coalesce(k, 0) END) AS fourth_predictions FROM pred LEFT JOIN n USING (trace_id, idx) GROUP BY 1""",
        "k02_judgments": f"{_BASE} SELECT trace_id, idx AS point_index, {_WKT.format('x', 'y')} AS trace_point_wkt, coalesce(CAST(segment_id AS VARCHAR), '') AS feature_id FROM pred",
        "k03_snapped_points": f"{_BASE} SELECT trace_id, idx AS point_index, coalesce(CAST(segment_id AS VARCHAR), '') AS feature_id, CASE WHEN sx IS NULL THEN '' ELSE {_WKT.format('sx', 'sy')} END AS snapped_point_wkt FROM pred",
        "k04_metric_rows": f"{_BASE}, {metric} SELECT * FROM metric_rows",
        "k06_compared": f"{_BASE}, {_COMPARED} SELECT * FROM compared",
        "a03_error_rates": f"""{_BASE}, {_COMPARED}, t AS (SELECT trace_id, round(coalesce(sum(distance_to_prev_point), 0), 2) AS total_distance, round(coalesce(sum(CASE WHEN is_correct THEN 0 ELSE distance_to_prev_point END), 0), 2) AS wrong_distance FROM compared GROUP BY ROLLUP (trace_id))
            SELECT *, CASE WHEN total_distance = 0 THEN -1.0::DOUBLE ELSE round(wrong_distance / total_distance, 4) END AS error_rate FROM t""",
        "k09_report": f"""{_BASE}, {metric}, t AS (SELECT count(*) AS traces, sum(source_length) / 1000 AS km, sum(target_candidates_count) AS c, sum(matched_target_ids_count) AS m, avg(avg_dist_to_road) AS d, (SELECT count(*) FROM seg) AS n FROM metric_rows),
            l AS (SELECT unnest([rpad('Traces', 35, '.') || traces, rpad('Target features', 35, '.') || n, rpad('Avg distance to snapped road', 35, '.') || printf('%.2f', d) || 'm', rpad('GPS traces length', 35, '.') || printf('%.2f', km) || 'km',
            rpad('Avg number of candidate segments', 35, '.') || printf('%.2f', c::DOUBLE / traces) || '/trace, ' || printf('%.2f', c::DOUBLE / km) || '/km', rpad('Avg number of matched segments', 35, '.') || printf('%.2f', m::DOUBLE / traces) || '/trace, ' || printf('%.2f', m::DOUBLE / km) || '/km']) AS text, unnest(range(6))::INTEGER AS line FROM t)
            SELECT line, text FROM l""",
        "p11_features": "SELECT CAST(s_suppkey AS VARCHAR) AS id, (3 + (s_suppkey % 3 = 0)::INTEGER + (s_suppkey % 3 = 1)::INTEGER)::BIGINT AS n_properties, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey || ',c' WHEN 1 THEN CAST(s_suppkey AS VARCHAR) ELSE '' END AS connector_ids FROM supplier",
        "p01_filter": """WITH f AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS s FROM customer)
            SELECT id, 'present' AS filter FROM f WHERE s IS NOT NULL UNION ALL SELECT id, 'value' FROM f WHERE s = 'BUILDING' UNION ALL SELECT id, 'id' FROM f WHERE s = 'BUILDING' AND id = '9' UNION ALL SELECT id, 'id first' FROM f WHERE id = '12' UNION ALL SELECT id, 'all' FROM f""",
        "u04_last_wins": "SELECT l_orderkey, l_linenumber, l_suppkey AS label FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_suppkey DESC) = 1",
        "f04_nearest_points": f"""WITH {_SEG}, near_pairs AS (SELECT a.segment_id, a.x1::DOUBLE AS x1, a.y1::DOUBLE AS y1, a.x2::DOUBLE AS x2, a.y2::DOUBLE AS y2, b.x1::DOUBLE AS u1, b.y1::DOUBLE AS v1, b.x2::DOUBLE AS u2, b.y2::DOUBLE AS v2 FROM seg a JOIN seg b ON b.segment_id = a.segment_id + 1),
            q AS (SELECT segment_id, unnest([0, 1, 2, 3]) AS k, unnest([x1, x2, x1 + t3 * (x2 - x1), x1 + t4 * (x2 - x1)]) AS x, unnest([y1, y2, y1 + t3 * (y2 - y1), y1 + t4 * (y2 - y1)]) AS y,
            unnest([pow(x1 - (u1 + t1 * (u2 - u1)), 2) + pow(y1 - (v1 + t1 * (v2 - v1)), 2), pow(x2 - (u1 + t2 * (u2 - u1)), 2) + pow(y2 - (v1 + t2 * (v2 - v1)), 2), pow(u1 - (x1 + t3 * (x2 - x1)), 2) + pow(v1 - (y1 + t3 * (y2 - y1)), 2), pow(u2 - (x1 + t4 * (x2 - x1)), 2) + pow(v2 - (y1 + t4 * (y2 - y1)), 2)]) AS d2
            FROM (SELECT *, greatest(0, least(1, ((x1 - u1) * (u2 - u1) + (y1 - v1) * (v2 - v1)) / (pow(u2 - u1, 2) + pow(v2 - v1, 2)))) AS t1, greatest(0, least(1, ((x2 - u1) * (u2 - u1) + (y2 - v1) * (v2 - v1)) / (pow(u2 - u1, 2) + pow(v2 - v1, 2)))) AS t2,
            greatest(0, least(1, ((u1 - x1) * (x2 - x1) + (v1 - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t3, greatest(0, least(1, ((u2 - x1) * (x2 - x1) + (v2 - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t4 FROM near_pairs))
            SELECT segment_id, round(x, 4) AS x, round(y, 4) AS y, round(sqrt(d2), 4) AS gap FROM q QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY d2, k) = 1""",
        "d15_connector_places": f"WITH {_SEG} SELECT segment_id, from_node AS connector_id, segment_id % 5 <> 0 AS on_line, round(CASE WHEN segment_id % 5 <> 0 OR x1 = x2 THEN x1 ELSE x1 + 130 END::DOUBLE, 4) AS px, round(CASE WHEN segment_id % 5 <> 0 OR y1 = y2 THEN y1 ELSE y1 + 260 END::DOUBLE, 4) AS py FROM seg",
    }


ORACLE_SQL = _sql()
