"""Registered queries on rules in all scopes and on the map themes, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lines, tags
from ..operators import references, rules, spatial, themes, validation
from ..sources import adapters
from ..sources.adapters import table
from .queries import _RULES, _SEG, _rules, _segments


def r01_scoped_access(spark, d):
    """Access at a place, heading, mode, purpose, status, time and weight: every order asks its own lines as rules."""
    k, s, p, n = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey"), F.col("l_quantity")
    text = lambda *v: F.array(*map(F.lit, v))
    heavy = F.struct(F.lit("weight").alias("dimension"), F.lit("greater_than").alias("comparison"), F.floor(n / 10).cast("double").alias("value"), F.lit("t").alias("unit"))
    found = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("segment_id"), k.cast("long").alias("position"), F.when(p % 2 == 0, (k - 1) / 8.0).alias("low"), F.when(p % 2 == 0, F.lit(1.0)).alias("high"),
        F.when(F.col("l_linestatus") == "O", "forward").alias("heading"), F.when(p % 7 == 0, "left").alias("side"), F.when(p % 4 == 1, text("vehicle")).when(p % 4 == 2, text("truck", "bus")).when(p % 4 == 3, text("bicycle")).alias("mode"),
        F.when(s % 3 == 1, text("to_deliver")).when(s % 3 == 2, text("at_destination", "to_farm")).alias("using"), F.when(k % 3 == 0, text("as_private")).alias("recognized"), F.when(s % 4 == 1, "Mo-Fr 08:00-18:00").when(s % 4 == 3, "sunrise-sunset").alias("during"),
        F.when(p % 5 == 0, F.array(heavy)).alias("vehicle"), F.when(F.col("l_returnflag") == "A", "allowed").when(F.col("l_returnflag") == "R", "denied").otherwise("designated").alias("access_type"),
    )
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    modes = F.when(o % 3 == 0, text("car", "motor_vehicle", "vehicle")).when(o % 3 == 1, text("truck", "motor_vehicle", "vehicle")).otherwise(text("bicycle", "vehicle"))
    facts = table(spark, d, "orders").select(
        o.alias("fact_id"), o.alias("segment_id"), ((o % 8) / 8.0).alias("position"), F.when(c % 2 == 0, "forward").otherwise("backward").alias("heading"), F.when(c % 3 == 0, "left").when(c % 3 == 1, "right").alias("side"), modes.alias("modes"),
        F.when(c % 2 == 1, "to_deliver").alias("purpose"), F.when(c % 5 > 1, "as_private").alias("status"), (o % 7).cast("int").alias("day"), ((o * 13) % 1440).cast("int").alias("minute"), F.create_map(F.lit("weight"), (c % 6) * 1000.0).alias("dimensions"),
    )
    return rules.resolved(found, facts, ["access_type"])


def r14_sequences(spark, d):
    """Routes over two connectors, and which a restriction of two steps prohibits."""
    turns = spatial.adjacency(adapters.connectors(_segments(spark, d))).where("segment_id % 3 = 0")
    next_ = spatial.adjacency(adapters.connectors(_segments(spark, d))).select(F.col("segment_id").alias("neighbour_id"), F.col("neighbour_id").alias("last_id"), F.col("connector_id").alias("last_connector"))
    ways = turns.join(next_, "neighbour_id").where("last_connector <> connector_id and last_id <> segment_id")
    ends = _segments(spark, d).select(F.col("segment_id").alias("last_id"), "from_node")
    ways = ways.join(ends, "last_id").withColumn("route_id", F.concat_ws("-", "segment_id", "connector_id", "neighbour_id", "last_connector", "last_id"))
    heading = F.when(F.col("last_connector") == F.col("from_node"), "forward").otherwise("backward")
    step = lambda i, c, s, h: F.struct(F.lit(i).alias("step"), c.alias("connector_id"), s.alias("segment_id"), h.alias("heading"))
    plain = F.lit("forward")
    routes = ways.select("route_id", F.explode(F.array(step(0, F.lit(None).cast("long"), F.col("segment_id"), plain), step(1, F.col("connector_id"), F.col("neighbour_id"), plain), step(2, F.col("last_connector"), F.col("last_id"), heading))).alias("s")).select("route_id", "s.*")
    entry = lambda c, s: F.struct(F.col(c).alias("connector_id"), F.col(s).alias("segment_id"))
    bans = ways.where("(segment_id + last_id) % 5 = 0").select(F.col("route_id").alias("restriction_id"), "segment_id", F.array(entry("connector_id", "neighbour_id"), entry("last_connector", "last_id")).alias("sequence"), F.lit("forward").alias("final_heading"))
    return rules.prohibited(routes, bans)


def r15_flags(spark, d):
    flags = F.when(F.col("access_type") == "allowed", F.array(F.lit("is_bridge"), F.lit("is_link"))).when(F.col("access_type") == "denied", F.array(F.lit("is_tunnel"))).otherwise(F.array(F.lit("is_link")))
    facts = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("segment_id"), ((F.col("o_orderkey") % 8) / 8.0).alias("fact_position"))
    return rules.flags_at(_rules(spark, d).select("segment_id", "low", "high", flags.alias("values")), facts).select("segment_id", "fact_position", F.array_join("flags", ",").alias("flags"))


def _drawn(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("feature_id"), "p_brand", F.when(k % 3 > 0, k % 5 - 1).cast("int").alias("level"), F.when(k % 4 > 0, k % 7).cast("int").alias("sort_key"), F.when(k % 2 == 0, k % 24).cast("int").alias("min_zoom"), F.when(k % 5 > 1, 10 + k % 14).cast("int").alias("max_zoom"))


def d08_zoom(spark, d):
    return _drawn(spark, d).where(themes.at_zoom(12)).select("feature_id")


def o07_draw_order(spark, d):
    return themes.draw_rank(_drawn(spark, d), "p_brand", "feature_id").select("feature_id", "draw_rank")


def d09_z_order(spark, d):
    levels = _rules(spark, d).select(F.col("segment_id").alias("feature_id"), "position", "low", "high", ((F.col("max_speed") / 10).cast("int") - 6).alias("value"))
    k = F.col("o_orderkey")
    facts = table(spark, d, "orders").select(k.cast("long").alias("feature_id"), ((k % 8) / 8.0).alias("fact_position"), F.when(k % 3 > 0, (k % 4).cast("int")).alias("level"))
    return themes.z_order(facts, levels)


def d12_sides(spark, d):
    ids = F.array((F.col("c_custkey") % 25).cast("int"), ((F.col("c_custkey") * 7) % 30).cast("int"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("division_id"), F.col("n_name").alias("name"))
    return themes.sides(table(spark, d, "customer").select(F.col("c_custkey").alias("boundary_id"), ids.alias("division_ids")), names)


def d16_subtypes(spark, d):
    kinds = F.array(*map(F.lit, ["country", "region", "county", "macrohood", "locality", "planet"]))
    rows = table(spark, d, "customer").select("c_custkey", kinds[(F.col("c_custkey") % 6).cast("int")].alias("subtype"))
    every = [themes.published(rows, t).select("c_custkey", F.lit(t).alias("feature_type")) for t in themes.SUBTYPES]
    return every[0].unionAll(every[1]).unionAll(every[2])


def f07_polygon_cells(spark, d):
    """Cells on a grid of 1,000 of rectangles of many sizes, and of each with its copy further east as one multi-geometry."""
    k = F.col("p_partkey")
    x, y, w, h = (k % 50) * 370.0, F.floor(k / 50) * 410.0, 1000.0 + (k % 7) * 300.0, 500.0 + (k % 5) * 450.0

    def rectangle(shift):
        point = lambda a, b: F.struct((x + shift + a).alias("x"), (y + b).alias("y"))
        return F.array(F.array(point(F.lit(0.0), F.lit(0.0)), point(w, F.lit(0.0)), point(w, h), point(F.lit(0.0), h), point(F.lit(0.0), F.lit(0.0))))

    cell = F.lit(1000.0)
    rows = table(spark, d, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    rows = rows.select("p_partkey", F.array(rectangle(F.lit(0.0)), rectangle((k % 3) * 700.0)).alias("parts"))
    cells = lines.polygon_cells(F.get("parts", F.lit(0)), cell)
    both = lines.multi_cells(F.col("parts"), lambda part: lines.polygon_cells(part, cell))
    return rows.select("p_partkey", F.size(cells).cast("long").alias("n_cells"), F.size(both).cast("long").alias("n_both"))


def f28_languages(spark, d):
    forms = ["en", "ja_kana", "zh_pinyin", "e", "sr-Latn-RS", "de_x", "nan-POJ", "be-tarask", "es-419", "en-x-private"]
    t = F.array(*map(F.lit, forms))[(F.col("c_custkey") % len(forms)).cast("int")]
    return table(spark, d, "customer").select("c_custkey", tags.language(t).alias("language"), tags.is_language(t).alias("is_language"))


def f32_pointers(spark, d):
    """The member k of events' properties, by JSON pointer, and one that is not there."""
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", validation.as_text(validation.pointer(v, "/k")).alias("k"), validation.as_text(validation.pointer(v, "/none/0")).alias("missing"))


def o06_categories(spark, d):
    line = F.when(F.col("p_partkey") % 10 == 9, F.col("p_name")).when(F.col("p_partkey") % 10 == 8, F.concat(F.lower("p_brand"), F.lit("; ["), F.lower("p_brand"), F.lit("]"))).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("; ["), F.lower("p_brand"), F.lit(","), F.lower("p_type"), F.lit(","), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("]")))
    return themes.category_listing(table(spark, d, "part").select(line.alias("line")), "line")


def j08_sidecar(spark, d):
    other = table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("id"), F.col("s_name").alias("label"))
    return themes.sidecar(_segments(spark, d).select(F.col("segment_id").alias("id"), "subtype"), other)


def j15_unresolved(spark, d):
    """Connectors of segments that name no connector, when every 13th is missing."""
    c = adapters.connectors(_segments(spark, d))
    return themes.unresolved(c, "connector_id", c.select("connector_id").distinct().where("connector_id % 13 <> 0"), "connector_id").select("segment_id", "connector_id")


def j15_references(spark, d):
    """References of all kinds between features made of suppliers, 20 kinds a supplier; some connectors, buildings and divisions are missing."""
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    doc = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else text(p) for p in parts))
    segment = doc('{"connectors":[{"connector_id":"c', k, '"},{"connector_id":"c', k + 1, '"}],"destinations":[{"from_connector_id":"c', k, '","to_connector_id":"c', k + 2, '","to_segment_id":"s', k + 1, '"}],"prohibited_transitions":[{"sequence":[{"connector_id":"c', k + 1, '","segment_id":"s', k + 3, '"}]}]}')
    division = doc('{"parent_division_id":"d', F.floor(k / 10), '","hierarchies":[[{"division_id":"d0"},{"division_id":"d', k, '"}]],"capital_division_ids":["d', k + 4, '"],"capital_of_divisions":[{"division_id":"d', k - 1, '"}]}')
    kinds = [("segment", "s", segment, k >= 0), ("connector", "c", F.lit("{}"), k % 3 > 0), ("building", "b", F.lit("{}"), k % 5 > 0), ("building_part", "p", doc('{"building_id":"b', k, '"}'), k >= 0), ("division", "d", division, k % 7 != 3), ("division_area", "a", doc('{"division_id":"d', k, '"}'), k >= 0), ("division_boundary", "e", doc('{"division_ids":["d', k, '","d', k + 1, '"]}'), k >= 0)]
    own = F.array(*(F.struct(F.lit(kind).alias("type"), doc(letter, k).alias("id"), properties.alias("properties"), there.alias("there")) for kind, letter, properties, there in kinds))
    features = table(spark, d, "supplier").select(F.explode(own).alias("f")).select("f.*").where("there").drop("there")
    return references.unresolved(features)


QUERIES = {f.__name__: f for f in (j15_references, r01_scoped_access, r14_sequences, r15_flags, d08_zoom, o07_draw_order, d09_z_order, d12_sides, d16_subtypes, f07_polygon_cells, f28_languages, f32_pointers, o06_categories, j08_sidecar, j15_unresolved)}

_CON = "con AS (SELECT segment_id, from_node AS connector_id FROM seg UNION ALL SELECT segment_id, to_node FROM seg)"
_DRAWN = "drawn AS (SELECT p_partkey AS feature_id, p_brand, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 5 - 1 END AS level, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 7 END AS sort_key, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 24 END AS min_zoom, CASE WHEN p_partkey % 5 > 1 THEN 10 + p_partkey % 14 END AS max_zoom FROM part)"
ORACLE_SQL = {
    "r01_scoped_access": """WITH hit AS (SELECT o_orderkey AS fact_id, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'allowed' WHEN 'R' THEN 'denied' ELSE 'designated' END AS access_type FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        WHERE (l_partkey % 2 <> 0 OR (l_linenumber - 1) / 8.0::DOUBLE <= (o_orderkey % 8) / 8.0::DOUBLE) AND (l_linestatus <> 'O' OR o_custkey % 2 = 0) AND (l_partkey % 7 <> 0 OR o_custkey % 3 = 0)
        AND (l_partkey % 4 = 0 OR l_partkey % 4 = 1 OR (l_partkey % 4 = 2 AND o_orderkey % 3 = 1) OR (l_partkey % 4 = 3 AND o_orderkey % 3 = 2)) AND (l_suppkey % 3 = 0 OR (l_suppkey % 3 = 1 AND o_custkey % 2 = 1)) AND (l_linenumber % 3 <> 0 OR o_custkey % 5 > 1)
        AND (l_suppkey % 4 IN (0, 2) OR (l_suppkey % 4 = 1 AND o_orderkey % 7 < 5 AND (o_orderkey * 13) % 1440 BETWEEN 480 AND 1079)) AND (l_partkey % 5 <> 0 OR (o_custkey % 6) * 1000 > floor(l_quantity / 10) * 1000)
        QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber DESC, access_type DESC) = 1) SELECT o_orderkey AS fact_id, access_type FROM orders LEFT JOIN hit ON fact_id = o_orderkey""",
    "r14_sequences": f"""WITH {_SEG}, {_CON} SELECT DISTINCT concat_ws('-', a.segment_id, a.connector_id, b.segment_id, c.connector_id, e.segment_id) AS route_id FROM con a JOIN con b ON b.connector_id = a.connector_id AND b.segment_id <> a.segment_id
        JOIN con c ON c.segment_id = b.segment_id AND c.connector_id <> a.connector_id JOIN con e ON e.connector_id = c.connector_id AND e.segment_id <> b.segment_id AND e.segment_id <> a.segment_id JOIN seg s ON s.segment_id = e.segment_id
        WHERE a.segment_id % 3 = 0 AND (a.segment_id + e.segment_id) % 5 = 0 AND c.connector_id = s.from_node""",
    "r15_flags": f"""WITH {_RULES}, h AS (SELECT f.segment_id, f.fact_position, unnest(CASE access_type WHEN 'allowed' THEN ['is_bridge', 'is_link'] WHEN 'denied' THEN ['is_tunnel'] ELSE ['is_link'] END) AS flag
        FROM (SELECT DISTINCT segment_id, fact_position FROM facts) f JOIN rules r ON r.segment_id = f.segment_id AND low <= fact_position AND fact_position <= high)
        SELECT f.segment_id, f.fact_position, coalesce(string_agg(DISTINCT flag, ',' ORDER BY flag), '') AS flags FROM facts f LEFT JOIN h ON h.segment_id = f.segment_id AND h.fact_position = f.fact_position GROUP BY 1, 2""",
    "d08_zoom": f"WITH {_DRAWN} SELECT feature_id FROM drawn WHERE coalesce(min_zoom, 0) <= 12 AND coalesce(max_zoom, 23) >= 12",
    "o07_draw_order": f"WITH {_DRAWN} SELECT feature_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(level, 0), coalesce(sort_key, 0) DESC, feature_id) AS INTEGER) AS draw_rank FROM drawn",
    "d09_z_order": f"""WITH {_RULES}, h AS (SELECT f.segment_id, fact_position, CAST(floor(max_speed / 10) AS INTEGER) - 6 AS value FROM facts f JOIN rules r USING (segment_id) WHERE low <= fact_position AND fact_position <= high QUALIFY row_number() OVER (PARTITION BY f.segment_id ORDER BY position DESC, value DESC) = 1)
        SELECT f.segment_id AS feature_id, f.fact_position, CAST(coalesce(value, CASE WHEN f.segment_id % 3 > 0 THEN f.segment_id % 4 END, 0) AS INTEGER) AS z FROM facts f LEFT JOIN h USING (segment_id)""",
    "d12_sides": "SELECT c_custkey AS boundary_id, l.n_name AS left_name, r.n_name AS right_name FROM customer LEFT JOIN nation l ON l.n_nationkey = c_custkey % 25 LEFT JOIN nation r ON r.n_nationkey = (c_custkey * 7) % 30",
    "d16_subtypes": "SELECT c_custkey, 'division' AS feature_type FROM customer WHERE c_custkey % 6 < 5 UNION ALL SELECT c_custkey, 'division_area' FROM customer WHERE c_custkey % 6 IN (0, 1, 2, 4) UNION ALL SELECT c_custkey, 'division_boundary' FROM customer WHERE c_custkey % 6 < 3",
    "f07_polygon_cells": """WITH t AS (SELECT p_partkey, (p_partkey % 50) * 370 AS x, (p_partkey // 50) * 410 AS y, 1000 + (p_partkey % 7) * 300 AS w, 500 + (p_partkey % 5) * 450 AS h, (p_partkey % 3) * 700 AS s FROM part),
        c AS (SELECT p_partkey, x // 1000 AS a1, (x + w) // 1000 AS a2, (x + s) // 1000 AS b1, (x + s + w) // 1000 AS b2, (y + h) // 1000 - y // 1000 + 1 AS n FROM t)
        SELECT p_partkey, n * (a2 - a1 + 1) AS n_cells, n * (a2 - a1 + b2 - b1 + 2 - greatest(0, a2 - b1 + 1)) AS n_both FROM c""",
    "f28_languages": "SELECT c_custkey, CASE c_custkey % 10 WHEN 0 THEN 'en' WHEN 1 THEN 'ja-Kana' WHEN 2 THEN 'zh-Latn-pinyin' WHEN 4 THEN 'sr-Latn-RS' WHEN 6 THEN 'nan-Latn' WHEN 7 THEN 'be-Latn-tarask' END AS language, c_custkey % 10 IN (0, 4, 6, 7) AS is_language FROM customer",
    "f32_pointers": "SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS missing FROM events",
    "o06_categories": """WITH c AS (SELECT lower(p_brand) AS root, CASE WHEN p_partkey % 10 < 8 THEN rpad(replace(p_name, ' ', '_'), 45, '.') || lower(p_brand) || ' > ' || lower(p_type) || ' > ' || replace(p_name, ' ', '_') END AS entry FROM part WHERE p_partkey % 10 < 9)
        SELECT root, count(entry) AS n, coalesce(string_agg(DISTINCT entry, '; ' ORDER BY entry), '') AS listing FROM c GROUP BY 1""",
    "j08_sidecar": f"WITH {_SEG} SELECT segment_id AS id, subtype, s_name AS label FROM seg JOIN supplier ON s_suppkey * 3 = segment_id",
    "j15_references": """WITH k AS (SELECT s_suppkey AS k FROM supplier), f AS (SELECT 'segment' AS type, 's' || k AS id FROM k UNION ALL SELECT 'connector', 'c' || k FROM k WHERE k % 3 > 0 UNION ALL SELECT 'building', 'b' || k FROM k WHERE k % 5 > 0 UNION ALL SELECT 'division', 'd' || k FROM k WHERE k % 7 <> 3),
        r AS (SELECT 'segment' AS from_type, 's' || k AS from_id, unnest(['connectors[].connector_id', 'connectors[].connector_id', 'destinations[].from_connector_id', 'destinations[].to_connector_id', 'destinations[].to_segment_id', 'prohibited_transitions[].sequence[].connector_id', 'prohibited_transitions[].sequence[].segment_id']) AS role,
                unnest(['connector', 'connector', 'connector', 'connector', 'segment', 'connector', 'segment']) AS to_type, unnest(['c' || k, 'c' || (k + 1), 'c' || k, 'c' || (k + 2), 's' || (k + 1), 'c' || (k + 1), 's' || (k + 3)]) AS to_id FROM k
              UNION ALL SELECT 'building_part', 'p' || k, 'building_id', 'building', 'b' || k FROM k UNION ALL SELECT 'division_area', 'a' || k, 'division_id', 'division', 'd' || k FROM k
              UNION ALL SELECT 'division_boundary', 'e' || k, 'division_ids[]', 'division', unnest(['d' || k, 'd' || (k + 1)]) FROM k
              UNION ALL SELECT 'division', 'd' || k, unnest(['parent_division_id', 'hierarchies[][].division_id', 'hierarchies[][].division_id', 'capital_division_ids[]', 'capital_of_divisions[].division_id']), 'division', unnest(['d' || (k // 10), 'd0', 'd' || k, 'd' || (k + 4), 'd' || (k - 1)]) FROM k WHERE k % 7 <> 3)
        SELECT DISTINCT * FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.type = r.to_type AND f.id = r.to_id)""",
    "j15_unresolved": f"WITH {_SEG}, {_CON} SELECT segment_id, connector_id FROM con WHERE connector_id % 13 = 0",
}
