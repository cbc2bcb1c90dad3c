"""Registered queries that validate documents made of the tables, with DuckDB SQL that states the rules on their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validation
from ..operators.validation import GEOMETRIES
from ..sources.adapters import table

# Constraints of features and of two feature types.
TRIMMED = r"^(\S.*)?\S$"
COMMON = {"required": ["theme", "type", "version"], "patternProperties": {"^ext_.*$": {}}, "properties": {"theme": {"enum": ["addresses", "base", "buildings", "divisions", "places", "transportation"]}, "type": {"type": "string"}, "version": {"type": "integer", "minimum": 0}}}
ID = {"type": "string", "minLength": 1, "pattern": TRIMMED}
PLACE = {
    "type": "object", "required": ["geometry", "properties"], "unevaluatedProperties": False,
    "$defs": {"names": {"properties": {"names": {"type": "object", "required": ["primary"], "unevaluatedProperties": False, "properties": {"primary": {"type": "string", "minLength": 1, "pattern": TRIMMED}}}}}},
    "properties": {
        "type": {"const": "Feature"}, "id": ID, "geometry": {"oneOf": [GEOMETRIES["Point"]]},
        "properties": {
            "unevaluatedProperties": False, "allOf": [COMMON, {"$ref": "#/$defs/names"}],
            "properties": {
                "categories": {"type": "object", "required": ["primary"], "properties": {"primary": {"type": "string"}}}, "confidence": {"type": "number", "minimum": 0, "maximum": 1},
                "websites": {"type": "array", "items": {"type": "string", "format": "uri"}, "uniqueItems": True, "minItems": 1}, "emails": {"type": "array", "items": {"type": "string", "format": "email"}, "uniqueItems": True, "minItems": 1},
                "phones": {"type": "array", "items": {"type": "string"}, "uniqueItems": True, "minItems": 1},
            },
        },
    },
}
_SIDES = ["subtype", "class", "division_ids", "is_land", "is_territorial"]
BOUNDARY = {
    "type": "object", "required": ["geometry", "properties"], "unevaluatedProperties": False,
    "properties": {
        "type": {"const": "Feature"}, "id": ID, "geometry": {"oneOf": [GEOMETRIES["LineString"], GEOMETRIES["MultiLineString"]]},
        "properties": {
            "unevaluatedProperties": False, "allOf": [COMMON, {"if": {"properties": {"subtype": {"enum": ["country"]}}}, "then": {"required": _SIDES, "not": {"required": ["country"]}}, "else": {"required": [*_SIDES, "country"]}}],
            "oneOf": [{"properties": {"is_land": {"const": True}}}, {"properties": {"is_territorial": {"const": True}}}],
            "properties": {"subtype": {"type": "string"}, "class": {"type": "string", "enum": ["land", "maritime"]}, "is_land": {"type": "boolean"}, "is_territorial": {"type": "boolean"}, "division_ids": {"type": "array", "items": ID, "minItems": 2, "maxItems": 2, "uniqueItems": True}, "country": {"type": "string", "minLength": 2, "maxLength": 2, "pattern": "^[A-Z]{2}$"}},
        },
    },
}


def _spread(spark: SparkSession, d: str) -> DataFrame:
    """Customers over the session's number of partitions: checking a document costs far more than moving its number."""
    return table(spark, d, "customer").select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")


def _chosen(k, *texts: str):
    """The text that k (from 0) names."""
    return F.get(F.array(*map(F.lit, texts)), k.cast("int"))


def _places(spark: SparkSession, d: str) -> DataFrame:
    """c_custkey, doc: customers as places, each with the fault that its number names."""
    k = F.col("c_custkey")
    ok = '"categories":{"primary":"cafe"},"confidence":0.5'
    faults = [
        '"categories":{"primary":"cafe"},"confidence":1.5', '"categories":{"primary":"cafe"},"confidence":"x"', '"categories":{"alternate":[]},"confidence":1', f'{ok},"norms":{{}}', f'{ok},"websites":["no uri"]', f'{ok},"phones":[]', f'{ok},"phones":["1","2","1"]',
        f'{ok},"names":{{"primary":" X"}}', f'{ok},"emails":["a@b.org","ab"]', f'{ok},"confidence":null'.replace('"confidence":0.5,', ""), f'{ok},"ext_note":{{"a":1}}', f'{ok},"names":{{}}',
    ]
    version = F.when(k % 5 == 4, F.lit("-1")).when(k % 5 == 3, F.lit("1.5")).otherwise(F.lit("2.0"))
    shape = F.when(k % 7 == 6, F.lit('{"type":"LineString","coordinates":[[0,0],[1,1]]}')).when(k % 7 == 5, F.lit('{"type":"Point","coordinates":[1]}')).otherwise(F.lit('{"type":"Point","coordinates":[1,2.5]}'))
    doc = F.concat(F.lit('{"type":"Feature","id":"'), k.cast("string"), F.lit('","geometry":'), shape, F.lit(',"properties":{"theme":"places","type":"place","version":'), version, F.lit(","), _chosen(k % len(faults), *faults), F.lit("}}"))
    return _spread(spark, d).select("c_custkey", doc.alias("doc"))


def v01_place_errors(spark, d):
    found = validation.checked(_places(spark, d), "c_custkey", "doc", PLACE)
    return validation.each_error(found, "c_custkey").select("c_custkey", "e.path", "e.schema", "e.message")


def _boundaries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    sides = _chosen(k % 4, '"is_land":true,"is_territorial":false', '"is_land":true,"is_territorial":true', '"is_land":false,"is_territorial":false', '"is_land":false,"is_territorial":true')
    subtype = _chosen(k % 3, '"subtype":"country"', '"subtype":"region","country":"XA"', '"subtype":"region"')
    ids = _chosen(k % 5, '["a","b"]', '["a"]', '["a","a"]', '["a","b","c"]', '["a"," b"]')
    more = F.when(k % 7 == 6, F.lit(',"country":"XAB"')).otherwise(F.lit(""))
    wanted = F.when(k % 11 == 0, F.lit(',"ext_expected_errors":["missing property \'country\'","not failed"]')).otherwise(F.lit(""))
    cls = F.when(k % 13 == 0, F.lit("river")).otherwise(F.lit("land"))
    doc = F.concat(F.lit('{"type":"Feature","id":"b","geometry":{"type":"LineString","coordinates":[[0,0],[1,1]]},"properties":{"theme":"divisions","type":"division_boundary","version":0,"class":"'), cls, F.lit('",'), sides, F.lit(","), subtype, F.lit(',"division_ids":'), ids, F.when(k % 3 == 1, F.lit("")).otherwise(more), wanted, F.lit("}}"))
    return _spread(spark, d).select("c_custkey", doc.alias("doc"))


def v20_boundary_errors(spark, d):
    found = validation.checked(_boundaries(spark, d), "c_custkey", "doc", BOUNDARY)
    return validation.each_error(found, "c_custkey").select("c_custkey", "e.path", "e.message")


def v29_expected_errors(spark, d):
    """Of documents that say which errors they must have: whether they fail, and how many of those errors are missing."""
    docs = _boundaries(spark, d)
    v = F.try_parse_json("doc")
    found = validation.checked(docs.where(F.size(validation.expected(F.col("doc"))) > 0).select("c_custkey", "doc", v.isNotNull().alias("ok")), "c_custkey", "doc", BOUNDARY)
    both = found.join(docs, "c_custkey")
    return both.select("c_custkey", (F.size("errors") > 0).alias("fails"), F.size(validation.missed(F.col("errors"), validation.expected(F.col("doc")))).cast("long").alias("n_missed"))


def j14_dispatch(spark, d):
    """Documents of two feature types, and some whose theme and type do not belong together."""
    places = _places(spark, d).select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("k"), F.when(F.col("c_custkey") % 9 == 8, F.replace("doc", F.lit('"theme":"places"'), F.lit('"theme":"divisions"'))).otherwise(F.col("doc")).alias("doc"))
    every = places.unionAll(_boundaries(spark, d).select(F.concat(F.lit("b"), F.col("c_custkey").cast("string")).alias("k"), "doc"))
    found = validation.dispatched(every, "k", "doc", {("places", "place"): PLACE, ("divisions", "division_boundary"): BOUNDARY})
    return found.select("k", F.size("errors").cast("long").alias("n_errors"), F.exists("errors", lambda e: e["message"] == "oneOf failed, none matched").alias("none_matched"))


_AREA, _LINE, _POINT = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}', '{"type":"LineString","coordinates":[[0,0],[1,1]]}', '{"type":"Point","coordinates":[1,2]}'
#: Theme, type, geometry and properties of a document made of a customer with balance x, whole balance i, ten times that t, and key k; when a value breaks a rule (DuckDB).
TYPES = [
    ("addresses", "address", _POINT, '"number":"{i}","country":"XA","address_levels":[{"value":"A"},{}]', "false"),
    ("base", "bathymetry", _AREA, '"depth":{i}', "i < 0"),
    ("base", "infrastructure", _POINT, '"subtype":"tower","class":"bridge","height":{x}', "x <= 0"),
    ("base", "land", _POINT, '"subtype":"land","class":"hill","elevation":{t}', "i * 10 > 9000"),
    ("base", "land_cover", _AREA, '"subtype":"crop","cartography":{"min_zoom":{i}}', "i NOT BETWEEN 0 AND 23"),
    ("base", "land_use", _LINE, '"subtype":"park","class":"park","elevation":{i}', "i > 9000"),
    ("base", "water", _AREA, '"subtype":"lake","class":"pond","is_salt":true,"wikidata":"Q{k}"', "false"),
    ("buildings", "building", _AREA, '"height":{x},"names":{"primary":"N{k}","common":{"en":"a"}}', "x <= 0"),
    ("buildings", "building_part", _AREA, '"building_id":"{k}","num_floors":{i}', "i <= 0"),
    ("divisions", "division_boundary", _LINE, '"subtype":"region","class":"land","is_land":true,"is_territorial":{b},"division_ids":["a","b"],"country":"XA"', "i % 2 = 0"),
    ("divisions", "division", _POINT, '"names":{"primary":"N"},"subtype":"locality","country":"XA","hierarchies":[[{"division_id":"a","name":"A","subtype":"country"}]],"parent_division_id":"a","population":{i}', "i < 0"),
    ("divisions", "division_area", _AREA, '"names":{"primary":"N"},"subtype":"region","class":"land","country":"XA","division_id":"d","is_land":{b},"is_territorial":false', "i % 2 <> 0"),
    ("places", "place", _POINT, '"categories":{"primary":"cafe"},"confidence":{x}e-4', "x < 0"),
    ("transportation", "connector", _POINT, '"ext_x":{x}', "false"),
    ("transportation", "segment", _LINE, '"subtype":"road","class":"primary","connectors":[{"connector_id":"a","at":0},{"connector_id":"b","at":1}],"speed_limits":[{"max_speed":{"value":{i},"unit":"mph"}}]', "i NOT BETWEEN 1 AND 350"),
]


def _features(spark: SparkSession, d: str) -> DataFrame:
    """c_custkey, doc: customers as features of all types; a quarter each lacks its version, has an unknown property, or an unknown type."""
    k, x = F.col("c_custkey"), F.col("c_acctbal").cast("decimal(15,2)")
    i = F.floor(x).cast("long")
    heads = [f'{{"type":"Feature","id":"f","geometry":{shape},"properties":{{"theme":"{theme}",{more},"type":"{type_}' for theme, type_, shape, more, _ in TYPES]
    doc = _chosen(k % len(TYPES), *heads)
    for name, value in {"{i}": i.cast("string"), "{t}": (i * 10).cast("string"), "{x}": x.cast("string"), "{k}": k.cast("string"), "{b}": F.when(i % 2 == 0, "true").otherwise("false")}.items():
        doc = F.replace(doc, F.lit(name), value)
    tail = _chosen(F.floor(k / len(TYPES)) % 4, '","version":1', '"', '","version":1,"zzz":1', 's","version":1')
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    return rows.select("c_custkey", F.concat(doc, tail, F.lit("}}")).alias("doc"))


def j14_feature_types(spark, d):
    """Documents of all published feature types against the whole catalog in one plan."""
    found = validation.checked(_features(spark, d), "c_custkey", "doc", validation.feature_catalog(spark))
    e = F.col("errors")

    def some(test):
        return F.exists(e, test)

    known = ("missing property 'version'", "false schema", "oneOf failed, none matched")
    return found.select(
        "c_custkey", some(lambda x: x["message"] == known[0]).alias("no_version"), some(lambda x: x["path"] == "/properties/zzz").alias("unknown_name"),
        F.size(F.filter(e, lambda x: (x["path"] == "") & (x["message"] == known[1]))).cast("long").alias("n_other_types"), some(lambda x: ~x["message"].isin(*known)).alias("bad_value"),
    )


QUERIES = {f.__name__: f for f in (v01_place_errors, v20_boundary_errors, v29_expected_errors, j14_dispatch, j14_feature_types)}

_P = "S#/properties/properties"
_PLACE_ERRORS = f"""
p AS (SELECT c_custkey, c_custkey % 12 AS f, c_custkey % 5 AS v, c_custkey % 7 AS g FROM customer),
place_errors AS (SELECT c_custkey, '/properties/confidence' AS path, '{_P}/properties/confidence/maximum' AS schema, 'maximum: got 1.5, want 1' AS message FROM p WHERE f = 0
  UNION ALL SELECT c_custkey, '/properties/confidence', '{_P}/properties/confidence/type', 'got string, want number' FROM p WHERE f = 1
  UNION ALL SELECT c_custkey, '/properties/confidence', '{_P}/properties/confidence/type', 'got null, want number' FROM p WHERE f = 9
  UNION ALL SELECT c_custkey, '/properties/categories', '{_P}/properties/categories/required', 'missing property ''primary''' FROM p WHERE f = 2
  UNION ALL SELECT c_custkey, '/properties/norms', '{_P}/unevaluatedProperties', 'false schema' FROM p WHERE f = 3
  UNION ALL SELECT c_custkey, '/properties/websites/0', '{_P}/properties/websites/items/format', '''no uri'' is not valid uri' FROM p WHERE f = 4
  UNION ALL SELECT c_custkey, '/properties/phones', '{_P}/properties/phones/minItems', 'minItems: got 0, want 1' FROM p WHERE f = 5
  UNION ALL SELECT c_custkey, '/properties/phones', '{_P}/properties/phones/uniqueItems', 'items at 0 and 2 are equal' FROM p WHERE f = 6
  UNION ALL SELECT c_custkey, '/properties/names/primary', 'S#/$defs/names/properties/names/properties/primary/pattern', ''' X'' does not match pattern ''^(\\\\S.*)?\\\\S$''' FROM p WHERE f = 7
  UNION ALL SELECT c_custkey, '/properties/emails/1', '{_P}/properties/emails/items/format', '''ab'' is not valid email' FROM p WHERE f = 8
  UNION ALL SELECT c_custkey, '/properties/names', 'S#/$defs/names/properties/names/required', 'missing property ''primary''' FROM p WHERE f = 11
  UNION ALL SELECT c_custkey, '/properties/version', '{_P}/allOf/0/properties/version/minimum', 'minimum: got -1, want 0' FROM p WHERE v = 4
  UNION ALL SELECT c_custkey, '/properties/version', '{_P}/allOf/0/properties/version/type', 'got number, want integer' FROM p WHERE v = 3
  UNION ALL SELECT c_custkey, '/geometry', 'S#/properties/geometry/oneOf', 'oneOf failed, none matched' FROM p WHERE g IN (5, 6)
  UNION ALL SELECT c_custkey, '/geometry/coordinates', 'S#/properties/geometry/oneOf/0/properties/coordinates/minItems', 'minItems: got 1, want 2' FROM p WHERE g = 5
  UNION ALL SELECT c_custkey, '/geometry/type', 'S#/properties/geometry/oneOf/0/properties/type/enum', 'value must be ''Point''' FROM p WHERE g = 6
  UNION ALL SELECT c_custkey, '/geometry/coordinates/' || i, 'S#/properties/geometry/oneOf/0/properties/coordinates/items/type', 'got array, want number' FROM p, (SELECT unnest([0, 1]) AS i) WHERE g = 6)
"""
_BOUNDARY_ERRORS = """
o AS (SELECT c_custkey, c_custkey % 4 AS s, c_custkey % 3 AS t, c_custkey % 5 AS i, c_custkey % 7 = 6 AND c_custkey % 3 <> 1 AS more, c_custkey % 13 = 0 AS river, c_custkey % 11 = 0 AS says FROM customer),
boundary_errors AS (SELECT c_custkey, '/properties' AS path, 'oneOf failed, subschemas 0, 1 matched' AS message FROM o WHERE s = 1
  UNION ALL SELECT c_custkey, '/properties', 'oneOf failed, none matched' FROM o WHERE s = 2
  UNION ALL SELECT c_custkey, '/properties/' || c, 'value must be true' FROM o, (SELECT unnest(['is_land', 'is_territorial']) AS c) WHERE s = 2
  UNION ALL SELECT c_custkey, '/properties', 'not failed' FROM o WHERE t = 0 AND more
  UNION ALL SELECT c_custkey, '/properties', 'missing property ''country''' FROM o WHERE t = 2 AND NOT more
  UNION ALL SELECT c_custkey, '/properties/country', unnest(['maxLength: got 3, want 2', '''XAB'' does not match pattern ''^[A-Z]{2}$''']) FROM o WHERE more
  UNION ALL SELECT c_custkey, '/properties/division_ids', 'minItems: got 1, want 2' FROM o WHERE i = 1
  UNION ALL SELECT c_custkey, '/properties/division_ids', 'items at 0 and 1 are equal' FROM o WHERE i = 2
  UNION ALL SELECT c_custkey, '/properties/division_ids', 'maxItems: got 3, want 2' FROM o WHERE i = 3
  UNION ALL SELECT c_custkey, '/properties/division_ids/1', ''' b'' does not match pattern ''^(\\\\S.*)?\\\\S$''' FROM o WHERE i = 4
  UNION ALL SELECT c_custkey, '/properties/class', 'value must be one of ''land'', ''maritime''' FROM o WHERE river)
"""
_BAD = " ".join(f"WHEN {n} THEN {bad}" for n, (*_, bad) in enumerate(TYPES))
ORACLE_SQL = {
    "j14_feature_types": f"""WITH c AS (SELECT c_custkey, c_acctbal::DECIMAL(15,2) AS x, floor(c_acctbal::DECIMAL(15,2))::BIGINT AS i, (c_custkey // {len(TYPES)}) % 4 AS fault FROM customer),
        b AS (SELECT c_custkey, fault, fault <> 3 AND CASE c_custkey % {len(TYPES)} {_BAD} END AS bad FROM c)
        SELECT c_custkey, fault = 1 AS no_version, fault = 2 AS unknown_name, CASE WHEN fault = 3 THEN {len(TYPES)} WHEN fault > 0 OR bad THEN {len(TYPES) - 1} ELSE 0 END::BIGINT AS n_other_types, bad AS bad_value FROM b""",
    "v01_place_errors": f"WITH {_PLACE_ERRORS} SELECT * FROM place_errors",
    "v20_boundary_errors": f"WITH {_BOUNDARY_ERRORS} SELECT * FROM boundary_errors",
    "v29_expected_errors": f"""WITH {_BOUNDARY_ERRORS} SELECT o.c_custkey, count(e.message) > 0 AS fails, 2 - count(DISTINCT CASE WHEN e.message IN ('missing property ''country''', 'not failed') THEN e.message END) AS n_missed
        FROM o LEFT JOIN boundary_errors e ON e.c_custkey = o.c_custkey WHERE says GROUP BY 1""",
    "j14_dispatch": f"""WITH {_PLACE_ERRORS}, {_BOUNDARY_ERRORS} SELECT 'p' || p.c_custkey AS k, CASE WHEN p.c_custkey % 9 = 8 THEN 1 ELSE count(e.message) END AS n_errors, p.c_custkey % 9 = 8 OR g IN (5, 6) AS none_matched FROM p LEFT JOIN place_errors e ON e.c_custkey = p.c_custkey GROUP BY p.c_custkey, g
        UNION ALL SELECT 'b' || o.c_custkey, count(e.message), s = 2 FROM o LEFT JOIN boundary_errors e ON e.c_custkey = o.c_custkey GROUP BY o.c_custkey, s""",
}
