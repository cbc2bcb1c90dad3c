import json

import pytest
from pyspark.sql import functions as F

from wayfold.operators import validation
from wayfold.operators.validation import GEOMETRIES

SCHEMA = {
    "type": "object", "unevaluatedProperties": False, "required": ["id", "geometry", "properties"],
    "$defs": {"unit": {"type": "number", "minimum": 0, "maximum": 1}, "range": {"properties": {"between": {"type": "array", "items": {"$ref": "#/$defs/unit"}, "minItems": 2, "maxItems": 2, "uniqueItems": True}}}},
    "properties": {
        "id": {"type": "string", "minLength": 1, "pattern": r"^(\S.*)?\S$"}, "geometry": {"oneOf": [GEOMETRIES["LineString"], GEOMETRIES["Point"]]},
        "properties": {
            "type": "object", "unevaluatedProperties": False, "required": ["subtype"], "patternProperties": {"^ext_.*$": {}},
            "allOf": [{"properties": {"level": {"type": "integer", "default": 0}, "time": {"type": "string", "format": "date-time"}}}, {"if": {"properties": {"subtype": {"enum": ["country"]}}}, "then": {"not": {"required": ["parent"]}}, "else": {"required": ["parent"]}}],
            "oneOf": [{"required": ["class"], "properties": {"subtype": {"const": "road"}, "class": {"enum": ["a", "b"]}, "surface": {"type": "string"}}}, {"properties": {"subtype": {"const": "country"}}}],
            "properties": {
                "subtype": {"type": "string"}, "parent": {"type": "string"}, "rules": {"type": "array", "uniqueItems": True, "items": {"type": "object", "unevaluatedProperties": False, "allOf": [{"$ref": "#/$defs/range"}], "anyOf": [{"required": ["min"]}, {"required": ["max"]}], "properties": {"min": {"type": "integer", "exclusiveMinimum": 0}, "max": {"type": "integer", "maximum": 350}, "when": {"minProperties": 1}}}},
                "common": {"type": "object", "minProperties": 1, "additionalProperties": False, "patternProperties": {"^[a-z]{2}$": {"type": "string", "minLength": 1}}},
            },
        },
    },
}
LINE = {"type": "LineString", "coordinates": [[0, 0], [1, 1.5]]}
ROAD = {"subtype": "road", "class": "a", "parent": "p"}


def document(**properties):
    return {"id": "x", "geometry": LINE, "properties": {k: v for k, v in {**ROAD, **properties}.items() if v is not ...}}


CASES = [
    (document(), []), (document(subtype="country", **{"class": ...}, parent=...), []), (document(level=1.0, ext_any={"a": 1}, time="2024-02-22T23:55:60Z"), []),
    (document(level=1.5), ["'/properties/level' [S#/properties/properties/allOf/0/properties/level/type]: got number, want integer"]),
    (document(level=None), ["got null, want integer"]), (document(time="abc2024-02-22T23:55:01-08:00"), ["allOf/0/properties/time/format]: 'abc2024-02-22T23:55:01-08:00' is not valid date-time"]),
    (document(parent=...), ["allOf/1/else/required]: missing property 'parent'"]), (document(subtype="country", **{"class": ...}), ["[S#/properties/properties/allOf/1/then]: not failed"]),
    (document(subtype="rail"), ["oneOf failed, none matched", "value must be 'road'", "value must be 'country'"]), (document(**{"class": "c"}), ["value must be one of 'a', 'b'"]),
    (document(unknown=1), ["'/properties/unknown' [S#/properties/properties/unevaluatedProperties]: false schema"]),
    (document(subtype="country", parent=..., surface="x", **{"class": ...}), ["'/properties/surface' [S#/properties/properties/unevaluatedProperties]: false schema"]),
    (document(rules=[{"min": 5, "between": [0, 1]}, {"max": 350, "when": {"a": 1}}]), []), (document(rules=[]), []),
    (document(rules=[{"min": 0}]), ["'/properties/rules/0/min' [S#/properties/properties/properties/rules/items/properties/min/exclusiveMinimum]: exclusiveMinimum: got 0, want 0"]),
    (document(rules=[{"max": 351}, {"when": {}}]), ["maximum: got 351, want 350", "'/properties/rules/1' [S#/properties/properties/properties/rules/items/anyOf]: anyOf failed", "minProperties: got 0, want 1"]),
    (document(rules=[{"min": 1, "between": [0.5, 1.5, 0.5]}]), ["[S#/$defs/range/properties/between/maxItems]: maxItems: got 3, want 2", "items at 0 and 2 are equal", "'/properties/rules/0/between/1' [S#/$defs/unit/maximum]: maximum: got 1.5, want 1"]),
    (document(rules=[{"min": 1}, {"min": 1}]), ["/uniqueItems]: items at 0 and 1 are equal"]), (document(rules="no"), ["got string, want array"]),
    (document(common={}), ["minProperties: got 0, want 1"]), (document(common={"en": "a", "abc123": "b"}), ["additional properties 'abc123' not allowed"]), (document(common={"en": ""}), ["minLength: got 0, want 1"]),
    ({**document(), "id": " x"}, [r"' x' does not match pattern '^(\\S.*)?\\S$'"]), ({**document(), "id": "x\n"}, ["does not match pattern"]),
    ({**document(), "geometry": {"type": "Point", "coordinates": [1, "a"]}}, ["coordinates/items/type]: got string, want number"]), ({**document(), "geometry": {**LINE, "more": 1}}, ["'/geometry/more'"]),
    ({**document(), "geometry": {"type": "LineString", "coordinates": [[0, 0]]}}, ["minItems: got 1, want 2"]), ({}, ["missing properties 'id', 'geometry', 'properties'"]), ([], ["got array, want object"]),
]


def test_constraints(spark):
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(CASES)] + [(900, "{"), (901, None)], "k int, doc string")
    found = {r.k: r.lines for r in validation.checked(rows, "k", "doc", SCHEMA).select("k", validation.lines(F.col("errors")).alias("lines")).collect()}
    for i, (d, wanted) in enumerate(CASES):
        assert bool(found[i]) == bool(wanted), (d, found[i])
        for w in wanted:
            assert any(w in line for line in found[i]), (w, found[i])
    assert found[900] == found[901] == ["at '' [S#]: not a JSON document"]


def test_expected_errors_pointers_and_defaults(spark):
    docs = [document(level="x", ext_expected_errors=["got string, want integer", "not there"]), document(ext_expected_errors=["none"]), {"properties": 3}]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "k int, doc string")
    found = validation.checked(rows, "k", "doc", SCHEMA).join(rows, "k")
    assert [r.m for r in found.select("k", validation.missed(F.col("errors"), validation.expected(F.col("doc"))).alias("m")).orderBy("k").collect()] == [["not there"], ["none"], []]
    v = F.parse_json(F.lit('{"a": {"b/c": [1, {"d": null}]}, "level": 4}'))
    got = spark.range(1).select(*(F.to_json(validation.pointer(v, p)).alias(f"p{i}") for i, p in enumerate(["/a/b~1c/0", "/a/b~1c/1/d", "/a/x", "/level"])), validation.with_default(v, {"properties": {"level": {"default": 0}}}, "level", "int").alias("given"), validation.with_default(v, {"properties": {"z": {"default": 7}}}, "z", "int").alias("filled")).first()
    assert tuple(got) == ("1", "null", None, "4", 4, 7)


def test_schemas_are_checked():
    for bad in ({"typ": "x"}, {"$ref": "#/$defs/none"}, {"properties": {"a": {"pattern": "("}}}, {"allOf": [{"items": {"minimun": 1}}]}):
        with pytest.raises(Exception):  # noqa: B017
            validation.check_schema(bad, bad)


ODD = [
    ({"properties": {"it's": {"type": "string"}, "a b": {"minimum": 2}}}, {"it's": 1, "a b": 1}, ["got number, want string", "minimum: got 1, want 2"]), ({"properties": {"it's": {"type": "string"}}}, {"it's": "x"}, []),
    ({"properties": {"a": {"properties": {"b.c": {"const": 1}}}}}, {"a": {"b.c": 2}}, ["at '/a/b.c'"]), ({"const": {"x": 1, "y": [2, "z"]}}, {"y": [2, "z"], "x": 1}, []), ({"enum": [{"x": 1}, 3]}, {"x": 2}, ["value must be one of"]), ({"enum": ["a", 3]}, 3.0, []), ({"const": True}, 1, ["value must be true"]),
    ({"additionalProperties": False, "patternProperties": {"ext_": {}}}, {"my_ext_a": 1}, []), ({"additionalProperties": False, "patternProperties": {"^ext_": {}}}, {"my_ext_a": 1}, ["additional properties 'my_ext_a' not allowed"]),
    ({"properties": {"a": {}}, "additionalProperties": {"type": "integer"}}, {"a": "x", "b": "y", "c": 2}, ["at '/b' [S#/additionalProperties/type]: got string, want integer"]), ({"propertyNames": {"pattern": "^[a-z]+$", "maxLength": 2}}, {"ab": 1, "ABC": 2}, ["'ABC' does not match pattern", "maxLength: got 3, want 2"]),
    ({"type": "integer"}, 123456789012345678901234567890, []), ({"type": "integer"}, 1.5, ["got number, want integer"]), ({"type": ["null", "string"]}, None, []), ({"type": ["null", "string"]}, 4, ["got number, want null or string"]), ({"maxProperties": 1}, {"a": 1, "b": 2}, ["maxProperties: got 2, want 1"]),
    ({"format": "date-time"}, "2023-02-30T10:00:00Z", ["is not valid date-time"]), ({"format": "date-time"}, "2024-02-29T10:00:00+01:00", []), ({"uniqueItems": True}, [{"a": 1, "b": 2}, {"b": 2, "a": 1}], ["items at 0 and 1 are equal"]), ({"properties": {"a": False}}, {"a": 1}, ["at '/a'"]),
    ({"not": {"type": "object", "minProperties": 1}}, {"a": 1}, ["not failed"]), ({"unevaluatedProperties": False, "anyOf": [{"properties": {"a": {"type": "string"}}, "required": ["a"]}, {"properties": {"b": {}}, "required": ["b"]}]}, {"a": 1, "b": 2}, ["at '/a' [S#/unevaluatedProperties]: false schema"]),
    ({"unevaluatedProperties": False, "if": {"properties": {"a": {"minimum": 3}}, "required": ["a"]}, "then": {"properties": {"b": {}}}, "else": {"properties": {"c": {}}}}, {"a": 5, "b": 1}, []), ({"items": {"items": {"properties": {"a": {"type": "string"}}}}}, [[{}, {"a": 1}]], ["at '/0/1/a' [S#/items/items/properties/a/type]"]),
]


@pytest.mark.parametrize("schema, document, wanted", ODD)
def test_single_rules(spark, schema, document, wanted):
    rows = spark.createDataFrame([(0, json.dumps(document))], "k int, doc string")
    found = validation.checked(rows, "k", "doc", schema).select(validation.lines(F.col("errors")).alias("lines")).first().lines
    assert bool(found) == bool(wanted) and all(any(w in line for line in found) for w in wanted), found


def test_plan_grows_with_the_schema_only(spark):
    """Closed objects with a choice at each of six levels: results are bound, not pasted."""
    schema = {"type": "string"}
    for _ in range(6):
        schema = {"unevaluatedProperties": False, "oneOf": [{"properties": {"a": schema}}, {"required": ["b"], "properties": {"b": {}}}]}
    found, _ = validation.expressions(schema, "v")[::-1]
    assert len(found) < 40_000
