"""Documents of the published feature types: good ones of each type, and each kind of fault with the texts that it must give."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from wayfold.operators import validation
from wayfold.operators.catalog import Catalog

POINT, LINE = {"type": "Point", "coordinates": [1, 2.5]}, {"type": "LineString", "coordinates": [[0, 0], [1, 1.5, 3]]}
AREA = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
AREAS = {"type": "MultiPolygon", "coordinates": [AREA["coordinates"]], "bbox": [0, 0, 1, 1]}
NAMES = {"primary": "A", "common": {"en": "A", "zh-Hant": "B"}, "rules": [{"variant": "short", "value": "a", "language": "de", "between": [0, 0.5], "side": "left", "perspectives": {"mode": "accepted_by", "countries": ["XA"]}}]}
LIMIT = {"max_speed": {"value": 50, "unit": "km/h"}, "when": {"mode": ["car"], "during": "Mo-Fr 07:00-19:00", "vehicle": [{"dimension": "weight", "comparison": "greater_than", "value": 3.5, "unit": "t"}]}}
TURN = {"sequence": [{"connector_id": "c", "segment_id": "s"}], "final_heading": "forward", "when": {"heading": "forward", "using": ["to_deliver"], "recognized": ["as_permitted"]}}
SIGN = {"from_connector_id": "a", "to_connector_id": "b", "to_segment_id": "s", "final_heading": "forward", "labels": [{"value": "x", "type": "street"}], "symbols": ["airport"]}
GOOD = {
    "address": ("addresses", POINT, {"country": "XA", "postcode": "1", "street": "S", "number": "1a", "unit": "2", "postal_city": "C", "address_levels": [{"value": "A"}, {}]}),
    "bathymetry": ("base", AREAS, {"depth": 10, "level": 1, "cartography": {"prominence": 1, "min_zoom": 0, "max_zoom": 23, "sort_key": -3}}),
    "infrastructure": ("base", POINT, {"subtype": "tower", "class": "bridge", "height": 3.5, "surface": "sand", "source_tags": {"a": 1}, "wikidata": "Q1", "names": NAMES}),
    "land": ("base", LINE, {"subtype": "land", "class": "cliff", "elevation": -3}), "land_cover": ("base", AREA, {"subtype": "moss"}), "land_use": ("base", AREA, {"subtype": "park", "class": "zoo"}),
    "water": ("base", AREA, {"subtype": "lake", "class": "pond", "is_salt": True, "is_intermittent": False}),
    "building": ("buildings", AREA, {"class": "residential", "height": 2.5, "num_floors": 2, "roof_shape": "dome", "roof_direction": 359.5, "has_parts": True, "names": NAMES}),
    "building_part": ("buildings", AREA, {"building_id": "b", "min_height": -1, "facade_material": "brick"}),
    "division": ("divisions", POINT, {"names": NAMES, "subtype": "region", "country": "XA", "region": "XA-1", "hierarchies": [[{"division_id": "a", "name": "A", "subtype": "country"}]], "parent_division_id": "a", "norms": {"driving_side": "left"}, "local_type": {"en": "state"}, "capital_division_ids": ["c"], "perspectives": {"mode": "disputed_by", "countries": ["XA"]}}),
    "division_area": ("divisions", AREAS, {"names": NAMES, "subtype": "county", "class": "land", "country": "XA", "division_id": "d", "is_land": True, "is_territorial": True}),
    "division_boundary": ("divisions", LINE, {"subtype": "region", "class": "maritime", "division_ids": ["a", "b"], "is_land": False, "is_territorial": True, "country": "XA", "is_disputed": True}),
    "place": ("places", POINT, {"names": NAMES, "categories": {"primary": "a_b", "alternate": ["c"]}, "confidence": 1, "websites": ["https://a.example/b"], "socials": ["x:y"], "emails": ["a@b.c"], "phones": ["1"], "brand": {"names": NAMES, "wikidata": "Q5"}, "addresses": [{"freeform": "f", "country": "XA"}]}),
    "connector": ("transportation", POINT, {"ext_any": {"a": [1]}}),
    "segment": ("transportation", LINE, {"subtype": "road", "class": "primary", "subclass": "link", "names": NAMES, "connectors": [{"connector_id": "a", "at": 0}, {"connector_id": "b", "at": 1}], "speed_limits": [LIMIT, {"min_speed": {"value": 5, "unit": "mph"}}], "access_restrictions": [{"access_type": "denied", "between": [0, 1]}], "prohibited_transitions": [TURN], "destinations": [SIGN], "road_surface": [{"value": "dirt"}], "road_flags": [{"values": ["is_link"]}], "width_rules": [{"value": 3}], "level_rules": [{"value": 1}], "subclass_rules": [{"value": "alley"}], "routes": [{"name": "n", "between": [0, 0.1]}]}),
}


def feature(kind, **changes):
    theme, shape, more = copy.deepcopy(GOOD[kind])
    properties = {"theme": theme, "type": kind, "version": 0, "sources": [{"property": "", "dataset": "d", "confidence": 0.5, "update_time": "2024-02-29T23:55:60Z"}], **more, **changes}
    return {"type": "Feature", "id": "x", "geometry": shape, "properties": {k: v for k, v in properties.items() if v is not ...}}


def shaped(kind, shape):
    return feature(kind) | {"geometry": shape}


def renamed(kind, **changes):
    return feature(kind, names={**NAMES, **changes})


RAIL = {"class": "tram", "subtype": "rail", "rail_flags": [{"values": ["is_freight"]}]} | {k: ... for k in ("subclass", "speed_limits", "prohibited_transitions", "destinations", "road_surface", "road_flags", "width_rules")}
MORE_GOOD = [feature("segment", **RAIL), feature("segment", **RAIL | {"subtype": "water", "class": ..., "rail_flags": ...}), feature("division", subtype="country", parent_division_id=...), feature("division_boundary", subtype="country", country=...), shaped("infrastructure", AREAS)]
BAD = [
    (feature("address", address_levels=[]), ["minItems: got 0, want 1"]), (feature("address", address_levels=[{}] * 6), ["maxItems: got 6, want 5"]), (feature("address", street=" A"), [r"' A' does not match pattern '^(\\S.*)?\\S$'"]),
    (feature("bathymetry", depth=-1), ["depth/minimum]: minimum: got -1, want 0"]), (feature("bathymetry", depth=...), ["missing property 'depth'"]),
    (feature("building", **{"class": "made-up"}), ["/properties/properties/properties/class/enum]: value must be one of"]), (feature("building", height=-1.23), ["properties/height/exclusiveMinimum]: exclusiveMinimum: got -1.23, want 0"]),
    (feature("building", num_floors=-3), ["shapeContainer/properties/num_floors/exclusiveMinimum]: exclusiveMinimum: got -3, want 0"]), (feature("building", num_floors_underground=-1), ["exclusiveMinimum: got -1, want 0"]),
    (feature("building", sources=[{"property": "", "dataset": "d", "confidence": 100}, {"property": "/a", "dataset": "d", "confidence": -1}]), ["/sourcePropertyItem/properties/confidence/maximum]: maximum: got 100, want 1", "/sourcePropertyItem/properties/confidence/minimum]: minimum: got -1, want 0"]),
    (feature("building", sources=[{"property": "", "dataset": "d", "update_time": "abc2023-02-22T23:55:01-08:00"}]), ["propertyDefinitions/featureUpdateTime/format]: 'abc2023-02-22T23:55:01-08:00' is not valid date-time"]),
    (feature("building", sources=[{"property": "", "dataset": "d", "update_time": "2023-02-30T10:00:00Z"}]), ["'2023-02-30T10:00:00Z' is not valid date-time"]), (feature("building", theme="places"), ["oneOf failed, none matched"]), (feature("building", type="house"), ["oneOf failed, none matched"]),
    (shaped("building", LINE), ["/properties/type/enum]: value must be 'Polygon'", "/properties/type/enum]: value must be 'MultiPolygon'"]), (shaped("building", {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 2]]]}), ["the ring does not end where it begins"]),
    (renamed("building", common={"abc123def456": "E"}), ["additional properties 'abc123def456' not allowed"]), (renamed("building", rules=[{"variant": "common", "language": "ga:genitive", "value": "B"}]), ["'ga:genitive' does not match pattern"]), (feature("building", names={"common": {"en": "E"}}), ["missing property 'primary'"]),
    (feature("building_part", names={"primary": ""}), ["minLength: got 0, want 1"]), (renamed("building", rules=[{"value": "a"}, {"variant": "x", "value": "a"}]), ["missing property 'variant'", "value must be one of 'common', 'official', 'alternate', 'short'"]),
    (renamed("land", common={"etymology:wikidata": "a", "etymology": "b"}, rules=[{"variant": "common", "language": "etymology:wikidata", "value": "a"}, {"variant": "short", "language": "pronunciation", "value": "b"}]), ["additionalProperties]: additional properties", "'etymology:wikidata' does not match pattern", "'pronunciation' does not match pattern"]),
    (feature("division", capital_division_ids=["    "]), ["'    ' does not match pattern"]), (feature("division", **{"class": "burg"}), ["value must be one of 'megacity', 'city', 'town', 'village', 'hamlet'"]), (feature("division", country="ZZZ"), ["maxLength: got 3, want 2", "'ZZZ' does not match pattern"]),
    (shaped("division", {"type": "Point", "coordinates": ["a", 1]}), ["properties/coordinates/items/type]: got string, want number"]), (shaped("division", LINE), ["value must be 'Point'"]),
    (feature("division", hierarchies=[[{"division_id": "a", "subtype": "country"}, {"name": "b", "subtype": "region"}, {"name": "c", "division_id": "c"}], []]), [f"/propertyDefinitions/hierarchyItem/required]: missing property '{n}'" for n in ("name", "division_id", "subtype")] + ["/propertyDefinitions/hierarchy/minItems]: minItems: got 0, want 1"]),
    (renamed("division", primary=None, common={"a-b-c-d-e-f-g-h-i-j-k-l": "x"}), ["/propertyDefinitions/allNames/properties/primary/type]: got null, want string", "additional properties 'a-b-c-d-e-f-g-h-i-j-k-l' not allowed"]),
    (feature("division", norms={"driving_side": "middle", "more": 1}), ["value must be one of 'left', 'right'", "/properties/properties/properties/norms/unevaluatedProperties]: false schema"]), (feature("division", parent_division_id=" "), ["' ' does not match pattern"]), (feature("division", region="foo"), ["minLength: got 3, want 4", "'foo' does not match pattern"]),
    (feature("division", subtype="planet"), ["/propertyDefinitions/placetype/enum]: value must be one of 'country',"]), (feature("division", names=..., subtype=..., country=..., hierarchies=..., parent_division_id=...), ["missing properties 'names', 'subtype', 'country', 'hierarchies'"]),
    (feature("division", subtype="country"), ["[S#/properties/properties/allOf/3/then]: not failed"]), (feature("division", parent_division_id=...), ["missing property 'parent_division_id'"]),
    (feature("division_area", division_id="abc "), ["'abc ' does not match pattern"]), (shaped("division_area", {"type": "Polygon", "coordinates": [1, 2]}), ["got number, want array"]), (feature("division_area", is_land="x"), ["is_land/type]: got string, want boolean"]), (feature("division_area", is_land=False, is_territorial=False), ["anyOf failed"]),
    (feature("division_area", region="this just seems wrong"), ["/propertyDefinitions/iso3166_2SubdivisionCode/maxLength]: maxLength: got 21, want 6", "'this just seems wrong' does not match pattern"]), (feature("division_area", names=..., subtype=..., country=..., division_id=..., **{"class": ...}), [" missing properties 'names', 'subtype', 'class', 'country', 'division_id'"]),
    (feature("division_boundary", division_ids=["a", "b", "b", 4], is_land="x"), ["maxItems: got 4, want 2", "items at 1 and 2 are equal", "propertyDefinitions/id/type]: got number, want string", "got string, want boolean"]), (feature("division_boundary", division_ids=["a"]), ["minItems: got 1, want 2"]),
    (shaped("division_boundary", POINT), ["value must be 'LineString'"]), (feature("division_boundary", is_land=True), ["division_boundary.yaml#/properties/properties/oneOf]: oneOf failed, subschemas 0, 1 matched"]), (feature("division_boundary", country=...), ["missing property 'country'"]), (feature("division_boundary", **{"class": "river"}), ["value must be one of 'land', 'maritime'"]),
    (feature("place", addresses=[{"freeform": "a", "region2": "b"}]), ["/$defs/propertyDefinitions/address/unevaluatedProperties]: false schema"]), (feature("place", categories={"alternate": ["a"]}), ["missing property 'primary'"]), (feature("place", categories={"primary": "foo_", "alternate": [" bar ", "BAZ"]}), [f"'{t}' does not match pattern" for t in ("foo_", " bar ", "BAZ")]),
    (feature("place", emails=[]), ["minItems: got 0, want 1"]), (feature("place", phones=[]), ["minItems: got 0, want 1"]), (feature("place", websites=["no"]), ["'no' is not valid uri"]), (shaped("place", LINE), ["value must be 'Point'"]), (feature("connector", level=1), ["/properties/unevaluatedProperties]: false schema", "schema/transportation/connector.yaml#/properties/properties/unevaluatedProperties]: false schema"]),
    (feature("segment", **{"class": "x"}), ["roadClass/enum]: value must be one of 'motorway',"]), (feature("segment", connectors=[{"connector_id": "a", "at": 0}, {"connector_id": "b", "at": 1}, {"connector_id": "a", "at": 0.0}]), ["items at 0 and 2 are equal"]), (feature("segment", connectors=["a", 1, True]), [f"got {k}, want object" for k in ("string", "number", "boolean")]),
    (shaped("segment", POINT), ["at '/geometry/type' [S#/properties/type/enum]: value must be 'LineString'"]), (feature("segment", width_rules=[]), ["minItems: got 0, want 1"]), (feature("segment", width_rules=[{}]), ["propertyContainers/widthRulesContainer/items/required]: missing property 'value'"]),
    (feature("segment", routes=[{"name": ""}]), ["routes/items/properties/name/minLength]: minLength: got 0, want 1", "routes/items/properties/name/pattern]: '' does not match pattern"]), (feature("segment", sources=[{"property": "", "dataset": "d", "between": []}]), ["minItems: got 0, want 2"]),
    (feature("segment", subtype=...), ["missing property 'subtype'"]), (feature("segment", version=...), ["missing property 'version'"]), (feature("segment", subtype="rail", **{"class": "motorway"}), ["oneOf failed, none matched", "[S#/$defs/propertyDefinitions/railClass/enum]: value must be one of"]),
    (feature("segment", **RAIL | {"rail_flags": [{"values": ["is_freight", "is_freight"]}]}), ["railFlagsContainer/items/properties/values/uniqueItems]: items at 0 and 1 are equal"]), (feature("segment", **RAIL | {"rail_flags": [{"values": ["x"]}]}), ["value must be one of"]),
    (feature("segment", destinations=[{**SIGN, "labels": SIGN["labels"] * 2}]), ["destinations/items/properties/labels/uniqueItems]: items at 0 and 1 are equal"]), (feature("segment", destinations=[{**SIGN, "labels": [{"value": None, "type": "x"}], "symbols": ["y"]}]), ["propertyDefinitions/destinationLabelType/enum]: value must be one of 'street',", "got null, want string", "propertyDefinitions/destinationSignSymbol/enum]: value must be one of 'motorway',"]),
    (feature("segment", destinations=[{k: v for k, v in SIGN.items() if k != "final_heading"}]), ["missing property 'final_heading'"]), (feature("segment", road_flags=[{"values": ["is_link", "is_link"]}]), ["roadFlagsContainer/items/properties/values/uniqueItems]: items at 0 and 1 are equal"]), (feature("segment", road_flags=["is_link"]), ["got string, want object"]),
    (feature("segment", during="x"), ["schema/transportation/segment.yaml#/properties/properties/unevaluatedProperties]: false schema"]), (feature("segment", level=1.5), ["schema/defs.yaml#/$defs/propertyDefinitions/level/type]: got number, want integer"]), (feature("segment", level_rules=[{"value": 1, "foo": 2}]), ["'/properties/level_rules/0/foo' [S#/$defs/propertyContainers/levelRulesContainer/items/unevaluatedProperties]: false schema"]),
    (feature("segment", road_surface=[{"value": "lava"}]), ["[S#/$defs/propertyDefinitions/roadSurface/enum]: value must be one of"]), (feature("segment", access_restrictions=[{"access_type": "denied", "when": {"mode": ["boat"]}}]), ["travelMode/enum]: value must be one of"]),
    (feature("segment", access_restrictions=[{"access_type": "denied", "when": {"vehicle": [{"dimension": "weight", "comparison": "equal", "value": {}}]}}]), ["propertyContainers/vehicleScopeContainer/properties/vehicle/items/properties/value/type]: got object, want number"]),
    (feature("segment", access_restrictions=[{"foo": 1}, {"access_type": "denied", "when": {"mode": ["car"], "baz": 1}}]), ["'/properties/access_restrictions/0' [S#/$defs/propertyContainers/accessContainer/items/required]: missing property 'access_type'", "'/properties/access_restrictions/1/when/baz' [S#/$defs/propertyContainers/accessContainer/items/properties/when/unevaluatedProperties]: false schema"]),
    (feature("segment", prohibited_transitions=[{**TURN, "sequence": TURN["sequence"] * 2, "foo": 1}]), ["items at 0 and 1 are equal", "'/properties/prohibited_transitions/0/foo' [S#/$defs/propertyContainers/prohibitedTransitionsContainer/items/unevaluatedProperties]: false schema"]), (feature("segment", prohibited_transitions=[{**TURN, "sequence": []}]), ["sequence/minItems]: minItems: got 0, want 1"]),
    (feature("segment", speed_limits=[{}]), ["anyOf/0/required]: missing property 'min_speed'", "anyOf/1/required]: missing property 'max_speed'"]), (feature("segment", speed_limits={}), ["'/properties/speed_limits' [S#/$defs/propertyContainers/speedLimitsContainer/type]: got object, want array"]), (feature("segment", speed_limits=[{**LIMIT, "when": {"mode": ["boat"]}}]), ["'/properties/speed_limits/0/when/mode/0' [S#/$defs/propertyDefinitions/travelMode/enum]: value must be one of"]),
    (feature("segment", speed_limits=[{**LIMIT, "when": {}}, {"max_speed": {"value": 351, "unit": "kn"}}]), ["minProperties: got 0, want 1", "maximum: got 351, want 350", "value must be one of 'km/h', 'mph'"]), ({}, ["missing properties 'type', 'properties', 'geometry'"]), (feature("water") | {"more": 1}, ["schema.yaml#/unevaluatedProperties]: false schema"]),
]


def test_published_forms(spark):
    good = [feature(k) for k in GOOD] + MORE_GOOD
    docs = [(d, None) for d in good] + BAD
    frame = spark.createDataFrame([(i, json.dumps(d), e) for i, (d, e) in enumerate(docs)], "k int, doc string, wanted array<string>")
    found = validation.checked(frame, "k", "doc", validation.feature_catalog(spark)).join(frame.select("k", "wanted"), "k")
    for r in found.select("k", F.size("errors").alias("n"), validation.missed(F.col("errors"), F.coalesce("wanted", F.array())).alias("missed"), validation.lines(F.col("errors")).alias("lines")).collect():
        assert (r.n == 0) == (r.k < len(good)) and not r.missed, (docs[r.k], r.missed, r.lines)


def test_catalog_from_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "thing.yaml").write_text("type: object\nrequired: [at]\nproperties: {at: {$ref: ../defs.json#/$defs/day}, a: {$ref: https://x.example/a.json}}\n")
    (tmp_path / "defs.json").write_text(json.dumps({"$defs": {"day": {"type": "string", "enum": ["2024-01-01"]}}}))
    (tmp_path / "schema.yaml").write_text("items: {$ref: ./sub/thing.yaml}\n")
    place = validation.Catalog.load(spark, str(tmp_path), {"https://x.example/a.json": {"type": "integer"}}).place("schema.yaml")
    frame = spark.createDataFrame([(0, '[{"at": "2024-01-01", "a": 3}]'), (1, '[{}, {"at": 1, "a": "x"}]')], "k int, doc string")
    got = {r.k: r.lines for r in validation.checked(frame, "k", "doc", place).select("k", validation.lines(F.col("errors"), True).alias("lines")).collect()}
    assert got[0] == []
    assert got[1] == ["at '/0' [schema/sub/thing.yaml#/required]: missing property 'at'", "at '/1/at' [schema/defs.json#/$defs/day/type]: got number, want string", "at '/1/at' [schema/defs.json#/$defs/day/enum]: value must be '2024-01-01'", "at '/1/a' [schema/https://x.example/a.json#/type]: got string, want integer"]


def test_references_are_followed_and_checked():
    for files in ({"a.yaml": {"$ref": "b.yaml"}}, {"a.yaml": {"$ref": "#/$defs/x"}}, {"a.yaml": {"$ref": "b.yaml"}, "b.yaml": {"properties": {"x": {"$ref": "a.yaml"}}}}, {"a.yaml": {"items": {"$ref": "#"}}}, {"a.yaml": {"$defs": {"group": {"x": {"typ": "string"}}}}}):
        with pytest.raises(ValueError):
            place = Catalog(files).place("a.yaml")
            validation.check_schema(place.schema, place, "")
    place = validation.feature_catalog(None)
    assert len(place.catalog.files) == 21 + len(validation.GEOJSON)
    validation.check_schema(place.schema, place, "")
