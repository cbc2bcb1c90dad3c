"""Foreign keys of features: every reference of a document as one row, and those that name nothing, found in one pass.

References of all kinds are stacked as (from_type, from_id, role, to_type, to_id). The distinct keys that are asked for meet the features'
own keys once, however many rows ask for one of them; only the keys that are missing go back to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TURNS = "array<struct<sequence:array<struct<connector_id:string,segment_id:string>>>>"
_SIGNS = "array<struct<from_connector_id:string,to_connector_id:string,to_segment_id:string>>"
_NAMED = "array<struct<division_id:string>>"
# Type, member of the properties, its form, the way from there to the ids, and the type that they name.
REFERENCES = [
    ("segment", "connectors", "array<struct<connector_id:string>>", lambda v: F.transform(v, lambda c: c["connector_id"]), "connector", "connectors[].connector_id"),
    ("segment", "destinations", _SIGNS, lambda v: F.transform(v, lambda d: d["from_connector_id"]), "connector", "destinations[].from_connector_id"),
    ("segment", "destinations", _SIGNS, lambda v: F.transform(v, lambda d: d["to_connector_id"]), "connector", "destinations[].to_connector_id"),
    ("segment", "destinations", _SIGNS, lambda v: F.transform(v, lambda d: d["to_segment_id"]), "segment", "destinations[].to_segment_id"),
    ("segment", "prohibited_transitions", _TURNS, lambda v: F.flatten(F.transform(v, lambda t: F.transform(t["sequence"], lambda s: s["connector_id"]))), "connector", "prohibited_transitions[].sequence[].connector_id"),
    ("segment", "prohibited_transitions", _TURNS, lambda v: F.flatten(F.transform(v, lambda t: F.transform(t["sequence"], lambda s: s["segment_id"]))), "segment", "prohibited_transitions[].sequence[].segment_id"),
    ("building_part", "building_id", "string", lambda v: F.array(v), "building", "building_id"),
    ("division_area", "division_id", "string", lambda v: F.array(v), "division", "division_id"),
    ("division_boundary", "division_ids", "array<string>", lambda v: v, "division", "division_ids[]"),
    ("division", "parent_division_id", "string", lambda v: F.array(v), "division", "parent_division_id"),
    ("division", "hierarchies", f"array<{_NAMED}>", lambda v: F.transform(F.flatten(v), lambda h: h["division_id"]), "division", "hierarchies[][].division_id"),
    ("division", "capital_division_ids", "array<string>", lambda v: v, "division", "capital_division_ids[]"),
    ("division", "capital_of_divisions", _NAMED, lambda v: F.transform(v, lambda d: d["division_id"]), "division", "capital_of_divisions[].division_id"),
]


def _listed(kind: Column, properties: Column) -> Column:
    """Each reference of a feature, nulls left out."""
    every = []
    for of, member, form, ids, to, role in REFERENCES:
        found = F.when(kind == of, ids(F.try_variant_get(properties, f"$.{member}", form)))
        every.append(F.transform(F.coalesce(found, F.array().cast("array<string>")), _reference(role, to)))
    return F.filter(F.flatten(F.array(*every)), lambda r: r["to_id"].isNotNull())


def _reference(role: str, to: str):
    return lambda i: F.struct(F.lit(role).alias("role"), F.lit(to).alias("to_type"), i.alias("to_id"))


def references(features: DataFrame) -> DataFrame:
    """from_type, from_id, role, to_type, to_id of features (id, type, properties as JSON text), each once."""
    v = F.try_parse_json("properties")
    rows = features.select(F.col("type").alias("from_type"), F.col("id").alias("from_id"), F.explode(_listed(F.col("type"), v)).alias("r"))
    return rows.select("from_type", "from_id", "r.*").distinct()


def unresolved(features: DataFrame) -> DataFrame:
    """references() that name no feature of the type."""
    asked = references(features)
    own = features.select(F.col("type").alias("to_type"), F.col("id").alias("to_id")).distinct()
    missing = asked.select("to_type", "to_id").distinct().join(own, ["to_type", "to_id"], "left_anti")
    return asked.join(missing, ["to_type", "to_id"], "left_semi").select("from_type", "from_id", "role", "to_type", "to_id")


def sources_without_property(features: DataFrame) -> DataFrame:
    """id and property of sources whose JSON pointer (below /properties) names no member of their feature; "" names the whole."""
    v = F.try_parse_json("properties")
    rows = features.select("id", F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")).alias("names"), F.explode(F.try_variant_get(v, "$.sources", "array<struct<property:string>>")).alias("s"))
    name = F.replace(F.replace(F.split(F.col("s.property"), "/")[2], F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    known = (F.col("s.property") == "") | (F.startswith("s.property", F.lit("/properties/")) & F.array_contains("names", name))
    return rows.where(~F.coalesce(known, F.lit(False))).select("id", F.col("s.property").alias("property"))
