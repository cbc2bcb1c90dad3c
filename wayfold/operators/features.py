"""Operators on feature properties: validation, perspectives, names, sources, turn restrictions, building parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What follows "name" or stands before "_name" in a tag, and the variant that it means.
VARIANTS = {"official": "official", "short": "short", "loc": "alternate", "int": "alternate", "nat": "alternate", "old": "alternate", "ref": "alternate", "reg": "alternate", "alt": "alternate", "nick": "alternate"}


def failing(column: str, keyword: str, wanted) -> Column:
    """struct(path, keyword, message) if the column breaks the rule, else null; only `required` looks at nulls."""
    c = F.col(column)
    text = c.cast("string")
    listed = ", ".join(f"'{w}'" for w in wanted) if keyword == "enum" else ""
    broken, message = {
        "required": lambda: (c.isNull(), F.lit(f"missing property '{column}'")),
        "enum": lambda: (~c.isin(*wanted), F.lit(f"value must be one of {listed}" if len(wanted) > 1 else f"value must be {listed}")),
        "pattern": lambda: (~c.rlike(wanted[:-1] + r"\z" if wanted.endswith("$") else wanted), F.concat(F.lit("'"), c, F.lit("' does not match pattern '" + wanted + "'"))),
        "minimum": lambda: (c < wanted, F.concat(F.lit("minimum: got "), text, F.lit(f", want {wanted}"))),
        "maximum": lambda: (c > wanted, F.concat(F.lit("maximum: got "), text, F.lit(f", want {wanted}"))),
        "exclusiveMinimum": lambda: (c <= wanted, F.concat(F.lit("exclusiveMinimum: got "), text, F.lit(f", want {wanted}"))),
        "exclusiveMaximum": lambda: (c >= wanted, F.concat(F.lit("exclusiveMaximum: got "), text, F.lit(f", want {wanted}"))),
        "minLength": lambda: (F.char_length(c) < wanted, F.concat(F.lit("minLength: got "), F.char_length(c).cast("string"), F.lit(f", want {wanted}"))),
        "maxLength": lambda: (F.char_length(c) > wanted, F.concat(F.lit("maxLength: got "), F.char_length(c).cast("string"), F.lit(f", want {wanted}"))),
        "minItems": lambda: (F.size(c) < wanted, F.concat(F.lit("minItems: got "), F.size(c).cast("string"), F.lit(f", want {wanted}"))),
        "maxItems": lambda: (F.size(c) > wanted, F.concat(F.lit("maxItems: got "), F.size(c).cast("string"), F.lit(f", want {wanted}"))),
        "uniqueItems": lambda: (F.size(F.array_distinct(c)) < F.size(c), F.lit("items are not unique")),
        "const": lambda: (c != F.lit(wanted), F.lit(f"value must be '{wanted}'")),
    }[keyword]()
    broken = broken if keyword == "required" else c.isNotNull() & broken
    return F.when(broken, F.struct(F.lit(f"/properties/{column}").alias("path"), F.lit(keyword).alias("keyword"), message.alias("message")))


def errors(*rules: Column) -> Column:
    """All broken rules as an array; a row is valid if it is empty."""
    return F.array_compact(F.array(*rules))


def only_if(condition: Column, rule: Column) -> Column:
    """The rule where the condition holds (if and then); an unknown condition counts as true."""
    return F.when(F.coalesce(condition, F.lit(True)), rule)


def exactly_one(*branches: Column) -> Column:
    """Whether exactly one branch is valid; each branch is an errors() array."""
    return sum((F.size(b) == 0).cast("int") for b in branches) == 1


def validated(feats: DataFrame, key: str, *rules: Column) -> DataFrame:
    """key, path, keyword, message: one row a broken rule."""
    return feats.select(key, F.explode(errors(*rules)).alias("e")).select(key, "e.*")


def seen_from(country: str) -> Column:
    """Whether a feature with accepted_by and disputed_by belongs to a country's view.

    accepted_by names the only countries that see it; disputed_by those that do not; neither: everyone sees it.
    """
    accepted, disputed = F.array_contains("accepted_by", country), F.array_contains("disputed_by", country)
    return F.when(F.col("accepted_by").isNotNull(), accepted).when(F.col("disputed_by").isNotNull(), ~disputed).otherwise(True)


def name_variant(tag: Column) -> Column:
    """struct(variant, language) of a name tag; null for tags that hold no name."""
    kind = F.regexp_extract(tag, r"^([a-z]+)_name(?::|\z)", 1)
    table = F.create_map(*(F.lit(x) for pair in VARIANTS.items() for x in pair))
    variant = F.when(tag.rlike(r"^name(:|\z)"), "common").otherwise(F.try_element_at(table, kind))
    language = F.nullif(F.regexp_extract(tag, r"name:(.+)\z", 1), F.lit(""))
    return F.when(variant.isNotNull(), F.struct(variant.alias("variant"), language.alias("language")))


def names(tags: DataFrame) -> DataFrame:
    """feature_id, primary, common (map by language, the least value of each), rules (variant, language, value) of (feature_id, tag, value)."""
    met = tags.withColumn("v", name_variant(F.col("tag"))).where("v is not null and value is not null")
    each = met.groupBy("feature_id", "v").agg(F.min("value").alias("value"), F.array_sort(F.collect_set("value")).alias("every"))
    common = F.col("v.variant") == "common"
    plain = F.min(F.when(common & F.col("v.language").isNull(), F.col("value")))
    by_language = F.map_from_entries(F.array_sort(F.collect_list(F.when(common & F.col("v.language").isNotNull(), F.struct(F.col("v.language").alias("key"), F.col("value").alias("value"))))))
    rest = F.array_sort(F.flatten(F.collect_list(F.when(~common, F.transform("every", lambda x: F.struct(F.col("v.variant").alias("variant"), F.col("v.language").alias("language"), x.alias("value")))))))
    return each.groupBy("feature_id").agg(plain.alias("primary"), by_language.alias("common"), rest.alias("rules"))


def attributed(sources: DataFrame, prop: str) -> DataFrame:
    """feature_id and dataset: of the source of the property (a JSON pointer) if one is listed, else of the root ""; the least of several."""
    own, root = F.min(F.when(F.col("property") == prop, F.col("dataset"))), F.min(F.when(F.col("property") == "", F.col("dataset")))
    return sources.groupBy("feature_id").agg(F.coalesce(own, root).alias("dataset"))


def allowed_turns(turns: DataFrame, prohibited: DataFrame) -> DataFrame:
    """Turns (segment_id, connector_id, neighbour_id) without those that a restriction names; all others are allowed."""
    return turns.join(prohibited, ["segment_id", "connector_id", "neighbour_id"], "left_anti")


def parts_of_buildings(buildings: DataFrame, parts: DataFrame, members: DataFrame, cell: int) -> DataFrame:
    """part_id, building_id, explicit of rectangles (id, x1, y1, x2, y2).

    Members (building_id, part_id) come first; other parts go to the building that contains them whole, the smallest id
    of several; parts without a building are left out, and so is a building's only part if it has the building's shape.
    A part and its building meet in the grid cell of the part's lower corner, so the join is on equal cells.
    """
    at = lambda v: F.floor(F.col(v) / cell)
    b = buildings.select(F.col("id").alias("building_id"), *(F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")))
    p = parts.withColumnRenamed("id", "part_id")
    told = p.join(members, "part_id").join(b, "building_id").withColumn("explicit", F.lit(True))
    left = p.join(members.select("part_id").distinct(), "part_id", "left_anti").withColumns({"cx": at("x1"), "cy": at("y1")})
    spread = b.withColumn("cx", F.explode(F.sequence(at("bx1"), at("bx2")))).withColumn("cy", F.explode(F.sequence(at("by1"), at("by2"))))
    inside = left.join(spread, ["cx", "cy"]).where("bx1 <= x1 and x2 <= bx2 and by1 <= y1 and y2 <= by2")
    same = (F.col("x1") == F.col("bx1")) & (F.col("y1") == F.col("by1")) & (F.col("x2") == F.col("bx2")) & (F.col("y2") == F.col("by2"))
    found = inside.groupBy("part_id").agg(F.min(F.struct("building_id", same.alias("same"))).alias("m")).select("part_id", "m.building_id", "m.same", F.lit(False).alias("explicit"))
    every = told.select("part_id", "building_id", same.alias("same"), "explicit").unionByName(found)
    counts = every.groupBy("building_id").agg(F.count("*").alias("n"))
    return every.join(counts, "building_id").where("not (n = 1 and same)").select("part_id", "building_id", "explicit")
