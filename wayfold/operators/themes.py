"""Queries of the map themes: zoom ranges, drawing order, sides of boundaries, categories, references between features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tags import category_path

# The subtypes that are published for each feature type of the divisions theme.
SUBTYPES = {
    "division": ["country", "dependency", "region", "county", "localadmin", "locality", "macrohood", "neighborhood", "microhood"],
    "division_area": ["country", "dependency", "region", "county", "localadmin", "locality", "neighborhood", "microhood"],
    "division_boundary": ["country", "region", "county"],
}


def at_zoom(zoom: int) -> Column:
    """Whether a feature (min_zoom, max_zoom) is drawn at a zoom from 0 to 23; a missing end has no limit."""
    return (F.coalesce("min_zoom", F.lit(0)) <= zoom) & (F.coalesce("max_zoom", F.lit(23)) >= zoom)


def draw_rank(rows: DataFrame, tile: str, key: str) -> DataFrame:
    """rows with draw_rank within their tile: from the bottom up, by level, then by falling sort_key (the least is on top), both 0 if missing."""
    order = Window.partitionBy(tile).orderBy(F.coalesce("level", F.lit(0)), F.desc(F.coalesce("sort_key", F.lit(0))), key)
    return rows.withColumn("draw_rank", F.row_number().over(order))


def z_order(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """feature_id, fact_position, z: the value of the last level rule (position, low, high, value) there, else the feature's level, else 0."""
    hit = F.when(F.col("low").isNull() | ((F.col("low") <= F.col("fact_position")) & (F.col("fact_position") <= F.col("high"))), F.struct("position", "value"))
    found = facts.join(rules, "feature_id", "left").groupBy("feature_id", "fact_position", "level").agg(F.max(hit).alias("hit"))
    return found.select("feature_id", "fact_position", F.coalesce("hit.value", "level", F.lit(0)).alias("z"))


def sides(boundaries: DataFrame, names: DataFrame) -> DataFrame:
    """boundary_id, left_name, right_name: of the first and second of division_ids; names: division_id, name."""
    named = lambda side: names.select(F.col("division_id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"))
    ends = boundaries.select("boundary_id", F.get("division_ids", F.lit(0)).alias("left_id"), F.get("division_ids", F.lit(1)).alias("right_id"))
    return ends.join(named("left"), "left_id", "left").join(named("right"), "right_id", "left").select("boundary_id", "left_name", "right_name")


def published(rows: DataFrame, feature_type: str) -> DataFrame:
    """rows whose subtype is published for the feature type."""
    return rows.where(F.col("subtype").isin(*SUBTYPES[feature_type]))


def category_listing(lines: DataFrame, column: str) -> DataFrame:
    """root, n, listing of lines "code; [root,...,code]": the codes below each root with their paths, sorted; roots alone are listed without codes."""
    paths = lines.select(category_path(F.col(column)).alias("c")).where("c is not null")
    entry = F.when(F.size("c.path") > 1, F.concat(F.rpad(F.col("c.category"), 45, "."), F.array_join("c.path", " > ")))
    return paths.groupBy(F.get("c.path", F.lit(0)).alias("root")).agg(F.count(entry).alias("n"), F.array_join(F.array_sort(F.collect_set(entry)), "; ").alias("listing"))


def sidecar(features: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    """Features with the columns of another data set that names them by id; only those that both have."""
    return features.join(other, key)


def unresolved(rows: DataFrame, reference: str, targets: DataFrame, key: str) -> DataFrame:
    """rows whose reference is not null and names no target."""
    known = targets.select(F.col(key).alias("__wf_target"))
    return rows.where(F.col(reference).isNotNull()).join(known, F.col(reference) == F.col("__wf_target"), "left_anti")
