"""Scoped rules: the last rule of a list whose scopes all hold decides; a missing scope always holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scopes import KILOGRAMS, converted, open_at
from ..functions.tags import METRES


def holds(position: Column, heading: Column | None = None) -> Column:
    """Whether a rule (low, high, heading) covers a position and heading; ends are inclusive."""
    ok = (F.col("low") <= position) & (position <= F.col("high"))
    return ok & (F.col("heading").isNull() | (F.col("heading") == heading)) if heading is not None else ok


#: How a vehicle's dimension is compared with a rule's value.
COMPARED = {"greater_than": lambda a, b: a > b, "greater_than_equal": lambda a, b: a >= b, "equal": lambda a, b: a == b, "less_than": lambda a, b: a < b, "less_than_equal": lambda a, b: a <= b}


def vehicle_holds(listed: Column, dimensions: Column) -> Column:
    """Whether a vehicle, as a map from dimension to metres, kilograms or a count, fits all entries of a rule.

    listed: array of struct(dimension, comparison, value, unit); null holds for all, an unknown dimension or unit for none.
    """

    def fits(entry):
        fact = F.try_element_at(dimensions, entry["dimension"])
        wanted = F.when(entry["unit"].isNull(), entry["value"]).otherwise(F.coalesce(converted(entry["value"], entry["unit"], METRES), converted(entry["value"], entry["unit"], KILOGRAMS)))
        return F.coalesce(*(F.when(entry["comparison"] == name, test(fact, wanted)) for name, test in COMPARED.items()), F.lit(False))

    return listed.isNull() | F.forall(listed, fits)


def holds_all(fact) -> Column:
    """Whether a rule holds for a fact in every scope; fact(name) gives a fact's column.

    Rule columns: low, high, heading, side, mode, using, recognized, during, vehicle; a null scope always holds. Facts:
    position, heading, side, modes (the mode and its wider ones), purpose, status, day, minute, dimensions. A fact that
    is null does not fit a scope; neither do opening hours that cannot be read.
    """
    same = lambda scope: F.col(scope).isNull() | F.coalesce(F.col(scope) == fact(scope), F.lit(False))
    listed = lambda scope, name: F.col(scope).isNull() | F.coalesce(F.array_contains(F.col(scope), fact(name)), F.lit(False))
    place = F.coalesce(F.col("low").isNull() | ((F.col("low") <= fact("position")) & (fact("position") <= F.col("high"))), F.lit(False))
    mode = F.col("mode").isNull() | F.coalesce(F.arrays_overlap(F.col("mode"), fact("modes")), F.lit(False))
    hours = F.col("during").isNull() | F.coalesce(open_at(F.col("during"), fact("day"), fact("minute")), F.lit(False))
    return place & same("heading") & same("side") & mode & listed("using", "purpose") & listed("recognized", "status") & hours & vehicle_holds(F.col("vehicle"), fact("dimensions"))


def resolved(rules: DataFrame, facts: DataFrame, values: list[str]) -> DataFrame:
    """fact_id with the values of the last rule (by position) of its segment that holds in every scope; nulls if none does."""
    met = facts.select(*(F.col(c).alias(c if c in ("fact_id", "segment_id") else f"fact_{c}") for c in facts.columns)).join(rules, "segment_id", "left")
    hit = F.when(holds_all(lambda name: F.col(f"fact_{name}")), F.struct("position", *values))
    return met.groupBy("fact_id").agg(F.max(hit).alias("hit")).select("fact_id", *(F.col(f"hit.{v}").alias(v) for v in values))


def deciding(rules: DataFrame, facts: DataFrame, values: dict) -> DataFrame:
    """facts (segment_id, fact_position, fact_heading) with the values (name to default) of the last rule that holds, else the defaults.

    The last rule is a maximum of (position in the list, values), so the group-by combines before the shuffle.
    """
    met = facts.join(rules, "segment_id", "left")
    hit = F.when(holds(F.col("fact_position"), F.col("fact_heading")), F.struct("position", *values))
    found = met.groupBy("segment_id", "fact_position", "fact_heading").agg(F.max(hit).alias("hit"))
    return found.select("segment_id", "fact_position", "fact_heading", *(F.coalesce(F.col(f"hit.{v}"), F.lit(default)).alias(v) for v, default in values.items()))


def flags_at(ranges: DataFrame, facts: DataFrame) -> DataFrame:
    """segment_id, fact_position, flags: the sorted union of the values of all ranges (low, high, values) that cover a position."""
    met = facts.join(ranges, "segment_id", "left")
    inside = F.when(F.col("low").isNull() | ((F.col("low") <= F.col("fact_position")) & (F.col("fact_position") <= F.col("high"))), F.col("values"))
    return met.groupBy("segment_id", "fact_position").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(inside)))).alias("flags"))


def prohibited(routes: DataFrame, restrictions: DataFrame) -> DataFrame:
    """route_id of the routes that follow a restriction's whole sequence and arrive with its final heading; each once.

    routes: route_id, step (0: the first segment, whose connector is null), connector_id, segment_id, heading.
    restrictions: restriction_id, segment_id, sequence (array of struct(connector_id, segment_id)), final_heading. A
    route may be on the restricted segment at any step; all that no restriction names is allowed.
    """
    first = restrictions.select("restriction_id", "segment_id", F.size("sequence").alias("n"), "final_heading")
    starts = routes.select("route_id", "step", "segment_id").join(first, "segment_id").select("route_id", "restriction_id", F.col("step").alias("start"), "n", "final_heading")
    entries = restrictions.select(F.col("restriction_id").alias("r_id"), F.posexplode("sequence").alias("i", "e")).select("r_id", "i", F.col("e.connector_id").alias("r_connector"), F.col("e.segment_id").alias("r_segment"))
    due = starts.join(entries, F.col("restriction_id") == F.col("r_id")).withColumn("at", F.col("start") + F.col("i") + 1)
    steps = routes.select(F.col("route_id").alias("s_id"), F.col("step").alias("s_step"), "connector_id", F.col("segment_id").alias("s_segment"), "heading")
    met = due.join(steps, (F.col("route_id") == F.col("s_id")) & (F.col("at") == F.col("s_step")) & (F.col("r_connector") == F.col("connector_id")) & (F.col("r_segment") == F.col("s_segment")))
    last = F.max(F.when(F.col("i") == F.col("n") - 1, F.col("heading")))
    whole = met.groupBy("route_id", "restriction_id", "start", "n", "final_heading").agg(F.count("*").alias("k"), last.alias("arrival"))
    return whole.where("k = n and arrival = final_heading").select("route_id").distinct()


def elementary_intervals(rules: DataFrame, value: str) -> DataFrame:
    """segment_id, low, high, value: [0, 1] cut at every end of a rule, each part with its deciding value.

    Parts without a rule are left out. A segment's break points are gathered in one array: a list of rules belongs to
    one segment and is small by nature.
    """
    ends = rules.groupBy("segment_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("low", "high"))))).alias("ends"))
    parts = ends.select("segment_id", F.posexplode("ends").alias("i", "from"), "ends").where(F.col("i") < F.size("ends") - 1).select("segment_id", "from", F.get("ends", F.col("i") + 1).alias("to"))
    covering = parts.join(rules, "segment_id").where((F.col("low") <= F.col("from")) & (F.col("to") <= F.col("high")))
    best = covering.groupBy("segment_id", "from", "to").agg(F.max(F.struct("position", value)).alias("b"))
    return best.select("segment_id", F.round("from", 6).alias("low"), F.round("to", 6).alias("high"), f"b.{value}")
