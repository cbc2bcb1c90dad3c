"""The division tree: ancestors, inherited properties, political perspectives, invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import checkpointed

def ancestors(divs: DataFrame) -> DataFrame:
    """division_id, ancestor_id, depth (0: itself), for chains of any length.

    The way up is doubled in each round: after k rounds all ancestors fewer than 2**k steps away are known, and `up`
    has the one that is exactly 2**k steps away. A cycle of parents raises an error.
    """
    up = checkpointed(divs.where("parent_id is not null").select(F.col("division_id").alias("child"), F.col("parent_id").alias("above")).join(divs.select(F.col("division_id").alias("above")), "above", "left_semi"))
    every = divs.select("division_id", F.col("division_id").alias("ancestor_id"), F.lit(0).cast("long").alias("depth"))
    n, step = divs.count(), 1
    while not up.isEmpty():
        if step > n:
            raise ValueError("the parents of some divisions form a cycle")
        further = every.join(up, F.col("ancestor_id") == F.col("child")).select("division_id", F.col("above").alias("ancestor_id"), (F.col("depth") + step).alias("depth"))
        every = checkpointed(every.unionAll(further))
        second = up.select(F.col("child").alias("above"), F.col("above").alias("next"))
        up, step = checkpointed(up.join(second, "above").select("child", F.col("next").alias("above"))), 2 * step
    return every


def inherited(divs: DataFrame, *properties: str) -> DataFrame:
    """division_id with each property of the nearest ancestor (itself first) that has one."""
    values = divs.select(F.col("division_id").alias("ancestor_id"), *properties)
    known = ancestors(divs).join(values, "ancestor_id")
    return known.groupBy("division_id").agg(*(F.min(F.when(F.col(p).isNotNull(), F.struct("depth", p))).getField(p).alias(p) for p in properties))


def rollup(divs: DataFrame, value: str) -> DataFrame:
    """ancestor_id with the sum of value over all divisions below it and itself."""
    return ancestors(divs).join(divs.select("division_id", value), "division_id").groupBy("ancestor_id").agg(F.sum(value).alias(value))


def invariants(divs: DataFrame) -> DataFrame:
    """division_id and which rule of hierarchies it breaks; divs: division_id, subtype, parent_id, hierarchies.

    A hierarchy is a path of (division_id, subtype, name) from the country to the division itself; the first one is the
    default. Rules: at least one hierarchy; each starts at a country and ends at the division; the division before the
    last of the default one is the parent; a country has no parent and all others have one.
    """
    first, last = (lambda h: F.get(h, F.lit(0))), (lambda h: F.get(h, F.size(h) - 1))
    default = F.get("hierarchies", F.lit(0))
    rules = [
        ("no hierarchy", F.coalesce(F.size("hierarchies"), F.lit(0)) < 1),
        ("does not start at a country", F.exists("hierarchies", lambda h: ~F.coalesce(first(h)["subtype"] == "country", F.lit(False)))),
        ("does not end at itself", F.exists("hierarchies", lambda h: ~F.coalesce(last(h)["division_id"] == F.col("division_id"), F.lit(False)))),
        ("parent differs from the default hierarchy", ~F.get(default, F.size(default) - 2)["division_id"].eqNullSafe(F.col("parent_id"))),
        ("country with parent", (F.col("subtype") == "country") & F.col("parent_id").isNotNull()),
        ("no parent", (F.col("subtype") != "country") & F.col("parent_id").isNull()),
    ]
    broken = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules)))
    return divs.select("division_id", F.explode(broken).alias("fault"))


def hierarchies(divs: DataFrame) -> DataFrame:
    """divs with hierarchies: one path from the farthest ancestor to the division itself."""
    names = divs.select(F.col("division_id").alias("ancestor_id"), F.col("subtype").alias("a_subtype"), F.col("name").alias("a_name"))
    step = F.struct(F.col("ancestor_id").alias("division_id"), F.col("a_subtype").alias("subtype"), F.col("a_name").alias("name"))
    path = ancestors(divs).join(names, "ancestor_id").groupBy("division_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("up"), step.alias("step")))).alias("p"))
    return divs.join(path.select("division_id", F.array(F.transform("p", lambda x: x["step"])).alias("hierarchies")), "division_id")
