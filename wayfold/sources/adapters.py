"""Map features derived from the star-schema tables by integer arithmetic.

Coordinates are whole micro-degrees from a fixed origin; they become doubles only inside distance formulas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import bound
from .storage import spread

# Grid spacing and origin of the derived road network.
SPACING = 2000
ORIGIN_LON, ORIGIN_LAT = -83.70, 32.80


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_side(part: DataFrame) -> DataFrame:
    """One row: n, the nodes along a side of a road grid that has an edge for every key up to the largest."""
    return part.agg((F.floor(F.sqrt(F.coalesce(F.max("p_partkey"), F.lit(0)) / 2)) + 2).cast("long").alias("n"))


def segments(part: DataFrame) -> DataFrame:
    """Road segments of a square grid: segment_id, x1, y1, x2, y2, from_node, to_node, subtype, width. They are dealt by key, so that what is computed from them is not one task's work."""
    k, n = F.col("p_partkey"), F.col("n")
    flat = F.col("flat")
    numbered = spread(part.select(k.cast("long"), "p_size"), "p_partkey").crossJoin(F.broadcast(grid_side(part)))
    along = bound(numbered, flat=k < n * (n - 1), r=F.pmod(k, n * (n - 1)))
    a, b = F.expr("r div (n - 1)"), F.expr("r % (n - 1)")
    placed = bound(along, row=F.when(flat, a).otherwise(b), col=F.when(flat, b).otherwise(a))
    x1, y1 = F.col("col") * SPACING, F.col("row") * SPACING
    return placed.select(
        k.alias("segment_id"), x1.alias("x1"), y1.alias("y1"), (x1 + F.when(flat, SPACING).otherwise(0)).alias("x2"), (y1 + F.when(flat, 0).otherwise(SPACING)).alias("y2"),
        (F.col("row") * n + F.col("col")).alias("from_node"), (F.when(flat, F.col("row") * n + F.col("col") + 1).otherwise((F.col("row") + 1) * n + F.col("col"))).alias("to_node"),
        F.when(F.pmod(k, F.lit(7)) == 0, "rail").when(F.pmod(k, F.lit(11)) == 0, "water").otherwise("road").alias("subtype"), F.col("p_size").cast("long").alias("width"),
    )


def connectors(segs: DataFrame) -> DataFrame:
    """segment_id, connector_id, at (0 or 1)."""
    pair = F.array(F.struct(F.col("from_node").alias("connector_id"), F.lit(0.0).alias("at")), F.struct(F.col("to_node").alias("connector_id"), F.lit(1.0).alias("at")))
    return segs.select("segment_id", F.explode(pair).alias("c")).select("segment_id", "c.*")


def trace_points(events: DataFrame, part: DataFrame) -> DataFrame:
    """GPS points: trace_id, idx (from 0), ts, x, y; traces are users, ordered by time and event.

    Traces are dealt once by user, in partitions whose number grows with the events: the window and what follows a
    broadcast join keep that many tasks.
    """
    events = spread(events, "user_id")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    idx = F.row_number().over(order) - 1
    numbered = events.select("user_id", "event_id", "ts", idx.cast("long").alias("idx")).crossJoin(F.broadcast(grid_side(part)))
    x = (F.col("idx") * 500) % (SPACING * (F.col("n") - 1))
    y = (F.col("user_id") % F.col("n")) * SPACING + ((F.col("event_id") * 31) % 9 - 4) * 10
    return numbered.select(F.col("user_id").cast("long").alias("trace_id"), "idx", "ts", x.cast("long").alias("x"), y.cast("long").alias("y"))


def rules(lineitem: DataFrame) -> DataFrame:
    """Scoped rules: an order is a segment's rule list, its lines are the rules in order."""
    low = (F.col("l_linenumber") - 1) / 8.0
    return lineitem.select(
        F.col("l_orderkey").cast("long").alias("segment_id"), F.col("l_linenumber").cast("long").alias("position"), low.alias("low"), F.least(F.lit(1.0), low + F.floor("l_quantity") / 25.0).alias("high"),
        F.when(F.col("l_linestatus") == "O", "forward").when(F.col("l_quantity") < 10, None).otherwise("backward").alias("heading"),
        F.when(F.col("l_returnflag") == "A", "allowed").when(F.col("l_returnflag") == "R", "denied").otherwise("designated").alias("access_type"), (F.floor("l_quantity") * 2 + 10).cast("long").alias("max_speed"),
    )


def divisions(region: DataFrame, nation: DataFrame, customer: DataFrame) -> DataFrame:
    """A division tree country - region - locality: division_id, name, parent_id, subtype, country, region, driving_side, population."""
    country = region.select(F.concat(F.lit("c"), F.col("r_regionkey").cast("string")).alias("division_id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id"), F.lit("country").alias("subtype"), F.concat(F.lit("X"), F.substring("r_name", 1, 1)).alias("country"), F.lit(None).cast("string").alias("region"), F.when(F.col("r_regionkey") % 2 == 0, "right").otherwise("left").alias("driving_side"), F.lit(0).cast("long").alias("population"))
    nk = F.col("n_nationkey")
    middle = nation.select(F.concat(F.lit("r"), nk.cast("string")).alias("division_id"), F.col("n_name").alias("name"), F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("parent_id"), F.lit("region").alias("subtype"), F.lit(None).cast("string").alias("country"), F.concat(F.lit("X-"), nk.cast("string")).alias("region"), F.when(nk % 5 == 0, "left").alias("driving_side"), F.lit(0).cast("long").alias("population"))
    leaf = customer.select(F.concat(F.lit("l"), F.col("c_custkey").cast("string")).alias("division_id"), F.col("c_name").alias("name"), F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("parent_id"), F.lit("locality").alias("subtype"), F.lit(None).cast("string").alias("country"), F.lit(None).cast("string").alias("region"), F.when(F.col("c_custkey") % 97 == 0, "left").alias("driving_side"), F.floor(F.abs("c_acctbal")).cast("long").alias("population"))
    return country.unionAll(middle).unionAll(leaf)


def heights(part: DataFrame) -> DataFrame:
    """feature_id and a height tag in one of the documented spellings, or in none."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    with_ = lambda before, after: F.concat(F.lit(before), size, F.lit(after))
    forms = [size, with_("", " m"), with_("", ".5m"), with_("", " ft"), with_("", ". '"), with_(" ", "'  6.5\" "), with_("", "\""), F.lit("tall"), with_(" ", ".25 meters "), with_("", "."), with_("", ". metre"), with_("", ".65feet "), with_("", " in")]
    chosen = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        chosen = F.when(F.pmod(k, F.lit(len(forms))) == i, f).otherwise(chosen)
    return part.select(k.cast("long").alias("feature_id"), chosen.alias("height"))
