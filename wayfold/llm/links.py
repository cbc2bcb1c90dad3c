"""Connected components of an edge table by alternating star operations.

Each round points every node's larger neighbours at the node's least neighbour (large star), then every node's
smaller neighbours at the least of them (small star). All steps are joins and partially aggregated group-bys, no
neighbour list is ever gathered, and the rounds grow with the logarithm of a component's size. Nodes with many edges
are joined by a bounded broadcast (looked_up), so no task gathers them. Each round is checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, looked_up


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return looked_up(both.where("v > u"), "u", least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    kept = looked_up(down, "u", least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionAll(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of edges (a, b), self-loops and repeats allowed."""
    now = checkpointed(edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    sign = None
    while True:
        large = checkpointed(_large_star(now).where("u <> v").distinct())
        now = checkpointed(_small_star(large).where("u <> v").distinct())
        # Done when a round changes nothing: the sum of row hashes and the count stay.
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == sign:
            break
        sign = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
