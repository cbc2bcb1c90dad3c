"""GPS traces: steps between points, splitting at gaps, lengths and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bound
from ..functions.geo import metres
from ..sources.storage import checkpointed


def steps(points: DataFrame) -> DataFrame:
    """points with step_m (metres from the point before), raw_m (not rounded) and step_s (seconds); null at the first point."""
    w = Window.partitionBy("trace_id").orderBy("idx")
    before = {f"_{c}": F.lag(c).over(w) for c in ("x", "y", "ts")}
    met = points.withColumns(before)
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_ts").cast("timestamp"))) / 1e6
    raw = metres(F.col("_x"), F.col("_y"), F.col("x"), F.col("y"))
    return met.withColumns({"raw_m": raw, "step_m": F.round(raw, 2), "step_s": F.round(seconds, 3)}).drop("_x", "_y", "_ts")


def successors(points: DataFrame, least_m: float, least_s: float, ahead: int = 4) -> DataFrame:
    """points (trace_id, n from 1, x, y, ts) with next: n of the first later point of the trace that lies far enough off in metres and seconds, null without one.

    The next `ahead` points are looked at first, one after the other, in one window; points that find none there look at four times as many
    in each further round, by a join. Work beyond the window grows with how long traces stay in one place.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))

    def far(x, y, t):
        late = F.coalesce((us(t) - us("ts")) / 1e6 >= least_s, F.lit(True))
        return late & (metres(F.col("x"), F.col("y"), F.col(x), F.col(y)) >= least_m)

    w = Window.partitionBy("trace_id").orderBy("n")
    looked = points.withColumns({f"_{c}{k}": F.lead(c, k).over(w) for k in range(1, ahead + 1) for c in ("x", "y", "ts")} | {"_last": F.count("*").over(Window.partitionBy("trace_id")), "next": F.lit(None).cast("long")})
    for k in range(1, ahead + 1):
        found = F.when(F.col("n") + k <= F.col("_last"), F.when(far(f"_x{k}", f"_y{k}", f"_ts{k}"), F.col("n") + k))
        looked = bound(looked.withColumnRenamed("next", "_before"), next=F.coalesce("_before", found)).drop("_before")
    looked = checkpointed(looked.select(*points.columns, "next", "_last"))
    low, more = ahead, None
    left = looked.where(F.col("next").isNull() & (F.col("n") + low < F.col("_last"))).drop("next")
    later = points.select("trace_id", F.col("n").alias("next"), F.col("x").alias("_bx"), F.col("y").alias("_by"), F.col("ts").alias("_bt"))
    while not left.isEmpty():
        high = 4 * low
        tried = left.withColumn("next", F.explode(F.sequence(F.col("n") + low + 1, F.least(F.col("n") + high, F.col("_last")))))
        met = tried.join(later, ["trace_id", "next"]).where(far("_bx", "_by", "_bt"))
        new = checkpointed(met.groupBy("trace_id", "n").agg(F.min("next").alias("_found")))
        more = new if more is None else more.unionAll(new)
        left = checkpointed(left.join(new, ["trace_id", "n"], "left_anti").where(F.col("n") + high < F.col("_last")))
        low = high
    if more is not None:
        looked = looked.join(more, ["trace_id", "n"], "left").withColumn("next", F.coalesce("next", "_found"))
    return looked.select(*points.columns, "next")


#: Points of a block of thinned(): the most that one row holds.
BLOCK = 128


def thinned(points: DataFrame, least_m: float = 50.0, least_s: float = 1.0, block: int = BLOCK) -> DataFrame:
    """points without those that lie less than least_m metres or least_s seconds after the last one kept; a trace's first point stays.

    The point kept after another depends on that one only: the kept points are the orbit of a trace's first point under
    successors(). Traces are cut into blocks of `block` points. Within a block the orbit is followed from the block's entry; entries are the orbit of
    the first point under the map from each point to where its orbit leaves the block. Maps of 1, 2, 4 ... such ways are made by joins of each with
    itself, and the entries double with each, so rounds grow with the logarithm of a trace's blocks, traces of one block need
    none, and no row holds more than a block. A point without coordinates is dropped,
    one without a time is judged by metres only; of points that share an index the order is by place.
    """
    order = Window.partitionBy("trace_id").orderBy("idx", "ts", "x", "y")
    numbered = points.where("trace_id is not null and x is not null and y is not null").withColumn("n", F.row_number().over(order).cast("long"))
    at = (F.col("n") - 1 - F.pmod(F.col("n") - 1, F.lit(block))).alias("start")  # points before the block
    blocks = checkpointed(successors(numbered, least_m, least_s).groupBy("trace_id", at).agg(F.array_sort(F.collect_list(F.struct("n", "next", F.struct(*points.columns).alias("point")))).alias("held")))

    # From the last point back: where each one's orbit leaves the block. Those after it are in the list already, at their distance from it.
    ways = F.col("held.next")
    end = F.col("start") + F.size("held")
    leave = lambda out, p: F.concat(F.array(F.when(p["next"] > end, p["next"]).otherwise(F.get(out, (p["next"] - p["n"] - 1).cast("int")))), out)
    exits = F.aggregate(F.reverse("held"), F.array().cast("array<bigint>"), leave)
    jump, jumps = checkpointed(blocks.where(F.array_max(ways) > end).select("trace_id", "start", F.posexplode(exits).alias("pos", "next")).where("next is not null").select("trace_id", (F.col("start") + F.col("pos") + 1).alias("n"), "next")), []
    while not jump.isEmpty():
        jumps.append(jump)
        jump = checkpointed(jump.join(jump.select("trace_id", F.col("n").alias("next"), F.col("next").alias("then")), ["trace_id", "next"]).select("trace_id", "n", F.col("then").alias("next")))
    entered = blocks.where("start = 0").withColumn("entry", F.lit(1).cast("long"))
    if jumps:
        entry = entered.select("trace_id", F.col("entry").alias("n"))
        for jump in reversed(jumps):
            entry = entry.unionAll(entry.join(jump, ["trace_id", "n"]).select("trace_id", F.col("next").alias("n")))
        later = entry.where(F.col("n") > block).select("trace_id", at, F.col("n").alias("entry"))
        entered = entered.unionByName(blocks.join(later, ["trace_id", "start"]))
    # Forward from the entry: the next point to keep, and the places of those kept.
    go = lambda a, p: F.when(p["n"] == a["now"], F.struct(p["next"].alias("now"), F.concat(a["kept"], F.array(p["n"])).alias("kept"))).otherwise(a)
    kept = F.aggregate("held", F.struct(F.col("entry").alias("now"), F.array().cast("array<bigint>").alias("kept")), go)["kept"]
    chosen = entered.select("start", "held", F.explode(kept).alias("n"))
    return chosen.select(F.get("held", (F.col("n") - F.col("start") - 1).cast("int"))["point"].alias("p")).select("p.*")


def parts(points: DataFrame, gap_m: float = 100.0, gap_s: float | None = None) -> DataFrame:
    """steps() with part: how many gaps longer than gap_m metres (or gap_s seconds) lie before the point in its trace."""
    gap = F.col("step_m") > gap_m
    gap = gap | (F.col("step_s") > gap_s) if gap_s is not None else gap
    w = Window.partitionBy("trace_id").orderBy("idx")
    return steps(points).withColumn("part", F.sum(F.coalesce(gap.cast("int"), F.lit(0))).over(w).cast("long"))


def metrics(points: DataFrame, matched: DataFrame) -> DataFrame:
    """Per trace: points, length in metres, matched points, mean distance to the road (null without a match), share matched."""
    lengths = steps(points).groupBy("trace_id").agg(F.count("*").alias("n_points"), F.round(F.sum("raw_m"), 2).alias("length_m"))
    roads = matched.groupBy("trace_id").agg(F.count("*").alias("n_matched"), F.round(F.avg("distance"), 2).alias("mean_distance_m"))
    both = lengths.join(roads, "trace_id", "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0).cast("long")))
    return both.withColumn("percent_matched", F.round(100.0 * F.col("n_matched") / F.col("n_points"), 2))


def totals(per_trace: DataFrame) -> DataFrame:
    """One row over metrics(): traces, points, km, mean of the traces' mean distances, points a km."""
    t = per_trace.agg(F.count("*").alias("n_traces"), F.sum("n_points").alias("n_points"), F.round(F.sum("length_m") / 1000, 2).alias("km"), F.round(F.avg("mean_distance_m"), 2).alias("mean_distance_m"), F.sum("n_matched").alias("n_matched"))
    return t.withColumn("points_per_km", F.round(F.col("n_points") / F.nullif("km", F.lit(0.0)), 2))


def error_rate(matched: DataFrame, labels: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per trace: labelled metres, metres matched to another segment than the label's, and their quotient (-1 if no metres).

    labels: trace_id, idx, label_id; lengths: steps(). A labelled point without a match counts as wrong.
    """
    met = labels.join(matched, ["trace_id", "idx"], "left").join(lengths.select("trace_id", "idx", "step_m"), ["trace_id", "idx"], "left")
    step = F.coalesce("step_m", F.lit(0.0))
    wrong = F.when(F.col("segment_id").eqNullSafe(F.col("label_id")), 0.0).otherwise(step)
    by = met.groupBy("trace_id").agg(F.round(F.sum(step), 2).alias("total_distance"), F.round(F.sum(wrong), 2).alias("wrong_distance"))
    return by.withColumn("error_rate", F.when(F.col("total_distance") == 0, -1.0).otherwise(F.round(F.col("wrong_distance") / F.col("total_distance"), 4)))


def segment_speed(points: DataFrame, matched: DataFrame) -> DataFrame:
    """segment_id, points and mean speed in km/h of the steps that end on it; steps without time are left out."""
    met = steps(points).where("step_s > 0").join(matched.select("trace_id", "idx", "segment_id"), ["trace_id", "idx"])
    return met.groupBy("segment_id").agg(F.count("*").alias("n"), F.round(3.6 * F.sum("step_m") / F.sum("step_s"), 4).alias("kmh"))
