"""What is made of matched traces: predictions and transitions as tables, result documents, text tables and reports.

matched has trace_id, idx and the best prediction of a point (segment_id, distance, sx, sy), as near() gives it; a point
without a row has no prediction.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import bound
from ..functions.geo import fraction_along, haversine, metres, wkt_point
from ..sources.storage import checkpointed
from .matcher import Options


def _log_prob(sigma: float) -> Column:
    return F.lit(-math.log(math.sqrt(2 * math.pi) * sigma)) - 0.5 * (F.col("distance") / sigma) * (F.col("distance") / sigma)


def ranked(near: DataFrame, sigma: float = Options.sigma) -> DataFrame:
    """near() with log_prob (Gaussian emission) and rank: a point's predictions, the likeliest first, ties to the smaller segment."""
    order = Window.partitionBy("trace_id", "idx").orderBy(F.desc("log_prob"), "segment_id")
    return near.withColumn("log_prob", _log_prob(sigma)).withColumn("rank", F.row_number().over(order))


#: What a transition needs of a candidate, besides its segment's ends.
_SNAPPED = ("segment_id", "x", "y", "sx", "sy", "from_node", "to_node")


def _with_next(near: DataFrame, *more: str) -> DataFrame:
    """near() with ahead: the candidates (and the columns more of each) of the point whose index is one higher, by one window over the trace instead of joins of near() with itself."""
    w = Window.partitionBy("trace_id").orderBy("idx").rangeBetween(1, 1)
    rows = near.where("trace_id is not null and idx is not null").select("trace_id", "idx", *_SNAPPED, *more, "x1", "y1", "x2", "y2")
    return rows.withColumn("ahead", F.collect_list(F.struct(*_SNAPPED, F.struct("x", "y").alias("place"), *more)).over(w))


def _direct(rows: DataFrame) -> DataFrame:
    """Of _with_next(): rows with b, each later candidate on the same segment or on one that shares a connector."""
    met = rows.withColumn("b", F.explode("ahead")).drop("ahead")
    shared = F.col("from_node").isin(F.col("b.from_node"), F.col("b.to_node")) | F.col("to_node").isin(F.col("b.from_node"), F.col("b.to_node"))
    return met.where((F.col("segment_id") == F.col("b.segment_id")) | ((F.col("segment_id") != F.col("b.segment_id")) & shared))


def _straight() -> Column:
    return F.when(F.col("segment_id") == F.col("b.segment_id"), metres(F.col("sx"), F.col("sy"), F.col("b.sx"), F.col("b.sy")))


def _ways(met: DataFrame, *over: Column) -> DataFrame:
    """Of _direct() with step and straight: trace_id, idx (the later point's), from_segment, to_segment, step, route; over: the ways over shared connectors, null where none is shared."""
    route = F.when(F.col("segment_id") == F.col("b.segment_id"), F.col("straight")).otherwise(F.least(*over))
    return met.select("trace_id", (F.col("idx") + 1).alias("idx"), F.col("segment_id").alias("from_segment"), F.col("b.segment_id").alias("to_segment"), "step", route.alias("route"))


def _likely(ways: DataFrame, o: Options) -> DataFrame:
    """The shortest route of each pair, where it differs from the trace's step by no more than the options allow."""
    gap = F.abs(F.col("step") - F.col("route"))
    best = ways.groupBy("trace_id", "idx", "from_segment", "to_segment", "step").agg(F.min("route").alias("route")).where(gap <= o.most_deviation)
    return best.select("trace_id", "idx", "from_segment", "to_segment", F.round("route", 2).alias("route_m"), (F.lit(-math.log(o.beta)) - gap / o.beta).alias("log_prob"))


def transitions(near: DataFrame, options: Options | None = None) -> DataFrame:
    """trace_id, idx, from_segment, to_segment, route_m, log_prob: pairs of predictions of neighbouring points on one segment or on two that share a connector.

    The route is the straight way on one segment, else the way over the connector; the shortest of several. Pairs whose
    route differs from the trace's step by more than the options allow are left out. near: with x, y, sx, sy and the
    segment's ends and nodes; it is read once.
    """
    met = bound(_direct(_with_next(near)), step=metres(F.col("x"), F.col("y"), F.col("b.x"), F.col("b.y")))
    met = bound(met, straight=_straight())
    for node, x, y in (("from_node", "x1", "y1"), ("to_node", "x2", "y2")):
        leg = lambda c, d: F.when(F.col(node).isin(F.col("b.from_node"), F.col("b.to_node")), metres(F.col(x), F.col(y), F.col(c), F.col(d)))  # noqa: B023, E731
        met = bound(bound(met, **{f"out_{node}": leg("sx", "sy")}), **{f"in_{node}": leg("b.sx", "b.sy")})
    return _likely(_ways(met, *(F.col(f"out_{n}") + F.col(f"in_{n}") for n in ("from_node", "to_node"))), options or Options())


def routes(near: DataFrame, options: Options | None = None) -> DataFrame:
    """transitions() over any number of connectors: the shortest way between predictions of neighbouring points over their trace's candidate segments.

    Pairs on one segment or with a shared connector need no search. For the others labels (metres from a prediction to a connector) are
    relaxed in rounds: those that a round improved meet the links of their trace, and the least of each connector is kept, by partial minima before
    the shuffle. No label exceeds the trace's step and the largest deviation, so rounds end after as many links as fit in that; and a label is dropped
    if the straight way on to the next point's predictions would exceed it, as no way is shorter than the straight one. That holds where a connector is one
    place: in traces whose segments give one connector several places all labels within the bound are followed. The labels of a
    prediction's own two connectors are columns of every label and are not stored. Ways back over
    segments matched before are not blocked here, as a table of transitions knows no sequence; the matcher blocks them.
    """
    o = options or Options()
    key = ["trace_id", "idx", "from_segment"]
    near = bound(near, m1=metres(F.col("sx"), F.col("sy"), F.col("x1"), F.col("y1")))
    near = bound(near, m2=metres(F.col("sx"), F.col("sy"), F.col("x2"), F.col("y2")))
    near = bound(near, off=metres(F.col("x"), F.col("y"), F.col("sx"), F.col("sy")))
    rows = checkpointed(_with_next(near, "m1", "m2", "off"))
    length = metres(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    ways = F.array(*(F.struct(F.col(a).alias("node"), F.col(b).alias("other"), length.alias("length"), F.col(x).alias("ox"), F.col(y).alias("oy")) for a, b, x, y in (("from_node", "to_node", "x2", "y2"), ("to_node", "from_node", "x1", "y1"))))
    segs = rows.select("trace_id", "segment_id", "from_node", "to_node", "x1", "y1", "x2", "y2").distinct()
    ends = [f(c).alias(f"{name}_{c}") for name, f in (("low", F.min), ("high", F.max)) for c in ("ox", "oy")]
    links = checkpointed(segs.select("trace_id", F.explode(ways).alias("w")).select("trace_id", "w.*").groupBy("trace_id", "node", "other").agg(F.min("length").alias("length"), *ends))
    moved = links.groupBy("trace_id", "other").agg(*(F.min(f"low_{c}").alias(f"low_{c}") for c in ("ox", "oy")), *(F.max(f"high_{c}").alias(f"high_{c}") for c in ("ox", "oy"))).where("low_ox <> high_ox or low_oy <> high_oy")
    loose = checkpointed(moved.select("trace_id").distinct())

    places = F.col("ahead.place")
    stepped = bound(rows.withColumn("q", F.explode(F.array_distinct(places))), step=metres(F.col("x"), F.col("y"), F.col("q.x"), F.col("q.y")))
    direct = _ways(bound(_direct(stepped), straight=_straight()), *(F.when(F.col(n) == F.col(f"b.{k}"), F.col(m) + F.col(f"b.{r}")) for n, m in (("from_node", "m1"), ("to_node", "m2")) for k, r in (("from_node", "m1"), ("to_node", "m2"))))
    # How far the next predictions lie from q; of several places with one index, from each other. Half a metre of slack is more than rounding makes of distances.
    off = F.array_max("ahead.off") + F.when(F.size(F.array_distinct(places)) > 1, F.lit(math.inf)).otherwise(0.0)
    sources = stepped.select("trace_id", (F.col("idx") + 1).alias("idx"), F.col("segment_id").alias("from_segment"), "step", F.col("q.x").alias("qx"), F.col("q.y").alias("qy"), (F.col("step") + o.most_deviation + off + 0.5).alias("budget"), F.col("from_node").alias("n1"), "m1", F.col("to_node").alias("n2"), "m2", "x1", "y1", "x2", "y2")
    if not loose.isEmpty():
        sources = sources.join(loose.withColumn("loose", F.lit(True)), "trace_id", "left").withColumn("budget", F.when(F.col("loose"), F.lit(math.inf)).otherwise(F.col("budget"))).drop("loose")
    held = [*key, "step", "qx", "qy", "budget", "n1", "m1", "n2", "m2"]
    within = (F.col("m") <= F.col("step") + o.most_deviation) & (F.col("m") + metres(F.col("ox"), F.col("oy"), F.col("qx"), F.col("qy")) <= F.col("budget"))
    better = [F.coalesce((F.col("node") != F.col(n)) | (F.col("m") < F.col(m) - 1e-9), F.lit(True)) for n, m in (("n1", "m1"), ("n2", "m2"))]
    two = F.inline(F.array(*(F.struct(F.col(n).alias("node"), F.col(m).alias("m"), F.col(x).alias("ox"), F.col(y).alias("oy")) for n, m, x, y in (("n1", "m1", "x1", "y1"), ("n2", "m2", "x2", "y2")))))
    front, labels = sources.select(*held, two).where(within).select(*held, "node", "m"), None
    while labels is None or not front.isEmpty():
        tried = front.join(links, ["trace_id", "node"]).select(*held, F.col("other").alias("node"), (F.col("m") + F.col("length")).alias("m"), F.col("low_ox").alias("ox"), F.col("low_oy").alias("oy")).where(within & better[0] & better[1])
        met = tried.select(*held, "node", "m", F.lit(None).cast("double").alias("known"))
        met = met if labels is None else met.unionByName(labels.select(*held, "node", "m", F.col("m").alias("known")))
        labels = checkpointed(met.groupBy(*held, "node").agg(F.min("m").alias("m"), F.min("known").alias("known")))
        front = labels.where("known is null or m < known - 1e-9").drop("known")
    into = F.inline(F.array(*(F.struct(F.col(n).alias("node"), F.col(m).alias("rest")) for n, m in (("from_node", "m1"), ("to_node", "m2")))))
    arriving = rows.select("trace_id", "idx", F.col("segment_id").alias("to_segment"), into)
    over = labels.join(arriving, ["trace_id", "idx", "node"]).where("from_segment <> to_segment").select(*key, "to_segment", "step", (F.col("m") + F.col("rest")).alias("route"))
    return _likely(direct.unionByName(over), o)


def grouped_candidates(pairs: DataFrame) -> DataFrame:
    """trace_id, n, candidates (sorted array of segment ids) of (trace_id, segment_id); a trace whose only row has null has none."""
    return pairs.groupBy("trace_id").agg(F.count("segment_id").alias("n"), F.array_sort(F.collect_list("segment_id")).alias("candidates"))


def quantiles(values: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles by linear interpolation between neighbouring ranks; Nones without values.

    Values are range-partitioned (ties are spread by a hash of the row), the partitions' sizes tell which of them holds a rank, and the
    rank is looked up there: no task sees more than its partition.
    """
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = values.where(F.col(column).isNotNull()).select(F.col(column).alias("value"), F.xxhash64(*(c for c, kind in values.dtypes if "map<" not in kind and "variant" not in kind)).alias("tie"))
    dealt = checkpointed(held.repartitionByRange(parts, "value", "tie").withColumn("part", F.spark_partition_id()))
    sizes = dict(dealt.groupBy("part").count().collect())  # one number a partition
    n = sum(sizes.values())
    if not n:
        return [None] * len(shares)
    wanted, starts, at = {}, {}, 0
    for part in sorted(sizes):
        starts[part], at = at, at + sizes[part]
    for rank in {r for q in shares for r in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))}:
        part = max(p for p in starts if starts[p] <= rank)
        wanted[rank] = (part, rank - starts[part] + 1)
    some = dealt.where(F.col("part").isin(*{p for p, _ in wanted.values()})).withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("value", "tie")))
    test = F.lit(False)
    for p, r in wanted.values():
        test = test | ((F.col("part") == p) & (F.col("rank") == r))
    got = {(r["part"], r["rank"]): r["value"] for r in some.where(test).collect()}  # two values a share
    low_high = [(got[wanted[math.floor(q * (n - 1))]], got[wanted[math.ceil(q * (n - 1))]], q * (n - 1) % 1) for q in shares]
    return [float(low) + (float(high) - float(low)) * part for low, high, part in low_high]


def described(values: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, standard deviation, least, quartiles and largest value."""
    c, shares = F.col(column), (0.25, 0.5, 0.75)
    quarters = zip(shares, quantiles(values, column, list(shares)), strict=True)
    return values.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev(c).alias("std"), F.min(c).alias("least"), *(F.lit(x).cast("double").alias(f"q{int(100 * q)}") for q, x in quarters), F.max(c).alias("most"))


def with_predictions(points: DataFrame, matched: DataFrame) -> DataFrame:
    """Every point with its prediction, nulls without one."""
    return points.join(matched.select("trace_id", "idx", "segment_id", "distance", "sx", "sy"), ["trace_id", "idx"], "left")


def documents(points: DataFrame, matched: DataFrame, diagnostic: bool = False, every: DataFrame | None = None) -> DataFrame:
    """trace_id and json: one result document a trace, nulls kept; diagnostic adds point indexes, every (ranked()) all predictions."""
    rows = with_predictions(points, matched)
    if every is not None:
        rows = rows.join(every.groupBy("trace_id", "idx").agg(_listed().alias("p")), ["trace_id", "idx"], "left")
    return _documents(rows, diagnostic)


def documents_of(near: DataFrame, diagnostic: bool = False, sigma: float = Options.sigma) -> DataFrame:
    """documents() with all predictions of spatial.near_or_none(): its rows are gathered by point, then by trace, and joined with nothing."""
    log_prob = F.when(F.col("segment_id").isNotNull(), _log_prob(sigma))
    points = near.withColumn("log_prob", log_prob).groupBy("trace_id", "idx", "ts", "x", "y").agg(_listed("sx", "sy").alias("p"))
    first = F.try_element_at("p", F.lit(1))
    return _documents(points.select("*", *(first[c].alias(c) for c in ("segment_id", "distance", "sx", "sy"))), diagnostic)


def _listed(*more: str) -> Column:
    """A point's predictions, the likeliest first, ties to the smaller segment; rows without a segment are none."""
    one = F.struct((-F.col("log_prob")).alias("order"), "segment_id", "distance", "log_prob", *more)
    return F.array_sort(F.collect_list(F.when(F.col("segment_id").isNotNull(), one)))


def _documents(rows: DataFrame, diagnostic: bool) -> DataFrame:
    """documents() of points with their best prediction and, in p if there is one, all of them."""
    place = lambda x, y: wkt_point(F.col(x), F.col(y))
    best = F.when(F.col("segment_id").isNotNull(), F.struct(F.col("segment_id").cast("string").alias("id"), place("sx", "sy").alias("snapped_point"), F.col("distance").alias("distance_to_snapped_road")))
    fields = [place("x", "y").alias("original_point"), F.col("ts").cast("string").alias("time"), best.alias("snap_prediction")] + ([F.col("idx").alias("point_index")] if diagnostic else [])
    if "p" in rows.columns:
        one = lambda c: F.struct(c["segment_id"].cast("string").alias("id"), c["distance"].alias("distance_to_snapped_road"), c["log_prob"].alias("best_log_prob"))
        fields.append(F.transform(F.coalesce("p", F.array().cast(rows.schema["p"].dataType)), one).alias("predictions"))
    whole = rows.groupBy("trace_id").agg(F.count("*").alias("point_count"), F.count("segment_id").alias("points_with_matches"), F.array_sort(F.collect_set("segment_id")).alias("target_ids"), F.array_sort(F.collect_list(F.struct("idx", F.struct(*fields).alias("point")))).alias("points"))
    doc = F.struct(F.col("trace_id").cast("string").alias("id"), "point_count", "points_with_matches", "target_ids", F.col("points.point").alias("points"))
    return whole.select("trace_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))


def text(c: Column) -> Column:
    """A value as text, empty if it is missing."""
    return F.coalesce(c.cast("string"), F.lit(""))


def judgments(points: DataFrame, matched: DataFrame) -> DataFrame:
    """trace_id, point_index, trace_point_wkt, feature_id: the table that people judge."""
    return with_predictions(points, matched).select("trace_id", F.col("idx").alias("point_index"), wkt_point(F.col("x"), F.col("y")).alias("trace_point_wkt"), text(F.col("segment_id")).alias("feature_id"))


def snapped_points(points: DataFrame, matched: DataFrame) -> DataFrame:
    """trace_id, point_index, feature_id, snapped_point_wkt."""
    return with_predictions(points, matched).select("trace_id", F.col("idx").alias("point_index"), text(F.col("segment_id")).alias("feature_id"), text(wkt_point(F.col("sx"), F.col("sy"))).alias("snapped_point_wkt"))


def metric_rows(points: DataFrame, matched: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row a trace: length, points, matches, their percentage as text, candidates (trace_id, n_candidates), distinct matches, mean distance."""
    w = Window.partitionBy("trace_id").orderBy("idx")
    step = metres(F.lag("x").over(w), F.lag("y").over(w), F.col("x"), F.col("y"))
    rows = with_predictions(points, matched).withColumn("step", step).groupBy("trace_id").agg(F.round(F.coalesce(F.sum("step"), F.lit(0.0)), 2).alias("source_length"), F.count("*").alias("points"), F.count("segment_id").alias("points_with_match"), F.countDistinct("segment_id").alias("matched_target_ids_count"), F.round(F.avg("distance"), 2).alias("avg_dist_to_road"))
    percent = F.format_string("%.2f", 100.0 * F.col("points_with_match") / F.col("points"))
    return rows.withColumn("percent_points_with_match", percent).join(candidates.select("trace_id", F.col("n_candidates").alias("target_candidates_count")), "trace_id", "left").fillna(0, ["target_candidates_count"])


def compared(points: DataFrame, matched: DataFrame, labels: DataFrame, segs: DataFrame) -> DataFrame:
    """One row a labelled point, up to its trace's first point without a label; traces without labels are left out.

    labels: trace_id, idx, label_id. A label whose segment is not in segs has no snapped place.
    """
    return against_labels(with_predictions(points, matched), labels, segs)


def against_labels(predicted: DataFrame, labels: DataFrame, segs: DataFrame) -> DataFrame:
    """compared() of with_predictions() or nearest_or_none(). A trace without labels ends before its first point, so it needs no test of its own."""
    rows = predicted.join(labels, ["trace_id", "idx"], "left")
    w = Window.partitionBy("trace_id").orderBy("idx")
    missing = F.sum(F.col("label_id").isNull().cast("int")).over(w)
    rows = rows.withColumns({"missing": missing, "px": F.lag("x").over(w), "py": F.lag("y").over(w)}).where("missing = 0")
    rows = bound(rows, step=F.coalesce(haversine(F.col("px"), F.col("py"), F.col("x"), F.col("y")), F.lit(0.0)))
    ends = segs.select(F.col("segment_id").alias("label_id"), "x1", "y1", "x2", "y2")
    rows = rows.join(ends, "label_id", "left")
    rows = bound(rows, t=fraction_along(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    place = F.when(F.col("x1").isNotNull(), wkt_point(F.col("x1") + F.col("t") * (F.col("x2") - F.col("x1")), F.col("y1") + F.col("t") * (F.col("y2") - F.col("y1"))))
    return rows.select(
        "trace_id", F.col("idx").alias("point_index"), F.col("label_id").cast("string").alias("label_feature_id"), text(F.col("segment_id")).alias("prediction_feature_id"), text(place).alias("label_snapped_wkt"),
        text(wkt_point(F.col("sx"), F.col("sy"))).alias("prediction_snapped_wkt"), F.col("step").alias("distance_to_prev_point"), F.col("segment_id").eqNullSafe(F.col("label_id")).alias("is_correct"),
    )


def error_rates(rows: DataFrame) -> DataFrame:
    """Of compared(): per trace and, with a null trace_id, over all: labelled metres, wrong metres and their quotient; -1 without metres."""
    wrong = F.when(F.col("is_correct"), 0.0).otherwise(F.col("distance_to_prev_point"))
    by = rows.rollup("trace_id").agg(F.round(F.coalesce(F.sum("distance_to_prev_point"), F.lit(0.0)), 2).alias("total_distance"), F.round(F.coalesce(F.sum(wrong), F.lit(0.0)), 2).alias("wrong_distance"))
    return by.withColumn("error_rate", F.when(F.col("total_distance") == 0, -1.0).otherwise(F.round(F.col("wrong_distance") / F.col("total_distance"), 4)))


def report(rows: DataFrame, n_targets: DataFrame) -> DataFrame:
    """line, text: the totals of metric_rows() as a report; averages are empty without traces or kilometres. n_targets: one row with n."""
    km = F.sum("source_length") / 1000
    t = rows.agg(F.count("*").alias("traces"), km.alias("km"), F.sum("target_candidates_count").alias("c"), F.sum("matched_target_ids_count").alias("m"), F.avg("avg_dist_to_road").alias("d"))
    t = t.crossJoin(F.broadcast(n_targets))  # one row each
    two = lambda c: text(F.format_string("%.2f", c))
    per = lambda c: F.concat(two(F.col(c) / F.nullif(F.col("traces"), F.lit(0))), F.lit("/trace, "), two(F.col(c) / F.nullif(F.col("km"), F.lit(0.0))), F.lit("/km"))
    lines = [("Traces", text(F.col("traces"))), ("Target features", text(F.col("n"))), ("Avg distance to snapped road", F.concat(two(F.col("d")), F.lit("m"))), ("GPS traces length", F.concat(two(F.col("km")), F.lit("km"))), ("Avg number of candidate segments", per("c")), ("Avg number of matched segments", per("m"))]
    listed = F.array(*(F.concat(F.rpad(F.lit(name), 35, "."), value) for name, value in lines))
    return t.select(F.posexplode(listed).alias("line", "text"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    """One JSON document a row, nulls kept."""
    rows.write.option("ignoreNullFields", "false").json(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """documents() as text, one a line."""
    docs.select("json").write.text(path)


def write_options(spark: SparkSession, options: Options, path: str) -> None:
    """The options of a run as one line of JSON beside its output."""
    spark.createDataFrame([(json.dumps(vars(options)),)], "value string").coalesce(1).write.text(path)
