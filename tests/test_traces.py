from wayfold.operators import results, traces
from wayfold.operators.matcher import Options, metres


def test_thinned_equals_loop(spark):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(t, i, start + timedelta(seconds=0.4 * i * (1 + t)), float((i * 97) % 700 + 150 * i), float((i * 31) % 900)) for t in range(3) for i in range(120)] + [(9, 0, None, 1.0, 2.0), (9, 1, None, 1.0, 2.0), (9, 2, start, None, 2.0), (9, 3, start, 900.0, 2.0)]
    got = sorted((r.trace_id, r.idx) for r in traces.thinned(spark.createDataFrame(rows, "trace_id long, idx long, ts timestamp, x double, y double")).collect())
    want, last = [], None
    for t, i, ts, x, y in rows:
        if x is None:
            continue
        if last is None or last[0] != t or (metres(last[2:], (x, y)) >= 50 and (ts is None or last[1] is None or (ts - last[1]).total_seconds() >= 1)):
            want.append((t, i))
            last = (t, ts, x, y)
    assert got == sorted(want) and 20 < len(want) < 300


def test_thinned_traces_that_stay_or_go_back(spark):
    """A trace that stays in one place for 200 points, one that comes back, one point alone."""
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(0, i, start + timedelta(seconds=i), 10.0 * (i % 3), 0.0) for i in range(200)] + [(0, 200, start + timedelta(seconds=300), 5000.0, 0.0)]
    rows += [(1, i, start + timedelta(seconds=i), 1000.0 * (i % 2), 0.0) for i in range(9)] + [(2, 5, start, 0.0, 0.0)]
    got = sorted((r.trace_id, r.idx) for r in traces.thinned(spark.createDataFrame(rows, "trace_id long, idx long, ts timestamp, x double, y double")).collect())
    assert got == [(0, 0), (0, 200)] + [(1, i) for i in range(9)] + [(2, 5)]
    assert traces.thinned(spark.createDataFrame([], "trace_id long, idx long, ts timestamp, x double, y double")).collect() == []


def test_thinned_by_blocks(spark):
    """Traces of many blocks, of one, and a step over several blocks; a trace within one block needs no round of joins."""
    import random
    from datetime import datetime, timedelta

    dice, start, rows = random.Random(3), datetime(2024, 1, 1), []
    for t, n in enumerate((1, 4, 5, 70, 300)):
        x = 0.0
        for i in range(n):
            x += dice.choice((0.0, 100.0, 300.0, 600.0)) if not 100 < i < 130 else 0.0
            rows.append((t, i, start + timedelta(seconds=0.3 * i), x, 10.0 * dice.random()))
    frame = spark.createDataFrame(rows, "trace_id long, idx long, ts timestamp, x double, y double")
    want, last = [], None
    for t, i, ts, x, y in rows:
        if last is None or last[0] != t or (metres(last[2:], (x, y)) >= 50 and (ts - last[1]).total_seconds() >= 1):
            want.append((t, i))
            last = (t, ts, x, y)
    for block in (1, 4, 128):
        got = traces.thinned(frame, block=block)
        assert got.columns == frame.columns and sorted((r.trace_id, r.idx) for r in got.collect()) == sorted(want)
    assert "Join" not in plan_of(traces.thinned(frame.where("trace_id < 3")))


def test_quantiles_by_selection(spark):
    import numpy as np

    values = [3.0] * 500 + [float(i * 7919 % 1000) for i in range(777)] + [None] * 5
    frame = spark.createDataFrame([(i, v, {"a": 1}) for i, v in enumerate(values)], "k int, v double, m map<string,int>")
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    assert np.allclose(results.quantiles(frame, "v", shares), np.quantile([v for v in values if v is not None], shares))
    assert results.quantiles(frame.where("v is null"), "v", [0.5]) == [None] and results.quantiles(frame.where("k = 3"), "v", [0.5]) == [3.0]


def test_routes_over_connectors(spark):
    """A row of segments (0-1-2-3-4) with a spur: the way between candidates three segments apart, and none beyond the bound."""
    ends = {i: (i, i + 1, 1000.0 * i, 0.0, 1000.0 * (i + 1), 0.0) for i in range(4)} | {9: (1, 8, 1000.0, 0.0, 1000.0, 1000.0)}
    at = {0: (500.0, 0.0), 1: (1500.0, 0.0), 2: (2500.0, 0.0), 3: (3500.0, 0.0), 9: (1000.0, 700.0)}
    near = [(1, idx, seg, *at[seg], *at[seg], *ends[seg]) for idx, segs in ((0, (0, 9)), (1, (3, 1)), (2, (2,))) for seg in segs]
    frame = spark.createDataFrame(near, "trace_id long, idx long, segment_id long, x double, y double, sx double, sy double, from_node long, to_node long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.idx, r.from_segment, r.to_segment): r.route_m for r in results.routes(frame, Options(most_deviation=1000.0)).collect()}

    def way(*places):
        return round(sum(metres(a, b) for a, b in zip(places, places[1:])), 2)

    line = [(1000.0 * i, 0.0) for i in range(5)]
    want = {(1, 0, 3): way(at[0], at[3]), (1, 0, 1): way(at[0], at[1]), (1, 9, 3): way(at[9], line[1], at[3]), (1, 9, 1): way(at[9], line[1], at[1]), (2, 3, 2): way(at[3], at[2]), (2, 1, 2): way(at[1], at[2])}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 0.02 for k in want)
    assert (1, 9, 3) not in {(r.idx, r.from_segment, r.to_segment) for r in results.routes(frame, Options(most_deviation=20.0)).collect()}


NEAR = "trace_id long, idx long, segment_id long, x double, y double, sx double, sy double, from_node long, to_node long, x1 double, y1 double, x2 double, y2 double"


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def made_up_near(moved):
    """Two traces over a made-up grid of 5 x 5 connectors; moved: the second trace's segments name a connector in several places."""
    import random

    dice, rows = random.Random(5), []
    for trace in (1, 2):
        place = {n: (1000.0 * (n % 5), 1000.0 * (n // 5)) for n in range(25)}
        segs = {s: ends for s, ends in enumerate([(n, n + 1) for n in range(25) if n % 5 < 4] + [(n, n + 5) for n in range(20)]) if dice.random() < 0.8}
        edges = {s: [place[n] for n in ends] for s, ends in segs.items()}
        if moved and trace == 2:
            edges = {s: [(x + 700 * (s % 3), y) for x, y in e] for s, e in edges.items()}
        for idx in (0, 1, 2, 4, 5):
            for s in dice.sample(sorted(segs), 6):
                t = dice.random()
                (x1, y1), (x2, y2) = edges[s]
                rows.append((trace, idx, s, 900.0 * idx, 2000.0, x1 + t * (x2 - x1), y1 + t * (y2 - y1), *segs[s], x1, y1, x2, y2))
    return rows


def test_transitions_need_no_join(spark):
    """One window over the trace finds the next point's candidates; a gap in the numbers parts a trace."""
    rows = made_up_near(False)
    got = results.transitions(spark.createDataFrame(rows, NEAR), Options(most_deviation=1000.0))
    assert "Join" not in plan_of(got)
    want = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] + 1 == b[1]:
                step = metres(a[3:5], b[3:5])
                over = [metres(a[5:7], e) + metres(e, b[5:7]) for n, e in ((a[7], a[9:11]), (a[8], a[11:13])) if n in b[7:9]]
                way = [metres(a[5:7], b[5:7])] if a[2] == b[2] else over
                if way and abs(step - min(way)) <= 1000:
                    want[a[0], b[1], a[2], b[2]] = round(min(way), 2)
    got = {tuple(r)[:4]: r.route_m for r in got.collect()}
    assert got.keys() == want.keys() and len(want) > 20 and {k[1] for k in want} == {1, 2, 5} and all(abs(got[k] - want[k]) < 0.02 for k in want)


def test_routes_equal_a_search_of_every_pair(spark):
    """Labels that lead away from the next point are dropped, in a trace whose connectors have several places none."""
    for moved in (False, True):
        rows = made_up_near(moved)
        got = results.routes(spark.createDataFrame(rows, NEAR), Options(most_deviation=400.0))
        assert plan_of(got).count("Join") == 1  # pairs on one segment or with a shared connector take no part in it
        want = {}
        for a in rows:
            least, front = {}, [(metres(a[5:7], e), n) for n, e in ((a[7], a[9:11]), (a[8], a[11:13]))]
            while front:
                m, n = front.pop()
                if m < least.get(n, 1e9) - 1e-9:
                    least[n] = m
                    front += [(m + metres(r[9:11], r[11:13]), q) for r in rows if r[0] == a[0] for p, q in (r[7:9], r[8:6:-1]) if p == n]
            for b in rows:
                if a[0] == b[0] and a[1] + 1 == b[1]:
                    step = metres(a[3:5], b[3:5])
                    over = [least[n] + metres(e, b[5:7]) for n, e in ((b[7], b[9:11]), (b[8], b[11:13])) if n in least]
                    way = [metres(a[5:7], b[5:7])] if a[2] == b[2] else over
                    if way and abs(step - min(way)) <= 400:
                        want[a[0], b[1], a[2], b[2]] = round(min(way), 2)
        got = {tuple(r)[:4]: r.route_m for r in got.collect()}
        assert got.keys() == want.keys() and len(want) > 40 and all(abs(got[k] - want[k]) < 0.02 for k in want)


def test_compared_points_are_read_once_beside_their_labels(spark):
    """Points with their nearest segment by one outer join, and no test of which traces have labels: the same rows as by joins."""
    from wayfold.operators import spatial

    points = spark.createDataFrame([(t, i, 100.0 * i + 7 * t, 150.0 * (i % 3 == 2) + 900.0 * (i == 5)) for t in range(4) for i in range(8)] + [(5, 0, None, 1.0)], "trace_id long, idx long, x double, y double")
    segs = spark.createDataFrame([(s, 200.0 * s, 0.0, 200.0 * s + 200, 0.0) for s in range(4)] + [(9, 0.0, 0.0, 200.0, 0.0)], "segment_id long, x1 double, y1 double, x2 double, y2 double")
    labels = points.where("trace_id % 2 = 0 and idx <> 6").selectExpr("trace_id", "idx", "cast(idx div 2 as long) label_id")
    near = spatial.near(points, segs, 30.0)
    predicted = spatial.nearest_or_none(points, segs, 30.0)
    got = results.against_labels(predicted, labels, segs)
    assert sorted(map(str, got.collect())) == sorted(map(str, results.compared(points, results.ranked(near).where("rank = 1"), labels, segs).collect()))
    assert plan_of(got).count("Join") == 3 and "LeftSemi" not in plan_of(got)
    assert predicted.count() == 33 and predicted.where("segment_id is null").count() == 5 and predicted.where("segment_id = 9").count() == 0


def test_documents_of_candidates_need_no_join(spark):
    """The same documents as from points and predictions; points of which all candidates lie too far have none."""
    from pyspark.sql import functions as F

    from wayfold.operators import spatial

    points = spark.createDataFrame([(t, i, 100.0 * i, 150.0 * (i % 3 == 2) + 900.0 * (i == 5)) for t in range(3) for i in range(7)] + [(4, 0, None, 1.0)], "trace_id long, idx long, x double, y double").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    segs = spark.createDataFrame([(s, 200.0 * s, 0.0, 200.0 * s + 200, 0.0) for s in range(4)] + [(9, 0.0, 0.0, 200.0, 0.0)], "segment_id long, x1 double, y1 double, x2 double, y2 double")
    ranked = results.ranked(spatial.near(points, segs, 30.0))
    got = results.documents_of(spatial.near_or_none(points, segs, 30.0), True)
    want = results.documents(points, ranked.where("rank = 1"), True, ranked)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 4
    assert plan_of(got).count("Join") == 1


def test_writers_of_results(spark, tmp_path):
    results.write_options(spark, Options(sigma=5.0), str(tmp_path / "o"))
    assert '"sigma": 5.0' in spark.read.text(str(tmp_path / "o")).first().value
    results.write_json_lines(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"a":1,"b":null}'


def test_grid_coordinates_of_known_places(spark):
    """Published values of the grid: the pole, 45 degrees on the central meridian, the edge of a zone on the equator."""
    from pyspark.sql import functions as F

    from wayfold.functions.geo import transverse_mercator

    known = [(-81.0, 0.0, 500000.0, 0.0), (-81.0, 45.0, 500000.0, 4982950.400), (-84.0, 0.0, 166021.443, 0.0), (-78.0, 0.0, 833978.557, 0.0), (-81.0, 89.9999999999, 500000.0, 9997964.943)]
    rows = spark.createDataFrame(known, "lon double, lat double, e double, n double")
    e, n = transverse_mercator(F.col("lon"), F.col("lat"))
    for r in rows.select("e", "n", e.alias("x"), n.alias("y")).collect():
        assert abs(r.x - r.e) < 1e-3 and abs(r.y - r.n) < 1e-3, r


def test_flat_caps(spark):
    """A trace along a road: a road ahead of its end is outside the buffer, one beside it inside, and the corner is round."""
    from wayfold.operators import spatial

    points = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (1000, 0), (1000, 1000)])] + [(2, 0, 5000.0, 5000.0)], "trace_id long, idx long, x double, y double")
    roads = {1: (-150, -500, -150, 500), 2: (500, 150, 600, 150), 3: (500, 400, 600, 400), 4: (1120, -120, 1300, -300), 5: (1100, -100, 1300, -300), 6: (1000, 1100, 2000, 1100), 7: (300, -900, 300, 900), 8: (900, 500, 901, 501)}
    segs = spark.createDataFrame([(i, *map(float, c)) for i, c in roads.items()], "segment_id long, x1 double, y1 double, x2 double, y2 double")
    flat = {(r.trace_id, r.segment_id) for r in spatial.within_flat_buffer(points, segs, 17.0).collect()}
    round_ = {(r.trace_id, r.segment_id) for r in spatial.within_buffer(points, segs, 17.0).collect()}
    assert flat == {(1, 2), (1, 5), (1, 7), (1, 8), (2, None)}
    assert round_ - flat == {(1, 1), (1, 6)}
