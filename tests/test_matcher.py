import itertools
import math

from tests.oracle import DATA
from wayfold.operators import matcher
from wayfold.operators.matcher import Options, Road, follow, metres
from wayfold.sources import adapters


def grid(n=3, step=2000):
    """segment: (nodes, ends) of an n by n grid."""
    at = lambda k: (float(k % n * step), float(k // n * step))
    pairs = [(k, k + 1) for k in range(n * n) if k % n < n - 1] + [(k, k + n) for k in range(n * (n - 1))]
    return {i: (p, (at(p[0]), at(p[1]))) for i, p in enumerate(pairs)}


def road(roads, segment, place):
    nodes, ends = roads[segment]
    (ax, ay), (bx, by) = ends
    t = max(0.0, min(1.0, ((place[0] - ax) * (bx - ax) + (place[1] - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
    snapped = (ax + t * (bx - ax), ay + t * (by - ay))
    return Road(segment, nodes, ends, snapped, metres(place, snapped))


def test_follow_equals_brute_force():
    roads = grid()
    o = Options(allow_loops=True, segment_penalty=0, via_penalty=0, most_deviation=1e9, sigma=30, beta=30)
    places = [(300.0, 150.0), (1700.0, 200.0), (2150.0, 900.0), (2300.0, 1900.0), (3500.0, 2150.0)]
    points = [(p, None, [road(roads, s, p) for s in roads]) for p in places]
    dist = {(a, b): 0.0 if a == b else math.inf for a in range(9) for b in range(9)}
    for (a, b), ends in roads.values():
        dist[a, b] = dist[b, a] = metres(*ends)
    for k, a, b in itertools.product(range(9), repeat=3):
        dist[a, b] = min(dist[a, b], dist[a, k] + dist[k, b])

    def length(r, s):
        if r.segment == s.segment:
            return metres(r.place, s.place)
        return min(metres(r.place, p) + dist[a, b] + metres(q, s.place) for a, p in zip(r.nodes, r.ends) for b, q in zip(s.nodes, s.ends))

    def value(r):
        return -0.5 * (r.distance / o.sigma) ** 2

    # every sequence of candidates, by exhaustive search over the nearest four of each point
    points = [(p, t, sorted(c, key=lambda r: r.distance)[:4]) for p, t, c in points]
    kept = {r.segment for _, _, c in points for r in c}
    assert kept
    full = [(p, t, c) for p, t, c in points]
    got = follow(full, o)
    links = matcher.network([r for _, _, c in points for r in c])
    best = max(itertools.product(*(c for _, _, c in points)), key=lambda seq: sum(map(value, seq)) - sum(abs(metres(places[i], places[i + 1]) - matcher.route(seq[i], seq[i + 1], matcher.reach(seq[i], links, 1e12))[0]) / o.beta for i in range(4)))
    assert [g[1] for g in got] == [r.segment for r in best]
    whole = matcher.network([road(roads, s, places[0]) for s in roads])
    for r, s in itertools.product(points[0][2], points[4][2]):
        assert abs(matcher.route(r, s, matcher.reach(r, whole, 1e12))[0] - length(r, s)) < 1e-6


def test_gaps_and_ignored_points():
    roads = grid()
    o = Options()
    near = lambda p, t, s: (p, t, [road(roads, s, p)])
    points = [near((100.0, 0.0), 0.0, 0), near((400.0, 0.0), 10.0, 0), ((500.0, 900.0), 15.0, []), near((700.0, 0.0), 20.0, 0), near((900.0, 0.0), 500.0, 0)]
    got = follow(points, o)
    assert [g[1] for g in got] == [0, None, None, 0, 0]
    # a break ignores the unmatched point and the one before it; the next sequence starts at the next point
    late = [near((100.0, 0.0), 0.0, 0), near((400.0, 0.0), 10.0, 0), ((500.0, 0.0), 95.0, []), near((700.0, 0.0), 96.0, 0)]
    assert [g[:2] for g in follow(late, o)] == [(0, 0), (None, None), (None, None), (1, 0)]
    far = [near((100.0, 0.0), 0.0, 0), near((400.0, 0.0), 10.0, 0), near((400.0, 9000.0), 15.0, 11), near((400.0, 9000.0), 16.0, 11)]
    assert [g[:2] for g in follow(far, o)] == [(0, 0), (None, None), (None, None), (1, 11)]
    assert follow([], o) == [] and follow([((0.0, 0.0), None, [])], o) == [(None,) * 5]


def test_match_gives_a_row_for_every_point(spark):
    d = f"{DATA}/sf0.001"
    part, events = adapters.table(spark, d, "part"), adapters.table(spark, d, "events")
    points = adapters.trace_points(events, part)
    got = matcher.match(points, adapters.segments(part), Options(most_metres=30.0, allow_loops=True))
    rows = got.collect()
    assert len({(r["trace_id"], r["idx"]) for r in rows}) == len(rows) == points.count()
    assert all(r["distance"] <= 30 for r in rows if r["segment_id"] is not None) and any(r["segment_id"] is not None for r in rows)


def test_freed_sets_change_no_result(monkeypatch):
    roads = grid(5)
    places = [(300.0 + 7700 * abs(math.sin(i / 3)), 8000.0 * abs(math.cos(i / 5))) for i in range(60)]
    points = [(p, None, [] if i % 7 in (3, 4) else [r for r in (road(roads, s, p) for s in roads) if r.distance < 150]) for i, p in enumerate(places)]
    o = Options(allow_loops=True, most_deviation=1e4, sigma=30, beta=30)
    monkeypatch.setattr(matcher, "SETS_KEPT", 10**9)
    whole = follow(points, o)
    monkeypatch.setattr(matcher, "SETS_KEPT", 1)
    assert follow(points, o) == whole and any(x[4] for x in whole)


def spur():
    """Three segments in a row (0-1-2-3) and a fourth from the second connector to the side."""
    at = {0: (0.0, 0.0), 1: (1000.0, 0.0), 2: (2000.0, 0.0), 3: (3000.0, 0.0), 4: (1000.0, 1000.0)}
    return {i: (p, (at[p[0]], at[p[1]])) for i, p in enumerate([(0, 1), (1, 2), (2, 3), (1, 4)])}


def test_no_way_back_over_passed_segments():
    roads = spur()
    own = {0: (500.0, 0.0), 1: (1500.0, 0.0), 2: (2500.0, 0.0), 3: (1000.0, 500.0)}
    along = [(own[s], None, [road(roads, s, own[s])]) for s in (0, 1, 2)]
    side = (own[3], None, [road(roads, 3, own[3])])
    o = Options(most_deviation=1e6, gap_metres=1e9)
    # No route leads to the spur but over the second segment again: the point is ignored with the one before it.
    assert [x[1] for x in follow([*along, side], o)] == [0, 1, None, None]
    got = follow([*along, side], Options(most_deviation=1e6, gap_metres=1e9, allow_loops=True))
    assert [x[1] for x in got] == [0, 1, 2, 3] and got[3][4] == 3  # the second segment and two connectors again
    # A segment that a route only passed is blocked as well: 0 to 2 passes 1, so that the spur cannot be reached.
    assert [x[1] for x in follow([along[0], along[2], side, along[1]], o)] == [0, None, None, 1]
    # The same points in an order that needs no way back.
    assert [x[1] for x in follow([along[0], side], o)] == [0, 3]
