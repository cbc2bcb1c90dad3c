"""GPS traces matched to road segments by a hidden Markov model whose transitions are routes over candidate segments.

Spark finds each point's candidate segments by an equi-join on grid cells and deals out traces; the best sequence of a
trace is followed point by point from its first to its last, since revisit penalties depend on the whole path so far and
a later point can revise any earlier one. So a whole trace is one task's work and memory.

Routes run over the trace's candidate segments. Without loops (the default) they take no segment that the sequence has
matched or passed before; with loops, each segment and connector passed again is a revisit and costs its penalty.

Defined cases: a point without a candidate, or that no route reaches, is ignored together with the retained point
before it; the sequence goes on from the one before that, or ends there if the time or distance from the ignored one is
too large, and the next sequence starts at the next point. Ties go to the smaller segment id. Points without coordinates take part as points without candidates.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS
from ..sources.adapters import ORIGIN_LAT, ORIGIN_LON
from .spatial import near

RESULT = "trace_id long, idx long, sequence int, segment_id long, distance double, route_m double, revisits int"
#: Last layers whose states keep their sets; those of earlier ones are freed, and made again from the way back if needed.
SETS_KEPT = 8


@dataclass(frozen=True)
class Options:
    sigma: float = 4.1
    beta: float = 0.9
    most_metres: float = 10.0
    most_deviation: float = 300.0
    segment_penalty: float = 100.0
    via_penalty: float = 100.0
    gap_seconds: float = 60.0
    gap_metres: float = 300.0
    allow_loops: bool = False


@dataclass
class Road:
    """A candidate of a point: the segment, its connectors and the snapped place."""

    segment: int
    nodes: tuple[int, int]
    ends: tuple[tuple, tuple]
    place: tuple
    distance: float


@dataclass
class State:
    """The best way to a candidate: its log-probability and the way back."""

    road: Road
    score: float
    before: State | None = None
    route_m: float = 0.0
    revisits: int = 0
    segments: frozenset | None = frozenset()
    vias: frozenset | None = frozenset()
    via: tuple[int, ...] = ()
    passed: tuple[int, ...] = ()


@dataclass
class Layer:
    """A retained point and the states of its candidates."""

    row: int
    place: tuple
    seconds: float | None
    states: list[State] = field(default_factory=list)


def metres(a: tuple, b: tuple) -> float:
    """Great-circle metres between two places in micro-degrees."""
    p, r = math.radians(ORIGIN_LON + a[0] / 1e6), math.radians(ORIGIN_LON + b[0] / 1e6)
    q, s = math.radians(ORIGIN_LAT + a[1] / 1e6), math.radians(ORIGIN_LAT + b[1] / 1e6)
    h = math.sin((s - q) / 2) ** 2 + math.cos(q) * math.cos(s) * math.sin((r - p) / 2) ** 2
    return 2 * EARTH_RADIUS * math.asin(math.sqrt(h))


def network(roads: list[Road]) -> dict[int, list[tuple[int, float, int]]]:
    """Connector to its neighbours, the metres between them and the segment, over the given candidates only."""
    links: dict = {}
    for r in {r.segment: r for r in roads}.values():
        length = metres(*r.ends)
        for a, b in (r.nodes, r.nodes[::-1]):
            links.setdefault(a, []).append((b, length, r.segment))
    return links


def reach(start: Road, links: dict, most: float, blocked: frozenset = frozenset(), wanted: set | None = None) -> dict[int, tuple[float, int, int]]:
    """Connector to (metres from the start's place, connector before, segment between), for all within `most` metres over segments that are not blocked; the search ends once all wanted connectors are reached."""
    done: dict = {}
    left = set(wanted or ())
    queue = [(metres(start.place, end), node, -1, -1) for node, end in zip(start.nodes, start.ends, strict=True)]
    heapq.heapify(queue)
    while queue:
        d, node, before, by = heapq.heappop(queue)
        if node in done or d > most:
            continue
        done[node] = (d, before, by)
        left.discard(node)
        if wanted is not None and not left:
            break
        for other, length, segment in links.get(node, ()):
            if other not in done and segment not in blocked:
                heapq.heappush(queue, (d + length, other, node, segment))
    return done


def route(start: Road, end: Road, reached: dict) -> tuple[float, tuple[int, ...], tuple[int, ...]]:
    """Metres, connectors and segments passed between two places; infinite if the end is out of reach."""
    if start.segment == end.segment:
        return metres(start.place, end.place), (), ()
    ways = [(reached[n][0] + metres(p, end.place), n) for n, p in zip(end.nodes, end.ends, strict=True) if n in reached]
    if not ways:
        return math.inf, (), ()
    length, node = min(ways)
    via, passed = [], []
    while node != -1:
        via.append(node)
        _, node, by = reached[node]
        passed += [by] * (by != -1)
    return length, tuple(reversed(via)), tuple(reversed(passed))


def emission(distance: float, o: Options) -> float:
    return -math.log(math.sqrt(2 * math.pi) * o.sigma) - 0.5 * (distance / o.sigma) ** 2


def first_states(roads: list[Road], o: Options) -> list[State]:
    return [State(r, emission(r.distance, o), segments=frozenset([r.segment])) for r in roads]


def restored(state: State) -> State:
    """state with its sets, which its way back gives."""
    if state.segments is None:
        way, s = [], state
        while s is not None:
            way.append(s)
            s = s.before
        state.segments, state.vias = frozenset(x for s in way for x in (s.road.segment, *s.passed)), frozenset(v for s in way for v in s.via)
    return state


def next_states(prev: Layer, roads: list[Road], trace_m: float, links: dict, o: Options) -> list[State]:
    """The best state of each candidate that some route from prev reaches."""
    found: dict[int, State] = {}
    for s in map(restored, prev.states):
        reached = None
        for k, r in enumerate(roads):
            stays = r.segment == s.road.segment
            if not o.allow_loops and r.segment in s.segments and not stays:
                continue
            if reached is None and not stays:
                # Without loops a route takes no segment that was matched or passed before. Only ways to another segment need the search.
                reached = reach(s.road, links, trace_m + o.most_deviation, frozenset() if o.allow_loops else s.segments, {n for x in roads for n in x.nodes})
            length, via, passed = route(s.road, r, reached)
            gap = abs(trace_m - length)
            if gap > o.most_deviation:
                continue
            steps = () if stays else tuple(x for x, before in zip((*passed, r.segment), (s.road.segment, *passed), strict=True) if x != before)
            again, seen = sum(x in s.segments for x in steps), sum(v in s.vias for v in via)
            score = s.score + emission(r.distance, o) - math.log(o.beta) - gap / o.beta - seen * o.via_penalty - again * o.segment_penalty
            if k not in found or score > found[k].score:
                segments = s.segments.union(steps) if steps else s.segments
                found[k] = State(r, score, s, length, again + seen, segments, s.vias.union(via) if via else s.vias, via, passed)
    return [found[k] for k in sorted(found)]


def follow(points: list[tuple[tuple, float | None, list[Road]]], o: Options) -> list[tuple]:
    """(sequence, segment, distance, route metres, revisits) of each point (place, seconds, candidates); Nones if ignored."""
    links = network([r for _, _, roads in points for r in roads])
    out: list = [None] * len(points)
    layers: list[Layer] = []
    sequence = 0

    def close() -> None:
        nonlocal sequence
        state = max(layers[-1].states, key=lambda s: (s.score, -s.road.segment)) if layers else None
        for layer in reversed(layers):
            out[layer.row] = (sequence, state.road.segment, round(state.road.distance, 2), round(state.route_m, 2), state.revisits)
            state = state.before
        sequence += bool(layers)
        layers.clear()

    for row, (place, seconds, roads) in enumerate(points):
        roads = sorted(roads, key=lambda r: r.segment)
        states = next_states(layers[-1], roads, metres(layers[-1].place, place), links, o) if layers else first_states(roads, o)
        if states:
            layers.append(Layer(row, place, seconds, states))
            if len(layers) > SETS_KEPT:
                for s in layers[-SETS_KEPT - 1].states:
                    s.segments = s.vias = None
        elif layers:
            prev = layers.pop()
            late = seconds is not None and prev.seconds is not None and seconds - prev.seconds > o.gap_seconds
            if late or metres(prev.place, place) > o.gap_metres:
                close()
    close()
    return [x or (None,) * 5 for x in out]


def metrics(points: DataFrame, matched: DataFrame) -> DataFrame:
    """Per trace of match(): points, points with a match, route length, mean distance to the road (null without a match), revisits, distinct segments, sequences."""
    counts = points.groupBy("trace_id").agg(F.count("*").alias("n_points"))
    hit = matched.where("segment_id is not null").groupBy("trace_id").agg(
        F.count("*").alias("n_matched"), F.round(F.sum("route_m"), 2).alias("route_m"), F.round(F.avg("distance"), 2).alias("mean_distance_m"), F.sum("revisits").alias("n_revisits"),
        F.countDistinct("segment_id").alias("n_segments"), F.countDistinct("sequence").alias("n_sequences"),
    )
    return counts.join(hit, "trace_id", "left").fillna(0, ["n_matched", "route_m", "n_revisits", "n_segments", "n_sequences"])


def match(points: DataFrame, segs: DataFrame, options: Options | None = None) -> DataFrame:
    """One row a point: the sequence it belongs to, its segment, the metres to it, those of the route from the point before, and revisits.

    points: trace_id, idx, ts, x, y; segs: segment_id, x1, y1, x2, y2, from_node, to_node.
    """
    o = options or Options()
    close = near(points.select("trace_id", "idx", "x", "y"), segs, o.most_metres)
    road = F.struct("segment_id", "from_node", "to_node", "x1", "y1", "x2", "y2", "sx", "sy", "distance")
    roads = close.groupBy("trace_id", "idx").agg(F.collect_list(road).alias("roads"))
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    every = points.select("trace_id", "idx", "x", "y", seconds.alias("seconds")).join(roads, ["trace_id", "idx"], "left")

    def task(rows):
        import pyarrow as pa

        columns = {c: rows.column(c).to_pylist() for c in rows.column_names}
        order = sorted(range(rows.num_rows), key=columns["idx"].__getitem__)
        points_, known = [], {}
        for i in order:
            cands = []
            for r in columns["roads"][i] or ():
                # One copy of a segment's connectors and ends for all its points.
                shape = (r["from_node"], r["to_node"]), ((r["x1"], r["y1"]), (r["x2"], r["y2"]))
                cands.append(Road(r["segment_id"], *known.setdefault((r["segment_id"], *shape), shape), (r["sx"], r["sy"]), r["distance"]))
            place = tuple(math.nan if columns[c][i] is None else columns[c][i] for c in ("x", "y"))
            points_.append((place, columns["seconds"][i], cands))
        done = zip(*follow(points_, o), strict=True)
        kinds = {"sequence": pa.int32(), "segment_id": pa.int64(), "distance": pa.float64(), "route_m": pa.float64(), "revisits": pa.int32()}
        found = {name: pa.array(values, kind) for (name, kind), values in zip(kinds.items(), done, strict=True)}
        return pa.table({"trace_id": rows.column("trace_id"), "idx": pa.array([columns["idx"][i] for i in order], pa.int64()), **found})

    return every.groupBy("trace_id").applyInArrow(task, RESULT)
