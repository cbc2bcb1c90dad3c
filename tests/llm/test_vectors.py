"""Operators on vectors against brute force: ties, copies, repeated ids, nulls, huge components, empty tables."""

import numpy as np
import pytest

from tests.oracle import DATA, rows_of, sql_rows
from wayfold.llm import graph_dedup, hard_negatives
from wayfold.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int"


def vectors(n=400, dim=7, seed=3, ids=1):
    rng = np.random.default_rng(seed)
    m = np.round(rng.normal(size=(n, dim)) * rng.choice([0.2, 1, 3], size=(n, 1)), 1)
    m[n // 2 : n // 2 + 40] = m[0]  # copies and ties
    return [(i * ids, list(map(float, v)), int(rng.integers(0, 4))) for i, v in enumerate(m)]


ODD = [(None, [1.0] * 7, 1), (5000, None, 1), (5001, [1.0, None, 1.0], 1), (5002, [float("nan")] * 7, 1), (5003, [float("inf")] * 7, 1), (5004, [], 1), (5005, [0.5, -0.25], 2), (5006, [0.0] * 7, 3), (5100, [2.0] * 7, None), (5200, [0.3] * 7, 2), (5200, [0.3] * 7, 2), (5300, [1e18] * 7, 1), (5301, [1e300] + [0.0] * 6, 2)]


def finite(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def scaled(x):
    return int(np.floor(x * 256)) if abs(x) < 2**52 else int(x * 256)


def inner(a, b):
    return max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))


def brute_negatives(rows, every=100):
    use = [(i, (label + 1) % 10 if i % 7 == 0 else label, [scaled(x) for x in v]) for i, v, label in rows if i is not None and label is not None and finite(v)]
    found = []
    for a, of, q in use:
        if a % every:
            continue
        near = [(-inner(q, v), i, label) for i, label, v in use if i != a]
        for p, name, _ in sorted(x for x in near if x[2] == of)[:5]:
            inside = sorted((s, i) for s, i, label in near if label != of and 30 * -p <= 100 * -s <= 90 * -p)[:10]
            found += [(a, name, n, i, -p, -s) for n, (s, i) in enumerate(inside, 1)]
    return sorted(found)


@pytest.mark.parametrize("size", [(8192, 2048), (37, 3)])
def test_hard_negatives(spark, size, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 8)
    rows = vectors(ids=5) + ODD
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as q", "2 as a", "3 as c_block")
    found = hard_negatives.mine(frame, block=size[0], query_block=size[1])
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    for rows in ([], ODD[:4], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)]):
        assert hard_negatives.mine(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_heap_visits_all_pairs_by_falling_sums():
    u, w = np.array([3.0, -1.0, 3.0]), np.array([0.5, 2.0])
    got = list(hard_negatives.cells((np.arange(3), u), (np.arange(2), w)))
    assert [s for s, *_ in got] == sorted((float(x + y) for x in u for y in w), reverse=True)
    assert {(i, j) for _, i, j in got} == {(i, j) for i in range(3) for j in range(2)}


def test_windows_round_inwards():
    for s in range(0, 400):
        low, high = hard_negatives.window(s, 30, 90)
        assert [n for n in range(-5, 500) if 30 * s <= 100 * n <= 90 * s] == list(range(low, high + 1))


@pytest.mark.parametrize("name", ["op11_graph_dedup", "op13_hard_negatives"])
def test_vector_query_matches_sql(spark, name):
    d = f"{DATA}/sf0.001"
    assert rows_of(QUERIES[name](spark, d)) == sql_rows(ORACLE_SQL[name], d)


def brute_links(rows):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    able = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and finite(v) and any(v)]
    dim = max(len(v) for _, v in able)
    x = np.array([np.pad(v, (0, dim - len(v))) / np.abs(v).max() for _, v in able])
    x /= np.sqrt((x * x).sum(1))[:, None]
    near = x @ x.T >= graph_dedup.LEAST
    np.fill_diagonal(near, False)
    ids, least = np.array([i for i, _ in able]), np.array([i for i, _ in able])
    while True:
        new = np.minimum(least, np.where(near, least[None, :], 2**62).min(1))
        if (new == least).all():
            break
        least = new
    found = [(int(i), int(n), int(c), bool(i == c)) for i, n, c in zip(ids, near.sum(1), least)]
    alone = [(i, 0, i, i is not None) for i, v, _ in rows if i is None or not finite(v) or not any(v)]
    return sorted(found + alone, key=repr)


def near_copies(seed=1, dim=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(700, dim))
    groups = [b + rng.normal(size=(k, dim)) * 0.1 for b, k in zip(base, [2] * 60 + [9] * 10 + [300])]  # pairs, groups and one dense group
    chain = [base[99] * (1 - t) + base[98] * t for t in np.linspace(0, 1, 12)]
    m = np.concatenate([base, *groups, chain, np.repeat(base[5:6], 50, 0), base[6:7] * 1e200, base[7:8] * 1e-200])
    order = rng.permutation(len(m))
    return [(int(i), list(map(float, m[j])), 0) for i, j in enumerate(order)]


@pytest.mark.parametrize("region", [4096, 60])
def test_graph_dedup(spark, region):
    rows = near_copies() + [(None, [1.0] * 24, 1), (5000, None, 1), (5001, [1.0, None], 1), (5002, [float("nan")], 1), (5003, [], 1), (5004, [0.0, -0.0], 1), (5005, [3.0], 1), (5006, [2.0, 0.0], 1), (5007, [2.0, 0.0], 1), (5007, [2.0, 0.0], 1), (5005, [0.0, 1.0], 1)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as node", "2 as shard", "3 as role")
    found = graph_dedup.linked(frame, region=region)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    got, want = sorted(map(tuple, found.collect()), key=repr), brute_links(rows)
    assert [r[0] for r in got] == [r[0] for r in want]
    held, real = sum(min(g[1], w[1]) for g, w in zip(got, want)), sum(w[1] for w in want)
    assert held >= 0.97 * real and all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[2:] == w[2:] for g, w in zip(got, want)) >= 0.99 * len(want)
    if region > len(rows):
        assert got == want


def test_graph_dedup_of_nothing(spark):
    assert graph_dedup.linked(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(r) for r in graph_dedup.linked(spark.createDataFrame([(1, None, 0), (2, [1.0], 0)], SCHEMA)).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]


def test_graph_finds_its_way():
    x = graph_dedup.unit(np.random.default_rng(0).normal(size=(900, 16)).tolist(), 16)
    near = graph_dedup.adjacency(x, 0)
    assert all(i not in n and len(set(n.tolist())) == len(n) for i, n in enumerate(near))
    reached, front = {0}, {0}
    while front:
        front = {int(j) for i in front for j in near[i]} - reached
        reached |= front
    assert len(reached) == 900
