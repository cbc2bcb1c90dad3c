"""Hard negatives by an inverted multi-index: two half-space codebooks, cells visited by a multi-sequence heap.

Each vector is cut in two halves; a codebook of each half (k-means on a bounded sample) gives it a pair of codes, its
cell. A row of codes (i, j) scores at most u[i] + w[j] with an anchor: the anchor's half times the center, plus the half's
length times the largest distance of any row from that center. The heap yields cells by falling sums, so a search stops at
the first cell whose sum is below what is still wanted: the last of the anchor's best rows or, for negatives, the
larger of a window's lower end and its last row. Cells that lie above all windows are passed over.

Rows are dealt by cell into blocks of bounded size; anchors by a hash. Blocks are visited in rounds, in the order in which
an anchor's heap first reaches them, each round four times as many as all before it, and only while the sum reaches
what the anchor still wants. Positives come first; their scores fix the windows of the second search.

Components x become floor(256 x). Products are exact: in doubles below 2**52, in Python integers beyond.

Defined cases: rows without an id, a label or a vector, or with a null, NaN or infinite component, take no part; shorter
vectors count as padded with zeros; other rows are those with another id; rows that repeat an id are candidates each,
and anchors each; scores beyond 64 bits count as the end of the range.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clusters import k_means, padded, squared_distances
from .common import arrow_type, checkpointed, out

SCALE = 256.0
BLOCK, QUERY_BLOCK = 8192, 2048
SAMPLE = 8192
#: Codes a half: about this many rows a cell, and no more codes than MOST_CODES.
CELL_ROWS, MOST_CODES = 64, 256
SAFE, LONG = 2.0**52, 2**63


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (floor(256 x) as doubles) of the rows that take part."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("w", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("w", lambda x: F.when(F.abs(x) < SAFE, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    kept = vectors.where("vec_id is not null and label is not null and embedding is not null").withColumn("w", wide).where(fine)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))


class Index:
    """Codebooks of two halves with each center's radius, and the cells that each block holds."""

    def __init__(self, centers: tuple[np.ndarray, np.ndarray]):
        self.centers, self.dims = centers, [c.shape[1] for c in centers]
        self.radii = tuple(np.zeros(len(c)) for c in centers)
        self.blocks: dict[tuple[int, int], list[int]] = {}

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[..., : self.dims[0]], x[..., self.dims[0] :]

    def codes(self, x: np.ndarray) -> list[np.ndarray]:
        """Code and distance of each row in the first half, then in the second."""
        found = []
        for part, centers in zip(self.halves(x), self.centers, strict=True):
            code = squared_distances(part, centers).argmin(1)
            with np.errstate(over="ignore", invalid="ignore"):
                off = np.sqrt(((part - centers[code]) ** 2).sum(1))
            found += [code.astype(np.int32), np.where(np.isnan(off), np.inf, off)]
        return found

    def bounds(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half: the least and the largest product of q's half with a row of each code, safely rounded."""
        found = []
        for part, centers, radii in zip(self.halves(q), self.centers, self.radii, strict=True):
            with np.errstate(over="ignore", invalid="ignore"):
                length = np.sqrt(part @ part)
                mid, off = centers @ part, length * radii if length else np.zeros(len(radii))
                off = off + 1e-9 * (length * np.sqrt((centers * centers).sum(1)) + off) + 1e-6
                low, high = mid - off, mid + off
            found.append((np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)))
        return found


def cells(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[float, int, int]]:
    """(sum, code, code) of all pairs by falling sums: a heap over two falling sequences (codes, bounds)."""
    (a, u), (b, w) = ((codes[order], bounds[order]) for codes, bounds in (first, second) for order in [np.argsort(-bounds, kind="stable")])
    heap = [(-(u[0] + w[0]), 0, 0)] if len(a) and len(b) else []
    while heap:
        s, i, j = heapq.heappop(heap)
        yield -s, int(a[i]), int(b[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (-(u[i] + w[j + 1]), i, j + 1))
        if not j and i + 1 < len(a):
            heapq.heappush(heap, (-(u[i + 1] + w[0]), i + 1, 0))


def wanted_blocks(index: Index, q: np.ndarray, floor: float, low: int, high: int) -> list[int]:
    """Blocks at places low to high - 1 of the order in which the heap reaches them, while its sums reach floor."""
    (_, u), (_, w) = index.bounds(q)
    seen: dict[int, None] = {}
    for s, i, j in cells((np.arange(len(u)), u), (np.arange(len(w)), w)):
        if s < floor or len(seen) >= high:
            break
        for b in index.blocks.get((i, j), ()):
            seen.setdefault(b)
    return list(seen)[low:high]


def scores(q: np.ndarray, rows: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Exact products of q with rows, as doubles or (beyond 2**52) as Python integers held to 64 bits."""
    with np.errstate(over="ignore", invalid="ignore"):
        if np.sqrt(q @ q) * norms.max(initial=0) < SAFE:
            return rows @ q
    return np.array([max(-LONG, min(LONG - 1, sum(int(a) * int(b) for a, b in zip(q, r, strict=True)))) for r in rows], object)


class Block:
    """The rows of a block by cell."""

    def __init__(self, index: Index, rows: pa.Table, dim: int):
        c1, c2 = (rows.column(n).to_numpy() for n in ("c1", "c2"))
        order = np.lexsort((c2, c1))
        c1, c2 = c1[order], c2[order]
        self.index, self.ids, self.labels = index, rows.column("vec_id").to_numpy()[order], rows.column("label").to_numpy()[order]
        self.v = padded(rows.column("v").to_pylist(), dim)[order]
        with np.errstate(over="ignore"):
            self.norms = np.sqrt((self.v * self.v).sum(1))
        first = np.flatnonzero(np.concatenate([[True], (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])])) if len(c1) else np.empty(0, np.int64)
        ends = np.append(first[1:], len(c1))
        self.spans = {(int(c1[s]), int(c2[s])): (int(s), int(e)) for s, e in zip(first, ends, strict=True)}
        self.codes = np.unique(c1), np.unique(c2)

    def cells(self, q: np.ndarray) -> Iterator[tuple[float, float, int, int]]:
        """(least sum, largest sum, start, end) of the cells that have rows here, by falling largest sums."""
        (l1, u1), (l2, u2) = self.index.bounds(q)
        a, b = self.codes
        for s, i, j in cells((a, u1[a]), (b, u2[b])):
            if span := self.spans.get((i, j)):
                yield l1[i] + l2[j], s, *span

    def positives(self, name: int, label: int, q: np.ndarray, floor: float, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) of other rows with the label that reach floor."""
        best: list[tuple[int, int]] = []
        for _, high, s, e in self.cells(q):
            if high < floor:
                break
            at = s + np.flatnonzero((self.labels[s:e] == label) & (self.ids[s:e] != name))
            if len(at):
                found = scores(q, self.v[at], self.norms[at])
                best = top(best, found, self.ids[at], found >= floor, k)
                floor = max(floor, best[-1][0]) if len(best) == k else floor
        return best

    def negatives(self, label: int, q: np.ndarray, windows: list[tuple[int, int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each window (low, high, least still wanted): the k best (score, id) of rows with another label inside."""
        best: list[list[tuple[int, int]]] = [[] for _ in windows]
        least, most = [max(low, floor) for low, _, floor in windows], max((h for _, h, _ in windows), default=0)
        for low, high, s, e in self.cells(q):
            if not least or high < min(least):
                break
            if low > most:
                continue
            at = s + np.flatnonzero(self.labels[s:e] != label)
            if not len(at):
                continue
            found = scores(q, self.v[at], self.norms[at])
            for i, (_, h, _) in enumerate(windows):
                inside = (found >= least[i]) & (found <= h)
                if inside.any():
                    best[i] = top(best[i], found, self.ids[at], inside, k)
                    least[i] = max(least[i], best[i][-1][0]) if len(best[i]) == k else least[i]
        return best


def top(best: list, found: np.ndarray, ids: np.ndarray, use: np.ndarray, k: int) -> list[tuple[int, int]]:
    new = zip(map(int, found[use].tolist()), ids[use].tolist(), strict=True)
    return sorted([*best, *new], key=lambda x: (-x[0], x[1]))[:k]


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and largest whole n with low * score <= 100 n <= high * score."""
    return -(-low * score // 100), high * score // 100


def indexed(rows: DataFrame, dim: int, block: int) -> tuple[DataFrame, Index]:
    """rows with c1, c2 and c_block, and their index."""
    n = rows.count()
    half = dim // 2
    codes = min(MOST_CODES, max(1, int((n / CELL_ROWS) ** 0.5)))
    sample = padded(rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(SAMPLE).toArrow().column(0).to_pylist(), dim)
    sample = sample[np.abs(sample).max(axis=1, initial=0) < 2.0**40]
    index = Index((k_means(sample[:, :half], codes), k_means(sample[:, half:], codes)))
    schema = arrow_type("vec_id long, label long, c1 int, r1 double, c2 int, r2 double")
    schema = schema.append(pa.field("v", pa.list_(pa.float64())))

    def assign(batches):
        for b in batches:
            v = b.column(2)
            yield out(schema, b.column(0), b.column(1), *index.codes(padded(v.to_pylist(), dim)), v)

    coded = rows.mapInArrow(assign, "vec_id long, label long, c1 int, r1 double, c2 int, r2 double, v array<double>")
    # Ties within a cell are broken by a hash, so that one frequent cell is spread over blocks.
    dealt = checkpointed(coded.repartitionByRange(max(1, -(-n // block)), "c1", "c2", F.xxhash64("vec_id")).withColumn("c_block", F.spark_partition_id()))
    held = dealt.groupBy("c_block", "c1", "c2").agg(F.max("r1").alias("r1"), F.max("r2").alias("r2")).toArrow()  # no more than cells and blocks
    for b, i, j, r1, r2 in zip(*(c.to_pylist() for c in held.columns), strict=True):
        index.blocks.setdefault((i, j), []).append(b)
        index.radii[0][i], index.radii[1][j] = max(index.radii[0][i], r1), max(index.radii[1][j], r2)
    for blocks in index.blocks.values():
        blocks.sort()
    return dealt.drop("r1", "r2"), index


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = checkpointed(prepared(vectors))
    dim = max(2, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    dealt, index = indexed(rows, dim, block)
    shared = spark.sparkContext.broadcast(index)
    blocks = len({b for held in index.blocks.values() for b in held})
    # An anchor's own number, so that anchors that repeat an id stay apart.
    anchors = checkpointed(rows.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("a", F.monotonically_increasing_id()))
    q_blocks = max(1, -(-anchors.count() // query_block))
    anchors = anchors.select("a", F.pmod(F.xxhash64("a"), F.lit(q_blocks)).cast("int").alias("q_block"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("of"), F.col("v").alias("q"))

    def searched(state, visit, schema: str, order, per: list[str], k: int) -> DataFrame:
        """All rounds of one search. state(found): a, floor and what visit needs; visit(block, anchor): rows after a."""
        kinds = arrow_type(schema)

        def task(key, left, right):
            b = Block(shared.value, right, dim)
            found = [row for x in left.to_pylist() for row in visit(b, x | {"q": padded([x["q"]], dim)[0]})]
            return pa.Table.from_batches([out(kinds, *(list(zip(*found, strict=True)) or [[]] * len(kinds)))])

        @F.pandas_udf("array<int>")
        def reached(q, floor, first, last):
            import pandas as pd

            return pd.Series([wanted_blocks(shared.value, padded([x], dim)[0], f, lo, hi) for x, f, lo, hi in zip(q, floor, first, last, strict=True)])

        found, first, last = spark.createDataFrame([], schema), 0, 1
        while first < blocks:
            now = anchors.join(state(found), "a").withColumn("c_block", F.explode(reached("q", "floor", F.lit(first), F.lit(last))))
            now = checkpointed(now)
            met = now.select((F.col("c_block") + 0).alias("c_block"), (F.col("q_block") + 0).alias("q_block")).distinct()  # one small row a pair of blocks
            copies = dealt.join(met, "c_block").select("c_block", "q_block", "vec_id", "label", "c1", "c2", "v")
            new = now.groupBy("c_block", "q_block").cogroup(copies.groupBy("c_block", "q_block")).applyInArrow(task, schema)
            best = F.row_number().over(Window.partitionBy(*per).orderBy(*order))
            found = checkpointed(found.unionAll(new).withColumn("n", best).where(F.col("n") <= k).drop("n"))
            first, last = last, min(blocks, 5 * last)
        return found

    def best_of(b: Block, x: dict):
        return [(x["a"], v, s) for s, v in b.positives(x["anchor_id"], x["of"], x["q"], x["floor"], positives)]

    def open_anchors(found: DataFrame) -> DataFrame:
        last = found.groupBy("a").agg(F.min("score").cast("double").alias("least"), F.count("*").alias("n"))
        return anchors.select("a").join(last, "a", "left").select("a", F.when(F.col("n") >= positives, F.col("least")).otherwise(float("-inf")).alias("floor"))

    order = [F.desc("score"), "id"]
    near = searched(open_anchors, best_of, "a long, id long, score long", order, ["a"], positives)
    near = near.withColumn("p", F.row_number().over(Window.partitionBy("a").orderBy(*order)))
    near = checkpointed(near.select("a", "p", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    def inside(b: Block, x: dict):
        sides = [(*window(w["s"], low, high), w["least"]) for w in x["windows"]]
        return [(x["a"], w["p"], v, s) for w, best in zip(x["windows"], b.negatives(x["of"], x["q"], sides, negatives), strict=True) for s, v in best]

    def open_windows(found: DataFrame) -> DataFrame:
        last = found.groupBy("a", "p").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        least = F.when(F.col("n") >= negatives, F.col("least")).otherwise(-LONG)
        # A positive of negative score has an empty window.
        mine = near.where("positive_score >= 0").join(last, ["a", "p"], "left").select("a", F.struct("p", F.col("positive_score").alias("s"), least.cast("long").alias("least")).alias("w"))
        floor = F.array_min(F.transform("windows", lambda w: F.greatest(F.ceil(w["s"].cast("double") * (low / 100) - 1), w["least"].cast("double"))))
        return mine.groupBy("a").agg(F.collect_list("w").alias("windows")).withColumn("floor", floor.cast("double"))  # as many as positives

    hard = searched(open_windows, inside, "a long, p int, id long, score long", order, ["a", "p"], negatives)
    named = hard.join(near, ["a", "p"]).join(anchors.select("a", "anchor_id"), "a")
    rank = F.row_number().over(Window.partitionBy("a", "p").orderBy(*order))
    return named.withColumn("rank", rank).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
