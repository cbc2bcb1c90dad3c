"""Exact ranked search of words by balls over sparse document vectors.

A document's vector holds, for each term that some item has, a whole number that grows with the term's count and falls
with the document's length; an item's vector holds the terms' weights. A score is their inner product.

Documents are dealt by their strongest term, so that neighbours are alike, into partitions of bounded size; each task
builds ball trees over its rows: a node has the mean of its vectors and the largest distance from it, and is split by
the nearer of two distant vectors. A node's scores are at most item . mean + |item| radius, rounded upwards; nodes are
visited best first until the bound falls below the item's tenth score, and the documents of a leaf are scored in whole
numbers. Both vectors carry the square root of the weight for the bound, which leaves the product as it is and makes
balls smaller. A first pass over one in FIRST_ONE_IN documents, chosen by a hash, gives each item a tenth score to start from;
the second pass covers all documents.

The test set is dealt by a hash into parts of about PART_WORDS words; a part's vocabulary and items are broadcast. A part
takes one pass over the texts, which keeps counts of the part's terms only.

Defined cases: null texts have no terms; documents without an id rank after all others of their score; rows that repeat
an id or a text rank one by one; items that repeat an id are ranked each on its own, and items without an id under null;
items without a known term give no rows.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_type, checkpointed, out, written

PART_WORDS = 200_000
#: Documents a partition and a leaf hold, and terms of a tree's documents together.
BLOCK, LEAF, TREE_TERMS = 16_384, 64, 4_000_000
FIRST_ONE_IN = 32
FOUND = "item int, doc_id long, score long"
# Terms are runs of ASCII letters and digits and of all other characters beyond ASCII; only A-Z are lower-cased.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TERM_BYTES).split()


@dataclass
class Items:
    """The items of a part: names, and each one's terms as numbers of the part's vocabulary."""

    names: list[int | None]
    known: dict[bytes, int]
    has: list[np.ndarray]


def parts_of(benchmark: DataFrame, most: int) -> Iterator[Items]:
    usable = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // (6 * most)))
    for p in range(n):
        items = Items([], {}, [])
        for r in usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == p).orderBy("item_id", "text").toLocalIterator():
            if words := set(terms(r.text)):
                items.names.append(r.item_id)
                items.has.append(np.sort(np.array([items.known.setdefault(w, len(items.known)) for w in sorted(words)])))
        if items.names:
            yield items


def counted(docs: DataFrame, known) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers of known ones) and tf of each document that has a term."""
    schema = arrow_type("doc_id long, n long").append(pa.field("terms", pa.list_(pa.int32()))).append(pa.field("tf", pa.list_(pa.int64())))

    def task(batches):
        for b in batches:
            rows = []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = terms(text)
                if words:
                    count = Counter(map(known.value.get, words))
                    count.pop(None, None)
                    rows.append((name, len(words), list(count), list(count.values())))
            yield out(schema, *(list(zip(*rows, strict=True)) or [[]] * 4))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, "doc_id long, n long, terms array<int>, tf array<long>")


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for k in df.tolist()], np.int64)


def strengths(tf: np.ndarray, n: int, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - 90 + (90 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """Balls over the rows of a sparse matrix (starts, columns, whole values), with weights for the bound."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, cols: np.ndarray, values: np.ndarray, weight: np.ndarray):
        self.ids, self.n = ids, len(ids)
        self.vocabulary, self.cols = np.unique(cols, return_inverse=True)
        self.starts, self.values = starts, values
        self.root_weight = np.sqrt(weight[self.vocabulary].astype(float))
        self.scaled = values * self.root_weight[self.cols]
        self.squares = self._sums(self.scaled**2, starts)
        self.order = np.arange(self.n)
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        centers, self.radii = [], []
        todo = [(0, self.n, None)]
        while todo:
            low, high, above = todo.pop()
            node, rows = len(self.spans), self.order[low:high]
            if above is not None:
                self.children[above] = (*(self.children[above] or ()), node)
            mean, radius = self._ball(rows)
            centers.append(mean)
            self.radii.append(radius)
            self.spans.append((low, high))
            self.children.append(None)
            if high - low > LEAF:
                side = self._split(rows, mean)
                self.order[low:high] = np.concatenate([rows[side], rows[~side]])
                middle = low + int(side.sum())
                todo += [(low, middle, node), (middle, high, node)]
        self.radii = np.array(self.radii)
        self.center_starts = np.cumsum([0, *(len(c) for c, _ in centers)])[:-1]
        self.center_cols = np.concatenate([c for c, _ in centers])
        self.center_values = np.concatenate([v for _, v in centers])
        self.center_norms = np.sqrt(np.array([v @ v for _, v in centers]))

    @staticmethod
    def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[starts[1:]] - total[starts[:-1]]

    def _cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the values of these rows, and each one's row (from 0)."""
        n = self.starts[rows + 1] - self.starts[rows]
        row = np.repeat(np.arange(len(rows)), n)
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[rows], n), row

    def _distances(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        at, row = self._cells(rows)
        dots = np.bincount(row, self.scaled[at] * dense[self.cols[at]], len(rows))
        return np.maximum(self.squares[rows] + dense @ dense - 2 * dots, 0)

    def _ball(self, rows: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], float]:
        at, _ = self._cells(rows)
        mean = np.bincount(self.cols[at], self.scaled[at], len(self.vocabulary)) / max(1, len(rows))
        # The squares' difference loses digits where a ball is small: allow for them.
        slack = 1e-9 * (self.squares[rows].max(initial=0) + mean @ mean)
        held = np.flatnonzero(mean)
        return (held, mean[held]), float(np.sqrt(self._distances(rows, mean).max(initial=0) + slack))

    def _row(self, i: int) -> np.ndarray:
        dense = np.zeros(len(self.vocabulary))
        at = slice(self.starts[i], self.starts[i + 1])
        dense[self.cols[at]] = self.scaled[at]
        return dense

    def _split(self, rows: np.ndarray, mean) -> np.ndarray:
        """Which rows go left: those nearer to the row farthest from the mean than to the row farthest from that one."""
        dense = np.zeros(len(self.vocabulary))
        dense[mean[0]] = mean[1]
        one = rows[self._distances(rows, dense).argmax()]
        to_one = self._distances(rows, self._row(one))
        side = to_one < self._distances(rows, self._row(rows[to_one.argmax()]))
        if side.all() or not side.any():  # equal vectors
            side = np.arange(len(rows)) < len(rows) // 2
        return side

    def search(self, has: np.ndarray, weight: np.ndarray, best: list, floor: int, k: int) -> None:
        """Puts (score, -id order) of the rows that reach floor into the heap `best` of at most k."""
        place = np.searchsorted(self.vocabulary, has)
        good = place < len(self.vocabulary)
        good[good] = self.vocabulary[place[good]] == has[good]
        place, has = place[good], has[good]
        if not len(place):
            return
        item, whole = np.zeros(len(self.vocabulary)), np.zeros(len(self.vocabulary), np.int64)
        item[place], whole[place] = self.root_weight[place], weight[has]
        length = math.sqrt(item @ item)
        dots = np.add.reduceat(np.append(self.center_values * item[self.center_cols], 0.0), self.center_starts)
        dots[np.diff(np.append(self.center_starts, len(self.center_cols))) == 0] = 0
        reach = length * self.radii
        bounds = (dots + reach + 1e-9 * (length * self.center_norms + reach) + 1e-3).tolist()
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < max(floor, best[0][0] if len(best) == k else 1):
                break
            if self.children[node]:
                for c in self.children[node]:
                    heapq.heappush(heap, (-bounds[c], c))
                continue
            rows = self.order[slice(*self.spans[node])]
            at, row = self._cells(rows)
            values = np.append(whole[self.cols[at]] * self.values[at], 0)
            total = np.concatenate([[0], np.cumsum(values)])
            ends = np.searchsorted(row, np.arange(len(rows) + 1))
            scores = total[ends[1:]] - total[ends[:-1]]
            for i in np.flatnonzero(scores >= max(floor, 1)).tolist():
                entry = (int(scores[i]), -int(self.ids[rows[i]]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


def searched(vectors: DataFrame, shared, k: int) -> DataFrame:
    """item, doc_id, score: each partition's k best rows of every item that reach its floor."""
    schema = arrow_type(FOUND)
    nowhere = 2**63 - 1  # stands for a null id: after all others

    def task(batches):
        items, weight, floors = shared.value
        best: list[list] = [[] for _ in items.names]
        for t in trees(batches, weight, nowhere):
            for heap, has, floor in zip(best, items.has, floors, strict=True):
                t.search(has, weight, heap, floor, k)
        rows = [(i, None if -d == nowhere else -d, s) for i, heap in enumerate(best) for s, d in heap]
        yield out(schema, *(list(zip(*rows, strict=True)) or [[]] * 3))

    return vectors.mapInArrow(task, FOUND)


def trees(batches, weight: np.ndarray, nowhere: int) -> Iterator[Tree]:
    """Trees over runs of rows, each of a bounded number of rows and terms."""
    held, rows, size = [], 0, 0

    def tree() -> Tree:
        t = pa.Table.from_batches(held).combine_chunks()
        n = t.column("n").to_numpy()
        flat = [t.column(c).combine_chunks().flatten().to_numpy() for c in ("terms", "d")]
        return Tree(t.column("doc_id").fill_null(nowhere).to_numpy(), np.concatenate([[0], np.cumsum(n)]), *flat, weight)

    for b in batches:
        if b.num_rows:
            held.append(b)
            rows, size = rows + b.num_rows, size + len(b.column(b.schema.get_field_index("terms")).flatten())
            if rows >= BLOCK or size >= TREE_TERMS:
                yield tree()
                held, rows, size = [], 0, 0
    if held:
        yield tree()


def ranked_part(docs: DataFrame, items: Items, k: int, block: int) -> DataFrame:
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(items.known)
    counts = written(counted(docs, known), "terms")
    n_docs, n_terms = counts.agg(F.count("*"), F.sum("n")).first()
    holders = counts.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()  # no more than the part's terms
    df = np.zeros(len(items.known), np.int64)
    df[holders.column(0).to_numpy()] = holders.column(1).to_numpy()
    weight = weights(n_docs, df)
    schema = arrow_type("doc_id long, lead int, n int").append(pa.field("terms", pa.list_(pa.int32()))).append(pa.field("d", pa.list_(pa.int64())))

    def strong(batches):
        for b in batches:
            rows = []
            for name, n, t, tf in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if t:
                    t, d = np.array(t), strengths(np.array(tf, np.int64), n, n_docs, n_terms)
                    rows.append((name, int(t[(weight[t] * d).argmax()]), len(t), t, d))
            yield out(schema, *(list(zip(*rows, strict=True)) or [[]] * 5))

    made = counts.mapInArrow(strong, "doc_id long, lead int, n int, terms array<int>, d array<long>")
    dealt = made.repartitionByRange(max(1, -(-n_docs // block)), "lead", F.xxhash64("doc_id"))
    # Written once: both passes read it; the first only the rows that a hash picks.
    dealt = checkpointed(dealt)
    best = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    floors = np.zeros(len(items.names), np.int64)
    if n_docs > block:
        # As many documents a task as in the second pass, so that no more rows come back than from so many blocks.
        some = dealt.where(F.pmod(F.xxhash64("doc_id"), F.lit(FIRST_ONE_IN)) == 0).coalesce(max(1, n_docs // (FIRST_ONE_IN * block)))
        first = searched(some, spark.sparkContext.broadcast((items, weight, floors.tolist())), k)
        tenth = first.withColumn("rank", best).where(F.col("rank") == k).select("item", "score").toArrow()  # one number an item
        floors[tenth.column(0).to_numpy()] = tenth.column(1).to_numpy()
    every = searched(dealt, spark.sparkContext.broadcast((items, weight, floors.tolist())), k).withColumn("rank", best).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(items.names)), "item int, item_id long")
    return every.join(names, "item").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, benchmark: DataFrame, k: int = 10, part_words: int = PART_WORDS, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    found = []
    for items in parts_of(benchmark, part_words):
        found.append(written(ranked_part(docs, items, k, block), "ranked"))  # so that a part's broadcasts can go
    return functools.reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
