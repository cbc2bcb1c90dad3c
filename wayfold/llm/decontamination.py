"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of characters other than white space and punctuation, in lower case; those that no item holds are all one. The seeds of a test item are its rarest pairs of
neighbouring words, counted over all documents; a document holds a seed if the two words stand in it side by side or
with one word between them. An alignment of n words that reaches the least score breaks at most 4/3 (1 - least) n of the
item's pairs (a changed or missing word costs 1.5 and breaks two, a missing end costs 1 and breaks one, two words put
in between cost 1 and break one). An item has SEED_HITS seeds more than that where it has so many pairs: every document
whose alignment reaches the least score holds at least so many of them, however often any pair occurs, and documents
that hold fewer are left out at once.

Hits on nearby diagonals name one passage, which is aligned with the whole item by Smith-Waterman over words, in a window
that holds every alignment through these hits that can reach the least score. Windows with too few of the item's words
for that score are left out first, which loses nothing. The score is the alignment's value over the item's length: 1 for
a copy. An alignment counts only if it is worth more than one matching word, whatever the item's length.

Items of fewer than SHORT_WORDS words have too few pairs for that bound, so their seeds are single words: an alignment that
reaches the least score matches at least that share of the item's words, and two at least, so every such document holds one of
the rarest words that are left when one less is taken away.

The test set is dealt by a hash into parts of about PART_WORDS words. One part at a time is on the driver and in a
broadcast; with several parts, each one's rows are written before the next is read. A part takes two passes over the
documents (the counts and the search), which are maps; only counts are shuffled.

Defined cases: null texts count as empty; items without an id or with fewer than two words take no part; rows
that repeat a document or an item are each compared; of equal passages of a document the first is reported; n_seeds
counts the places of the reported passage that hold a seed of the item.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, out, written

SHORT_WORDS = 5
SEED_HITS = 3
PART_WORDS = 1_000_000
CHUNK_CHARS = 2 << 20
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
LEAST_SCORE = 0.5
PUNCTUATION = b".,;:!?\"'()[]{}|*#$%&<>-_=+/\\"
RESULT = "doc_id long, item_id long, score double, start_word long, end_word long, n_seeds long"

_SPACED = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))
_BASE = np.uint64(0x9E3779B97F4A7C15)


#: What stands for a word that no item holds; ids of items' words are odd.
OTHER = 2


def word_id(core: bytes) -> int:
    return xxhash.xxh64_intdigest(core, 5) | 1


def split(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACED).split()


def word_ids(texts: list[str | None], known: dict[bytes, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of all texts, one text after another, and the number of the text that each belongs to; words that are not known are OTHER (without `known`, all are)."""
    pieces = [split(t) for t in texts]
    if known is None:
        known = {w: word_id(w) for p in pieces for w in p}
    n = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ids = np.fromiter(map(known.get, chain.from_iterable(pieces), repeat(OTHER)), np.uint64, int(n.sum()))
    return ids, np.repeat(np.arange(len(pieces)), n)


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Texts in runs of about CHUNK_CHARS characters, each with the number of its first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_CHARS:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def pairs(ids: np.ndarray, gap: int = 1) -> np.ndarray:
    """A 64-bit hash of each word with the one `gap` places later; of the word alone for gap 0."""
    with np.errstate(over="ignore"):
        h = (ids[: len(ids) - gap] * _BASE + ids[gap:] if gap else ids) * _BASE
    return h ^ (h >> np.uint64(31))


def gaps_of(items: list[Item]) -> tuple[int, ...]:
    """The gaps at which texts are looked up: none for words alone, one or two for pairs."""
    return (0,) * any(not x.gap for x in items) + (1, 2) * any(x.gap for x in items)


class Lookup:
    """Sorted distinct hashes with a bitmap that turns most lookups away."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.shift = np.uint64(64 - max(16, len(self.keys).bit_length() + 5))
        self.bitmap = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bitmap[(self.keys >> self.shift).astype(np.int64)] = True

    def rows(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that hold a key, and each one's row."""
        at = np.flatnonzero(self.bitmap[(h >> self.shift).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        row = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        good = self.keys[row] == h[at]
        return at[good], row[good]


@dataclass
class Item:
    name: int
    ids: np.ndarray
    least: float

    def __post_init__(self):
        n = len(self.ids)
        #: 1 if seeds are pairs of words, 0 if they are words.
        self.gap = int(n >= SHORT_WORDS)
        #: Words that every alignment with the least score matches.
        self.matched = max(2, math.ceil(self.least * n - 1e-9))
        self.most_broken = math.floor(4 / 3 * (MATCH - self.least) * n + 1e-9) if self.gap else n - self.matched
        #: Seeds of the item that every passage with the least score holds.
        self.sure = max(1, min(SEED_HITS, n - 1 - self.most_broken)) if self.gap else 1
        self.words = Counter(self.ids.tolist())

    def seeds(self) -> np.ndarray:
        return pairs(self.ids, self.gap)


@dataclass
class Seeds:
    """Items, and for each seed (a row of the lookup) the (item, offset) pairs that have it."""

    items: list[Item]
    words: dict[bytes, int]
    lookup: Lookup
    holders: list[list[tuple[int, int]]]
    gaps: tuple[int, ...] = (1, 2)

    @staticmethod
    def of(items: list[Item], words: dict[bytes, int], counts: dict[int, int]) -> Seeds:
        """The rarest pairs of each item by counts (by hash), as many as the least score asks for; ties to the first."""
        chosen: dict[int, list[tuple[int, int]]] = {}
        for i, item in enumerate(items):
            h = item.seeds().tolist()
            for at in sorted(range(len(h)), key=lambda k: (counts.get(h[k], 0), k))[: item.most_broken + item.sure]:
                chosen.setdefault(h[at], []).append((i, at))
        lookup = Lookup(np.array(list(chosen), np.uint64))
        return Seeds(items, words, lookup, [chosen[k] for k in lookup.keys.tolist()], gaps_of(items))


def align(a: np.ndarray, b: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of b with a: its value and the part of a that it covers (start, end).

    Row by row; a gap along a row is a running maximum of the row tilted by the gap cost. Starts are carried along.
    """
    n = len(a)
    tilt = -GAP * np.arange(n + 1)
    above, above_start = np.zeros(n + 1), np.arange(n + 1)
    top, span = 0.0, (0, 0)
    for w in b:
        row, start = np.zeros(n + 1), np.arange(n + 1)
        diagonal = above[:-1] + np.where(a == w, MATCH, MISMATCH)
        down = above[1:] + GAP
        use = diagonal >= down
        value, origin = np.where(use, diagonal, down), np.where(use, above_start[:-1], above_start[1:])
        alive = value > 0
        row[1:][alive], start[1:][alive] = value[alive], origin[alive]
        lifted = row + tilt
        run = np.maximum.accumulate(lifted)
        came = np.maximum.accumulate(np.where(lifted >= run, np.arange(n + 1), 0))
        row, start = run - tilt, start[came]
        end = int(row.argmax())
        if row[end] > top:
            top, span = float(row[end]), (int(start[end]), end)
        above, above_start = row, start
    return top, *span


def best_passage(ids: np.ndarray, item: Item, hits: list[tuple[int, int]]) -> tuple[float, int, int, int] | None:
    """(score, start, end, seeds in it) of the best passage of a document through hits (diagonal, place) of an item.

    Passages that hold too few of the item's words for its least score are left out.
    """
    n = len(item.ids)
    near = n // 2 + 2
    # The most words that an alignment with the least score can leave out or add.
    pad = max(near, math.ceil((MATCH - item.least) * n / -GAP))
    best, reach = None, None
    hits.sort()
    groups: list[list[tuple[int, int]]] = []
    for d, p in hits:
        if groups and d - groups[-1][0][0] <= near:
            groups[-1].append((d, p))
        else:
            groups.append([(d, p)])
    for g in groups:
        first = g[0][0]
        if first >= 0 and len(ids) >= first + n and (ids[first : first + n] == item.ids).all():
            value, start, end = float(n), first, first + n
        else:
            low = max(0, first - pad)
            window = ids[low : g[-1][0] + n + pad]
            there = Counter(window.tolist())
            if sum(min(k, there[w]) for w, k in item.words.items()) < item.matched:
                continue
            value, s, e = align(window, item.ids)
            start, end = low + s, low + e
        if best is None or value > best:
            best, reach = value, (start, end)
    if best is None or best < item.least * MATCH * n or best <= MATCH:
        return None
    return best / (MATCH * n), *reach, len({p for _, p in hits if reach[0] <= p < reach[1] - item.gap})


def scan(texts: list[str | None], seeds: Seeds) -> Iterator[tuple[int, int, float, int, int, int]]:
    """(text number, item number, score, start, end, seeds in it) of each text and item that reach the item's least score."""
    for first, some in chunks(texts):
        ids, text = word_ids(some, seeds.words)
        place, row = [], []
        for gap in seeds.gaps:
            at, r = seeds.lookup.rows(pairs(ids, gap))
            inside = text[at] == text[at + gap]
            place.append(at[inside])
            row.append(r[inside])
        place, row = np.concatenate(place), np.concatenate(row)
        order = np.argsort(place, kind="stable")
        starts = np.searchsorted(text, np.arange(len(some) + 1))
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for p, r in zip(place[order].tolist(), row[order].tolist(), strict=True):
            t = int(text[p])
            p -= int(starts[t])
            for i, offset in seeds.holders[r]:
                found.setdefault(t, {}).setdefault(i, []).append((p - offset, p))
        for t, by_item in found.items():
            for i, hits in by_item.items():
                if len({p - d for d, p in hits}) < seeds.items[i].sure:
                    continue
                best = best_passage(ids[starts[t] : starts[t + 1]], seeds.items[i], hits)
                if best:
                    yield first + t, i, *best


def document_counts(docs: DataFrame, words: dict[bytes, int], keys: np.ndarray, gaps: tuple[int, ...] = (1,)) -> dict[int, int]:
    """How many rows of docs hold each of the word pairs (gap 1) or words (gap 0) with these hashes; those that none holds are left out."""
    shared = docs.sparkSession.sparkContext.broadcast((words, Lookup(keys)))
    schema = arrow_type("key long, n long")

    def task(batches):
        known, lookup = shared.value
        total = np.zeros(len(lookup.keys), np.int64)
        for b in batches:
            for _, some in chunks(b.column(0).to_pylist()):
                ids, text = word_ids(some, known)
                for gap in gaps:
                    at, row = lookup.rows(pairs(ids, gap))
                    inside = text[at] == text[at + gap]
                    held = np.unique(text[at[inside]] * len(total) + row[inside])
                    total += np.bincount(held % max(1, len(total)), minlength=len(total))
        some = np.flatnonzero(total)
        yield out(schema, lookup.keys[some].view(np.int64), total[some])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(task, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    return dict(zip(rows.column(0).to_numpy().view(np.uint64).tolist(), rows.column(1).to_pylist(), strict=True))


def parts_of(docs: DataFrame, benchmark: DataFrame, least: float) -> Iterator[Seeds]:
    """The seeds of one part of the test set after another."""
    usable = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = usable.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = max(1, -(-words // PART_WORDS))
    for p in range(n):
        items, known = [], {}
        for r in usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == p).orderBy("item_id", "text").toLocalIterator():
            ids = word_ids([r.text])[0]
            if len(ids) > 1:
                known |= {w: word_id(w) for w in split(r.text)}
                items.append(Item(r.item_id, ids, least))
        if items:
            yield Seeds.of(items, known, document_counts(docs, known, np.concatenate([x.seeds() for x in items]), tuple(g for g in gaps_of(items) if g < 2)))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """One row for each document and item whose alignment scores `least` or more."""
    schema = arrow_type(RESULT)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def finder(shared):
        def task(batches):
            for b in batches:
                names = b.column(0).to_pylist()
                found = [(names[t], shared.value.items[i].name, *rest) for t, i, *rest in scan(b.column(1).to_pylist(), shared.value)]
                yield out(schema, *(list(zip(*found, strict=True)) or [[]] * 6))

        return task

    found, shared = [], None
    for seeds in parts_of(docs, benchmark, least):
        if found:  # rows of an earlier part are written, so that its broadcast can go
            found[-1] = written(found[-1], "leaks")
            shared.unpersist()
        shared = docs.sparkSession.sparkContext.broadcast(seeds)
        found.append(rows.mapInArrow(finder(shared), RESULT))
    return functools.reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], RESULT)


def leaking(shared, text: str) -> Column:
    """Whether a text holds an item of the broadcast seeds."""

    @F.pandas_udf("boolean")
    def holds(texts):
        import pandas as pd

        found = np.zeros(len(texts), bool)
        found[[t for t, *_ in scan(texts.tolist(), shared.value)]] = True
        return pd.Series(found)

    return holds(text)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """docs without the rows that hold a copy of a test item; a map, columns as they were.

    Each part of the test set is searched in what the parts before it have left, written where there are several.
    """
    before = None
    for seeds in parts_of(docs, benchmark, least):
        if before is not None:
            docs = written(docs, "unleaked")
            before.unpersist()
        before = docs.sparkSession.sparkContext.broadcast(seeds)
        docs = docs.where(~leaking(before, "text"))
    return docs
