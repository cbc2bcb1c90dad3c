"""Cumulative-link (proportional odds) regression on sparse text features.

P(grade > k | x) = sigmoid(w.x - theta_k): one weight vector is shared by all thresholds, and the thresholds are
ordered because each is the one before plus a positive step. The expected grade is the sum of the tail probabilities.

Fitting takes a bounded sample of labelled rows (a parameter of the callers) and runs on the driver over the features
that tell the grades apart; all others have no weight. Scoring is a map over partitions: the
slots of each distinct word that have a weight are cached, and a few features of the whole text are added.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cache, checkpointed

#: Features are hashed to so many bits; models keep only the slots that have a weight, so collisions cost nothing.
BITS = 44
_LETTER = re.compile(r"[a-zß-ÿ]+")
_UPPER = re.compile(r"[A-ZÀ-Þ]+")
_DIGIT = re.compile(r"[0-9]+")
EDGE = ".,;:!?\"'()[]{}|*#$%&<>-_=+/\\"


def slot(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature, 11) & ((1 << BITS) - 1)


def word_slots(word: bytes) -> tuple[int, ...]:
    """Hashed features of a word: itself, its beginnings of 4 and 5 letters, and its shape."""
    w = word.decode("utf-8", "replace")
    core = w.lower().strip(EDGE)
    shape = _DIGIT.sub("0", _UPPER.sub("A", _LETTER.sub("a", w)))[:12]
    slots = [slot("s:" + shape)]
    if core:
        slots.append(slot("w:" + core))
        slots += [slot(f"p{n}:{core[:n]}") for n in (4, 5) if len(core) > n]
    return tuple(slots)


def text_slots(raw: bytes, n_words: int, n_distinct: int) -> list[int]:
    """Hashed features of the whole text: length, repetition, capitals, symbols, digits and word length, in steps."""
    step = lambda x: min(9, int(10 * x))
    n = max(1, len(raw))
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    capitals, digits = int(hist[65:91].sum()), int(hist[48:58].sum())
    symbols = int(hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum())
    parts = ("bias:", f"len:{int(math.log2(n_words + 1))}", f"rep:{step(1 - n_distinct / max(1, n_words)) if n_words > 20 else 'short'}", f"cap:{step(capitals / n)}", f"sym:{step(4 * symbols / n)}", f"dig:{step(4 * digits / n)}", f"wl:{min(12, n // max(1, n_words))}", f"nl:{step(20 * int(hist[10]) / n)}")
    return [slot("d:" + p) for p in parts]


def features(text: str | None) -> np.ndarray:
    """Sorted slots of the features that the text has; presence only, so that long texts do not add up noise."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    distinct = set(words)
    slots = [s for w in sorted(distinct) for s in word_slots(w)] + text_slots(raw, len(words), len(distinct))
    return np.unique(np.asarray(slots, np.int64))


@dataclass(frozen=True)
class OrdinalModel:
    weights: dict[int, float]  # by slot; no more than the features of the bounded sample
    thresholds: np.ndarray

    @property
    def grades(self) -> int:
        return len(self.thresholds) + 1

    def tails(self, score: float) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1.0 / (1.0 + np.exp(-np.clip(score - self.thresholds, -500, 500)))


def telling(rows: list[tuple[np.ndarray, int]], least_z: float, most: int, least_rows: int = 5) -> np.ndarray:
    """Sorted slots, `most` at most, whose shares in grade 0 and in the others differ by least_z standard errors."""
    slots, at = np.unique(np.concatenate([s for s, _ in rows]), return_inverse=True)
    above = np.repeat([y > 0 for _, y in rows], [len(s) for s, _ in rows])
    a = np.bincount(at[above], minlength=len(slots))
    b = np.bincount(at[~above], minlength=len(slots))
    na = sum(y > 0 for _, y in rows)
    nb = len(rows) - na
    p = (a + b) / len(rows)
    z = np.abs(a / max(1, na) - b / max(1, nb)) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / max(1, na) + 1 / max(1, nb)))
    good = np.flatnonzero((z >= least_z) & (a + b >= least_rows))
    return np.sort(slots[good[np.lexsort((slots[good], -z[good]))[:most]]])


def fit(rows: list[tuple[np.ndarray, int]], grades: int, ridge: float = 0.05, least_z: float = 4.0, most: int = 512) -> OrdinalModel:
    """Shared weights and ordered thresholds by damped Newton steps on the summed threshold losses; deterministic.

    rows: (slots, grade). Only telling() slots get a weight. The optimum has ordered thresholds: for each one the
    predicted and the true numbers of rows above it agree, and fewer rows lie above a higher one. With no rows, or
    rows of one grade only, there are no weights and the thresholds follow the smoothed shares of the grades.
    """
    k = grades - 1
    y = np.array([g for _, g in rows], np.int64)
    share = [((y > j).sum() + 0.5) / (len(y) + 1.0) for j in range(k)] if rows else [0.05 / (j + 1) for j in range(k)]
    theta = np.maximum.accumulate(np.array([-math.log(p / (1 - p)) for p in share]) + 1e-3 * np.arange(k))
    chosen = telling(rows, least_z, most) if rows and len(set(y.tolist())) > 1 else np.empty(0, np.int64)
    if not len(chosen):
        return OrdinalModel({}, theta)
    m = len(chosen)
    x = np.zeros((len(rows), m))
    for i, (s, _) in enumerate(rows):
        x[i, np.searchsorted(chosen, np.intersect1d(s, chosen, assume_unique=True))] = 1
    above = (y[:, None] > np.arange(k)[None, :]).astype(np.float64)
    v = np.concatenate([np.zeros(m), theta])

    def loss(v_):
        z = (x @ v_[:m])[:, None] - v_[None, m:]
        return float((np.logaddexp(0, z) - above * z).sum() + ridge * (v_[:m] @ v_[:m]) / 2), z

    now, z = loss(v)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        gap, bend = p - above, p * (1 - p)
        slope = np.concatenate([x.T @ gap.sum(1) + ridge * v[:m], -gap.sum(0)])
        h = np.zeros((m + k, m + k))
        h[:m, :m] = (x * bend.sum(1)[:, None]).T @ x + ridge * np.eye(m)
        h[:m, m:] = -(x.T @ bend)
        h[m:, :m] = h[:m, m:].T
        h[m:, m:] = np.diag(bend.sum(0) + 1e-6)
        step, size = np.linalg.solve(h, slope), 1.0
        while (new := loss(v - size * step))[0] > now and size > 1e-6:
            size /= 2
        v, gain, (now, z) = v - size * step, now - new[0], new
        if gain < 1e-6 * max(1.0, now):
            break
    return OrdinalModel({int(s): float(w) for s, w in zip(chosen, v[:m], strict=True)}, np.maximum.accumulate(v[m:]) + 1e-9 * np.arange(k))


def scorer(model: OrdinalModel):
    """A function from text to the linear score w.x, with a bounded cache of word weights."""
    weights = model.weights
    weighted = set(weights)
    cache = Cache(lambda w: tuple(s for s in word_slots(w) if s in weighted))

    def score(text: str | None) -> float:
        raw = (text or "").encode("utf-8", "replace")
        words = raw.split()
        distinct = set(words)
        slots = set(chain.from_iterable(map(cache.__getitem__, distinct))) | weighted.intersection(text_slots(raw, len(words), len(distinct)))
        return sum(weights[s] for s in sorted(slots))

    return score


def predicted(model: OrdinalModel, text: str, shared) -> Column:
    """struct(expected, tails) of the text column; shared is the broadcast model."""
    score = None

    @F.pandas_udf("expected double, tails array<double>")
    def rate(texts):
        import pandas as pd

        nonlocal score
        if score is None:
            score = scorer(shared.value)
        tails = [shared.value.tails(score(t)) for t in texts]
        return pd.DataFrame({"expected": [float(t.sum()) for t in tails], "tails": [t.tolist() for t in tails]})

    return rate(text)


def sample_rows(docs: DataFrame, graded: DataFrame, grades: int, most: int) -> tuple[DataFrame, list[tuple[np.ndarray, int]]]:
    """The chosen labels (doc_id, grade), and features and grades of their documents.

    graded: doc_id, grade from 0 to grades - 1. At most `most` labelled documents of each grade are taken, the first by
    a hash of the id, so that the sample may be broadcast and collected. Of rows that repeat an id one is taken, that
    of the text with the least hash.
    """
    once = graded.where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    parts = [once.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for g in range(grades)]
    chosen = checkpointed(reduce(DataFrame.unionAll, parts).select("doc_id", F.col("grade").cast("int").alias("grade")))

    @F.pandas_udf("array<long>")
    def slots(texts):
        return texts.map(features)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", F.xxhash64("text").alias("h"), slots("text").alias("slots"))
    found = rows.groupBy("doc_id", "grade").agg(F.min_by("slots", "h").alias("slots")).orderBy("doc_id").select("grade", "slots").toArrow().combine_chunks()
    if not found.num_rows:
        return chosen, []
    lists = found.column("slots").chunk(0)
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    return chosen, [(flat[ends[i] : ends[i + 1]], int(g)) for i, g in enumerate(found.column("grade").to_pylist())]
