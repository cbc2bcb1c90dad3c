"""Toxicity severity by cumulative-link ordinal regression.

Grades: 0 for rows labelled not toxic. The labels hold no severity, so toxic rows get 1, 2 or 3 by terciles of how
many of their words, repeats included, hold a feature at least MARKER_ODDS times likelier in toxic rows. The model reads
which features are present and never how often, so it has to learn the grade from other evidence than the grader's.
The fit takes at most MOST_LABELLED documents of each label; scoring covers every document.

Defined cases: a null text counts as empty; label rows with a null id or label are not used; of labels that repeat an
id the larger toxic label counts, of documents that repeat it the text with the least hash is learned from; of equal
counts at a tercile all get the lower grade; an empty labels table gives zero weights, so nothing is toxic.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordinal
from .common import Cache, free

MOST_LABELLED = 2000
MARKER_ODDS = 8.0
GRADES = 4


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> ordinal.OrdinalModel:
    """The severity model from labelled documents (doc_id, toxic 0/1)."""
    graded = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("grade"))
    chosen, rows = ordinal.sample_rows(docs, graded, 2, most)
    toxic = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen.where("grade = 1").select("doc_id")), "doc_id")
    return ordinal.fit(severities(rows, marked_words(toxic, markers(rows))), GRADES, least_z=5.0)


def markers(rows: list) -> np.ndarray:
    """Sorted slots that are MARKER_ODDS times likelier in toxic rows than in others."""
    if not rows:
        return np.empty(0, np.int64)
    names, at = np.unique(np.concatenate([s for s, _ in rows]), return_inverse=True)
    y = np.repeat([bool(g) for _, g in rows], [len(s) for s, _ in rows])
    toxic, clean = np.bincount(at[y], minlength=len(names)), np.bincount(at[~y], minlength=len(names))
    n_toxic = sum(g > 0 for _, g in rows)
    odds = ((toxic + 0.5) / (n_toxic + 1)) / ((clean + 0.5) / (len(rows) - n_toxic + 1))
    return names[(odds >= MARKER_ODDS) & (toxic >= 5)]


def marked_words(toxic: DataFrame, marker: np.ndarray) -> list[float]:
    """Of each toxic document of the sample, by doc_id: how many of its words, repeats included, have a marker."""
    shared = toxic.sparkSession.sparkContext.broadcast(set(marker.tolist()))

    @F.pandas_udf("double")
    def marked(texts):
        has = Cache(lambda w: not shared.value.isdisjoint(ordinal.word_slots(w)))
        return texts.map(lambda t: float(sum(map(has.__getitem__, t.encode("utf-8", "replace").split()))))

    rows = toxic.select("doc_id", F.xxhash64("text").alias("h"), marked("text").alias("n")).groupBy("doc_id").agg(F.min_by("n", "h").alias("n"))
    return [r.n for r in rows.orderBy("doc_id").collect()]


def severities(rows: list, counts: list[float]) -> list:
    """The rows with their 0/1 label turned into grades 0 to 3; counts are those of the toxic rows, in the same order."""
    low, high = np.quantile(counts, [1 / 3, 2 / 3]) if counts else (0.0, 0.0)
    n = iter(counts)
    return [(slots, 1 + int((x := next(n)) > low) + int(x > high) if y else 0) for slots, y in rows]


def score(docs: DataFrame, model: ordinal.OrdinalModel, as_: str = "toxicity") -> DataFrame:
    """docs with a column struct(expected, tails): expected severity 0 to 3, P(severity >= 1, 2, 3)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(as_, ordinal.predicted(model, "text", shared))


def rate(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, expected_severity, p_toxic (severity of 1 or more) and is_toxic (p_toxic over the threshold)."""
    rated = score(docs.select("doc_id", "text"), train(docs, labels))
    p = F.col("toxicity.tails")[0]
    return rated.select("doc_id", F.col("toxicity.expected").alias("expected_severity"), p.alias("p_toxic"), (p > threshold).alias("is_toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows rated toxic; columns as they were."""
    (name,) = free(docs, "__wf_toxicity")
    rated = score(docs, train(docs, labels), name)
    return rated.where(F.col(name)["tails"][0] <= threshold).drop(name)
