"""Quality grades by cumulative-link ordinal regression on graded ratings.

Rating of a labelled document: 0 for quality 0; 1 for quality 1 with the toxic flag; 2 for quality 1 without it.
The expected grade (0 to 2) and the tail probability P(grade >= 1) come from hashed-text weights shared by both
thresholds; keep selects by the tail. The fit takes at most MOST_LABELLED documents of each rating.

Defined cases: a null text counts as empty; label rows with a null id or quality are not used (a null toxic flag
counts as 0); of labels that repeat an id the smallest rating counts, of documents that repeat it the text with the least
hash is learned from; without labels, or with one rating only, the weights are zero and the tail follows the ratings' smoothed shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordinal

MOST_LABELLED = 2000
GRADES = 3


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> ordinal.OrdinalModel:
    rating = F.when(F.col("quality") <= 0, 0).when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2)
    graded = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(rating).alias("grade"))
    _, rows = ordinal.sample_rows(docs, graded, GRADES, most)
    return ordinal.fit(rows, GRADES)


def grade(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, expected_grade, tail_probability P(grade >= 1), and keep (tail of at least the threshold)."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rated = docs.select("doc_id", ordinal.predicted(model, "text", shared).alias("q"))
    tail = F.col("q.tails")[0]
    return rated.select("doc_id", F.col("q.expected").alias("expected_grade"), tail.alias("tail_probability"), (tail >= threshold).alias("keep"))
