"""Exact top-k by inner product over norm-sorted vectors.

Vectors are range-partitioned by descending length into blocks; queries are dealt to blocks by a hash. All vectors are rotated by the
right singular vectors of a bounded sample, so that the first coordinates carry most of an inner product. Blocks are
visited in rounds from the longest vectors on, each round four times as many blocks as all before it. After a round every query knows its k-th
best score so far; by Cauchy-Schwarz only blocks whose longest vector times the query's length reaches it are left, and
a query and a block are brought together only if they are. Inside a block, vectors past that bound are skipped, partial
sums over the first coordinates plus the product of the residual lengths drop most others, and the rest are multiplied out.

Components x become floor(256 x). Products are exact: in doubles while they stay below 2**53; of larger ones, those that
may be among the k best by their error bound are computed again in Python integers.

Defined cases: vectors that are null or hold a null, NaN or infinite component take no part, nor do rows without an
id; shorter vectors count as padded with zeros; rows that repeat an id are candidates each; a query's own id is never
its candidate; scores beyond 64 bits are reported at the end of the range, and ranked among themselves as doubles where they come from different blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_type, checkpointed, out

SCALE = 256.0
BLOCK = 8192
QUERY_BLOCK = 4096
SAMPLE = 10_000
HEAD = 16
LONG = 2**63
FOUND = "query_id long, vec_id long, score long, beyond double"


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, v (floor(256 x) as doubles), norm."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    # floor() of a huge double gives a long; beyond its range the double is whole already.
    v = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) < 2.0**52, F.floor(x.cast("double") * SCALE).cast("double")).otherwise(x.cast("double") * SCALE))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return kept.select(F.col("vec_id").cast("long"), v.alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def rotation(vecs: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of at most SAMPLE vectors; any orthogonal matrix gives the same results, only slower."""
    sample = vecs.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(SAMPLE).toArrow().column("v").to_pylist()
    m = matrix(sample, dim)
    return np.linalg.eigh(m.T @ m)[1][:, ::-1] if len(m) and np.isfinite(m).all() and np.abs(m).max(initial=0) < 1e100 else np.eye(dim)


def matrix(rows: list, dim: int) -> np.ndarray:
    m = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        m[i, : len(r)] = r
    return m


def exact(q: np.ndarray, c: np.ndarray) -> int:
    return sum(int(a) * int(b) for a, b in zip(q, c, strict=True))


def best(queries, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, c: np.ndarray, turn: np.ndarray, k: int) -> list[tuple]:
    """(query, id, score, beyond) of each query's k best candidates of a block, those that reach floor; ties to smaller ids.

    beyond: 0, or the score as a double where it does not fit 64 bits.
    """
    rows = []
    with np.errstate(over="ignore", invalid="ignore"):
        q_norm, c_norm = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
        order = np.lexsort((ids, -c_norm))
        ids, c, c_norm = ids[order], c[order], c_norm[order]
        qr, cr = q @ turn, c @ turn
        rest_q, rest_c = np.sqrt((qr[:, HEAD:] ** 2).sum(1)), np.sqrt((cr[:, HEAD:] ** 2).sum(1))
        for i, name in enumerate(queries):
            limit, reach = floor[i], q_norm[i] * c_norm
            slack = 1e-6 * (1 + reach)
            bound = cr[:, :HEAD] @ qr[i, :HEAD] + rest_q[i] * rest_c + slack
            bound[~np.isfinite(bound)] = np.inf
            if limit == -np.inf and len(c) > k + 1:  # a first k-th score from the most promising vectors
                likely = np.argpartition(-bound, k)[: k + 1]
                likely = likely[(ids[likely] != name) & (reach[likely] < 2.0**52)]
                if len(likely) >= k:
                    limit = np.sort(c[likely] @ q[i])[-k]
            at = np.flatnonzero((reach + slack >= limit) & (bound >= limit) & (ids != name))
            score = c[at] @ q[i]
            # Sums below 2**52 are exact in doubles, others are off by a few units in the last place of the lengths' product.
            error = np.where(reach[at] < 2.0**52, 0.0, 1e-12 * reach[at])
            score[~np.isfinite(score)], error[~np.isfinite(error)] = 0.0, np.inf
            if len(at) > k:
                low = np.partition(score - error, len(at) - k)[len(at) - k]
                at, score, error = (x[score + error >= low] for x in (at, score, error))
            whole = [int(s) if not e else exact(q[i], c[j]) for j, s, e in zip(at, score, error, strict=True)]
            for s, v in sorted(zip([-s for s in whole], ids[at].tolist(), strict=True))[:k]:
                if -s >= limit:
                    rows.append((name, v, max(-LONG, min(LONG - 1, -s)), 0.0 if -LONG <= -s < LONG else float(max(-(10**300), min(10**300, -s)))))
    return rows


def reaching(shared):
    """A function from a query's length and floor to how many of the (falling) block tops reach the floor."""

    @F.pandas_udf("int")
    def count(q_norm, floor):
        import pandas as pd

        with np.errstate(divide="ignore", invalid="ignore"):
            least = (floor.to_numpy() - 1e-6) / (q_norm.to_numpy() * (1 + 1e-6))
        least = np.where(np.isnan(least), -np.inf, least)
        return pd.Series(np.searchsorted(-shared.value, -least, side="right").astype(np.int32))

    return count


def blocked(vecs: DataFrame, n: int) -> DataFrame:
    """vecs with c_block: the number of a block, by descending length; ties are broken by a hash, so that one frequent length cannot fill a block."""
    return checkpointed(vecs.repartitionByRange(n, F.col("norm").desc(), F.xxhash64("vec_id")).withColumn("c_block", F.spark_partition_id()))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    vecs = checkpointed(prepared(vectors))
    n, dim = vecs.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dim = max(dim, 1)
    schema = arrow_type(FOUND)
    turn = spark.sparkContext.broadcast(rotation(vecs, dim))  # dim x dim
    dealt = blocked(vecs, max(1, -(-n // block)))
    asked = vecs.where(F.pmod("vec_id", F.lit(every)) == 0)
    q_blocks = max(1, -(-asked.count() // query_block))
    queries = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("q_block"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("norm").alias("q_norm"))
    # The longest vector of each block: one number for `block` vectors, in one array for the driver and the tasks.
    longest = dealt.groupBy("c_block").agg(F.max("norm").alias("norm")).toArrow()
    blocks = max(longest.column(0).to_pylist(), default=0) + 1  # a session may deal more blocks than were asked for
    tops = np.zeros(blocks)
    tops[longest.column(0).to_numpy()] = longest.column(1).to_numpy()
    tops = np.maximum.accumulate(tops[::-1])[::-1]  # a block without rows is no longer than the next

    def visit(key, left, right):
        names = left.column("query_id").to_pylist()
        rows = best(names, matrix(left.column("q").to_pylist(), dim), np.asarray(left.column("floor").to_pylist(), float), right.column("vec_id").to_numpy(), matrix(right.column("v").to_pylist(), dim), turn.value, k)
        return pa.Table.from_batches([out(schema, *(list(zip(*rows, strict=True)) or [[]] * 4))])

    order = Window.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("score"), "vec_id")
    found, low, high = spark.createDataFrame([], FOUND), 0, 1
    while low < blocks:
        floors = found.groupBy("query_id").agg(F.min(F.when(F.col("beyond") == 0, F.col("score").cast("double")).otherwise(F.col("beyond"))).alias("least"), F.count("*").alias("n")).where(F.col("n") >= k)
        now = queries.join(floors, "query_id", "left").withColumn("floor", F.coalesce("least", F.lit(float("-inf"))))
        # Blocks of this round whose bound reaches the query's floor; lengths fall, so they are the first ones.
        now = now.withColumn("left", reaching(spark.sparkContext.broadcast(tops[low:high].copy()))("q_norm", "floor")).where(F.col("left") > 0)
        now = checkpointed(now.select("q_block", "query_id", "q", "floor", F.explode(F.sequence(F.lit(low), F.col("left") + F.lit(low - 1))).alias("c_block")))
        met = now.select((F.col("c_block") + 0).alias("c_block"), (F.col("q_block") + 0).alias("q_block")).distinct()  # one small row a pair of blocks
        copies = dealt.join(met, "c_block").select("c_block", "q_block", "vec_id", "v")
        new = now.groupBy("c_block", "q_block").cogroup(copies.groupBy("c_block", "q_block")).applyInArrow(visit, FOUND)
        found = checkpointed(found.unionAll(new).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))
        low, high = high, min(blocks, 5 * high)
    return found.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")
