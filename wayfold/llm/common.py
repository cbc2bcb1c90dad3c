"""Helpers shared by the corpus operators: table access, shared storage, word splitting and bounded caches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import checkpointed, written  # noqa: F401

#: Words of a text are runs of characters other than these bytes (bytes.split() cuts at the same six).
ASCII_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(df: DataFrame, size: int, each: int) -> int:
    """How many partitions hold `size` things at `each` a partition; no fewer than the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def looked_up(rows: DataFrame, key: str, table: DataFrame, hot_one_in: int = 10_000) -> DataFrame:
    """rows joined (left) with table, which has each key once; keys that many rows share are joined without a shuffle.

    A key is frequent if over one in hot_one_in rows has it: there are fewer than hot_one_in such keys, whatever the
    size of rows, so their part of the table is broadcast. All other keys meet in a shuffle, where none is large.
    rows is read three times and should be checkpointed or cheap.
    """
    count = rows.groupBy(key).agg(F.count("*").alias("__wf_n"))
    n = rows.count()
    hot = checkpointed(count.where((F.col("__wf_n") * hot_one_in > n) & (F.col("__wf_n") > 1)).select(F.col(key).alias("__wf_hot")))
    mark = rows.join(F.broadcast(hot), F.col(key) == F.col("__wf_hot"), "left")
    few = F.broadcast(table.join(F.broadcast(hot), F.col(key) == F.col("__wf_hot"), "left_semi"))
    often = mark.where("__wf_hot is not null").drop("__wf_hot").join(few, key, "left")
    return mark.where("__wf_hot is null").drop("__wf_hot").join(table, key, "left").unionByName(often)


def with_row_key(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id and text (null: empty) with _k, equal only for rows of the same id and text.

    Joining back on (doc_id, _k) keeps repeated rows and rows that share an id but not a text apart.
    """
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *also).withColumn("_k", F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-(2**62))), "text"))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as make it differ from all columns of df (which Spark compares in lower case)."""
    taken, found = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        found.append(n)
    return found


class Cache(dict):
    """A dict that fills itself by a function and starts anew when it holds too many entries."""

    def __init__(self, make, most: int = 300_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def word_hashes(seed: int = 0, most: int = 400_000) -> Cache:
    """64-bit fingerprints of words given as bytes."""
    return Cache(lambda w: xxhash.xxh64_intdigest(w, seed), most)


def arrow_type(schema: str):
    """pyarrow schema for a list like 'doc_id long, n int'."""
    names = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(n, names[t]) for n, t in (x.split() for x in schema.split(","))])


def out(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def slabs(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.Table]:
    """Batches gathered until their column holds most_bytes, so that work inside a slab sees many rows at a bounded size."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.column(b.schema.get_field_index(column)).nbytes
            if size >= most_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
