"""The folder that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only in a local session without that setting.

    A cluster without the setting is an error: its executors would not see the driver's temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(rows: DataFrame, each: int = 100_000) -> int:
    """How many partitions rows are worth: one for `each` rows, no fewer than the session's number. Counting a Parquet table reads footers only."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))


def spread(rows: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """rows dealt by keys over n partitions (by default tasks_for()): files of few row groups are read by few tasks, whose work would grow with the table."""
    return rows.repartition(n or tasks_for(rows), *keys)


def checkpointed(df: DataFrame) -> DataFrame:
    """df after a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
