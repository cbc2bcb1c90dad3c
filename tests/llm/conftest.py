import pytest


@pytest.fixture
def docs_of(spark):
    """documents from (doc_id, text) pairs, with an extra column whose name clashes with working columns."""

    def make(rows, schema="doc_id long, text string"):
        from pyspark.sql import functions as F

        return spark.createDataFrame(rows, schema).withColumn("score", F.lit("x")).withColumn("start", F.lit(1))

    return make
