"""Columns that are computed once however often they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns, each computed once a row.

    A filter on a column made by withColumn() is moved below it and repeats the column's expression at each use, and so on
    through all columns that it is made of; it is not moved below the one-row generator that gives these.
    """
    made = F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items()))))
    return rows.select("*", made)


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often use repeats it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
