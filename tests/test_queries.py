import pytest

from tests.oracle import DATA, rows_of, sql_rows
from wayfold.plans import checks, properties, queries, results, themes

QUERIES, ORACLE_SQL = queries.QUERIES | properties.QUERIES | results.QUERIES | checks.QUERIES | themes.QUERIES, queries.ORACLE_SQL | properties.ORACLE_SQL | results.ORACLE_SQL | checks.ORACLE_SQL | themes.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    d = f"{DATA}/sf0.001"
    got, want = rows_of(QUERIES[name](spark, d)), sql_rows(ORACLE_SQL[name], d)
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
