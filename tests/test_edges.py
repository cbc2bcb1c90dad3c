"""Queries on rare values that the given tables lack, and steps that must be computed once and by many tasks."""

import duckdb

from tests.oracle import DATA, rows_of, sql_rows
from wayfold.plans import checks, properties, queries, results
from wayfold.sources.storage import tasks_for

D = f"{DATA}/sf0.001"


def test_feature_types_of_balances_below_one(spark, tmp_path):
    """A whole balance of 0, times ten, is the number 0; 00 is no JSON."""
    duckdb.sql(f"COPY (SELECT 3 + 15 * i AS c_custkey, 0.5::DOUBLE - i // 4 AS c_acctbal FROM range(8) t(i)) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    assert rows_of(checks.j14_feature_types(spark, str(tmp_path))) == sql_rows(checks.ORACLE_SQL["j14_feature_types"], tmp_path)


def plan_of(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_places_of_candidates_are_computed_once(spark):
    """F2 to F9: a filter on the distance does not repeat what the distance is made of."""
    assert plan_of(results.o01_predictions(spark, D)).count("ASIN") == 1


def test_points_at_a_share_are_computed_once(spark):
    assert plan_of(properties.f35_point_at(spark, D)).count("ASIN") == 1


def test_features_are_read_once(spark):
    """The text is parsed for the parts and for the line (a point or a line), whatever filters follow."""
    assert plan_of(properties.s06_geojson_decode(spark, D)).count("$.coordinates") <= 4


def test_flat_buffers_are_computed_once(spark):
    met = plan_of(results.j02_flat_buffer(spark, D))
    assert met.count("SQRT(") < 40


def test_rows_are_dealt_by_number(spark):
    """What is computed from a small file of one row group is the work of all tasks; rules and facts by segment."""
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks_for(spark.range(1_000_001)) == 11
    assert tasks_for(spark.range(10)) == wanted
    for rows in (queries._segments(spark, D), queries._rules(spark, D), queries._facts(spark, D)):
        assert rows.rdd.getNumPartitions() == wanted


def test_rows_of_cells_are_crossed_once(spark):
    """The filter on a row's crossings does not compute them again."""
    assert plan_of(properties.u02_scan_cells(spark, D)).count("array_sort(") == 1
