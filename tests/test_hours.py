"""Opening hours: single times, overriding rules, and texts that are not understood."""

import datetime

import pytest
from pyspark.sql import functions as F

from wayfold.functions import hours

CASES = [
    ("Mo-Fr 15:00-18:00", "2024-03-04 15:00", True), ("Mo-Fr 15:00-18:00", "2024-03-04 18:00", False), ("Mo-Fr 15:00-18:00", "2024-03-09 16:00", False), ("24/7", "2024-02-29 23:59", True), ("Mo-Fr 07:00-19:00; PH off", "2024-03-04 08:00", None),
    ("22:00-06:00", "2024-01-01 05:59", True), ("Su 18:00-26:00", "2024-03-04 01:59", True), ("Su 18:00-26:00", "2024-03-04 02:00", False), ("Dec 24-Jan 02", "2024-01-02 10:00", True), ("Dec 24-Jan 02", "2024-01-03 10:00", False), ("Dec 24-26 off", "2024-12-25 10:00", False), ("2023-2025 10:00-11:00", "2024-06-01 10:30", True), ("2025 10:00-11:00", "2024-06-01 10:30", False),
    ("Mo[2] 10:00-11:00", "2024-03-11 10:30", True), ("Mo[2] 10:00-11:00", "2024-03-04 10:30", False), ("Fr[-1] 10:00-11:00", "2024-03-29 10:30", True), ("Fr[-1] 10:00-11:00", "2024-03-22 10:30", False), ("week 02 10:00-11:00", "2024-01-08 10:00", True), ("Fr-Mo 10:00-11:00", "2024-03-06 10:30", False), ("Fr-Mo 10:00-11:00", "2024-03-03 10:30", True),
    ("Mo 10:00-12:00, Mo 14:00-15:00", "2024-03-04 14:30", True), ("Mo 10:00-12:00; Mo 14:00-15:00", "2024-03-04 10:30", False), ("Apr-Sep: Mo-Fr 10:00-12:00", "2024-05-06 10:30", True), ("Mo-Fr 10:00-12:00;", "2024-05-06 10:30", True), ("off", "2024-05-06 10:30", False), ("by appointment", "2024-05-06 10:30", None), ("25:00", "2024-05-06 10:30", None), ("", "2024-05-06 10:30", None), (None, "2024-05-06 10:30", None),
]


def test_opening_hours(spark):
    frame = spark.createDataFrame([(i, t, datetime.datetime.fromisoformat(w)) for i, (t, w, _) in enumerate(CASES)] + [(900, "24/7", None)], "k int, hours string, at timestamp")
    got = {r.k: r.is_open for r in hours.with_open(frame, "hours", F.col("at")).collect()}
    assert got == {i: o for i, (_, _, o) in enumerate(CASES)} | {900: None}
    assert {(r.hours, r.n) for r in hours.not_understood(frame, "hours").collect()} == {("Mo-Fr 07:00-19:00; PH off", 1), ("by appointment", 1), ("25:00", 1), ("", 1)}


@pytest.mark.parametrize("text", ["Mo-Fr 08:00-12:00,11:00-17:00", "22:00-06:00; Su off", "Sa 10:00-30:00"])
def test_spans_are_sorted_and_apart(text):
    found = hours.spans(text, 2023)
    assert all(a < b for a, b in found) and all(b < c for (_, b), (c, _) in zip(found, found[1:])) and len(found) > 50
