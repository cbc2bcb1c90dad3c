"""Opening hours as sets of minutes of a year.

A text is a list of rules: optional years, months and days, weeks and weekdays, then times, then `off`. Rules after ";" take the place of
earlier ones on the days that they name, rules after "," add to them, and those after "||" hold where nothing before names
a day. Understood are 24/7, years (2024, 2023-2025), months and dates (Jan-Mar, Dec 24-Jan 02), weeks (week 01-10, week 02-52/2),
weekdays (Mo-Fr,Su; Mo[1], Fr[-1]), times (08:00-12:00, 22:00-02:00, 18:00-26:00, 18:00+, which ends at midnight), `open`, `off` and `closed`.
Holidays, sunrise, comments and other text give null; a day without a rule is closed. Distinct texts are few beside the rows that have
them, so each is read once, in tasks, and rows are matched by a test of ranges.
"""

from __future__ import annotations

import datetime
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

# Names in the order of the calendar.
DAYS = ["Mo", "Tu", "We", "Th", "Fr", "Sa", "Su"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
DAY = 24 * 60
SPANS = ArrayType(StructType([StructField("low", IntegerType()), StructField("high", IntegerType())]))

_DAY, _MONTH, _CLOCK = "|".join(DAYS), "|".join(MONTHS), r"[0-4][0-9]:[0-5][0-9]"
_DATE = rf"(?:{_MONTH})(?:\s+[0-3][0-9](?!:))?"
_DATES = rf"{_DATE}(?:\s*-\s*(?:{_DATE}|[0-3][0-9](?!:)))?"
_WEEKDAY = rf"(?:{_DAY})(?:\[-?[1-5]\]|-(?:{_DAY}))?"
_TIME = rf"{_CLOCK}(?:-{_CLOCK}|\+)"
_RULE = re.compile(
    rf"(?P<years>[12][0-9]{{3}}(?:-[12][0-9]{{3}})?(?:,[12][0-9]{{3}}(?:-[12][0-9]{{3}})?)*)?\s*(?P<dates>{_DATES}(?:\s*,\s*{_DATES})*)?\s*(?:week\s+(?P<weeks>[0-5]?[0-9](?:-[0-5]?[0-9](?:/[0-9]+)?)?(?:,[0-5]?[0-9](?:-[0-5]?[0-9](?:/[0-9]+)?)?)*))?\s*:?\s*"
    rf"(?P<days>{_WEEKDAY}(?:\s*,\s*{_WEEKDAY})*)?\s*(?P<times>24/7|{_TIME}(?:\s*,\s*{_TIME})*)?\s*(?P<state>open|off|closed)?"
)


def _minutes(clock: str) -> int:
    return int(clock[:2]) * 60 + int(clock[3:5])


def _within(value: int, low: int, high: int) -> bool:
    """Whether a value lies in a range that may run over the end of its circle."""
    return low <= value <= high if low <= high else value >= low or value <= high


def _named(rule: dict, day: datetime.date) -> bool:
    """Whether a rule's selectors name a day."""
    if rule["years"] and not any(_within(day.year, int(y[:4]), int(y[-4:])) for y in rule["years"].split(",")):
        return False
    if rule["weeks"]:
        week, good = day.isocalendar()[1], False
        for w in rule["weeks"].split(","):
            span, _, step = w.partition("/")
            low, _, high = span.partition("-")
            good |= _within(week, int(low), int(high or low)) and (week - int(low)) % int(step or 1) == 0
        if not good:
            return False
    if rule["dates"] and not any(_dated(d.strip(), day) for d in rule["dates"].split(",")):
        return False
    return not rule["days"] or any(_weekday(d.strip(), day) for d in rule["days"].split(","))


def _dated(text: str, day: datetime.date) -> bool:
    low, _, high = (x.strip() for x in text.partition("-"))
    of = lambda t, last: (MONTHS.index(t[:3]) + 1) * 100 + (int(t[3:]) if t[3:].strip() else 31 if last else 0)
    high = low if not high else low[:3] + " " + high if high[0].isdigit() else high
    return _within(day.month * 100 + day.day, of(low, False), of(high, True))


def _weekday(text: str, day: datetime.date) -> bool:
    if "[" in text:
        n = int(text[3:-1])
        other = day + datetime.timedelta(days=7 * (1 if n < 0 else -1) * abs(n))
        nearer = day + datetime.timedelta(days=7 * (1 if n < 0 else -1) * (abs(n) - 1))
        return text[:2] == DAYS[day.weekday()] and other.month != day.month and nearer.month == day.month
    low, _, high = text.partition("-")
    return _within(day.weekday(), DAYS.index(low), DAYS.index(high or low))


def read(text: str | None) -> list[tuple[str, dict]] | None:
    """(how it joins, selectors and times) of each rule; None for text that is not understood."""
    if text is None or not text.strip():
        return None
    rules, at, joint = [], 0, ";"
    text = text.strip().rstrip(";").rstrip()
    while True:
        m = _RULE.match(text, at)
        if not m or m.end() == at or not any(m.groupdict().values()):
            return None
        rules.append((joint, m.groupdict()))
        end = re.compile(r"\s*(;|,|\|\||\Z)\s*").match(text, m.end())
        if not end:
            return None
        joint, at = end[1], end.end()
        if not joint:
            return rules


def spans(text: str | None, year: int) -> list[tuple[int, int]] | None:
    """Sorted, separate (first, after last) minutes of a year at which a text is open; None if it is not understood."""
    rules = read(text)
    if rules is None:
        return None
    found: list[list[int]] = []
    start = datetime.date(year, 1, 1)
    for n in range(-1, (datetime.date(year + 1, 1, 1) - start).days):
        day, times, named = start + datetime.timedelta(days=n), [], False
        for joint, rule in rules:
            if not _named(rule, day) or (joint == "||" and named):
                continue
            clock = [(0, DAY)] if rule["times"] in (None, "24/7") else [(_minutes(t), DAY if "+" in t else _minutes(t[6:])) for t in map(str.strip, rule["times"].split(","))]
            clock = [(a, b if b > a else b + DAY) for a, b in clock]
            if rule["state"] in ("off", "closed"):
                times = [x for a, b in times for x in _without(a, b, clock)]
            else:
                times = times + clock if joint == "," else clock
            named = True
        found += [[n * DAY + a, n * DAY + b] for a, b in times]
    merged: list[list[int]] = []
    for a, b in sorted([max(0, a), b] for a, b in found if b > 0):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def _without(a: int, b: int, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    for low, high in sorted(cuts):
        if low < b and high > a:
            return ([(a, low)] if a < low else []) + (_without(high, b, cuts) if high < b else [])
    return [(a, b)]


@F.pandas_udf(SPANS)
def _spans(texts: pd.Series, years: pd.Series) -> pd.Series:
    made = (spans(t, int(y)) for t, y in zip(texts, years, strict=True))
    return pd.Series([None if s is None else [{"low": a, "high": b} for a, b in s] for s in made], dtype=object)


def with_open(rows: DataFrame, hours: str, when: Column, as_: str = "is_open") -> DataFrame:
    """rows with whether their opening hours hold at a time (a timestamp, read in the session's zone); null for hours that are not understood, null, or without a time."""
    dated = rows.withColumns({"__wf_year": F.year(when), "__wf_minute": (F.dayofyear(when) - 1) * DAY + F.hour(when) * 60 + F.minute(when)})
    known = dated.select(F.col(hours).alias("__wf_text"), F.col("__wf_year").alias("__wf_of")).where("__wf_text is not null and __wf_of is not null").distinct()
    known = known.withColumn("__wf_spans", _spans("__wf_text", "__wf_of"))
    met = dated.join(known, (F.col(hours) == F.col("__wf_text")) & (F.col("__wf_year") == F.col("__wf_of")), "left")
    holds = F.exists("__wf_spans", lambda s: (s["low"] <= F.col("__wf_minute")) & (F.col("__wf_minute") < s["high"]))
    return met.withColumn(as_, holds).drop("__wf_year", "__wf_minute", "__wf_text", "__wf_of", "__wf_spans")


def not_understood(rows: DataFrame, hours: str) -> DataFrame:
    """hours and n: texts that no rule could be read from, and how many rows have them."""
    each = rows.where(F.col(hours).isNotNull()).groupBy(hours).agg(F.count("*").alias("n"))
    return each.where(_spans(F.col(hours), F.lit(2024)).isNull())
