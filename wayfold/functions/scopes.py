"""Column functions for the scopes of rules: travel modes, opening hours, units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tags import METRES

# Each travel mode's more general modes. Bus, hgv, hov and emergency have none that is documented.
WIDER = {"car": ["motor_vehicle", "vehicle"], "truck": ["motor_vehicle", "vehicle"], "motorcycle": ["motor_vehicle", "vehicle"], "motor_vehicle": ["vehicle"], "bicycle": ["vehicle"]}
DAYS = ["Mo", "Tu", "We", "Th", "Fr", "Sa", "Su"]
# Kilograms in each unit of weight, km/h in each unit of speed.
KILOGRAMS = {"oz": 0.028349523125, "lb": 0.45359237, "st": 6.35029318, "lt": 1016.0469088, "g": 0.001, "kg": 1.0, "t": 1000.0}
KMH = {"km/h": 1.0, "mph": 1.609344}


def mode_holds(modes: Column, fact: str) -> Column:
    """Whether a rule's modes include the fact's mode or one that is wider; no modes hold for all."""
    return modes.isNull() | F.arrays_overlap(modes, F.array(*map(F.lit, [fact, *WIDER.get(fact, [])])))


def member_holds(listed: Column, fact: Column) -> Column:
    """Whether a purpose or status is listed; no list holds for all."""
    return listed.isNull() | F.array_contains(listed, fact)


def converted(value: Column, unit: Column, table: dict[str, float]) -> Column:
    """value in the table's base unit; null for other units."""
    return value * F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), unit)


def in_metres(value: Column, unit: Column) -> Column:
    return converted(value, unit, METRES)


def open_at(hours: Column, day: Column, minute: Column) -> Column:
    """Whether opening hours hold on a day (0: Monday) at a minute of the day; null for hours outside the subset.

    Subset: groups "Mo-Fr 08:00-12:00,13:00-17:00" joined by ";", days as one day, a range or a comma list of days
    without ranges, or none for all days. A range ends before its second time; one that ends earlier than it starts
    runs past midnight and belongs to the day on which it starts.
    """
    name, clock = "(?:Mo|Tu|We|Th|Fr|Sa|Su)", r"[0-9]{2}:[0-9]{2}-[0-9]{2}:[0-9]{2}"
    group = rf"(?:{name}(?:-{name}|(?:,\s*{name})*)\s+)?{clock}(?:,\s*{clock})*"
    index = lambda d: (F.array_position(F.array(*map(F.lit, DAYS)), d) - 1).cast("int")
    span = lambda n, a, b: F.pmod(n - a, F.lit(7)) <= F.pmod(b - a, F.lit(7))

    def on(days: Column, n: Column) -> Column:
        one = F.regexp_extract_all(days, F.lit(name), F.lit(0))
        return F.when(F.size(one) == 0, True).when(days.contains("-"), span(n, index(F.get(one, F.lit(0))), index(F.get(one, F.lit(1))))).otherwise(F.exists(one, lambda d: index(d) == n))

    def holds(g: Column) -> Column:
        days = F.regexp_extract(g, rf"^\s*({name}[^0-9]*)", 1)
        ranges = F.regexp_extract_all(g, F.lit(clock), F.lit(0))

        def within(r: Column) -> Column:
            at = lambda i: F.substring(r, i, 2).cast("int") * 60 + F.substring(r, i + 3, 2).cast("int")
            a, b = at(1), at(7)
            late = (a >= b) & ((on(days, day) & (minute >= a)) | (on(days, F.pmod(day - 1, F.lit(7))) & (minute < b)))
            return ((a < b) & on(days, day) & (a <= minute) & (minute < b)) | late

        return F.exists(ranges, within)

    return F.when(hours.rlike(rf"^\s*{group}(?:\s*;\s*{group})*\s*\z"), F.exists(F.split(hours, ";"), holds))
