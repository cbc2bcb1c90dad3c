"""Column functions on source tags: heights, units, languages, classes and categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres in each unit of length.
METRES = {"in": 0.0254, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344, "cm": 0.01, "m": 1.0, "km": 1000.0}
# Language parts of name tags that are spelled otherwise in BCP 47.
LANGUAGE_FIXES = {"ja_kana": "ja-Kana", "ja_hira": "ja-Hira", "zh_pinyin": "zh-Latn-pinyin", "zh_zhuyin": "zh-Bopo", "be-tarask": "be-Latn-tarask", "nan-POJ": "nan-Latn"}
# Fixed value: the pattern of language tags.
LANGUAGE = r"^(?:(?:[A-Za-z]{2,3}(?:-[A-Za-z]{3}){0,3}?)|(?:[A-Za-z]{4,8}))(?:-[A-Za-z]{4})?(?:-[A-Za-z]{2}|[0-9]{3})?(?:-(?:[A-Za-z0-9]{5,8}|[0-9][A-Za-z0-9]{3}))*(?:-[A-WY-Za-wy-z0-9](?:-[A-Za-z0-9]{2,8})+)*\z"
# The published spellings of heights, with n for a number, and whether they are metric.
_N, _S = r"([0-9]+(?:\.[0-9]*)?)", r"\s*"
HEIGHTS = {
    "X": (rf"^{_S}{_N}{_S}\z", "m"), "X m": (rf"^{_S}{_N}{_S}ms?{_S}\z", "m"), "X meter": (rf"^{_S}{_N}{_S}meters?{_S}\z", "m"), "X metre": (rf"^{_S}{_N}{_S}metres?{_S}\z", "m"),
    "X'": (rf"^{_S}{_N}{_S}'{_S}\z", "ft"), "X ft": (rf"^{_S}{_N}{_S}ft{_S}\z", "ft"), "X feet": (rf"^{_S}{_N}{_S}feet{_S}\z", "ft"), "X'Y\"": (rf"^{_S}{_N}{_S}'{_S}{_N}{_S}\"{_S}\z", "ft"), "X\"": (rf"^{_S}{_N}\"{_S}\z", "in"),
}


def height_metres(text: Column) -> Column:
    """Metres of a height tag: plain or metric numbers as they are, feet and inches to 2 places; null for anything else."""
    found = F.lit(None).cast("double")
    for name, (pattern, unit) in HEIGHTS.items():
        number = lambda group: F.regexp_extract(text, pattern, group).try_cast("double")  # noqa: B023, E731
        value = number(1) if unit == "m" else F.round(number(1) * METRES[unit] + (number(2) * METRES["in"] if "Y" in name else 0.0), 2)
        found = F.when(text.rlike(pattern), value).otherwise(found)
    return found


def height_format(text: Column) -> Column:
    """The published name of the spelling that height_metres reads; null if it reads none."""
    return F.coalesce(*(F.when(text.rlike(pattern), F.lit(name)) for name, (pattern, _) in HEIGHTS.items()))


def tag(tags: Column, key: str) -> Column:
    """The value of a tag, null if it is missing."""
    return F.try_element_at(tags, F.lit(key))


def normal_tag(tags: Column, key: str) -> Column:
    """The value of a tag in lower case and without blanks around it."""
    return F.lower(F.trim(tag(tags, key)))


def class_of(tags: Column, rules: Sequence[tuple[str, Sequence[str], str, str]]) -> Column:
    """struct(subtype, class) by the first rule (key, values, subtype, class) whose tag has one of the values; null if none fits."""
    pair = lambda a, b: F.struct(F.lit(a).alias("subtype"), F.lit(b).alias("class"))
    return F.coalesce(*(F.when(normal_tag(tags, key).isin(*values), pair(subtype, cls)) for key, values, subtype, cls in rules))


def is_language(text: Column) -> Column:
    """Whether a text has the form of a BCP 47 language tag."""
    return text.rlike(LANGUAGE)


def language(text: Column) -> Column:
    """A language tag with the known misspellings mended; null if it has no valid form."""
    fixed = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in LANGUAGE_FIXES.items() for x in pair)), text), text)
    return F.when(is_language(fixed), fixed)


def category_path(line: Column) -> Column:
    """struct(category, path) of a line "code; [root,...,code]"; null without a path."""
    parts = F.split(line, ";")
    inner = F.trim(F.get(parts, F.lit(1)))
    return F.when(F.size(parts) > 1, F.struct(F.trim(F.get(parts, F.lit(0))).alias("category"), F.split(F.substring(inner, F.lit(2), F.length(inner) - 2), ",").alias("path")))
