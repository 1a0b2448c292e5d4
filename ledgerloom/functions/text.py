"""Blank tests and the small delimited formats of the read-access configuration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    """Null, empty or only white space of any Unicode kind."""
    return c.isNull() | c.rlike(r"\A\p{javaWhitespace}*\z")


def stripped(c: Column) -> Column:
    """Drop control characters and spaces at both ends, as far as U+0020."""
    return F.regexp_replace(c, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


def whole_number(c: Column) -> Column:
    """32-bit integer of an already stripped text, else null."""
    return F.when(c.rlike(r"\A[+-]?[0-9]+\z"), c.try_cast("int"))


def items(c: Column, separator: str) -> Column:
    """Distinct non-blank parts; null text gives an empty array."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), separator), stripped)
    return F.array_distinct(F.filter(parts, lambda part: ~blank(part)))


def pairs(c: Column) -> Column:
    """``key:value`` entries of a comma list as an array of structs.

    The first colon splits; entries lacking a key or a value are dropped.
    """
    entries = F.split(F.coalesce(c, F.lit("")), ",")
    halves = F.transform(entries, lambda entry: F.split(stripped(entry), ":", 2))
    named = F.transform(halves, lambda half: F.struct(
        stripped(half[0]).alias("key"), stripped(F.get(half, F.lit(1))).alias("value")))
    return F.filter(named, lambda pair: ~blank(pair["key"]) & ~blank(pair["value"]))


def last_per_key(entries: Column) -> Column:
    """Of entries sharing a key keep the last one, inside the row."""
    def is_last(entry: Column, place: Column) -> Column:
        later = F.slice(entries, place + 2, F.greatest(F.size(entries) - place - 1, F.lit(0)))
        return ~F.exists(later, lambda other: other["key"] == entry["key"])
    return F.filter(entries, is_last)


def text_or(c: Column, default: Column) -> Column:
    return F.when(blank(stripped(c)), default).otherwise(stripped(c))


def number_or(c: Column, default: Column) -> Column:
    """Stored integer, the default if it is absent or no integer; never below one."""
    return F.greatest(F.lit(1), F.coalesce(whole_number(stripped(c)), default))
