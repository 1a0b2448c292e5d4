"""Instants, skew, fixed windows and look-back bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INSTANT = (r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,9})?"
            r"(Z|[+-][0-9]{2}:[0-9]{2}(:[0-9]{2})?)\z")


def instant(text: Column) -> Column:
    """Timestamp of a full ISO instant with a zone, else null."""
    shaped = F.upper(text)
    return F.when(shaped.rlike(_INSTANT), F.try_to_timestamp(shaped))


def skew_seconds(a: Column, b: Column) -> Column:
    return F.abs(F.unix_seconds(a) - F.unix_seconds(b))


def window_id(at: Column, seconds: int | Column) -> Column:
    return F.floor(F.unix_seconds(at) / seconds).cast("bigint")


def minutes_before(at: Column, minutes: int) -> Column:
    return at - F.make_dt_interval(mins=F.lit(minutes))
