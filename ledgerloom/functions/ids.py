"""Reproducible ids, so that a retry or a replay gives the same ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank


def derived_id(stage: str, *parts: Column) -> Column:
    # A null part leaves a mark of its own, so that rows that lack one do not share an id.
    texts = [F.coalesce(p.cast("string"), F.lit("\0")) for p in parts]
    return F.sha2(F.concat_ws(":", *texts, F.lit(stage)), 256)


def correlation(given: Column, generated: Column) -> Column:
    return F.when(blank(given), generated).otherwise(given)


def bucketed_account(number: Column, accounts: int) -> Column:
    return F.concat(F.lit("acct-"), F.lpad((number % accounts).cast("string"), 8, "0"))
