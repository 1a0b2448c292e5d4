"""Read access: stored settings, fixed-window limits, and ownership of looked-up rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.clock import window_id
from ..functions.text import blank, items, last_per_key, number_or, pairs, text_or, whole_number
from .skew import ranked

CALL_ORDER = ("ts", "event_id")


def api_keys(settings: DataFrame, column: str = "api_keys") -> DataFrame:
    """Allowed keys of each stored hash."""
    return settings.select("tenant_id", F.explode(items(F.col(column), ",")).alias("api_key"))


def key_limits(settings: DataFrame, column: str = "rate_limits") -> DataFrame:
    """Per-key limits; malformed entries are dropped, the last entry of a key wins."""
    entries = F.filter(pairs(F.col(column)), lambda p: whole_number(p["value"]).isNotNull())
    kept = settings.select("tenant_id", entries.alias("_entries"))
    flat = kept.select("tenant_id", F.inline(last_per_key(F.col("_entries"))))
    return flat.select("tenant_id", F.col("key").alias("api_key"), whole_number(F.col("value")).alias("key_limit"))


def key_merchants(settings: DataFrame, column: str = "api_key_merchants") -> DataFrame:
    """Merchants each key may read; an entry without members does not count."""
    entries = F.filter(pairs(F.col(column)), lambda p: F.size(items(p["value"], "[|]")) > 0)
    kept = settings.select("tenant_id", entries.alias("_entries"))
    flat = kept.select("tenant_id", F.inline(last_per_key(F.col("_entries"))))
    return flat.select("tenant_id", F.col("key").alias("api_key"),
                       F.explode(items(F.col("value"), "[|]")).alias("merchant_id"))


def effective(settings: DataFrame, defaults: dict[str, str | int]) -> DataFrame:
    """Stored fields over the defaults; integers never fall below one."""
    text = lambda name: text_or(F.col(name), F.lit(defaults[name])).alias(name)
    number = lambda name: number_or(F.col(name), F.lit(defaults[name])).alias(name)
    return settings.select("tenant_id", text("api_keys"), text("rate_limits"), text("api_key_merchants"),
                           number("rate_window_seconds"), number("default_limit_per_window"))


def for_tenants(tenants: DataFrame, settings: DataFrame) -> DataFrame:
    """One row per tenant, with nulls where it has nothing stored."""
    return tenants.select("tenant_id").join(settings, "tenant_id", "left")


def admissible(allowed: Sequence[str]) -> Column:
    return ~blank(F.col("api_key")) & F.col("api_key").isin(*allowed)


def window_counts(calls: DataFrame, seconds: int, allowed: Sequence[str]) -> DataFrame:
    """Calls per allowed key and fixed window."""
    counted = calls.filter(admissible(allowed)).withColumn("window_id", window_id(F.col("ts"), seconds))
    return counted.groupBy("api_key", "window_id").agg(F.count(F.lit(1)).alias("calls"))


def limit_verdicts(calls: DataFrame, limits: DataFrame, seconds: int, default_limit: int,
                   allowed: Sequence[str], rows: int | None = None) -> DataFrame:
    """Answer of the limiter to every call.

    Calls without a valid key are refused before counting; a call over the limit still
    counts. ``limits`` is configuration; Spark broadcasts it by its size.
    """
    placed = calls.withColumn("window_id", window_id(F.col("ts"), seconds))
    refused = placed.filter(~F.coalesce(admissible(allowed), F.lit(False))).select(
        "event_id", "api_key", "window_id", F.lit(None).cast("bigint").alias("ordinal"),
        F.lit(None).cast("int").alias("key_limit"), F.lit(401).alias("status"),
        F.when(blank(F.col("api_key")), fixed.API_KEY_MISSING).otherwise(fixed.API_KEY_INVALID).alias("message"))
    counted = ranked(placed.filter(admissible(allowed)), ["api_key", "window_id"], CALL_ORDER, "ordinal", rows)
    limited = counted.join(limits, "api_key", "left").withColumn(
        "key_limit", F.coalesce("key_limit", F.lit(default_limit)))
    over = F.col("ordinal") > F.col("key_limit")
    answered = limited.select(
        "event_id", "api_key", "window_id", "ordinal", "key_limit",
        F.when(over, 429).otherwise(200).alias("status"), F.when(over, fixed.RATE_EXCEEDED).alias("message"))
    return refused.unionByName(answered)


def status_lookup(lookups: DataFrame, ledger: DataFrame, owned: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Answer of the status view to every lookup, by id in bulk.

    401 for a key that is not allowed, 404 for an id not in the ledger, 403 for another
    merchant's transaction, else 200. Ids are unique in the ledger, so a hot id is hot on
    the lookup side only, where AQE splits it.
    """
    known = F.coalesce(admissible(allowed), F.lit(False))
    entries = ledger.select("transaction_id", "merchant_id", F.col("status").alias("_status"), "processed_at")
    rights = owned.select("api_key", "merchant_id", F.lit(True).alias("_owns"))
    met = lookups.join(entries, "transaction_id", "left").join(rights, ["api_key", "merchant_id"], "left")
    code = (F.when(~known, 401).when(F.col("_status").isNull(), 404)
            .when(F.col("_owns").isNull(), 403).otherwise(200))
    shown = met.withColumn("code", code)
    visible = lambda name: F.when(F.col("code") == 200, F.col(name))
    return shown.select("event_id", "api_key", "transaction_id", "code",
                        visible("_status").alias("status"), visible("processed_at").alias("processed_at"))
