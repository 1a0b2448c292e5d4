"""Checks of requests and log rows, and what a failed row ends as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import blank
from ..schemas import MONEY


def first_failure() -> Column:
    """Processor check: the first rule a request breaks, null if none."""
    amount = F.col("amount")
    return (
        F.when(amount.isNull() | (amount <= 0), fixed.AMOUNT_NOT_POSITIVE)
        .when(blank(F.col("account_id")), fixed.ACCOUNT_BLANK)
        .when(blank(F.col("idempotency_key")), fixed.KEY_BLANK)
        .when(blank(F.col("currency")), fixed.CURRENCY_BLANK)
        .when(F.col("type").isNull(), fixed.TYPE_NULL)
    )


def with_first_failure(requests: DataFrame) -> DataFrame:
    return requests.withColumn("reject_reason", first_failure())


def valid(requests: DataFrame) -> DataFrame:
    return requests.filter(first_failure().isNull())


def field_errors() -> Column:
    """Ingress check: every broken field with its first message, as array of structs."""
    amount, callback = F.col("amount"), F.col("callback_url")

    def broken(test: Column, field: str, message: Column | str) -> Column:
        text = F.lit(message) if isinstance(message, str) else message
        return F.when(test, F.struct(F.lit(field).alias("field"), text.alias("message")))

    too_small = amount < F.lit(fixed.SMALLEST_AMOUNT).cast("decimal(18,2)")
    checks = F.array(
        broken(blank(F.col("account_id")), "accountId", fixed.ACCOUNT_REQUIRED),
        broken(amount.isNull() | too_small, "amount",
               F.when(amount.isNull(), fixed.AMOUNT_REQUIRED).otherwise(fixed.AMOUNT_TOO_SMALL)),
        broken(callback.isNotNull() & ~callback.rlike(fixed.CALLBACK_PATTERN), "callbackUrl", fixed.CALLBACK_INVALID),
        broken(blank(F.col("currency")), "currency", fixed.CURRENCY_REQUIRED),
        broken(blank(F.col("idempotency_key")), "idempotencyKey", fixed.KEY_REQUIRED),
        broken(F.col("type").isNull(), "type", fixed.TYPE_REQUIRED),
    )
    return F.filter(checks, lambda check: check.isNotNull())


def with_field_errors(requests: DataFrame) -> DataFrame:
    """``field_errors``: map from field to message, empty for a good request."""
    return requests.withColumn("field_errors", F.map_from_entries(field_errors()))


def field_error_counts(requests: DataFrame) -> DataFrame:
    broken = requests.select(F.inline(field_errors()))
    return broken.groupBy("field", "message").agg(F.count(F.lit(1)).alias("n"))


def ledger_violation() -> Column:
    """First column of a log row the ledger table would not take, null if it fits."""
    found = F.lit(None).cast("string")
    for name, width in reversed(fixed.LEDGER_WIDTHS.items()):
        c = F.col(name)
        found = F.when(c.isNull(), f"{name} is null").when(
            F.char_length(c) > width, f"{name} exceeds {width}").otherwise(found)
    amount = F.col("amount")
    return (
        F.when(amount.isNull(), "amount is null")
        .when(amount.try_cast(MONEY).isNull(), "amount out of range")
        .when(F.col("processed_at").isNull(), "processed_at is null")
        .otherwise(found)
    )


def terminal_status(reason_class: Column) -> Column:
    """Status told to the caller; null means nobody can be told (undecodable payload)."""
    return (F.when(reason_class == "validation", "REJECTED")
            .when(reason_class == "undecodable", F.lit(None))
            .otherwise("FAILED"))
