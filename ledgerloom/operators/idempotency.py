"""Duplicate classification by idempotency key, and the accepted log it yields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.ids import derived_id
from .hold import ACQUIRED, HOLDER, hold
from .skew import is_first, ranked

ARRIVAL = ("seq", "delivery_no")
HOURS = 3600


def outcome(acquired: Column, holder: Column) -> Column:
    return (F.when(acquired, fixed.PROCESSED)
            .when(F.col("transaction_id") == holder, fixed.DUPLICATE_REPLAY)
            .otherwise(fixed.DUPLICATE_REJECTED))


def classify(valid_requests: DataFrame, ttl_hours: int = fixed.IDEMPOTENCY_TTL_HOURS,
             scope: Sequence[str] = ("idempotency_key",), fold_rows: int | None = None) -> DataFrame:
    """Label every valid request PROCESSED, DUPLICATE_REPLAY or DUPLICATE_REJECTED."""
    held = hold(valid_requests, scope, "created_at", ARRIVAL, "transaction_id", ttl_hours * HOURS, fold_rows)
    return held.withColumn("outcome", outcome(F.col(ACQUIRED), F.col(HOLDER)))


def first_wins(valid_requests: DataFrame, scope: Sequence[str] = ("idempotency_key",)) -> DataFrame:
    """Without expiry: only the first request of a key is processed."""
    return is_first(valid_requests, scope, ("created_at", *ARRIVAL), "first")


def accepted_log(classified: DataFrame) -> DataFrame:
    """Log events of the processed requests."""
    return classified.filter(F.col("outcome") == fixed.PROCESSED).select(
        "seq", "delivery_no",
        derived_id("accepted", F.col("transaction_id"), F.col("created_at").cast("string")).alias("event_id"),
        "transaction_id", "idempotency_key", "merchant_id", "account_id", "amount", "currency", "type",
        F.lit("ACCEPTED").alias("status"), "callback_url", "correlation_id",
        F.col("created_at").alias("processed_at"),
    )


def outcome_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def account_sequence(log: DataFrame, counted: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Position of each log event in its account's stream."""
    return ranked(log, ["account_id"], ["processed_at", *ARRIVAL], "account_seq", rows, counted)
