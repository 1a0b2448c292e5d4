"""Append-only audit documents: one per delivery, duplicates included, amounts as sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed, schemas
from ..functions.ids import derived_id


def documents(log: DataFrame, stored_at: Column | None = None,
              source_topic: Column | str = fixed.LOG_STREAM) -> DataFrame:
    topic = F.lit(source_topic) if isinstance(source_topic, str) else source_topic
    stamp = F.current_timestamp() if stored_at is None else stored_at
    return log.select(
        derived_id("audit", F.col("event_id"), F.col("copy_no")).alias("id"),
        "event_id", "transaction_id", "idempotency_key", "merchant_id", "account_id", "correlation_id",
        F.col("amount").cast(schemas.WIRE_AMOUNT).alias("amount"), "currency", "type", "status", "processed_at", stamp.alias("stored_at"),
        topic.alias("source_topic"))
