"""Status notifications: one dispatch stream from both stages, grouped per address."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.ids import derived_id
from ..functions.text import blank
from . import ledger
from .skew import ranked

PROCESSOR, LEDGER = "processor", "ledger"
DISPATCH_ORDER = ("occurred_at", "seq", "delivery_no", "stage_no", "copy_no")
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def status_update(df: DataFrame, stage: str, status: Column, occurred_at: Column, copy_no: Column) -> DataFrame:
    return df.select(
        derived_id(stage, F.col("transaction_id"), F.col("delivery_no"), copy_no, status).alias("event_id"),
        "callback_url", "transaction_id", status.alias("status"), "correlation_id",
        occurred_at.alias("occurred_at"), "seq", "delivery_no",
        F.lit(1 if stage == PROCESSOR else 2).alias("stage_no"), copy_no.cast("int").alias("copy_no"))


def outcome_updates(classified: DataFrame) -> DataFrame:
    """Processed and replayed requests report ACCEPTED, other duplicates REJECTED.

    The processing time of a request is its creation time here, so one stamp serves all.
    """
    status = F.when(F.col("outcome") == fixed.DUPLICATE_REJECTED, "REJECTED").otherwise("ACCEPTED")
    return status_update(classified, PROCESSOR, status, F.col("created_at"), F.lit(0))


def invalid_updates(invalid_requests: DataFrame) -> DataFrame:
    return status_update(invalid_requests, PROCESSOR, F.lit("REJECTED"), F.col("created_at"), F.lit(0))


def ledger_updates(labelled: DataFrame) -> DataFrame:
    """Skipped events report PERSISTED too; failed ones FAILED."""
    status = F.when(F.col("disposition") == ledger.FAILED, "FAILED").otherwise("PERSISTED")
    return status_update(labelled, LEDGER, status, F.col("processed_at"), F.col("copy_no"))


def dispatchable(updates: DataFrame) -> DataFrame:
    return updates.filter(~blank(F.col("callback_url")))


def dispatch(*updates: DataFrame) -> DataFrame:
    """One stream of all notifications that have an address."""
    merged = updates[0]
    for more in updates[1:]:
        merged = merged.unionByName(more)
    return dispatchable(merged)


def payloads(events: DataFrame, counted: DataFrame | None = None, rows: int | None = None,
             chunk: int = fixed.WEBHOOK_BATCH_ROWS, order: Sequence[str] = DISPATCH_ORDER) -> DataFrame:
    """Payloads of at most ``chunk`` updates per address, in stream order."""
    # Only what a payload shows or is ordered by travels.
    shown = ["callback_url", "transaction_id", "status", "correlation_id", "occurred_at"]
    narrow = dispatchable(events).select(*dict.fromkeys([*shown, *order]))
    placed = ranked(narrow, ["callback_url"], order, "_place", rows, counted).select(*shown, "_place")
    update = F.struct(
        "_place",
        F.struct(
            F.col("transaction_id").alias("transactionId"), "status",
            F.col("correlation_id").alias("correlationId"),
            F.date_format("occurred_at", STAMP).alias("occurredAt")).alias("update"))
    grouped = (placed.withColumn("chunk_no", F.floor((F.col("_place") - 1) / chunk).cast("bigint"))
               .groupBy("callback_url", "chunk_no")
               .agg(F.sort_array(F.collect_list(update)).alias("_updates")))
    return grouped.select(
        "callback_url", "chunk_no", F.size("_updates").cast("bigint").alias("updates"),
        F.to_json(F.col("_updates")["update"]).alias("payload"))


def batch_stats(events: DataFrame) -> DataFrame:
    """Events and distinct addresses of each consumed batch."""
    addressed = F.when(~blank(F.col("callback_url")), F.col("callback_url"))
    return events.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct(addressed).alias("addresses"))
