"""Writing log events into a ledger that takes each transaction once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from .skew import first_of, matched
from .validate import ledger_violation

LOG_ORDER = ("processed_at", "seq", "delivery_no", "copy_no")
INSERTED, SKIPPED, FAILED = "INSERTED", "SKIPPED", "FAILED"
CONFLICT = "account_idempotency_conflict"

# Micro-batch rows small enough to be sent to every task that scans the ledger.
BROADCAST_BATCH_ROWS = 200_000


def ledger_rows(log: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Ledger shape of log events; the stored status is always PERSISTED."""
    stamp = F.current_timestamp() if created_at is None else created_at
    return log.select(
        "transaction_id", "idempotency_key", "merchant_id", "account_id",
        F.col("amount").cast(schemas.MONEY).alias("amount"), "currency", "type",
        F.lit("PERSISTED").alias("status"), "processed_at", stamp.alias("created_at"))


@dataclass(frozen=True)
class Persisted:
    """What became of a set of log events.

    ``new`` holds the log rows that enter the ledger, ``labelled`` every log row with
    ``disposition`` (INSERTED, SKIPPED or FAILED) and ``reason``.
    """

    new: DataFrame
    labelled: DataFrame

    @property
    def inserted(self) -> DataFrame:
        return ledger_rows(self.new, F.col("processed_at"))


def persist(log: DataFrame, existing: DataFrame | None = None) -> Persisted:
    """Insert if absent.

    A row the table cannot hold fails. A transaction already stored, or stored by an
    earlier row, is skipped. A new transaction whose account and idempotency key belong
    to another one fails. A transaction id stands for one request, so its rows are
    judged by the first of them.

    Each rule is a minimum per key, combined before its shuffle, so that neither a hot
    id nor a hot account gathers in a task.
    """
    checked = log.withColumn("violation", ledger_violation())
    fitting = checked.filter(F.col("violation").isNull()).drop("violation")

    def entering(names: list[str]) -> DataFrame:
        fresh = first_of(fitting, ["transaction_id"], LOG_ORDER, names)
        if existing is not None:
            fresh = matched(fresh, existing.select("transaction_id"), ["transaction_id"], "left_anti")
        new = first_of(fresh, schemas.ACCOUNT_KEY, LOG_ORDER, names).select(*names)
        if existing is not None:
            new = matched(new, existing.select(*schemas.ACCOUNT_KEY), schemas.ACCOUNT_KEY, "left_anti")
        return new

    # The record's text travels with the labels only, which need no more than ids and order.
    new = entering([c for c in log.columns if c != "value"])
    winners = entering(["transaction_id", *schemas.ACCOUNT_KEY, *LOG_ORDER])
    return Persisted(new, _labelled(checked, winners, existing))


def _labelled(checked: DataFrame, new: DataFrame, existing: DataFrame | None) -> DataFrame:
    entry = F.struct(*LOG_ORDER)
    stored = new.select("transaction_id", entry.alias("_entry"), F.lit(True).alias("_stored"))
    if existing is not None:
        stored = stored.unionByName(
            existing.select("transaction_id", F.lit(True).alias("_stored")), allowMissingColumns=True)
    # The stored side has one row per id; a hot id on the log side is split by AQE.
    met = checked.join(stored, "transaction_id", "left")
    failed = F.col("violation").isNotNull() | F.col("_stored").isNull()
    disposition = (F.when(failed, FAILED).when(F.col("_entry") == entry, INSERTED).otherwise(SKIPPED))
    reason = F.coalesce("violation", F.when(F.col("_stored").isNull(), CONFLICT))
    columns = [c for c in checked.columns if c != "violation"]
    return met.select(*columns, disposition.alias("disposition"), reason.alias("reason"))


def narrowed(existing: DataFrame, batch: DataFrame, rows: int) -> DataFrame:
    """Ledger keys a small batch can meet.

    The batch travels to the ledger, whose key columns are scanned once and not shuffled. A
    larger batch leaves the choice of join to Spark.
    """
    keys = existing.select("transaction_id", *schemas.ACCOUNT_KEY)
    if rows > BROADCAST_BATCH_ROWS:
        return keys
    ids = batch.select("transaction_id").distinct().withColumn("_same_id", F.lit(True))
    accounts = batch.select(*schemas.ACCOUNT_KEY).distinct().withColumn("_same_account", F.lit(True))
    met = keys.join(F.broadcast(ids), "transaction_id", "left").join(F.broadcast(accounts), list(schemas.ACCOUNT_KEY), "left")
    return met.filter(F.col("_same_id") | F.col("_same_account")).select(*keys.columns)


def batch_counters(labelled: DataFrame) -> DataFrame:
    is_label = lambda label: F.count_if(F.col("disposition") == label)
    return labelled.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total_events"), is_label(INSERTED).alias("inserted"),
        is_label(SKIPPED).alias("skipped"), is_label(FAILED).alias("failed"))


def batch_summary(log: DataFrame) -> DataFrame:
    """Size of each batch with its first and last transaction."""
    place = F.struct(*LOG_ORDER)
    return log.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.min_by("transaction_id", place).alias("first_transaction_id"),
        F.max_by("transaction_id", place).alias("last_transaction_id"))


def replayed(log: DataFrame) -> DataFrame:
    """Ledger rebuilt from the whole log, as if it had been empty."""
    return persist(log).inserted
