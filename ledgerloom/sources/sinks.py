"""Sinks: keyed records, stored tables, and reconciliation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import fixed, schemas
from ..functions.text import blank
from .records import encoded


def publish_records(records: DataFrame, target: str, fmt: str = "parquet", **options) -> None:
    """Append keyed records to a folder, or to a topic when ``fmt`` is ``kafka``."""
    if fmt == "kafka":
        records.select("key", "value").write.format(fmt).options(**options).option("topic", target).save()
    else:
        records.write.format(fmt).options(**options).mode("append").save(target)


def publish_requests(requests: DataFrame, target: str, fmt: str = "parquet", **options) -> None:
    """Requests keyed by account; a request without account stops the job."""
    publish_records(encoded(requests, schemas.REQUEST_WIRE, "account_id"), target, fmt, **options)


def publish_webhooks(updates: DataFrame, target: str, fmt: str = "parquet", **options) -> None:
    """Notifications keyed by address; those without one are left out."""
    addressed = updates.filter(~blank(updates["callback_url"]))
    publish_records(encoded(addressed, schemas.WEBHOOK_WIRE, "callback_url"), target, fmt, **options)


def append_rows(rows: DataFrame, target: str, fmt: str = "parquet", **options) -> None:
    """Append to a stored table; ``jdbc`` writes in the ledger's batch size."""
    writer = rows.write.format(fmt).mode("append").options(**options)
    if fmt == "jdbc":
        writer.option("dbtable", target).option("batchsize", fixed.LEDGER_BATCH_ROWS).save()
    else:
        writer.save(target)


def append_run(run: DataFrame, target: str, fmt: str = "parquet", **options) -> None:
    """Append one reconciliation row."""
    append_rows(run.select(*schemas.RECONCILIATION_RUN.fieldNames()), target, fmt, **options)
