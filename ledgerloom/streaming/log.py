"""The two consumers of the transaction log, each with its own checkpoint."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed, schemas
from ..operators import audit, deadletter, webhooks
from ..operators.ledger import INSERTED, ledger_rows, narrowed, persist, replayed
from ..sources.records import decoded, encoded, kept, positioned, record_batch, record_stream
from ..sources.sinks import publish_records
from ..sources.tables import stored_or_empty
from .runs import PLACE_FIELDS, Place, batch_folder, batch_read, drain

# What a topic calls partition and offset travels beside each record in these columns.
POSITION = ("seq", "delivery_no", "copy_no", "source_partition")
RECORD = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("value", T.StringType()),
    T.StructField("seq", T.LongType()), T.StructField("delivery_no", T.IntegerType()),
    T.StructField("copy_no", T.IntegerType()), T.StructField("source_partition", T.LongType())])


def publish(log: DataFrame, path: str) -> None:
    """Append log events as JSON records keyed by account."""
    placed = log.withColumn("source_partition", F.col("seq") % fixed.STREAM_PARTITIONS)
    publish_records(encoded(placed, schemas.LOG_WIRE, "account_id", POSITION), path)


def consume(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return decoded(positioned(record_stream(spark, path, RECORD, fmt, **options)), schemas.LOG_WIRE)


@dataclass(frozen=True)
class LedgerFolders:
    """Where the ledger consumer keeps its tables."""

    root: str

    @property
    def ledger(self) -> str:
        return f"{self.root}/ledger"

    @property
    def arrived(self) -> str:
        return f"{self.root}/arrived"

    @property
    def labelled(self) -> str:
        return f"{self.root}/labelled"

    @property
    def webhooks(self) -> str:
        return f"{self.root}/{fixed.WEBHOOK_STREAM}"

    @property
    def letters(self) -> str:
        return f"{self.root}/{fixed.LOG_STREAM}{fixed.DEAD_LETTER_SUFFIX}"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"


LEDGER_PARTS = T.StructType([*schemas.LEDGER.fields, T.StructField("processed_date", T.DateType()),
                             *PLACE_FIELDS])


def stored_ledger(spark: SparkSession, folders: LedgerFolders) -> DataFrame:
    return stored_or_empty(spark, LEDGER_PARTS, folders.ledger)


def _store(rows: DataFrame, folders: LedgerFolders, place: Place) -> None:
    """Write a batch's ledger rows by day; only the partitions of this batch are replaced."""
    parts = rows.withColumns({"processed_date": F.to_date("processed_at"), "run_id": F.lit(place.run_id),
                              "batch_id": F.lit(place.batch_id)})
    # Even-sized files per day: a large day is split over tasks, small ones share one.
    (parts.hint("rebalance", "processed_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("processed_date", "run_id", "batch_id").parquet(folders.ledger))


def persist_batch(batch: DataFrame, place: Place, folders: LedgerFolders, notify: bool = True) -> None:
    """Insert a micro-batch, then derive notifications and dead letters from its labels.

    The records are decoded once and the labels computed once; both are written and read back
    by columns, so that the executors hold nothing of a batch, however large it is. Rows this
    batch stored in an earlier attempt are left out of the comparison, so a retry gives the
    same result.
    """
    if batch.isEmpty():
        return
    batch = batch.drop("key")
    batch_folder(batch, folders.arrived, place)
    arrived = batch_read(batch.sparkSession, batch.schema, folders.arrived, place)
    _persist_rows(arrived, arrived.count(), place, folders, notify)


def _persist_rows(batch: DataFrame, rows: int, place: Place, folders: LedgerFolders, notify: bool) -> None:
    spark = batch.sparkSession
    good = batch.filter(~F.col("undecodable")).drop("undecodable")
    others = stored_ledger(spark, folders).filter(place.is_other())
    labelled = persist(good, narrowed(others, good, rows)).labelled
    batch_folder(labelled, folders.labelled, place)
    done = batch_read(spark, labelled.schema, folders.labelled, place)
    _store(ledger_rows(done.filter(F.col("disposition") == INSERTED), F.col("processed_at")), folders, place)
    if notify:
        told = webhooks.dispatch(webhooks.ledger_updates(done))
        batch_folder(encoded(told, schemas.WEBHOOK_WIRE, "callback_url"), folders.webhooks, place)
    broken = batch.filter("undecodable").withColumn("copy_no", F.col("copy_no").cast("int"))
    letters = deadletter.log_letters(done).unionByName(deadletter.undecodable_letters(broken, fixed.LOG_STREAM))
    batch_folder(letters, folders.letters, place)


def ledger_arrived(log: DataFrame, folders: LedgerFolders, notify: bool = True) -> DataFrame:
    """Persist everything that has arrived on the log and return the whole ledger."""
    spark = log.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        persist_batch(batch, Place.of(batch, batch_id), folders, notify)

    drain(spark, log.writeStream.foreachBatch(step), folders.checkpoint)
    return stored_ledger(spark, folders).select(*schemas.LEDGER.fieldNames())


def replay(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> tuple[DataFrame, Observation]:
    """Ledger rebuilt from the whole retained log, first record to last.

    No notifications are sent again. The observation counts the records read once the
    result has been written.
    """
    read = Observation("replay")
    records = positioned(record_batch(spark, path, RECORD, fmt, **options)).observe(read, F.count(F.lit(1)).alias("records"))
    good = kept(decoded(records, schemas.LOG_WIRE), ~F.col("undecodable")).drop("undecodable", "value", "key")
    return replayed(good), read


def replay_into(spark: SparkSession, path: str, folders: LedgerFolders, fmt: str = "parquet",
                **options) -> tuple[DataFrame, int]:
    """The whole retained log put into a ledger that exists, and the number of records read.

    It takes the way of a micro-batch, as a run of its own: what is stored is skipped, only
    what is absent enters. No notifications are sent again.
    """
    records = decoded(positioned(record_batch(spark, path, RECORD, fmt, **options)), schemas.LOG_WIRE)
    place = Place(f"replay-{uuid.uuid4().hex}", 0)
    persist_batch(records, place, folders, notify=False)
    read = record_batch(spark, path, RECORD, fmt, **options).count()
    return stored_ledger(spark, folders).select(*schemas.LEDGER.fieldNames()), read


def audit_arrived(log: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append one document per arrived log record, by day, and return all documents."""
    good = kept(log, ~F.col("undecodable"))
    docs = audit.documents(good, F.col("processed_at"))
    by_day = docs.withColumn("processed_date", F.to_date("processed_at"))
    sink = by_day.writeStream.format("parquet").partitionBy("processed_date").option("path", path)
    drain(log.sparkSession, sink.outputMode("append"), checkpoint)
    return stored_or_empty(log.sparkSession, by_day.schema, path)
