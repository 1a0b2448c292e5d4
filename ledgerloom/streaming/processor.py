"""The processor as one stream: requests in, log events, notifications and dead letters out.

A micro-batch of request records is decoded and judged once and written under its place; what
is valid is folded onto the stored holds, and everything else the job emits is read from these
two tables. A retried batch therefore replaces all its outputs, and none is written twice.

    records -> judged -+- undecodable -> dead letter, nobody can be told
                       +- invalid     -> dead letter, REJECTED
                       +- valid -> holds -+- PROCESSED          -> log event, ACCEPTED
                                          +- DUPLICATE_REPLAY   -> ACCEPTED
                                          +- DUPLICATE_REJECTED -> REJECTED
                                          +- came too late      -> dead letter, FAILED

State and outputs commit together, so that a request whose batch fails half-way is judged
again from the start and not taken for its own replay.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed, schemas
from ..operators import deadletter, webhooks
from ..operators.hold import ACQUIRED, HELD, HOLDER
from ..operators.idempotency import accepted_log, outcome
from ..operators.validate import terminal_status
from ..sources.records import decoded, encoded, positioned, record_stream
from ..sources.sinks import publish_records
from ..sources.tables import stored_or_empty
from .idempotency import HoldFolders, Rule, fold_batch, key_rule
from .log import POSITION
from .runs import PLACE_FIELDS, Place, batch_folder, batch_read, drain

RECORD = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("value", T.StringType()),
    T.StructField("seq", T.LongType()), T.StructField("delivery_no", T.IntegerType()),
    T.StructField("source_partition", T.LongType())])

# A decoded record with what broke it; null for a good one.
JUDGED = T.StructType([
    *[f for f in RECORD.fields if f.name != "key"],
    *[T.StructField(name, schemas.wire_schema(schemas.REQUEST_WIRE)[field].dataType)
      for field, name in schemas.REQUEST_WIRE.items()],
    T.StructField("undecodable", T.BooleanType()), T.StructField("reason", T.StringType())])
LABELLED = T.StructType([*JUDGED.fields, T.StructField(ACQUIRED, T.BooleanType()),
                         T.StructField(HOLDER, T.StringType()), T.StructField(HELD, T.TimestampType())])

INVALID, UNDECODABLE, LATE = "INVALID", "UNDECODABLE", "LATE"
TOO_LATE = "arrived after a later request of its key"


@dataclass(frozen=True)
class ProcessorFolders:
    """Where the processor keeps what it has judged, its holds, and what it sends on."""

    root: str

    @property
    def judged(self) -> str:
        return f"{self.root}/judged"

    @property
    def duplicates(self) -> HoldFolders:
        return HoldFolders(f"{self.root}/duplicates")

    @property
    def log(self) -> str:
        return f"{self.root}/{fixed.LOG_STREAM}"

    @property
    def webhooks(self) -> str:
        return f"{self.root}/{fixed.WEBHOOK_STREAM}"

    @property
    def letters(self) -> str:
        return f"{self.root}/{fixed.REQUEST_STREAM}{fixed.DEAD_LETTER_SUFFIX}"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"


def publish_raw(records: DataFrame, path: str) -> None:
    """Append request records as they were sent, whatever they hold."""
    publish_records(records.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in records.columns
                                     else F.lit(None).cast(f.dataType).alias(f.name) for f in RECORD.fields]), path)


def consume(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return decoded(positioned(record_stream(spark, path, RECORD, fmt, **options)), schemas.REQUEST_WIRE)


def _late_letters(late: DataFrame) -> DataFrame:
    return deadletter.dead_letter(late, fixed.REQUEST_STREAM, F.lit(TOO_LATE), F.lit("late"), F.col("value"), F.lit(0))


def process_batch(batch: DataFrame, place: Place, folders: ProcessorFolders, rule: Rule) -> None:
    """Judge a micro-batch, fold its valid requests, and write what follows from either."""
    spark, holds = batch.sparkSession, folders.duplicates
    batch_folder(deadletter.classified_requests(batch).select(*JUDGED.fieldNames()), folders.judged, place)
    judged = batch_read(spark, JUDGED, folders.judged, place)
    fold_batch(judged.filter("reason IS NULL"), rule, holds, place)
    done = _with_outcome(batch_read(spark, LABELLED, holds.labelled, place))
    late = batch_read(spark, JUDGED, holds.late, place)
    log = accepted_log(done).join(done.select("seq", "delivery_no", "source_partition"), ["seq", "delivery_no"])
    # Requests and log are keyed by account alike, so an event stays in its partition.
    batch_folder(encoded(log.withColumn("copy_no", F.lit(0)), schemas.LOG_WIRE, "account_id", POSITION), folders.log, place)
    invalid = judged.filter("reason IS NOT NULL AND NOT undecodable")
    failed = webhooks.status_update(late, webhooks.PROCESSOR, F.lit("FAILED"), F.col("created_at"), F.lit(0))
    told = webhooks.dispatch(webhooks.outcome_updates(done), webhooks.invalid_updates(invalid), failed)
    batch_folder(encoded(told, schemas.WEBHOOK_WIRE, "callback_url"), folders.webhooks, place)
    batch_folder(deadletter.request_letters(judged).unionByName(_late_letters(late)), folders.letters, place)


def _with_outcome(held: DataFrame) -> DataFrame:
    return held.withColumn("outcome", outcome(F.col(ACQUIRED), F.col(HOLDER)))


def processed_arrived(records: DataFrame, folders: ProcessorFolders, ttl_hours: int = fixed.IDEMPOTENCY_TTL_HOURS,
                      scope: Sequence[str] = ("idempotency_key",)) -> DataFrame:
    """Process everything that has arrived; returns what became of every record so far."""
    rule = key_rule(ttl_hours, scope)

    def step(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            process_batch(batch, Place.of(batch, batch_id), folders, rule)

    drain(records.sparkSession, records.writeStream.foreachBatch(step), folders.checkpoint)
    return dispositions(records.sparkSession, folders)


def dispositions(spark: SparkSession, folders: ProcessorFolders) -> DataFrame:
    """One row per record: its outcome, the status told to the caller, and what broke it.

    The outcome is that of the duplicate check, or INVALID, UNDECODABLE or LATE. Records that
    nobody can be told about have no status.
    """
    def stored(schema: T.StructType, path: str) -> DataFrame:
        return stored_or_empty(spark, T.StructType([*schema.fields, *PLACE_FIELDS]), path)

    def rows(df: DataFrame, label, status, reason) -> DataFrame:
        return df.select("seq", "delivery_no", F.when(~F.col("undecodable"), F.col("transaction_id")).alias("transaction_id"),
                         label.alias("outcome"), status.alias("status"), reason.alias("reason"))

    done = _with_outcome(stored(LABELLED, folders.duplicates.labelled))
    accepted = F.when(F.col("outcome") == fixed.DUPLICATE_REJECTED, "REJECTED").otherwise("ACCEPTED")
    broken = stored(JUDGED, folders.judged).filter("reason IS NOT NULL")
    kind = F.when(F.col("undecodable"), UNDECODABLE).otherwise(INVALID)
    status = terminal_status(F.when(F.col("undecodable"), "undecodable").otherwise("validation"))
    late = stored(JUDGED, folders.duplicates.late)
    return (rows(done, F.col("outcome"), accepted, F.lit(None).cast("string"))
            .unionByName(rows(broken, kind, status, F.col("reason")))
            .unionByName(rows(late, F.lit(LATE), F.lit("FAILED"), F.lit(TOO_LATE))))
