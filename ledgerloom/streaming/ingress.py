"""The ingress as one stream: signed calls in, answers and request events out.

A micro-batch is checked once and written under its place. Calls that pass the checks before
the nonce check are folded onto the stored nonces, where that check is on; a call then is
refused (401), broken in its body (400), or accepted (202) and published as a request event.
All outputs are read from what was written, so a retried batch replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed, schemas
from ..operators import ingress, signatures, validate
from ..operators.hold import ACQUIRED, HELD, HOLDER
from ..sources.records import encoded
from ..sources.tables import stored_or_empty
from .idempotency import HoldFolders, Rule, fold_batch
from .runs import PLACE_FIELDS, Place, batch_folder, drain

REFUSED, BROKEN, ACCEPTED = 401, 400, 202
VALIDATION_FAILED, UNREADABLE = "Validation failed", "Unreadable body"

# A signed call as it arrives: headers, body, and its place in the stream.
CALL = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("delivery_no", T.IntegerType()),
    *[T.StructField(c, T.StringType()) for c in (
        "merchant_id", "nonce", "idem_header", "path", "body", "ts_header", "verify", "correlation_header")],
    T.StructField("received_at", T.TimestampType()), T.StructField("source_partition", T.LongType())])
CHECKED = T.StructType([*CALL.fields, T.StructField("_early", T.StringType()), T.StructField("_wrong", T.BooleanType())])
GUARDED = T.StructType([*CHECKED.fields, T.StructField(ACQUIRED, T.BooleanType()),
                        T.StructField(HOLDER, T.LongType()), T.StructField(HELD, T.TimestampType())])
ANSWER = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("delivery_no", T.IntegerType()),
    T.StructField("code", T.IntegerType()), T.StructField("message", T.StringType()),
    T.StructField("field_errors", T.MapType(T.StringType(), T.StringType())),
    T.StructField("transaction_id", T.StringType()), T.StructField("status", T.StringType())])


@dataclass(frozen=True)
class IngressFolders:
    """Where the ingress keeps its checks, nonces and answers, and publishes request events."""

    root: str

    @property
    def checked(self) -> str:
        return f"{self.root}/checked"

    @property
    def nonces(self) -> HoldFolders:
        return HoldFolders(f"{self.root}/nonces")

    @property
    def answers(self) -> str:
        return f"{self.root}/answers"

    @property
    def requests(self) -> str:
        return f"{self.root}/{fixed.REQUEST_STREAM}"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"


def _nonce_rule(ttl_minutes: int) -> Rule:
    return Rule(("merchant_id", "nonce"), "received_at", signatures.ARRIVAL, "seq", ttl_minutes * 60)


def _judged(spark: SparkSession, checked: DataFrame, place: Place, folders: IngressFolders,
            nonce_minutes: int | None) -> DataFrame:
    """Calls with their verdict. A call older than the use of its nonce counts as a replay."""
    early = checked.filter("_early IS NOT NULL").withColumn("verdict", F.col("_early"))
    rest = checked.filter("_early IS NULL")
    if nonce_minutes is None:
        return early.unionByName(rest.withColumn("verdict", signatures.after_nonce(F.lit(True))))
    fold_batch(rest, _nonce_rule(nonce_minutes), folders.nonces, place)
    guarded = spark.read.schema(GUARDED).parquet(place.folder(folders.nonces.labelled))
    late = spark.read.schema(CHECKED).parquet(place.folder(folders.nonces.late))
    return (early.unionByName(guarded.withColumn("verdict", signatures.after_nonce(F.col(ACQUIRED))).drop(ACQUIRED, HOLDER, HELD))
            .unionByName(late.withColumn("verdict", F.lit(fixed.NONCE_REPLAYED))))


def _answers(judged: DataFrame) -> DataFrame:
    """Calls with parsed body, answer code, message and field errors."""
    parsed = ingress.parsed_bodies(judged.withColumn("merchant_header", F.col("merchant_id")))
    errors = F.map_from_entries(validate.field_errors())
    refused = F.col("verdict") != fixed.SIGNATURE_OK
    broken = F.col("unreadable") | (F.size(errors) > 0)

    def told(then: Column) -> Column:
        return F.when(refused, F.col("verdict")).when(F.col("unreadable"), UNREADABLE).when(F.size(errors) > 0, then)

    return parsed.withColumns({
        "code": F.when(refused, REFUSED).when(broken, BROKEN).otherwise(ACCEPTED),
        "message": told(F.lit(VALIDATION_FAILED)),
        "field_errors": F.when(~refused & ~F.col("unreadable") & (F.size(errors) > 0), errors)})


def ingest_batch(batch: DataFrame, place: Place, folders: IngressFolders, merchants: DataFrame,
                 allowed_skew: int, nonce_minutes: int | None) -> None:
    """Check a micro-batch, then write its answers and publish the events of accepted calls."""
    spark = batch.sparkSession
    batch_folder(signatures.checked(batch, merchants, allowed_skew), folders.checked, place)
    checked = spark.read.schema(CHECKED).parquet(place.folder(folders.checked))
    answered = _answers(_judged(spark, checked, place, folders, nonce_minutes))
    events = ingress.events_of(answered.filter(F.col("code") == ACCEPTED))
    told = answered.select("seq", "delivery_no", F.col("code").cast("int").alias("code"), "message", "field_errors").join(
        events.select("seq", "delivery_no", "transaction_id", F.col("response_status").alias("status")),
        ["seq", "delivery_no"], "left")
    batch_folder(told.select(*ANSWER.fieldNames()), folders.answers, place)
    # What an accepted call carries is not blank, so each event has its key.
    position = checked.select("seq", "delivery_no", "source_partition")
    placed = events.join(position, ["seq", "delivery_no"])
    batch_folder(encoded(placed, schemas.REQUEST_WIRE, "account_id", ("seq", "delivery_no", "source_partition")),
                 folders.requests, place)


def ingested_arrived(calls: DataFrame, folders: IngressFolders, merchants: DataFrame,
                     allowed_skew: int = fixed.ALLOWED_SKEW_SECONDS, nonce_minutes: int | None = None) -> DataFrame:
    """Answer everything that has arrived and return all answers so far.

    ``merchants`` holds salts by merchant. The nonce check is off unless ``nonce_minutes`` is given.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            ingest_batch(batch, Place.of(batch, batch_id), folders, merchants, allowed_skew, nonce_minutes)

    drain(calls.sparkSession, calls.writeStream.foreachBatch(step), folders.checkpoint)
    return answers(calls.sparkSession, folders)


def answers(spark: SparkSession, folders: IngressFolders) -> DataFrame:
    """One row per call: code, message, field errors, and id and status of an accepted one."""
    return stored_or_empty(spark, T.StructType([*ANSWER.fields, *PLACE_FIELDS]), folders.answers).drop("run_id", "batch_id")
