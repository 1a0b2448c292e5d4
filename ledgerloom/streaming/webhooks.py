"""Consumer of the dispatch stream: payloads per address, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed, schemas
from ..operators.deadletter import UNDECODABLE
from ..operators.webhooks import payloads
from ..sources.records import decoded, kept, record_stream
from .runs import Place, batch_folder, drain

RECORD = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
PAYLOAD = T.StructType([
    T.StructField("callback_url", T.StringType()), T.StructField("chunk_no", T.LongType()),
    T.StructField("updates", T.LongType()), T.StructField("payload", T.StringType())])


def consume(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Decoded notifications; ``undecodable`` marks those that cannot be delivered anywhere."""
    return decoded(record_stream(spark, path, RECORD, fmt, **options), schemas.WEBHOOK_WIRE)


def letters_path(path: str) -> str:
    return f"{path}-{fixed.WEBHOOK_STREAM}{fixed.DEAD_LETTER_SUFFIX}"


def group_batch(batch: DataFrame, place: Place, path: str) -> None:
    """Payloads of one micro-batch, ordered by time and event id within an address.

    Undecodable notifications go to the dead letters of the dispatch stream, as they came.
    """
    good = kept(batch, ~F.col("undecodable"))
    ordered = good.select("callback_url", "transaction_id", "status", "correlation_id", "occurred_at", "event_id")
    batch_folder(payloads(ordered, order=("occurred_at", "event_id")), path, place)
    letters = kept(batch, F.col("undecodable")).select(
        F.lit(fixed.WEBHOOK_STREAM + fixed.DEAD_LETTER_SUFFIX).alias("topic"), "key",
        F.lit(UNDECODABLE).alias("reason"), F.col("value").alias("payload"))
    batch_folder(letters, letters_path(path), place)


def payloads_arrived(updates: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Group everything that has arrived and return all payloads so far."""
    spark = updates.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        group_batch(batch, Place.of(batch, batch_id), path)

    drain(spark, updates.writeStream.foreachBatch(step), checkpoint)
    return spark.read.schema(PAYLOAD).parquet(path)
