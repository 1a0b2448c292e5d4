"""Terminal failures: their dead-letter records and the status that is reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..schemas import LOG_WIRE
from ..sources.records import kept
from .ledger import FAILED
from .validate import first_failure, terminal_status

UNDECODABLE = "undecodable payload"


def dead_letter(df: DataFrame, stream: str, reason: Column, reason_class: Column, payload: Column,
                copy_no: Column) -> DataFrame:
    """Records of a stream's dead-letter topic: same partition, original payload."""
    return df.select(
        F.lit(stream + fixed.DEAD_LETTER_SUFFIX).alias("topic"), "source_partition",
        "seq", "delivery_no", copy_no.cast("int").alias("copy_no"), reason.alias("reason"),
        terminal_status(reason_class).alias("status"), payload.alias("payload"))


def classified_requests(decoded: DataFrame) -> DataFrame:
    """Decoded request records with ``reason``; null for the good ones."""
    reason = F.when(F.col("undecodable"), UNDECODABLE).otherwise(first_failure())
    return decoded.withColumn("reason", reason)


def request_letters(classified: DataFrame) -> DataFrame:
    kind = F.when(F.col("undecodable"), "undecodable").otherwise("validation")
    return dead_letter(kept(classified, F.col("reason").isNotNull()), fixed.REQUEST_STREAM,
                       F.col("reason"), kind, F.col("value"), F.lit(0))


def log_letters(labelled: DataFrame) -> DataFrame:
    body = F.to_json(
        F.struct(*[F.col(name).alias(field) for field, name in LOG_WIRE.items()]),
        {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"})
    # The record as it was sent, where it is known.
    sent = F.coalesce("value", body) if "value" in labelled.columns else body
    return dead_letter(labelled.filter(F.col("disposition") == FAILED), fixed.LOG_STREAM,
                       F.col("reason"), F.lit("persistence"), sent, F.col("copy_no"))


def undecodable_letters(broken: DataFrame, stream: str) -> DataFrame:
    return dead_letter(broken, stream, F.lit(UNDECODABLE), F.lit("undecodable"), F.col("value"), F.col("copy_no"))
