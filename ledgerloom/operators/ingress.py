"""Request bodies become request events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions.ids import correlation, derived_id
from ..schemas import CREATE_BODY, MONEY
from ..sources.records import CORRUPT


def parsed_bodies(bodies: DataFrame) -> DataFrame:
    """Columns of the JSON body; either spelling of the callback address is taken.

    ``unreadable`` marks bodies of bad syntax, wrong types or an unknown transaction type.
    """
    j = F.from_json("body", T.StructType([*CREATE_BODY.fields, T.StructField(CORRUPT, T.StringType())]),
                    {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    parsed = bodies.withColumn("_j", j)
    field = lambda name: F.col("_j")[name]
    unknown = F.coalesce(~field("type").isin(*fixed.TRANSACTION_TYPES), F.lit(False))
    return parsed.select(
        *[c for c in bodies.columns if c != "body"],
        field("idempotencyKey").alias("idempotency_key"), field("accountId").alias("account_id"),
        field("amount").alias("amount"), field("currency").alias("currency"), field("type").alias("type"),
        F.coalesce(field("callbackUrl"), field("callback_url")).alias("callback_url"),
        (F.col("_j").isNull() | field(CORRUPT).isNotNull() | unknown).alias("unreadable"))


def request_events(bodies: DataFrame) -> DataFrame:
    """Request events of accepted bodies; ids derive from the delivery, not from chance."""
    return events_of(parsed_bodies(bodies))


def events_of(parsed: DataFrame) -> DataFrame:
    identity = (F.col("seq"), F.col("delivery_no"))
    return parsed.select(
        "seq", "delivery_no",
        derived_id("event", *identity).alias("event_id"),
        derived_id("transaction", *identity).alias("transaction_id"),
        "idempotency_key", F.col("merchant_header").alias("merchant_id"), "account_id",
        F.col("amount").cast(MONEY).alias("amount"), "currency", "type", "callback_url",
        correlation(F.col("correlation_header"), derived_id("correlation", *identity)).alias("correlation_id"),
        F.col("received_at").alias("created_at"), F.lit("RECEIVED").alias("response_status"))
