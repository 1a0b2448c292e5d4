"""Auditing signed requests and guarding their nonces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.clock import instant, skew_seconds
from ..functions.signing import body_hash, signature
from ..functions.text import blank
from .hold import ACQUIRED, hold

HEADERS = ("merchant_id", "ts_header", "nonce", "verify", "idem_header")
ARRIVAL = ("seq", "delivery_no")


def _known(requests: DataFrame, merchants: DataFrame) -> DataFrame:
    """Requests with their merchant's salt; ``merchants`` is configuration,
    which Spark broadcasts by its size."""
    return requests.join(merchants, "merchant_id", "left").withColumn(
        "_sent", instant(F.col("ts_header")))


def _before_nonce(allowed_skew: int) -> Column:
    """First failure of the checks that precede the nonce check."""
    missing = blank(F.col(HEADERS[0]))
    for name in HEADERS[1:]:
        missing = missing | blank(F.col(name))
    return (
        F.when(missing, fixed.HEADERS_MISSING)
        .when(blank(F.col("salt")) | blank(F.col("salt_index")), fixed.MERCHANT_UNKNOWN)
        .when(F.col("_sent").isNull(), fixed.TIMESTAMP_INVALID)
        .when(skew_seconds(F.col("received_at"), F.col("_sent")) > allowed_skew, fixed.TIMESTAMP_SKEWED)
    )


def _wrong_signature() -> Column:
    expected = signature(F.col("body"), F.col("path"), F.col("ts_header"), F.col("nonce"),
                         F.col("idem_header"), F.col("salt"), F.col("salt_index"))
    return expected != F.col("verify")


def audit(requests: DataFrame, merchants: DataFrame, allowed_skew: int = fixed.ALLOWED_SKEW_SECONDS) -> DataFrame:
    """Verdict of every request with the nonce check off, its default.

    ``key_mismatch`` tells that header and body carry different idempotency keys, which
    the verdict ignores.
    """
    known = _known(requests, merchants)
    verdict = F.coalesce(_before_nonce(allowed_skew),
                         F.when(_wrong_signature(), fixed.SIGNATURE_INVALID), F.lit(fixed.SIGNATURE_OK))
    mismatch = F.coalesce(F.col("idem_header") != F.col("body_key"), F.lit(False))
    return known.select(*ARRIVAL, "merchant_id", verdict.alias("verdict"), mismatch.alias("key_mismatch"))


def checked(requests: DataFrame, merchants: DataFrame, allowed_skew: int = fixed.ALLOWED_SKEW_SECONDS) -> DataFrame:
    """Requests with ``_early``, the first failure before the nonce check, and ``_wrong``, whether
    the signature is."""
    known = _known(requests, merchants).withColumn("_early", _before_nonce(allowed_skew)).withColumn(
        "_wrong", F.coalesce(_wrong_signature(), F.lit(False)))
    return known.select(*requests.columns, "_early", "_wrong")


def after_nonce(accepted: Column) -> Column:
    """Verdict of a request that has passed the checks before the nonce check."""
    return (F.when(~accepted, fixed.NONCE_REPLAYED)
            .when(F.col("_wrong"), fixed.SIGNATURE_INVALID).otherwise(fixed.SIGNATURE_OK))


def nonce_audit(requests: DataFrame, merchants: DataFrame, allowed_skew: int = fixed.ALLOWED_SKEW_SECONDS,
                ttl_minutes: int = fixed.NONCE_TTL_MINUTES, fold_rows: int | None = None) -> DataFrame:
    """Verdicts with the nonce check on.

    Only requests that pass the earlier checks use up their nonce, even if their
    signature turns out wrong.
    """
    columns = (*ARRIVAL, "merchant_id", "nonce", "received_at", "_early", "_wrong")
    judged = checked(requests, merchants, allowed_skew).select(*columns)
    failed = judged.filter(F.col("_early").isNotNull()).select(
        *ARRIVAL, "merchant_id", "nonce", F.col("_early").alias("verdict"))
    guarded = hold(judged.filter(F.col("_early").isNull()), ["merchant_id", "nonce"], "received_at",
                   ARRIVAL, "seq", ttl_minutes * 60, fold_rows)
    verdict = after_nonce(F.col(ACQUIRED))
    return failed.unionByName(guarded.select(*ARRIVAL, "merchant_id", "nonce", verdict.alias("verdict")))


def hashed_bodies(requests: DataFrame) -> DataFrame:
    return requests.select(*ARRIVAL, body_hash(F.col("body")).alias("body_hash"))
