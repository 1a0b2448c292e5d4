"""Transaction data derived from the given tables.

The ``events`` table becomes requests, signed requests, read calls and load results; the
``customer`` table becomes stored read-access settings. Every row of a table is used, in
one scan each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions.ids import bucketed_account, derived_id
from ..functions.signing import signature
from ..functions.text import last_per_key, pairs, items, whole_number
from ..operators.ledger import Persisted, persist
from ..operators.idempotency import accepted_log, classify
from ..operators.validate import valid
from ..session import prepare
from ..sources.tables import EVENTS, CUSTOMER, table

ORDER = ("seq", "delivery_no")

# Read-access settings used by the limiter and the status lookup.
READ_WINDOW_SECONDS = 21_600
READ_DEFAULT_LIMIT = 2
READ_API_KEYS = ",".join(f"key-{n}" for n in range(16))
READ_LIMITS = "key-1:5, key-2:bad, key-3:1, broken, key-4:, key-3:4"
READ_MERCHANTS = ("key-1:merchant-1|merchant-2,key-2:,missing,key-3:merchant-3||merchant-4,"
                  "key-5:merchant-0|merchant-5|merchant-6")


def nth(column: str, every: int, rest: int) -> Column:
    return F.col(column) % every == rest


def from_events(events: DataFrame) -> DataFrame:
    """Requests with the faults and redeliveries the checks must find."""
    copies = F.when(nth("event_id", 97, 5), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    e = events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.regexp_extract("props", "([0-9]+)", 1).alias("k"), F.explode(copies).alias("delivery_no"))
    user = F.col("user_id").cast("string")
    merchant = (F.col("user_id") % 7).cast("string")
    transaction = F.concat(F.lit("tx-"), F.col("event_id").cast("string"))
    return e.select(
        F.col("event_id").alias("seq"),
        "delivery_no",
        derived_id("requested", transaction).alias("event_id"),
        transaction.alias("transaction_id"),
        F.when(~nth("event_id", 107, 2), F.concat(F.lit("idem-"), user, F.lit("-"), "k")).alias("idempotency_key"),
        F.when(~nth("event_id", 127, 6), F.concat(F.lit("merchant-"), merchant)).alias("merchant_id"),
        F.when(nth("event_id", 103, 1), "  ").otherwise(
            bucketed_account(F.col("user_id"), 100_000_000)).alias("account_id"),
        F.when(nth("event_id", 101, 0), -F.col("value")).otherwise(F.col("value"))
        .cast("decimal(18,2)").alias("amount"),
        F.when(nth("event_id", 109, 3), "").when(nth("user_id", 3, 0), "INR")
        .when(nth("user_id", 3, 1), "USD").otherwise("EUR").alias("currency"),
        F.when(nth("event_id", 113, 4), F.lit(None)).when(F.col("event_type") == "purchase", "DEBIT")
        .when(F.col("event_type") == "view", "REFUND").when(F.col("event_type") == "signup", "REVERSAL")
        .otherwise("CREDIT").alias("type"),
        F.when(nth("user_id", 4, 0), F.lit(None)).when(nth("user_id", 4, 1), "   ")
        .otherwise(F.concat(F.lit("https://merchant-"), merchant, F.lit(".example/webhook"))).alias("callback_url"),
        F.concat(F.lit("corr-"), F.col("event_id").cast("string")).alias("correlation_id"),
        (F.col("ts") + F.make_dt_interval(mins=F.col("delivery_no"))).alias("created_at"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(prepare(spark), sf_dir, EVENTS))


def valid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid(requests(spark, sf_dir))


# Columns the duplicate check itself reads, and those of a log event.
CHECKED = ("seq", "delivery_no", "transaction_id", "idempotency_key", "created_at")
LOGGED = (*CHECKED, "merchant_id", "account_id", "amount", "currency", "type", "callback_url", "correlation_id")
TOLD = (*CHECKED, "callback_url", "correlation_id")


def outcomes(spark: SparkSession, sf_dir: str, columns: Sequence[str] = LOGGED) -> DataFrame:
    """Classified requests; only ``columns`` travel through the shuffle."""
    return classify(valid_requests(spark, sf_dir).select(*columns))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted_log(outcomes(spark, sf_dir))


def redelivered(events: DataFrame) -> DataFrame:
    """The log as consumers see it: some events arrive twice."""
    twice = F.when(nth("seq", 89, 8), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return events.withColumn("copy_no", F.explode(twice))


def delivered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redelivered(log(spark, sf_dir))


def persisted(spark: SparkSession, sf_dir: str) -> Persisted:
    """The whole delivered log written into an empty ledger."""
    return persist(delivered_log(spark, sf_dir))


def eligible(events: DataFrame) -> DataFrame:
    """Log rows an empty ledger takes when each event is delivered once."""
    return persist(events.withColumn("copy_no", F.lit(0))).new


def json_text(name: str, column: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f'"{name}":"'), column, F.lit('"')), F.lit(f'"{name}":null'))


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request records as text: some cut short, some with a bad amount or type."""
    r = requests(spark, sf_dir)
    stamp = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    amount = F.when(nth("seq", 37, 3), '"ten"').otherwise(F.col("amount").cast("string"))
    kind = F.when(nth("seq", 41, 5), "TRANSFER").otherwise(F.col("type"))
    whole = F.concat(
        F.lit("{"), json_text("transactionId", F.col("transaction_id")),
        F.lit(","), json_text("idempotencyKey", F.col("idempotency_key")),
        F.lit(","), json_text("merchantId", F.col("merchant_id")),
        F.lit(","), json_text("accountId", F.col("account_id")),
        F.lit(',"amount":'), amount,
        F.lit(","), json_text("currency", F.col("currency")),
        F.lit(","), json_text("type", kind),
        F.lit(","), json_text("callbackUrl", F.col("callback_url")),
        F.lit(","), json_text("correlationId", F.col("correlation_id")),
        F.lit(","), json_text("createdAt", stamp), F.lit("}"))
    value = F.when(nth("seq", 31, 0), F.expr("substr(whole, 1, length(whole) - 1)")).otherwise(F.col("whole"))
    return r.select("seq", "delivery_no", (F.col("seq") % fixed.STREAM_PARTITIONS).alias("source_partition"),
                    whole.alias("whole")).select("seq", "delivery_no", "source_partition", value.alias("value"))


def _create_body() -> Column:
    """The JSON body of a request; the callback address alternates between its two spellings."""
    def body(address: str) -> Column:
        return F.concat(
            F.lit("{"), json_text("idempotencyKey", F.col("idempotency_key")),
            F.lit(","), json_text("accountId", F.col("account_id")),
            F.lit(',"amount":'), F.col("amount").cast("string"),
            F.lit(","), json_text("currency", F.col("currency")),
            F.lit(","), json_text("type", F.col("type")),
            F.lit(","), json_text(address, F.col("callback_url")), F.lit("}"))

    return F.when(nth("seq", 2, 0), body("callbackUrl")).otherwise(body("callback_url"))


def _correlation_header() -> Column:
    return F.when(nth("seq", 5, 0), F.lit(None)).when(nth("seq", 5, 1), " ").otherwise(F.col("correlation_id"))


def create_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingress bodies with their headers."""
    return requests(spark, sf_dir).select(
        "seq", "delivery_no", F.col("merchant_id").alias("merchant_header"),
        _correlation_header().alias("correlation_header"), _create_body().alias("body"),
        F.col("created_at").alias("received_at"))


def signing_config(spark: SparkSession) -> DataFrame:
    """Salts of the merchants that may sign; merchant-6 has none, merchant-5 a blank one."""
    return spark.range(6).select(
        F.concat(F.lit("merchant-"), F.col("id").cast("string")).alias("merchant_id"),
        F.when(F.col("id") == 5, " ").otherwise(
            F.concat(F.lit("salt-merchant-"), F.col("id").cast("string"))).alias("salt"),
        F.lit("1").alias("salt_index"))


def _signed(requests: DataFrame, body: Column, *more: Column) -> DataFrame:
    """Requests with signature headers; some come late, some with a wrong stamp or signature."""
    sent = F.col("created_at") - F.make_dt_interval(mins=F.col("delivery_no"))
    stamp = F.when(nth("seq", 19, 3), "not-a-time").otherwise(F.date_format(sent, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    signed = requests.select(
        "seq", "delivery_no", "merchant_id",
        F.concat(F.lit("nonce-"), (F.col("seq") % 5000).cast("string")).alias("nonce"),
        F.col("idempotency_key").alias("idem_header"),
        F.lit("/api/v1/transactions").alias("path"), body.alias("body"), stamp.alias("ts_header"),
        F.when(nth("seq", 17, 2), F.col("created_at") + F.expr("INTERVAL 121 SECOND"))
        .otherwise(F.col("created_at")).alias("received_at"), *more)
    right = signature(F.col("body"), F.col("path"), F.col("ts_header"), F.col("nonce"), F.col("idem_header"),
                      F.concat(F.lit("salt-"), "merchant_id"), F.lit("1"))
    return signed.withColumn("verify", F.when(nth("seq", 11, 4), "WRONG###1").otherwise(right))


def signed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"accountId":"'), F.col("account_id"), F.lit('","amount":'),
                    F.col("amount").cast("string"), F.lit(',"note":"' + "x" * 60 + '"}'))
    key = F.when(nth("seq", 13, 7), F.concat(F.lit("other-"), "idempotency_key")).otherwise(F.col("idempotency_key"))
    return _signed(requests(spark, sf_dir), body, key.alias("body_key"))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed calls with the bodies that create transactions."""
    return _signed(requests(spark, sf_dir), _create_body(), _correlation_header().alias("correlation_header"),
                   (F.col("seq") % fixed.STREAM_PARTITIONS).alias("source_partition"))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_from(table(prepare(spark), sf_dir, EVENTS))


def calls_from(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.when(~nth("event_id", 61, 0), F.concat(F.lit("key-"), (F.col("user_id") % 20).cast("string"))).alias("api_key"),
        F.concat(F.lit("tx-"), (F.col("event_id") + F.col("event_id") % 3 * 1_000_000).cast("string"))
        .alias("transaction_id"))


def load_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(prepare(spark), sf_dir, EVENTS)
    return e.select("event_id", F.when(F.col("event_type") == "error", 503).otherwise(202).alias("status"),
                    F.col("value").alias("duration_ms"))


def stored_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored read-access hash per customer; a null column is a field not stored."""
    c = table(prepare(spark), sf_dir, CUSTOMER)
    n = F.col("c_custkey")

    def number(mod: int) -> Column:
        return (n % mod).cast("string")

    return c.select(
        n.alias("tenant_id"),
        F.when(nth("c_custkey", 6, 1), F.lit(None)).when(nth("c_custkey", 6, 2), "  ").otherwise(
            F.concat(F.lit(" key-"), number(5), F.lit(", key-"), number(7), F.lit(",, \tkey-"), number(5), F.lit(" ,")))
        .alias("api_keys"),
        F.when(nth("c_custkey", 8, 3), F.lit(None)).otherwise(
            F.concat(F.lit("key-1:"), number(9), F.lit(", key-2:not-a-number, broken, key-4:, :7, key-5:5.0, key-"),
                     number(3), F.lit(": +"), number(4), F.lit(" ,key-6:3000000000")))
        .alias("rate_limits"),
        F.when(nth("c_custkey", 10, 4), F.lit(None)).otherwise(
            F.concat(F.lit("key-1:merchant-"), number(4), F.lit("|merchant-"), number(3),
                     F.lit(",key-2:,missing,key-3:merchant-3||merchant-"), number(6),
                     F.lit(",key-4: | ,key-"), number(2), F.lit(":merchant-9")))
        .alias("api_key_merchants"),
        F.when(nth("c_custkey", 7, 0), "60").when(nth("c_custkey", 7, 1), " 120 ").when(nth("c_custkey", 7, 2), "abc")
        .when(nth("c_custkey", 7, 3), "-5").when(nth("c_custkey", 7, 4), "5.0").when(nth("c_custkey", 7, 5), " ")
        .alias("rate_window_seconds"),
        F.when(nth("c_custkey", 5, 0), "0").when(nth("c_custkey", 5, 1), "+25").when(nth("c_custkey", 5, 2), "99999999999")
        .when(nth("c_custkey", 5, 3), number(50)).alias("default_limit_per_window"))


def limits(spark: SparkSession) -> DataFrame:
    """Per-key limits of the fixed settings, one row per key."""
    row = spark.range(1).select(F.inline(last_per_key(F.filter(
        pairs(F.lit(READ_LIMITS)), lambda p: whole_number(p["value"]).isNotNull()))))
    return row.select(F.col("key").alias("api_key"), whole_number(F.col("value")).alias("key_limit"))


def owned_merchants(spark: SparkSession) -> DataFrame:
    row = spark.range(1).select(F.inline(last_per_key(pairs(F.lit(READ_MERCHANTS)))))
    return row.select(F.col("key").alias("api_key"),
                      F.explode(items(F.col("value"), "[|]")).alias("merchant_id"))


def allowed_keys() -> list[str]:
    return READ_API_KEYS.split(",")
