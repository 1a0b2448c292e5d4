"""Literal rows for the tests."""

from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

T0 = datetime(2026, 3, 20, 12, 0, 0)

REQUEST = ("seq bigint, delivery_no int, event_id string, transaction_id string, idempotency_key string, "
           "merchant_id string, account_id string, amount decimal(38,18), currency string, type string, "
           "callback_url string, correlation_id string, created_at timestamp")
LOG = ("seq bigint, delivery_no int, copy_no int, event_id string, transaction_id string, idempotency_key string, "
       "merchant_id string, account_id string, amount decimal(38,18), currency string, type string, status string, "
       "callback_url string, correlation_id string, processed_at timestamp")


def request(seq, **changes):
    row = dict(seq=seq, delivery_no=0, event_id=f"ev-{seq}", transaction_id=f"tx-{seq}", idempotency_key=f"idem-{seq}",
               merchant_id="merchant-1", account_id="acct-1", amount=Decimal("10.00"), currency="USD", type="DEBIT",
               callback_url="https://merchant.example/webhook", correlation_id=f"corr-{seq}",
               created_at=T0 + timedelta(seconds=seq))
    row.update(changes)
    return row


def log_event(seq, **changes):
    row = dict(seq=seq, delivery_no=0, copy_no=0, event_id=f"ev-{seq}", transaction_id=f"tx-{seq}",
               idempotency_key=f"idem-{seq}", merchant_id="merchant-1", account_id="acct-1", amount=Decimal("12.34"),
               currency="USD", type="CREDIT", status="ACCEPTED", callback_url=None, correlation_id=f"corr-{seq}",
               processed_at=T0 + timedelta(seconds=seq))
    row.update(changes)
    return row


def frame(spark, schema, rows):
    names = [part.split()[0] for part in schema.replace("decimal(38,18)", "decimal").split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def requests(spark, *rows):
    return frame(spark, REQUEST, rows)


def log(spark, *rows):
    return frame(spark, LOG, rows)


def by_seq(df, *columns):
    return {r["seq"]: (r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns)) for r in df.collect()}


def at(text):
    return F.lit(text).cast("timestamp")
