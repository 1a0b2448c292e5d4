"""Declared schemas: nothing in this package infers one."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
WIRE_AMOUNT = T.DecimalType(38, 18)


def _fields(*pairs) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in pairs])


_text = T.StringType()
_time = T.TimestampType()
_count = T.LongType()

# Bodies as a client sends them; the callback address has two spellings.
CREATE_BODY = _fields(
    ("idempotencyKey", _text), ("accountId", _text), ("amount", WIRE_AMOUNT), ("currency", _text),
    ("type", _text), ("callbackUrl", _text), ("callback_url", _text),
)

# JSON field of each stream record -> column name.
REQUEST_WIRE = {
    "eventId": "event_id", "transactionId": "transaction_id", "idempotencyKey": "idempotency_key",
    "merchantId": "merchant_id", "accountId": "account_id", "amount": "amount", "currency": "currency",
    "type": "type", "callbackUrl": "callback_url", "correlationId": "correlation_id", "createdAt": "created_at",
}
LOG_WIRE = {
    "eventId": "event_id", "transactionId": "transaction_id", "idempotencyKey": "idempotency_key",
    "merchantId": "merchant_id", "accountId": "account_id", "amount": "amount", "currency": "currency",
    "type": "type", "status": "status", "callbackUrl": "callback_url", "correlationId": "correlation_id",
    "processedAt": "processed_at",
}
WEBHOOK_WIRE = {
    "eventId": "event_id", "callbackUrl": "callback_url", "transactionId": "transaction_id",
    "status": "status", "correlationId": "correlation_id", "occurredAt": "occurred_at",
}

LEDGER = _fields(
    ("transaction_id", _text), ("idempotency_key", _text), ("merchant_id", _text), ("account_id", _text),
    ("amount", MONEY), ("currency", _text), ("type", _text), ("status", _text),
    ("processed_at", _time), ("created_at", _time),
)
AUDIT = _fields(
    ("id", _text), ("event_id", _text), ("transaction_id", _text), ("idempotency_key", _text),
    ("merchant_id", _text), ("account_id", _text), ("correlation_id", _text), ("amount", WIRE_AMOUNT),
    ("currency", _text), ("type", _text), ("status", _text), ("processed_at", _time),
    ("stored_at", _time), ("source_topic", _text),
)
RECONCILIATION_RUN = _fields(
    ("run_at", _time), ("window_start", _time), ("audit_count", _count), ("ledger_count", _count),
    ("missing_in_ledger", _count), ("status", _text), ("notes", _text),
)

SETTINGS = _fields(
    ("tenant_id", _count), ("api_keys", _text), ("rate_limits", _text), ("api_key_merchants", _text),
    ("rate_window_seconds", _text), ("default_limit_per_window", _text),
)

ACCOUNT_KEY = ("account_id", "idempotency_key")


def wire_schema(wire: dict[str, str]) -> T.StructType:
    """Schema of a stream's JSON value; amounts keep whatever scale was sent."""
    kinds = {"amount": WIRE_AMOUNT}
    return _fields(*[
        (field, kinds.get(name, _time if name.endswith("_at") else _text)) for field, name in wire.items()
    ])
