"""Validation, decoding, ingress and dead letters."""

from datetime import datetime
from decimal import Decimal

import pytest
from builders import by_seq, log, log_event, request, requests
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from ledgerloom import fixed, schemas
from ledgerloom.operators import deadletter, ingress, validate
from ledgerloom.sources.records import decoded, encoded


def test_first_failure_wins_in_order(spark):
    df = requests(
        spark, request(1), request(2, amount=None, account_id=None), request(3, amount=Decimal("0")),
        request(4, account_id=" \t", idempotency_key=None), request(5, idempotency_key=" "),
        request(6, currency=""), request(7, type=None), request(8, amount=Decimal("0.001"), merchant_id=None))
    assert by_seq(validate.with_first_failure(df), "reject_reason") == {
        1: None, 2: "amount must be greater than zero", 3: "amount must be greater than zero",
        4: "accountId must not be blank", 5: "idempotencyKey must not be blank",
        6: "currency must not be blank", 7: "type must not be null", 8: None}


def test_ingress_reports_every_field(spark):
    df = requests(
        spark, request(1), request(2, amount=None, account_id="", idempotency_key=None, currency=" ", type=None,
                                   callback_url="ftp://x"),
        request(3, amount=Decimal("0.009")), request(4, callback_url=None), request(5, callback_url="https://"),
        request(6, callback_url="http://a\n"))
    found = by_seq(validate.with_field_errors(df), "field_errors")
    assert found[1] == {} and found[4] == {}
    assert found[2] == {
        "accountId": "accountId is required", "amount": "amount is required",
        "callbackUrl": "callbackUrl must be a valid http(s) URL", "currency": "currency is required",
        "idempotencyKey": "idempotencyKey is required", "type": "type is required"}
    assert found[3] == {"amount": "amount must be greater than 0"}
    assert set(found[5]) == {"callbackUrl"} and set(found[6]) == {"callbackUrl"}
    counts = {(r["field"]): r["n"] for r in validate.field_error_counts(df).groupBy("field").agg(F.sum("n").alias("n")).collect()}
    assert counts == {"accountId": 1, "amount": 2, "callbackUrl": 3, "currency": 1, "idempotencyKey": 1, "type": 1}


def test_ledger_violations(spark):
    df = log(spark, log_event(1), log_event(2, merchant_id=None), log_event(3, currency="x" * 9),
             log_event(4, amount=Decimal("1.005")), log_event(5, amount=Decimal(10) ** 17),
             log_event(6, idempotency_key="k" * 129), log_event(7, processed_at=None))
    found = by_seq(df.withColumn("v", validate.ledger_violation()), "v")
    assert found == {1: None, 2: "merchant_id is null", 3: "currency exceeds 8", 4: None, 5: "amount out of range",
                     6: "idempotency_key exceeds 128", 7: "processed_at is null"}


def test_terminal_status(spark):
    df = spark.createDataFrame([("validation",), ("undecodable",), ("persistence",)], "c string")
    assert [r[0] for r in df.select(validate.terminal_status(F.col("c"))).collect()] == ["REJECTED", None, "FAILED"]


GOOD = ('{"eventId":"e","transactionId":"t","idempotencyKey":"i","merchantId":"m","accountId":"a","amount":12.345,'
        '"currency":"USD","type":"DEBIT","callbackUrl":null,"correlationId":"c","createdAt":"2026-03-20T12:00:00Z"}')


def raw(spark):
    rows = [(1, GOOD), (2, GOOD[:-1]), (3, GOOD.replace("12.345", '"ten"')), (4, GOOD.replace("DEBIT", "TRANSFER")),
            (5, None), (6, GOOD.replace('"amount":12.345', '"amount":-1'))]
    return spark.createDataFrame([(s, 0, 2, v) for s, v in rows],
                                 "seq bigint, delivery_no int, source_partition bigint, value string")


def test_decoding_sets_broken_records_aside(spark):
    out = decoded(raw(spark), schemas.REQUEST_WIRE)
    assert by_seq(out, "undecodable") == {1: False, 2: True, 3: True, 4: True, 5: True, 6: False}
    good = out.filter("seq = 1").first()
    assert good["amount"] == Decimal("12.345") and good["created_at"] == datetime(2026, 3, 20, 12)


def test_request_letters_keep_partition_and_payload(spark):
    records = deadletter.classified_requests(decoded(raw(spark), schemas.REQUEST_WIRE))
    letters = {r["seq"]: r for r in deadletter.request_letters(records).collect()}
    assert set(letters) == {2, 3, 4, 5, 6}
    assert letters[6]["status"] == "REJECTED" and letters[6]["reason"] == fixed.AMOUNT_NOT_POSITIVE
    assert letters[3]["status"] is None and letters[3]["payload"] == GOOD.replace("12.345", '"ten"')
    assert {r["topic"] for r in letters.values()} == {"transaction_requests_dlt"}
    assert {r["source_partition"] for r in letters.values()} == {2}


def test_records_survive_encoding(spark):
    events = log(spark, log_event(1, callback_url="https://a.example"), log_event(2, amount=Decimal("0.001")))
    sent = encoded(events, schemas.LOG_WIRE, "account_id", ["seq"])
    assert {r["key"] for r in sent.collect()} == {"acct-1"}
    back = decoded(sent, schemas.LOG_WIRE)
    names = list(schemas.LOG_WIRE.values())
    assert sorted(back.select(names).collect()) == sorted(events.select(names).collect())


def test_record_without_key_is_an_error(spark):
    with pytest.raises(SparkRuntimeException, match="account_id must not be null"):
        encoded(log(spark, log_event(1, account_id=None)), schemas.LOG_WIRE, "account_id").collect()


def test_request_events(spark):
    rows = [(1, 0, "m", None, '{"accountId":"a","callback_url":"https://x","amount":1.5}'),
            (2, 0, "m", " ", '{"accountId":"a","callbackUrl":"https://y"}'), (3, 1, "m", "given", "{}")]
    df = spark.createDataFrame(rows, "seq bigint, delivery_no int, merchant_header string, correlation_header string, "
                                     "body string").withColumn("received_at", F.lit("2026-03-20").cast("timestamp"))
    once, again = (by_seq(ingress.request_events(df), "callback_url", "correlation_id", "transaction_id")
                   for _ in range(2))
    assert once == again
    assert once[1][0] == "https://x" and once[2][0] == "https://y" and once[3][:2] == (None, "given")
    assert len(once[1][1]) == 64 and once[1][1] != once[2][1]
