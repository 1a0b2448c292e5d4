"""The ingress as one stream: each call gets one answer, accepted ones one event."""

import base64
import hashlib
from datetime import timedelta

from builders import T0
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.operators import signatures
from ledgerloom.sources import records
from ledgerloom.sources.records import decoded, record_stream
from ledgerloom.streaming import ingress, processor
from ledgerloom.streaming.runs import Place

GOOD = ('{"idempotencyKey":"k%d","accountId":"acct-1","amount":10.5,"currency":"USD","type":"DEBIT",'
        '"callback_url":"https://a.example"}')


def call(seq, **changes):
    row = dict(seq=seq, delivery_no=0, merchant_id="m1", nonce=f"n{seq}", idem_header=f"k{seq}", path="/api/v1/transactions",
               body=GOOD % seq, ts_header=(T0 + timedelta(seconds=seq)).strftime("%Y-%m-%dT%H:%M:%SZ"), verify=None,
               correlation_header=None, received_at=T0 + timedelta(seconds=seq), source_partition=seq % 6)
    row.update(changes)
    if row["verify"] is None and row["body"] is not None:
        text = base64.b64encode(row["body"].encode()).decode() + row["path"] + row["ts_header"] + row["nonce"] + str(row["idem_header"]) + "salt"
        row["verify"] = hashlib.sha256(text.encode()).hexdigest().upper() + "###1"
    return tuple(row[f.name] for f in ingress.CALL.fields)


def mixture():
    return [call(1), call(2, nonce="n1"), call(3, verify="WRONG###1"), call(4, merchant_id="m9"), call(5, merchant_id="m2"),
            call(6, ts_header="yesterday"), call(7, received_at=T0 + timedelta(seconds=7 + 121)), call(8, idem_header=" "),
            call(9, body="{"), call(10, body='{"amount":"ten"}'), call(11, body='{"type":"GIFT","amount":1}'),
            call(12, body='{"amount":0,"callbackUrl":"ftp://x"}'), call(13, body=None, verify="x"),
            call(14, nonce="n3"), call(15, nonce="n1", received_at=T0 + timedelta(seconds=15 + 100))]


def merchants(spark):
    return spark.createDataFrame([("m1", "salt", "1"), ("m2", " ", "1")], "merchant_id string, salt string, salt_index string")


def run(spark, tmp_path, parts, name="in", **how):
    folders = ingress.IngressFolders(str(tmp_path / f"{name}-root"))
    for rows in parts:
        spark.createDataFrame(rows, ingress.CALL).write.mode("append").parquet(str(tmp_path / name))
        done = ingress.ingested_arrived(record_stream(spark, str(tmp_path / name), ingress.CALL), folders, merchants(spark), **how)
    return folders, done


def told(done):
    return {r["seq"]: (r["code"], r["message"]) for r in done.collect()}


WANT = {1: (202, None), 2: (202, None), 3: (401, "Invalid signature"), 4: (401, "Unknown merchant"), 5: (401, "Unknown merchant"),
        6: (401, "Invalid timestamp format"), 7: (401, "Request timestamp outside allowed skew"),
        8: (401, "Missing required auth headers"), 9: (400, "Unreadable body"), 10: (400, "Unreadable body"),
        11: (400, "Unreadable body"), 12: (400, "Validation failed"), 13: (401, "Invalid signature"), 14: (202, None),
        15: (202, None)}


def test_answers_and_events(spark, tmp_path):
    folders, done = run(spark, tmp_path, [mixture()])
    assert told(done) == WANT
    rows = {r["seq"]: r for r in done.collect()}
    assert rows[12]["field_errors"] == {
        "accountId": "accountId is required", "amount": "amount must be greater than 0",
        "callbackUrl": "callbackUrl must be a valid http(s) URL", "currency": "currency is required",
        "idempotencyKey": "idempotencyKey is required", "type": "type is required"}
    events = {r["seq"]: r for r in decoded(spark.read.schema(processor.RECORD).parquet(folders.requests), schemas.REQUEST_WIRE).collect()}
    assert set(events) == {1, 2, 14, 15} == {s for s, r in rows.items() if r["status"] == "RECEIVED"}
    for seq, event in events.items():
        assert event["transaction_id"] == rows[seq]["transaction_id"] and event["key"] == "acct-1" == event["account_id"]
        assert (event["idempotency_key"], event["callback_url"], event["source_partition"]) == (f"k{seq}", "https://a.example", seq % 6)
        assert event["correlation_id"] and not event["undecodable"]


def test_nonces_are_guarded_over_batches(spark, tmp_path):
    rows = mixture()
    _, done = run(spark, tmp_path, [rows[:9], rows[9:]], nonce_minutes=2)
    # A wrong signature uses its nonce up (14), and 15 comes within two minutes of 1.
    assert told(done) == WANT | {2: (401, "Replay detected"), 14: (401, "Replay detected"), 15: (401, "Replay detected")}


def test_verdicts_are_those_of_the_batch_operators(spark, tmp_path):
    rows = [call(n, nonce=f"n{n % 7}", received_at=T0 + timedelta(seconds=n * 9), verify="WRONG###1" if n % 5 == 0 else None,
                 ts_header=(T0 + timedelta(seconds=n * 9)).strftime("%Y-%m-%dT%H:%M:%SZ")) for n in range(60)]
    _, done = run(spark, tmp_path, [rows[:30], rows[30:]], nonce_minutes=2)
    batch = signatures.nonce_audit(spark.createDataFrame(rows, ingress.CALL), merchants(spark))
    assert {s: m or "OK" for s, (_, m) in told(done).items()} == {r["seq"]: r["verdict"] for r in batch.collect()}


def test_retried_batch_replaces_its_outputs(spark, tmp_path):
    rows = mixture()
    folders, done = run(spark, tmp_path, [rows[:9], rows[9:]], nonce_minutes=2)
    outputs = (folders.answers, folders.requests, folders.nonces.holds)
    whole = lambda: [sorted(map(repr, spark.read.parquet(p).collect())) for p in outputs]
    before = whole()
    run_id = spark.read.parquet(folders.checked).first()["run_id"]
    ingress.ingest_batch(spark.createDataFrame(rows[9:], ingress.CALL), Place(run_id, 1), folders, merchants(spark), 120, 2)
    assert whole() == before


def test_events_feed_the_processor(spark, tmp_path):
    folders, done = run(spark, tmp_path, [mixture()])
    after = processor.processed_arrived(processor.consume(spark, folders.requests),
                                        processor.ProcessorFolders(str(tmp_path / "processor")))
    sent = {r["transaction_id"] for r in done.filter(F.col("code") == 202).collect()}
    assert {r["transaction_id"]: r["outcome"] for r in after.collect()} == dict.fromkeys(sent, "PROCESSED")


def test_files_out_of_time_order_are_judged_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "BYTES_PER_TRIGGER", 1, raising=False)
    used = lambda n, at: call(n, nonce="n", received_at=T0 + timedelta(seconds=at),
                              ts_header=(T0 + timedelta(seconds=at)).strftime("%Y-%m-%dT%H:%M:%SZ"))
    for rows in ([used(2, 200)], [used(1, 0), used(3, 60)]):
        spark.createDataFrame(rows, ingress.CALL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    folders = ingress.IngressFolders(str(tmp_path / "root"))
    done = ingress.ingested_arrived(record_stream(spark, str(tmp_path / "in"), ingress.CALL), folders, merchants(spark), nonce_minutes=2)
    assert told(done) == {1: (202, None), 2: (202, None), 3: (401, "Replay detected")}
    after = processor.processed_arrived(processor.consume(spark, folders.requests),
                                        processor.ProcessorFolders(str(tmp_path / "processor")))
    assert sorted(r["outcome"] for r in after.collect()) == ["PROCESSED", "PROCESSED"]
