"""The processor as one stream: every record ends somewhere, once, whatever the batches."""

import json
from datetime import timedelta
from decimal import Decimal

from builders import T0, request, requests
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import schemas
from ledgerloom.operators import deadletter, webhooks
from ledgerloom.operators.idempotency import accepted_log, classify
from ledgerloom.operators.validate import first_failure, valid
from ledgerloom.sources import records as record_source
from ledgerloom.sources.records import decoded, encoded, positioned
from ledgerloom.streaming import log as log_stream
from ledgerloom.streaming import processor
from ledgerloom.streaming.idempotency import key_rule
from ledgerloom.streaming.runs import Place


def sent(spark, rows, broken=()):
    """Raw records of request rows and of ``broken`` (seq, text) pairs."""
    good = encoded(rows.withColumn("_key", F.coalesce("account_id", F.lit("none"))), schemas.REQUEST_WIRE, "_key",
                   ("seq", "delivery_no")).withColumn("source_partition", F.col("seq") % 6)
    bad = spark.createDataFrame([("none", text, seq, 0, seq % 6) for seq, text in broken], processor.RECORD)
    return good.unionByName(bad)


def mixture(spark):
    rows = [request(n, idempotency_key=f"k{n % 9}" if n % 4 else "hot", transaction_id=f"tx-{n - n % 2}",
                    amount=Decimal(-1 if n % 11 == 0 else 1), account_id=" " if n % 13 == 0 else f"acct-{n % 5}",
                    callback_url=None if n % 7 == 0 else f"https://{n % 3}.example", created_at=T0 + timedelta(hours=n))
            for n in range(90)]
    return requests(spark, *rows)


BROKEN = [(1000, "{"), (1001, '{"transactionId":"t","amount":"ten"}'), (1002, '{"type":"GIFT","amount":1}'), (1003, "")]


def run(spark, tmp_path, records, name="in", batches=1, folders=None):
    path, folders = str(tmp_path / name), folders or processor.ProcessorFolders(str(tmp_path / f"{name}-root"))
    for part in range(batches):
        step = F.least(F.floor(F.col("seq") * batches / 90), F.lit(batches - 1))
        processor.publish_raw(records.filter(step == part), path)
        done = processor.processed_arrived(processor.consume(spark, path), folders)
    return folders, done


def whole(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def by_seq(done):
    return {r["seq"]: (r["transaction_id"], r["outcome"], r["status"], r["reason"]) for r in done.collect()}


def test_every_record_ends_once(spark, tmp_path):
    rows = mixture(spark)
    _, done = run(spark, tmp_path, sent(spark, rows, BROKEN))
    got = by_seq(done)
    assert done.count() == 94 == len(got)
    want = {}
    for r in classify(valid(rows)).collect():
        told = "REJECTED" if r["outcome"] == "DUPLICATE_REJECTED" else "ACCEPTED"
        want[r["seq"]] = (r["transaction_id"], r["outcome"], told, None)
    for r in rows.withColumn("reason", first_failure()).filter("reason IS NOT NULL").collect():
        want[r["seq"]] = (r["transaction_id"], "INVALID", "REJECTED", r["reason"])
    for seq, _ in BROKEN:
        want[seq] = (None, "UNDECODABLE", None, deadletter.UNDECODABLE)
    assert got == want


def test_outputs_are_those_of_the_batch_operators(spark, tmp_path):
    rows = mixture(spark)
    folders, _ = run(spark, tmp_path, sent(spark, rows, BROKEN))
    done = classify(valid(rows))
    log = decoded(spark.read.schema(log_stream.RECORD).parquet(folders.log), schemas.LOG_WIRE)
    names = [*schemas.LOG_WIRE.values(), "seq", "delivery_no"]
    assert whole(log.select(*names)) == whole(accepted_log(done).select(*names))
    told = decoded(spark.read.parquet(folders.webhooks), schemas.WEBHOOK_WIRE).select(*schemas.WEBHOOK_WIRE.values())
    invalid = rows.filter(first_failure().isNotNull())
    same = webhooks.dispatch(webhooks.outcome_updates(done), webhooks.invalid_updates(invalid))
    assert whole(told) == whole(same.select(*told.columns))
    letters = spark.read.parquet(folders.letters).collect()
    assert {(r["seq"], r["topic"]) for r in letters} == {
        (n, "transaction_requests_dlt") for n in [r["seq"] for r in invalid.collect()] + [s for s, _ in BROKEN]}
    assert {r["seq"]: r["payload"] for r in letters if r["seq"] >= 1000} == dict(BROKEN)
    assert all(json.loads(r["payload"])["transactionId"] for r in letters if r["seq"] < 1000)


def test_several_batches_give_the_same(spark, tmp_path):
    records = sent(spark, mixture(spark), BROKEN)
    _, once = run(spark, tmp_path, records, "once")
    folders, parts = run(spark, tmp_path, records, "parts", 3)
    assert whole(once) == whole(parts)
    assert spark.read.parquet(folders.log).select("batch_id").distinct().count() == 3


def test_retried_batch_replaces_all_its_outputs(spark, tmp_path):
    records = sent(spark, mixture(spark), BROKEN)
    folders, done = run(spark, tmp_path, records, "in", 2)
    outputs = (folders.log, folders.webhooks, folders.letters, folders.judged, folders.duplicates.holds)
    before = [whole(spark.read.parquet(p)) for p in outputs] + [whole(done)]
    run_id = spark.read.parquet(folders.log).first()["run_id"]
    second = records.filter(F.col("seq") >= 45)
    batch = decoded(spark.createDataFrame(second.select(*processor.RECORD.fieldNames()).collect(), processor.RECORD),
                    schemas.REQUEST_WIRE)
    processor.process_batch(batch, Place(run_id, 1), folders, key_rule())
    after = [whole(spark.read.parquet(p)) for p in outputs] + [whole(processor.dispositions(spark, folders))]
    assert after == before


def test_requests_that_come_too_late_fail(spark, tmp_path):
    hours = {1: 0, 2: 100, 3: 47}
    folders = processor.ProcessorFolders(str(tmp_path / "root"))
    for n, h in hours.items():
        row = requests(spark, request(n, idempotency_key="k", created_at=T0 + timedelta(hours=h)))
        processor.publish_raw(sent(spark, row), str(tmp_path / "in"))
        done = processor.processed_arrived(processor.consume(spark, str(tmp_path / "in")), folders)
    assert {s: v[1:3] for s, v in by_seq(done).items()} == {
        1: ("PROCESSED", "ACCEPTED"), 2: ("PROCESSED", "ACCEPTED"), 3: ("LATE", "FAILED")}
    letter = spark.read.parquet(folders.letters).first()
    assert (letter["seq"], letter["reason"], letter["status"]) == (3, processor.TOO_LATE, "FAILED")
    told = decoded(spark.read.parquet(folders.webhooks), schemas.WEBHOOK_WIRE)
    assert sorted(r["status"] for r in told.collect()) == ["ACCEPTED", "ACCEPTED", "FAILED"]


def test_batch_without_a_valid_request(spark, tmp_path):
    folders, done = run(spark, tmp_path, sent(spark, requests(spark, request(1, amount=Decimal(0))), BROKEN))
    assert {v[1] for v in by_seq(done).values()} == {"INVALID", "UNDECODABLE"}
    assert spark.read.schema(log_stream.RECORD).parquet(folders.log).count() == 0


def test_nothing_arrived(spark, tmp_path):
    assert processor.dispositions(spark, processor.ProcessorFolders(str(tmp_path / "none"))).count() == 0


def test_the_ledger_consumer_reads_the_log(spark, tmp_path):
    folders, done = run(spark, tmp_path, sent(spark, mixture(spark), BROKEN), batches=2)
    ledger = log_stream.LedgerFolders(str(tmp_path / "ledger"))
    entered = log_stream.ledger_arrived(log_stream.consume(spark, folders.log), ledger)
    accepted = {r["transaction_id"] for r in done.collect() if r["outcome"] == "PROCESSED"}
    refused = {json.loads(r["payload"])["transactionId"] for r in spark.read.parquet(ledger.letters).collect()}
    assert {r["transaction_id"] for r in entered.collect()} | refused == accepted


def test_files_out_of_time_order_are_judged_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(record_source, "BYTES_PER_TRIGGER", 1, raising=False)
    folders, hours = processor.ProcessorFolders(str(tmp_path / "root")), {1: 100, 2: 0, 3: 47}
    for n, h in hours.items():
        row = requests(spark, request(n, idempotency_key="k", created_at=T0 + timedelta(hours=h)))
        processor.publish_raw(sent(spark, row).coalesce(1), str(tmp_path / "in"))
    done = processor.processed_arrived(processor.consume(spark, str(tmp_path / "in")), folders)
    assert {s: v[1] for s, v in by_seq(done).items()} == {1: "PROCESSED", 2: "PROCESSED", 3: "DUPLICATE_REJECTED"}
    ledger = log_stream.LedgerFolders(str(tmp_path / "ledger"))
    # Both log events stand for one account and key: the ledger takes the earlier one.
    parts = decoded(spark.read.schema(log_stream.RECORD).parquet(folders.log), schemas.LOG_WIRE)
    for seq in (1, 2):
        log_stream.publish(parts.filter(F.col("seq") == seq).coalesce(1), str(tmp_path / "log"))
    entered = log_stream.ledger_arrived(log_stream.consume(spark, str(tmp_path / "log")), ledger)
    assert [r["transaction_id"] for r in entered.collect()] == ["tx-2"]


def test_records_of_a_topic_get_their_position(spark):
    topic = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()),
                          T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()),
                          T.StructField("offset", T.LongType())])
    rows = spark.createDataFrame([(b"a", b"{}", "transaction_requests", 3, 17)], topic)
    assert tuple(positioned(rows).first()) == ("a", "{}", 17, 3, 0, 3)
    plain = positioned(rows).drop("offset")
    assert positioned(plain) is plain
