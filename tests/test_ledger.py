"""Insert-if-absent, counters, audit, reconciliation and notifications."""

import json
import random
from datetime import datetime, timedelta
from decimal import Decimal

from builders import T0, by_seq, log, log_event, request, requests
from pyspark.sql import functions as F

from ledgerloom.operators import audit, ledger, reconcile, webhooks
from ledgerloom.operators.idempotency import account_sequence, classify
from ledgerloom.operators.ledger import persist


def events():
    return [
        log_event(1), log_event(2, transaction_id="tx-1", idempotency_key="idem-1", copy_no=1),
        log_event(3, idempotency_key="idem-1"), log_event(4, merchant_id=None), log_event(5, currency="x" * 9),
        log_event(6, amount=Decimal("1.005")), log_event(7, account_id="acct-2", idempotency_key="idem-1")]


def test_dispositions(spark):
    done = persist(log(spark, *events()))
    assert by_seq(done.labelled, "disposition") == {
        1: "INSERTED", 2: "SKIPPED", 3: "FAILED", 4: "FAILED", 5: "FAILED", 6: "INSERTED", 7: "INSERTED"}
    assert by_seq(done.labelled, "reason")[3] == ledger.CONFLICT
    stored = {r["transaction_id"]: r for r in done.inserted.collect()}
    assert set(stored) == {"tx-1", "tx-6", "tx-7"}
    assert stored["tx-6"]["amount"] == Decimal("1.01")
    assert {r["status"] for r in stored.values()} == {"PERSISTED"}


def test_second_run_adds_nothing(spark):
    first = persist(log(spark, *events()))
    second = persist(log(spark, *events()), first.inserted)
    assert second.inserted.count() == 0
    assert by_seq(second.labelled, "disposition")[1] == "SKIPPED"
    assert by_seq(second.labelled, "disposition")[3] == "FAILED"


def test_equals_row_by_row_insertion(spark):
    rng = random.Random(3)
    rows = []
    for seq in range(500):
        tx = 0 if rng.random() < 0.3 else rng.randrange(150)
        rows.append(log_event(seq, transaction_id=f"tx-{tx}", account_id=f"acct-{tx % 5}", idempotency_key=f"k{tx % 40}",
                              copy_no=seq, merchant_id=None if tx % 17 == 4 else "m",
                              processed_at=T0 + timedelta(seconds=rng.randrange(100))))
    before = [("tx-0", "acct-0", "k0"), ("old", "acct-1", "k1")]
    ids, accounts = {b[0] for b in before}, {b[1:]: b[0] for b in before}
    want = {}
    for r in sorted(rows, key=lambda r: (r["processed_at"], r["seq"])):
        pair = (r["account_id"], r["idempotency_key"])
        if r["merchant_id"] is None:
            want[r["seq"]] = "FAILED"
        elif r["transaction_id"] in ids:
            want[r["seq"]] = "SKIPPED"
        elif pair in accounts:
            want[r["seq"]] = "FAILED"
        else:
            want[r["seq"]] = "INSERTED"
            ids.add(r["transaction_id"])
            accounts[pair] = r["transaction_id"]
    existing = spark.createDataFrame(before, "transaction_id string, account_id string, idempotency_key string")
    assert by_seq(persist(log(spark, *rows), existing).labelled, "disposition") == want
    narrow = ledger.narrowed(existing, log(spark, *rows), len(rows))
    assert by_seq(persist(log(spark, *rows), narrow).labelled, "disposition") == want


def test_counters_and_summary(spark):
    batches = F.floor(F.col("seq") / 4)
    done = persist(log(spark, *events())).labelled.withColumn("batch_id", batches)
    assert sorted(map(tuple, ledger.batch_counters(done).collect())) == [(0, 3, 1, 1, 1), (1, 4, 2, 0, 2)]
    summary = ledger.batch_summary(log(spark, *events()).withColumn("batch_id", batches))
    assert sorted(map(tuple, summary.collect())) == [(0, 3, "tx-1", "tx-3"), (1, 4, "tx-4", "tx-7")]


def test_replay_rebuilds_the_ledger(spark):
    assert sorted(ledger.replayed(log(spark, *events())).collect()) == sorted(
        persist(log(spark, *events())).inserted.collect())


def test_account_sequence(spark):
    rows = [log_event(1, processed_at=T0), log_event(2, processed_at=T0), log_event(3, account_id="b")]
    assert by_seq(account_sequence(log(spark, *rows)), "account_seq") == {1: 1, 2: 2, 3: 1}


def test_audit_keeps_every_delivery(spark):
    docs = audit.documents(log(spark, log_event(1, amount=Decimal("1.005")), log_event(1, copy_no=1)), F.col("processed_at"))
    found = docs.collect()
    assert len(found) == 2 and found[0]["id"] != found[1]["id"]
    assert Decimal("1.005") in {r["amount"] for r in found}
    assert {r["source_topic"] for r in found} == {"transaction_log"}


RUN_AT = datetime(2026, 3, 20, 12, 15)


def ids(spark, *pairs):
    return spark.createDataFrame(list(pairs), "transaction_id string, processed_at timestamp")


def run(spark, audited, entered, minutes=15):
    return reconcile.run_row(ids(spark, *audited), ids(spark, *entered), RUN_AT, minutes).first().asDict()


def test_reconciliation_without_drift(spark):
    rows = [("a", T0), ("b", T0 + timedelta(minutes=1))]
    found = run(spark, rows + rows[:1], rows)
    assert (found["audit_count"], found["ledger_count"], found["missing_in_ledger"]) == (3, 2, 0)
    assert (found["status"], found["notes"]) == ("OK", "Ledger matches audit window")


def test_reconciliation_lists_twenty_ids(spark):
    found = run(spark, [(f"tx-{n:02d}", T0) for n in range(25)], [("unrelated", T0 - timedelta(days=1))])
    assert (found["audit_count"], found["ledger_count"], found["missing_in_ledger"]) == (25, 0, 25)
    assert found["status"] == "DRIFT_DETECTED"
    assert found["notes"] == "Missing transactionIds in ledger: " + ",".join(f"tx-{n:02d}" for n in range(20))


def test_reconciliation_window_edge(spark):
    early = T0 - timedelta(microseconds=1)
    found = run(spark, [("edge", T0), ("early", early)], [("ledger-only", T0)])
    assert (found["audit_count"], found["missing_in_ledger"]) == (1, 1)
    missing = reconcile.missing_in_ledger(ids(spark, ("x", T0), ("x", T0), ("y", T0)), ids(spark, ("y", T0), ("z", T0)))
    assert [r[0] for r in missing.collect()] == ["x"]


def test_notifications_of_both_stages(spark):
    asked = [request(1, idempotency_key="k"), request(2, idempotency_key="k", transaction_id="tx-1", delivery_no=1),
             request(3, idempotency_key="k"), request(4, callback_url=" "), request(5, callback_url=None)]
    updates = webhooks.outcome_updates(classify(requests(spark, *asked)))
    sent = webhooks.dispatch(updates, webhooks.ledger_updates(persist(log(spark, *[
        dict(e, callback_url="https://l.example") for e in events()])).labelled))
    found = {(r["seq"], r["stage_no"]): r["status"] for r in sent.collect()}
    assert {k: v for k, v in found.items() if k[1] == 1} == {(1, 1): "ACCEPTED", (2, 1): "ACCEPTED", (3, 1): "REJECTED"}
    assert [found[(s, 2)] for s in range(1, 8)] == [
        "PERSISTED", "PERSISTED", "FAILED", "FAILED", "FAILED", "PERSISTED", "PERSISTED"]
    assert sent.select("event_id").distinct().count() == sent.count()


def test_payloads_keep_order_and_chunk(spark):
    asked = [request(n, callback_url=f"https://{'a' if n % 3 else 'b'}.example") for n in range(300)]
    updates = webhooks.outcome_updates(classify(requests(spark, *asked, request(900, callback_url="   "))))
    for bound in (None, 50):
        found = {(r["callback_url"], r["chunk_no"]): r for r in webhooks.payloads(updates, rows=bound).collect()}
        assert {k: r["updates"] for k, r in found.items()} == {
            ("https://a.example", 0): 100, ("https://a.example", 1): 100, ("https://b.example", 0): 100}
        body = json.loads(found[("https://a.example", 1)]["payload"])
        assert [u["transactionId"] for u in body] == [f"tx-{n}" for n in range(300) if n % 3][100:]
        assert set(body[0]) == {"transactionId", "status", "correlationId", "occurredAt"}


def test_small_batch_scans_the_ledger_once_and_leaves_it_in_place(spark, tmp_path):
    stored = ledger.ledger_rows(log(spark, *[log_event(n, account_id=f"a{n}") for n in range(50)]), F.col("processed_at"))
    stored.write.parquet(str(tmp_path / "ledger"))
    existing = spark.read.parquet(str(tmp_path / "ledger"))
    batch = log(spark, log_event(3, account_id="x"), log_event(99, account_id="a7", idempotency_key="idem-7"), log_event(98))
    met = ledger.narrowed(existing, batch, 3)
    assert sorted(r["transaction_id"] for r in met.collect()) == ["tx-3", "tx-7"]
    plan = met._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") == 1 and "SortMergeJoin" not in plan
    assert "ReadSchema: struct<transaction_id:string,idempotency_key:string,account_id:string>" in plan


def test_labels_are_decided_by_narrow_rows(spark):
    plan = persist(log(spark, log_event(1), log_event(2)))
    lines = plan.labelled._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in lines if "Aggregate" in line and "amount" in line]
