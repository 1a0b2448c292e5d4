"""Streams give the rows of the batch operators, over several micro-batches and retries."""

from dataclasses import dataclass
from datetime import timedelta
from decimal import Decimal

from builders import T0, by_seq, log, log_event, request, requests
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.operators import reconcile, webhooks
from ledgerloom.operators.hold import hold
from ledgerloom.operators.idempotency import classify
from ledgerloom.operators.ledger import persist
from ledgerloom.operators.validate import valid
from ledgerloom.sources import sinks
from ledgerloom.sources.records import decoded, encoded, record_batch, record_stream
from ledgerloom.sources.tables import by_id, since
from ledgerloom.streaming import idempotency, limits
from ledgerloom.streaming import log as log_stream
from ledgerloom.streaming import processor
from ledgerloom.streaming import webhooks as webhook_stream
from ledgerloom.streaming.runs import Place, batch_folder, batch_read

KEPT = ("outcome", "holder", "held_since")


def test_duplicates_over_several_batches(spark, tmp_path):
    rows = [request(n, idempotency_key=f"k{n % 7}" if n % 3 else "hot", transaction_id=f"tx-{n - n % 2}",
                    amount=Decimal(-1 if n % 11 == 0 else 1), created_at=T0 + timedelta(hours=n)) for n in range(120)]
    whole = requests(spark, *rows).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    arrivals, root = str(tmp_path / "in"), str(tmp_path / "root")
    for part in range(3):
        whole.filter(F.floor(F.col("seq") / 40) == part).write.mode("append").parquet(arrivals)
        done = idempotency.classified_arrived(record_stream(spark, arrivals, whole.schema), root)
    assert idempotency.late_so_far(spark, whole.schema, idempotency.HoldFolders(root)).count() == 0
    assert by_seq(done, *KEPT) == by_seq(classify(valid(whole)), *KEPT)


def test_nonces_on_a_stream(spark, tmp_path):
    rows = [(n, 0, "m", f"n{n % 5}", T0 + timedelta(seconds=13 * n)) for n in range(60)]
    whole = spark.createDataFrame(rows, "seq bigint, delivery_no int, merchant_id string, nonce string, received_at timestamp")
    arrivals, root = str(tmp_path / "in"), str(tmp_path / "root")
    for part in range(2):
        whole.filter(F.floor(F.col("seq") / 30) == part).write.mode("append").parquet(arrivals)
        done = idempotency.guarded_nonces_arrived(record_stream(spark, arrivals, whole.schema), root)
    same = hold(whole, ["merchant_id", "nonce"], "received_at", ["seq", "delivery_no"], "seq", 120)
    assert by_seq(done, "acquired", "held_since") == by_seq(same, "acquired", "held_since")


def test_payloads_of_the_dispatch_stream(spark, tmp_path):
    updates = webhooks.outcome_updates(classify(requests(spark, *[
        request(n, callback_url=" " if n % 4 == 0 else f"https://{n % 2}.example") for n in range(400)])))
    path = str(tmp_path / "dispatch")
    sinks.publish_webhooks(updates, path)
    done = webhook_stream.payloads_arrived(
        webhook_stream.consume(spark, path), str(tmp_path / "payloads"), str(tmp_path / "checkpoint"))
    assert {(r["callback_url"], r["chunk_no"]): r["updates"] for r in done.collect()} == {
        ("https://0.example", 0): 100, ("https://1.example", 0): 100, ("https://1.example", 1): 100}


def test_replay_of_the_published_log(spark, tmp_path):
    for path in published(spark, tmp_path, parts()):
        pass
    rebuilt, read = log_stream.replay(spark, path)
    rows = rebuilt.collect()
    assert sorted(rows) == sorted(persist(log(spark, *parts()[0], *parts()[1])).inserted.collect())
    assert read.get["records"] == 6


def test_reconciliation_of_the_stored_tables(spark, tmp_path):
    folders, runs = log_stream.LedgerFolders(str(tmp_path / "consumer")), str(tmp_path / "runs")
    for path in published(spark, tmp_path, parts()):
        entered = log_stream.ledger_arrived(log_stream.consume(spark, path), folders)
        docs = log_stream.audit_arrived(log_stream.consume(spark, path), str(tmp_path / "audit"), str(tmp_path / "cp"))
        run = reconcile.run_row(docs, log_stream.stored_ledger(spark, folders), T0 + timedelta(minutes=1), 15)
        sinks.append_run(run, runs)
    found = spark.read.schema(schemas.RECONCILIATION_RUN).parquet(runs).orderBy("audit_count").collect()
    assert [(r["audit_count"], r["ledger_count"], r["missing_in_ledger"]) for r in found] == [(3, 2, 1), (6, 3, 2)]
    assert found[1]["notes"] == "Missing transactionIds in ledger: tx-2,tx-4"
    assert by_id(entered, "tx-1").count() == 1
    plan = since(log_stream.stored_ledger(spark, folders), T0, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(processed_date" in plan and "PushedFilters: [IsNotNull(processed_at)" in plan


def test_window_counts_over_several_batches(spark, tmp_path):
    rows = [(n, "a" if n % 3 else None, "tx", T0 + timedelta(seconds=n)) for n in range(300)]
    whole = spark.createDataFrame(rows, "event_id bigint, api_key string, transaction_id string, ts timestamp")
    arrivals, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    for part in range(2):
        whole.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(arrivals)
        done = limits.count_arrived(record_stream(spark, arrivals, whole.schema), 60, ["a"], out, checkpoint)
    assert sorted(r["calls"] for r in done.collect()) == [40] * 5


def test_window_counts_keep_calls_that_come_days_late(spark, tmp_path):
    schema = "event_id bigint, api_key string, transaction_id string, ts timestamp"
    arrivals, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    for n, days in enumerate([5, 9, 0]):
        spark.createDataFrame([(n, "a", "tx", T0 + timedelta(days=days))], schema).write.mode("append").parquet(arrivals)
        whole = record_stream(spark, arrivals, spark.read.parquet(arrivals).schema)
        done = limits.count_arrived(whole, 60, ["a"], out, checkpoint)
    assert [r["calls"] for r in done.collect()] == [1, 1, 1]


def published(spark, tmp_path, parts):
    path = str(tmp_path / "log")
    for rows in parts:
        log_stream.publish(log(spark, *rows), path)
        yield path


def parts():
    hook = {"callback_url": "https://a.example"}
    return [[log_event(1, **hook), log_event(2, merchant_id=None, **hook), log_event(3, copy_no=0)],
            [log_event(1, copy_no=1, **hook), log_event(4, idempotency_key="idem-3", **hook), log_event(5)]]


def test_ledger_over_several_batches(spark, tmp_path):
    folders = log_stream.LedgerFolders(str(tmp_path / "consumer"))
    for path in published(spark, tmp_path, parts()):
        done = log_stream.ledger_arrived(log_stream.consume(spark, path), folders)
    whole = persist(log(spark, *parts()[0], *parts()[1]))
    assert sorted(done.collect()) == sorted(whole.inserted.collect())
    told = decoded(spark.read.parquet(folders.webhooks), schemas.WEBHOOK_WIRE)
    assert sorted((r["transaction_id"], r["status"]) for r in told.collect()) == [
        ("tx-1", "PERSISTED"), ("tx-1", "PERSISTED"), ("tx-2", "FAILED"), ("tx-4", "FAILED")]
    letters = spark.read.parquet(folders.letters)
    assert sorted((r["seq"], r["reason"]) for r in letters.collect()) == [
        (2, "merchant_id is null"), (4, "account_idempotency_conflict")]


def test_retried_batch_changes_nothing(spark, tmp_path):
    folders = log_stream.LedgerFolders(str(tmp_path / "consumer"))
    for path in published(spark, tmp_path, parts()):
        before = log_stream.ledger_arrived(log_stream.consume(spark, path), folders).collect()
    second = log(spark, *parts()[1]).withColumn("source_partition", F.lit(0).cast("bigint"))
    batch = second.withColumns({"undecodable": F.lit(False), "value": F.lit(""), "key": F.lit("")})
    runs = spark.read.parquet(folders.labelled).filter("batch_id = 1").select("run_id").distinct().collect()
    log_stream.persist_batch(batch, Place(runs[0][0], 1), folders)
    assert sorted(log_stream.stored_ledger(spark, folders).select(*before[0].__fields__).collect()) == sorted(before)


def test_broken_record_goes_to_the_dead_letters(spark, tmp_path):
    path, folders = str(tmp_path / "log"), log_stream.LedgerFolders(str(tmp_path / "consumer"))
    log_stream.publish(log(spark, log_event(1)), path)
    broken = spark.createDataFrame([("a", "{", 2, 0, 0, 3)], log_stream.RECORD)
    broken.write.mode("append").parquet(path)
    assert log_stream.ledger_arrived(log_stream.consume(spark, path), folders).count() == 1
    letter = spark.read.parquet(folders.letters).first()
    assert (letter["topic"], letter["source_partition"], letter["payload"], letter["status"]) == (
        "transaction_log_dlt", 3, "{", None)


def test_audit_is_a_second_reader(spark, tmp_path):
    folders = log_stream.LedgerFolders(str(tmp_path / "consumer"))
    for path in published(spark, tmp_path, parts()):
        log_stream.ledger_arrived(log_stream.consume(spark, path), folders)
        docs = log_stream.audit_arrived(log_stream.consume(spark, path), str(tmp_path / "audit"), str(tmp_path / "cp"))
    assert docs.count() == 6
    entered = log_stream.stored_ledger(spark, folders)
    assert entered.join(docs, "transaction_id", "left_anti").count() == 0


def test_new_checkpoint_over_old_folders_loses_nothing(spark, tmp_path):
    first, second = log_stream.LedgerFolders(str(tmp_path / "consumer")), str(tmp_path / "other")
    for path in published(spark, tmp_path, parts()[:1]):
        before = log_stream.ledger_arrived(log_stream.consume(spark, path), first).collect()
    log_stream.publish(log(spark, log_event(1), log_event(7), log_event(8)), second)

    @dataclass(frozen=True)
    class Moved(log_stream.LedgerFolders):
        @property
        def checkpoint(self):
            return str(tmp_path / "new-checkpoint")

    after = log_stream.ledger_arrived(log_stream.consume(spark, second), Moved(first.root)).collect()
    assert {r["transaction_id"] for r in after} == {r["transaction_id"] for r in before} | {"tx-7", "tx-8"}
    assert len(after) == len(before) + 2


def test_replay_into_a_ledger_adds_what_is_absent(spark, tmp_path):
    folders = log_stream.LedgerFolders(str(tmp_path / "consumer"))
    for path in published(spark, tmp_path, parts()[:1]):
        log_stream.ledger_arrived(log_stream.consume(spark, path), folders)
    told = spark.read.parquet(folders.webhooks).count()
    for path in published(spark, tmp_path, parts()[1:]):
        rows, read = log_stream.replay_into(spark, path, folders)
    assert sorted(rows.collect()) == sorted(persist(log(spark, *parts()[0], *parts()[1])).inserted.collect())
    assert read == 6 and spark.read.parquet(folders.webhooks).count() == told
    again, _ = log_stream.replay_into(spark, path, folders)
    assert sorted(again.collect()) == sorted(rows.collect())


def test_holds_outlive_pauses_and_late_rows_are_set_aside(spark, tmp_path):
    hours = {1: 0, 2: 100, 3: 47, 4: 101, 5: 400, 6: 120}
    rows = {n: request(n, idempotency_key="k", transaction_id=f"tx-{n}", created_at=T0 + timedelta(hours=h)) for n, h in hours.items()}
    arrivals, root = str(tmp_path / "in"), str(tmp_path / "root")
    for part in ([1], [2], [3, 4], [5], [6]):
        batch = requests(spark, *[rows[n] for n in part])
        batch.write.mode("append").parquet(arrivals)
        done = idempotency.classified_arrived(record_stream(spark, arrivals, batch.schema), root)
    assert by_seq(done, "outcome") == {1: "PROCESSED", 2: "PROCESSED", 4: "DUPLICATE_REJECTED", 5: "PROCESSED"}
    late = idempotency.late_so_far(spark, batch.schema, idempotency.HoldFolders(root))
    assert sorted(r["seq"] for r in late.collect()) == [3, 6]


def test_row_without_moment_on_a_stream(spark, tmp_path):
    batch = requests(spark, request(1, idempotency_key="k", created_at=None), request(2, idempotency_key="k"))
    batch.write.parquet(str(tmp_path / "in"))
    done = idempotency.classified_arrived(record_stream(spark, str(tmp_path / "in"), batch.schema), str(tmp_path / "root"))
    assert by_seq(done, *KEPT) == by_seq(classify(valid(batch)), *KEPT)


def test_ledger_notifications_reach_the_dispatch_consumer(spark, tmp_path):
    folders = log_stream.LedgerFolders(str(tmp_path / "consumer"))
    for path in published(spark, tmp_path, parts()):
        log_stream.ledger_arrived(log_stream.consume(spark, path), folders)
    spark.createDataFrame([("https://a.example", "{")], webhook_stream.RECORD).write.parquet(
        f"{folders.webhooks}/run_id=broken/batch_id=0")
    out = str(tmp_path / "payloads")
    done = webhook_stream.payloads_arrived(webhook_stream.consume(spark, folders.webhooks), out, str(tmp_path / "cp"))
    assert sum(r["updates"] for r in done.collect()) == 4
    letter = spark.read.parquet(webhook_stream.letters_path(out)).first()
    assert (letter["topic"], letter["key"], letter["payload"]) == ("webhook_dispatch_dlt", "https://a.example", "{")


def test_letters_carry_the_record_as_it_was_sent(spark, tmp_path):
    path, folders = str(tmp_path / "log"), log_stream.LedgerFolders(str(tmp_path / "consumer"))
    sent = '{"transactionId":"t","amount":12.34,"merchantId":null}'
    spark.createDataFrame([("a", sent, 2, 0, 0, 3)], log_stream.RECORD).write.parquet(path)
    log_stream.ledger_arrived(log_stream.consume(spark, path), folders)
    assert spark.read.parquet(folders.letters).first()["payload"] == sent


def watched_writes(spark, monkeypatch):
    """The writes of the ledger consumer, and whether each finds anything cached since this call."""
    found, write = [], log_stream.batch_folder
    cached = spark._jsparkSession.sharedState().cacheManager().numCachedEntries
    at_first = cached()

    def watched(df, path, place):
        found.append((path.rsplit("/", 1)[-1], cached() > at_first))
        write(df, path, place)

    monkeypatch.setattr(log_stream, "batch_folder", watched)
    return found


def test_ledger_batch_is_written_and_not_cached(spark, tmp_path, monkeypatch):
    folders, found = log_stream.LedgerFolders(str(tmp_path / "consumer")), watched_writes(spark, monkeypatch)
    path = str(tmp_path / "log")
    log_stream.publish(log(spark, *parts()[0], *parts()[1]), path)
    # Extreme stamps, in records that are undecodable by their type.
    bad = [(f"a{n}", f'{{"processedAt":"{stamp}","type":"GIFT"}}', 90 + n, 0, 0, 3)
           for n, stamp in enumerate(["0001-01-01T00:00:00Z", "1582-10-10T00:00:00Z", "+294247-01-10T04:00:54Z"])]
    spark.createDataFrame(bad, log_stream.RECORD).write.mode("append").parquet(path)
    done = log_stream.ledger_arrived(log_stream.consume(spark, path), folders)
    assert sorted(done.collect()) == sorted(persist(log(spark, *parts()[0], *parts()[1])).inserted.collect())
    assert found == [(name, False) for name in ("arrived", "labelled", "webhook_dispatch", "transaction_log_dlt")]
    assert spark.read.parquet(folders.arrived).count() == 9
    letters = spark.read.parquet(folders.letters).filter("reason = 'undecodable payload'").collect()
    assert sorted((r["seq"], r["payload"]) for r in letters) == [(r[2], r[1]) for r in bad]


def test_replay_into_a_ledger_is_written_and_not_cached(spark, tmp_path, monkeypatch):
    folders = log_stream.LedgerFolders(str(tmp_path / "consumer"))
    for path in published(spark, tmp_path, parts()[:1]):
        log_stream.ledger_arrived(log_stream.consume(spark, path), folders)
    found = watched_writes(spark, monkeypatch)
    for path in published(spark, tmp_path, parts()[1:]):
        rows, _ = log_stream.replay_into(spark, path, folders)
    assert found == [(name, False) for name in ("arrived", "labelled", "transaction_log_dlt")]
    # The replay is a run of its own, beside the records of the consumer.
    runs = spark.read.parquet(folders.arrived).groupBy("run_id").count().collect()
    assert sorted((r["run_id"].split("-")[0], r["count"]) for r in runs) == [("replay", 6), ("run", 3)]
    assert sorted(rows.collect()) == sorted(persist(log(spark, *parts()[0], *parts()[1])).inserted.collect())


def test_ledger_and_dispatch_consumers_cache_nothing(spark, tmp_path, monkeypatch):
    folders, found = log_stream.LedgerFolders(str(tmp_path / "consumer")), watched_writes(spark, monkeypatch)
    monkeypatch.setattr(webhook_stream, "batch_folder", log_stream.batch_folder)
    for path in published(spark, tmp_path, parts()):
        log_stream.ledger_arrived(log_stream.consume(spark, path), folders)
    done = webhook_stream.payloads_arrived(
        webhook_stream.consume(spark, folders.webhooks), str(tmp_path / "payloads"), str(tmp_path / "cp"))
    assert [(r["callback_url"], r["chunk_no"], r["updates"]) for r in done.collect()] == [("https://a.example", 0, 4)]
    assert {name for name, _ in found} >= {"arrived", "labelled", "webhook_dispatch", "payloads"}
    assert not any(cached for _, cached in found)


def test_chain_from_requests_to_audit_caches_nothing(spark, tmp_path, monkeypatch):
    found = watched_writes(spark, monkeypatch)
    monkeypatch.setattr(processor, "batch_folder", log_stream.batch_folder)
    rows = requests(spark, *[request(n, idempotency_key=f"k{n - n % 2}", amount=Decimal(-1 if n == 7 else 1)) for n in range(8)])
    sent = rows.withColumns({"_key": F.lit("a"), "source_partition": F.col("seq") % 6})
    path, folders = str(tmp_path / "in"), processor.ProcessorFolders(str(tmp_path / "root"))
    processor.publish_raw(encoded(sent, schemas.REQUEST_WIRE, "_key", ("seq", "delivery_no", "source_partition")), path)
    processor.processed_arrived(processor.consume(spark, path), folders)
    kept = log_stream.LedgerFolders(f"{folders.root}/ledger")
    entered = log_stream.ledger_arrived(log_stream.consume(spark, folders.log), kept)
    docs = log_stream.audit_arrived(log_stream.consume(spark, folders.log), str(tmp_path / "audit"), str(tmp_path / "cp"))
    assert sorted(r["transaction_id"] for r in entered.collect()) == [f"tx-{n}" for n in (0, 2, 4, 6)]
    assert docs.count() == 4
    assert {name for name, _ in found} >= {"judged", "transaction_log", "arrived", "labelled"}
    assert not any(cached for _, cached in found)


def test_reading_records_keeps_nothing_outside_the_heap(spark, tmp_path):
    management = spark.sparkContext._jvm.java.lang.management
    pools = spark.sparkContext._jvm.java.lang.Class.forName("java.lang.management.BufferPoolMXBean")

    def outside():
        spark.sparkContext._jvm.System.gc()
        return next(p for p in management.ManagementFactory.getPlatformMXBeans(pools) if p.getName() == "direct").getMemoryUsed()

    # One file, whose texts make a column chunk of about 45 MB.
    text = F.concat(*[F.sha2(F.concat("id", F.lit(n)).cast("string"), 512) for n in range(3)])
    rows = spark.range(0, 120_000, 1, 1).select(F.lit("a").alias("key"), text.alias("value"))
    place, path = Place("run", 0), str(tmp_path / "records")
    batch_folder(rows, path, place)
    at_first = outside()
    for read in (record_batch(spark, path, webhook_stream.RECORD), batch_read(spark, webhook_stream.RECORD, path, place)):
        assert read.agg(F.max("value")).first()[0] is not None
        assert outside() - at_first < 10_000_000
    out = str(tmp_path / "out")
    job = record_stream(spark, path, webhook_stream.RECORD).writeStream.format("parquet").option("path", out)
    job.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert outside() - at_first < 10_000_000
