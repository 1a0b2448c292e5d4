"""The registered queries: each takes (session, folder of given tables)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed, schemas
from ..functions.text import text_or
from ..operators import access, audit, deadletter, idempotency, ingress, ledger, loadrun, reconcile, signatures
from ..operators import validate, webhooks
from ..operators.skew import window_rows
from ..session import fresh_path, prepare, staged
from ..sources.records import decoded, record_batch, record_stream
from ..sources.sinks import publish_records
from ..sources.tables import EVENTS, GIVEN, arriving_path, since
from ..streaming import idempotency as idempotency_stream
from ..streaming import ingress as ingress_stream_job
from ..streaming import limits as limits_stream
from ..streaming import log as log_stream
from ..streaming import processor as processor_stream_job
from ..streaming import webhooks as webhook_stream
from . import derive

RUN_AT = datetime(2024, 1, 31)
LOOKBACK_MINUTES = 1440
KEYS = ("seq", "delivery_no")
COPY = (*KEYS, "copy_no")

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without a zone (the session runs in UTC), as other engines show them."""
    return df.select(*[
        F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType)
        else F.col(f.name) for f in df.schema.fields])


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(build(prepare(spark), sf_dir))
    REGISTRY[build.__name__] = run
    return run


# Requests

@query
def validate_first_failure(spark, sf):
    return validate.with_first_failure(derive.requests(spark, sf)).select(*KEYS, "reject_reason")


@query
def ingress_field_errors(spark, sf):
    found = validate.field_errors()
    text = F.array_join(F.transform(found, lambda e: F.concat(e["field"], F.lit("="), e["message"])), ";")
    return derive.requests(spark, sf).select(*KEYS, F.size(found).alias("errors"), text.alias("field_errors"))


@query
def ingress_error_counts(spark, sf):
    return validate.field_error_counts(derive.requests(spark, sf))


@query
def ingress_enrich(spark, sf):
    return ingress.request_events(derive.create_bodies(spark, sf))


@query
def decode_corrupt_split(spark, sf):
    records = decoded(derive.raw_requests(spark, sf), schemas.REQUEST_WIRE)
    kept = ("transaction_id", "amount", "type", "created_at")
    shown = lambda c: F.when(~F.col("undecodable"), F.col(c)).alias(c)
    return records.withColumn("amount", F.col("amount").cast(schemas.MONEY)).select(
        *KEYS, "undecodable", *[shown(c) for c in kept])


# Duplicates

@query
def idempotency_first_wins(spark, sf):
    return idempotency.first_wins(derive.valid_requests(spark, sf)).select(*KEYS, "idempotency_key", "first")


@query
def idempotency_ttl(spark, sf):
    return derive.outcomes(spark, sf, derive.CHECKED).select(*KEYS, "idempotency_key", "outcome", "holder", "held_since")


@query
def idempotency_ttl_scoped(spark, sf):
    """Keys of each merchant for itself; requests without a merchant are one merchant's."""
    rows = derive.valid_requests(spark, sf).select(*derive.CHECKED, "merchant_id")
    done = idempotency.classify(rows, scope=("merchant_id", "idempotency_key"))
    return done.select(*KEYS, "merchant_id", "idempotency_key", "outcome", "holder", "held_since")


@query
def outcome_summary(spark, sf):
    return idempotency.outcome_counts(derive.outcomes(spark, sf, derive.CHECKED))


@query
def accepted_log(spark, sf):
    return derive.log(spark, sf)


@query
def account_sequence(spark, sf):
    done = derive.outcomes(spark, sf, (*derive.CHECKED, "account_id")).filter(F.col("outcome") == fixed.PROCESSED)
    log = done.select(*KEYS, "account_id", F.col("created_at").alias("processed_at"))
    return idempotency.account_sequence(log, counted=derive.valid_requests(spark, sf))


@query
def nonce_replay(spark, sf):
    return signatures.nonce_audit(derive.signed_requests(spark, sf), derive.signing_config(spark))


# Ledger and audit

@query
def ledger_constraint_check(spark, sf):
    return derive.log(spark, sf).select(*KEYS, "transaction_id", validate.ledger_violation().alias("violation"))


@query
def ledger_unique_conflicts(spark, sf):
    labelled = derive.persisted(spark, sf).labelled
    return labelled.filter(F.col("reason") == ledger.CONFLICT).select(
        *COPY, "transaction_id", "account_id", "idempotency_key")


@query
def ledger_rows(spark, sf):
    fitting = derive.log(spark, sf).filter(validate.ledger_violation().isNull())
    return ledger.ledger_rows(fitting, F.col("processed_at"))


def _stored_log(spark, sf) -> DataFrame:
    """The accepted log, written once where a query reads it on several ways."""
    return staged(derive.log(spark, sf), "accepted-log")


def _with_existing(spark, sf) -> ledger.Persisted:
    log = _stored_log(spark, sf)
    stored = derive.eligible(log).filter(F.col("seq") % 10 == 9)
    return ledger.persist(derive.redelivered(log), stored)


@query
def ledger_insert_if_absent(spark, sf):
    return _with_existing(spark, sf).inserted


@query
def ledger_batch_counters(spark, sf):
    labelled = _with_existing(spark, sf).labelled
    return ledger.batch_counters(labelled.withColumn("batch_id", F.floor(F.col("seq") / fixed.LEDGER_BATCH_ROWS)))


@query
def log_batch_summary(spark, sf):
    log = derive.delivered_log(spark, sf)
    return ledger.batch_summary(log.withColumn("batch_id", F.floor(F.col("seq") / fixed.LEDGER_BATCH_ROWS)))


def _audit(log: DataFrame) -> DataFrame:
    return audit.documents(derive.redelivered(log), F.col("processed_at"))


def _money(documents: DataFrame) -> DataFrame:
    return documents.withColumn("amount", F.col("amount").cast(schemas.MONEY))


@query
def audit_append(spark, sf):
    return _money(_audit(derive.log(spark, sf)))


# Reconciliation and replay

def _reduced_ledger(log: DataFrame) -> DataFrame:
    return ledger.ledger_rows(derive.eligible(log).filter(F.col("seq") % 53 != 7), F.col("processed_at"))


@query
def ledger_since(spark, sf):
    return since(_reduced_ledger(derive.log(spark, sf)), RUN_AT, LOOKBACK_MINUTES).select("transaction_id", "processed_at")


@query
def audit_since(spark, sf):
    return since(_audit(derive.log(spark, sf)), RUN_AT, LOOKBACK_MINUTES).select("id", "transaction_id", "processed_at")


@query
def reconcile_missing(spark, sf):
    log = _stored_log(spark, sf)
    return reconcile.missing_in_ledger(
        since(_audit(log), RUN_AT, LOOKBACK_MINUTES), since(_reduced_ledger(log), RUN_AT, LOOKBACK_MINUTES))


@query
def reconcile_run(spark, sf):
    log = _stored_log(spark, sf)
    return reconcile.run_row(_audit(log), _reduced_ledger(log), RUN_AT, LOOKBACK_MINUTES)


@query
def reconcile_run_clean(spark, sf):
    log = _stored_log(spark, sf)
    entered = _reduced_ledger(log)
    covered = _audit(log).join(entered.select("transaction_id"), "transaction_id", "left_semi")
    return reconcile.run_row(covered, entered, RUN_AT, LOOKBACK_MINUTES)


@query
def replay_rebuild_ledger(spark, sf):
    return ledger.replayed(derive.delivered_log(spark, sf))


# Failures and notifications

def _letters(spark, sf) -> DataFrame:
    records = deadletter.classified_requests(decoded(derive.raw_requests(spark, sf), schemas.REQUEST_WIRE))
    labelled = ledger.persist(derive.redelivered(_stored_log(spark, sf))).labelled.withColumn(
        "source_partition", F.col("seq") % fixed.STREAM_PARTITIONS)
    return deadletter.request_letters(records).unionByName(deadletter.log_letters(labelled))


@query
def terminal_status(spark, sf):
    return _letters(spark, sf).groupBy("topic", "reason", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def dead_letter_route(spark, sf):
    return _letters(spark, sf)


def _dispatch(spark, sf) -> DataFrame:
    invalid = derive.requests(spark, sf).filter(validate.first_failure().isNotNull())
    done = staged(derive.outcomes(spark, sf), "outcomes")
    labelled = ledger.persist(derive.redelivered(idempotency.accepted_log(done))).labelled
    return webhooks.dispatch(
        webhooks.outcome_updates(done), webhooks.invalid_updates(invalid), webhooks.ledger_updates(labelled))


@query
def webhook_dispatch(spark, sf):
    return _dispatch(spark, sf)


@query
def webhook_payloads(spark, sf):
    # A request yields at most four notifications, so its address is hot from a quarter of the bound.
    counted = webhooks.dispatchable(derive.requests(spark, sf)).select("callback_url")
    return webhooks.payloads(_dispatch(spark, sf), counted=counted, rows=window_rows(counted) // 4)


@query
def webhook_batch_stats(spark, sf):
    batch = F.floor(F.col("seq") / fixed.WEBHOOK_BATCH_ROWS)
    invalid = derive.requests(spark, sf).filter(validate.first_failure().isNotNull())
    updates = webhooks.outcome_updates(derive.outcomes(spark, sf, derive.TOLD)).unionByName(webhooks.invalid_updates(invalid))
    return webhooks.batch_stats(updates.withColumn("batch_id", batch))


# Read access and signatures

# Defaults of the read-access settings, used where a stored hash lacks a field.
SETTING_DEFAULTS: dict[str, str | int] = {
    "api_keys": "key-0,key-1", "rate_limits": "key-0:10", "api_key_merchants": "key-0:merchant-0",
    "rate_window_seconds": 60, "default_limit_per_window": 120,
}


def _settings(spark, sf, column: str) -> DataFrame:
    stored = derive.stored_settings(spark, sf)
    return stored.select("tenant_id", text_or(F.col(column), F.lit(SETTING_DEFAULTS[column])).alias(column))


@query
def config_keys(spark, sf):
    return access.api_keys(_settings(spark, sf, "api_keys"))


@query
def config_limits(spark, sf):
    return access.key_limits(_settings(spark, sf, "rate_limits"))


@query
def config_merchants(spark, sf):
    return access.key_merchants(_settings(spark, sf, "api_key_merchants"))


@query
def config_effective(spark, sf):
    return access.effective(derive.stored_settings(spark, sf), SETTING_DEFAULTS)


@query
def rate_window_counts(spark, sf):
    return access.window_counts(derive.access_log(spark, sf), derive.READ_WINDOW_SECONDS, derive.allowed_keys())


@query
def rate_limit_verdict(spark, sf):
    return access.limit_verdicts(
        derive.access_log(spark, sf), derive.limits(spark), derive.READ_WINDOW_SECONDS,
        derive.READ_DEFAULT_LIMIT, derive.allowed_keys())


def _ledger(new: DataFrame) -> DataFrame:
    return ledger.ledger_rows(new, F.col("processed_at"))


@query
def status_lookup(spark, sf):
    return access.status_lookup(derive.access_log(spark, sf), _ledger(derive.eligible(derive.log(spark, sf))),
                                derive.owned_merchants(spark), derive.allowed_keys())


@query
def signature_audit(spark, sf):
    return signatures.audit(derive.signed_requests(spark, sf), derive.signing_config(spark))


@query
def body_hash(spark, sf):
    return signatures.hashed_bodies(derive.signed_requests(spark, sf))


# Load runs

@query
def load_summary(spark, sf):
    return loadrun.summary(derive.load_requests(spark, sf))


@query
def load_thresholds(spark, sf):
    return loadrun.thresholds(loadrun.summary(derive.load_requests(spark, sf)))


# Streams

def _event_stream(spark, sf) -> DataFrame:
    return record_stream(spark, arriving_path(sf, EVENTS), GIVEN[EVENTS])


@query
def idempotency_ttl_stream(spark, sf):
    root = fresh_path(spark, "idempotency")
    arrived = derive.from_events(_event_stream(spark, sf))
    arrived = arrived.select(*derive.CHECKED, "amount", "account_id", "currency", "type")
    done = idempotency_stream.classified_arrived(arrived, root)
    return done.select(*KEYS, "idempotency_key", "outcome", "holder", "held_since")


@query
def rate_window_counts_stream(spark, sf):
    root = fresh_path(spark, "limits")
    calls = derive.calls_from(_event_stream(spark, sf))
    return limits_stream.count_arrived(calls, derive.READ_WINDOW_SECONDS, derive.allowed_keys(),
                                       f"{root}/counts", f"{root}/checkpoint", lateness=None)


def _published(spark, sf) -> str:
    """The delivered log as a folder of records, as the processor leaves it."""
    path = fresh_path(spark, fixed.LOG_STREAM)
    log_stream.publish(derive.delivered_log(spark, sf), path)
    return path


@query
def ledger_stream(spark, sf):
    folders = log_stream.LedgerFolders(fresh_path(spark, "ledger"))
    return log_stream.ledger_arrived(log_stream.consume(spark, _published(spark, sf)), folders)


@query
def replay_into_ledger(spark, sf):
    """A consumer that has seen part of the log; then the whole log, replayed into its ledger."""
    folders, part = log_stream.LedgerFolders(fresh_path(spark, "ledger")), fresh_path(spark, fixed.LOG_STREAM)
    whole = _published(spark, sf)
    publish_records(record_batch(spark, whole, log_stream.RECORD).filter(F.col("seq") % 3 == 0), part)
    log_stream.ledger_arrived(log_stream.consume(spark, part), folders)
    rebuilt, _ = log_stream.replay_into(spark, whole, folders)
    return rebuilt


@query
def webhook_payloads_stream(spark, sf):
    """Notifications of the ledger consumer, grouped by the consumer of the dispatch stream."""
    folders = log_stream.LedgerFolders(fresh_path(spark, "ledger"))
    log_stream.ledger_arrived(log_stream.consume(spark, _published(spark, sf)), folders)
    told = webhook_stream.consume(spark, folders.webhooks)
    done = webhook_stream.payloads_arrived(told, f"{folders.root}/payloads", f"{folders.root}/payloads-checkpoint")
    return done.select(*webhook_stream.PAYLOAD.fieldNames())


@query
def audit_stream(spark, sf):
    root = fresh_path(spark, "audit")
    log = log_stream.consume(spark, _published(spark, sf))
    documents = log_stream.audit_arrived(log, f"{root}/documents", f"{root}/checkpoint")
    return _money(documents.drop("processed_date"))


def _processed(spark, sf) -> tuple[processor_stream_job.ProcessorFolders, DataFrame]:
    """The raw request records, broken ones too, put through the processor."""
    folders, sent = processor_stream_job.ProcessorFolders(fresh_path(spark, "processor")), fresh_path(spark, fixed.REQUEST_STREAM)
    processor_stream_job.publish_raw(derive.raw_requests(spark, sf), sent)
    return folders, processor_stream_job.processed_arrived(processor_stream_job.consume(spark, sent), folders)


@query
def processor_stream(spark, sf):
    """What the processor makes of every record it receives."""
    return _processed(spark, sf)[1]


@query
def processor_letters_stream(spark, sf):
    folders, _ = _processed(spark, sf)
    return spark.read.parquet(folders.letters).drop("run_id", "batch_id")


@query
def processor_notices_stream(spark, sf):
    folders, _ = _processed(spark, sf)
    return decoded(spark.read.schema(webhook_stream.RECORD).parquet(folders.webhooks), schemas.WEBHOOK_WIRE).select(
        *schemas.WEBHOOK_WIRE.values())


@query
def service_chain_stream(spark, sf):
    """Requests through processor, log, ledger consumer and audit consumer, reconciled.

    One row per transaction that reached the log: documents in the audit, whether the ledger
    holds it, and the last status its caller was sent, if it has an address.
    """
    folders, _ = _processed(spark, sf)
    kept = log_stream.LedgerFolders(f"{folders.root}/ledger")
    entered = log_stream.ledger_arrived(log_stream.consume(spark, folders.log), kept)
    documents = log_stream.audit_arrived(log_stream.consume(spark, folders.log), f"{folders.root}/audit",
                                         f"{folders.root}/audit-checkpoint")
    audited = documents.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("documents"))
    told = decoded(record_batch(spark, kept.webhooks, webhook_stream.RECORD), schemas.WEBHOOK_WIRE)
    last = told.groupBy("transaction_id").agg(F.max("status").alias("told"))
    held = entered.select("transaction_id", F.lit(True).alias("in_ledger"))
    return (audited.join(held, "transaction_id", "left").join(last, "transaction_id", "left")
            .select("transaction_id", "documents", F.coalesce("in_ledger", F.lit(False)).alias("in_ledger"), "told"))


def _ingested(spark, sf) -> tuple[ingress_stream_job.IngressFolders, DataFrame]:
    """Signed calls put through the ingress, nonce check on."""
    folders, sent = ingress_stream_job.IngressFolders(fresh_path(spark, "ingress")), fresh_path(spark, "calls")
    derive.submissions(spark, sf).select(*ingress_stream_job.CALL.fieldNames()).write.parquet(sent)
    calls = record_stream(spark, sent, ingress_stream_job.CALL)
    return folders, ingress_stream_job.ingested_arrived(calls, folders, derive.signing_config(spark),
                                                        nonce_minutes=fixed.NONCE_TTL_MINUTES)


@query
def ingress_stream(spark, sf):
    """The answer to every call."""
    errors = F.array_join(F.transform(F.map_entries("field_errors"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return _ingested(spark, sf)[1].withColumn("field_errors", errors)


@query
def ingress_chain_stream(spark, sf):
    """Calls through ingress and processor: what becomes of every accepted one."""
    entered, _ = _ingested(spark, sf)
    folders = processor_stream_job.ProcessorFolders(f"{entered.root}/processor")
    return processor_stream_job.processed_arrived(processor_stream_job.consume(spark, entered.requests), folders)
