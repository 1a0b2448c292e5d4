"""Read access, signatures and load summaries."""

import base64
import hashlib
from datetime import timedelta

import pytest
from builders import T0, by_seq
from pyspark.sql import functions as F

from ledgerloom.functions import clock, signing, text
from ledgerloom.operators import access, loadrun, signatures
from ledgerloom.sources.tables import settings_table

SETTINGS = ("tenant_id bigint, api_keys string, rate_limits string, api_key_merchants string, "
            "rate_window_seconds string, default_limit_per_window string")
DEFAULTS = {"api_keys": "d", "rate_limits": "d:1", "api_key_merchants": "d:m", "rate_window_seconds": 60,
            "default_limit_per_window": 120}


def settings(spark, *rows):
    return spark.createDataFrame([(n, *row) for n, row in enumerate(rows)], SETTINGS)


def test_settings_texts(spark):
    df = settings(
        spark, (" red, blue ,,red,\t", "red:31,blue:many", "loose,red:shop-x||shop-y,blue:", None, None),
        (None, "no colon,ash:,oak:4,oak:x,elm:1,elm:2", "k:a,k: | ,k:b|a", None, None), (" ", "a:b:3, c:5:6", "", None, None))
    assert sorted(map(tuple, access.api_keys(df).collect())) == [(0, "blue"), (0, "red")]
    assert sorted(map(tuple, access.key_limits(df).collect())) == [(0, "red", 31), (1, "elm", 2), (1, "oak", 4)]
    assert sorted(map(tuple, access.key_merchants(df).collect())) == [
        (0, "red", "shop-x"), (0, "red", "shop-y"), (1, "k", "a"), (1, "k", "b")]


def test_effective_settings(spark):
    df = settings(spark, (None, " ", None, "30", "abc"), ("k", "k:2", "k:m", "0", " 7 "), (None, None, None, "5.0", "-3"))
    found = {r["tenant_id"]: tuple(r)[1:] for r in access.effective(df, DEFAULTS).collect()}
    assert found == {0: ("d", "d:1", "d:m", 30, 120), 1: ("k", "k:2", "k:m", 1, 7), 2: ("d", "d:1", "d:m", 60, 1)}


def test_defaults_where_nothing_is_stored(spark, tmp_path):
    tenants = spark.createDataFrame([(0,), (1,)], "tenant_id bigint")
    nothing = settings_table(spark, str(tmp_path / "absent"))
    found = access.effective(access.for_tenants(tenants, nothing), DEFAULTS).collect()
    assert {tuple(r)[1:] for r in found} == {("d", "d:1", "d:m", 60, 120)} and len(found) == 2
    settings(spark, ("k", None, None, None, None)).write.parquet(str(tmp_path / "stored"))
    some = settings_table(spark, str(tmp_path / "stored"))
    assert sorted(r["api_keys"] for r in access.effective(access.for_tenants(tenants, some), DEFAULTS).collect()) == ["d", "k"]


def test_whole_numbers(spark):
    df = spark.createDataFrame([("5",), ("+5",), ("-5",), ("5.0",), ("1e3",), ("2147483648",), ("",)], "v string")
    assert [r[0] for r in df.select(text.whole_number(F.col("v"))).collect()] == [5, 5, -5, None, None, None, None]


def calls(spark, *rows):
    return spark.createDataFrame([(n, k, f"tx-{n}", T0 + timedelta(seconds=s)) for n, (k, s) in enumerate(rows)],
                                 "event_id bigint, api_key string, transaction_id string, ts timestamp")


@pytest.mark.parametrize("bound", [None, 0])
def test_limiter(spark, bound):
    df = calls(spark, ("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("a", 61), (None, 0), (" ", 0), ("z", 0))
    limits = spark.createDataFrame([("a", 2)], "api_key string, key_limit int")
    out = access.limit_verdicts(df, limits, 60, 1, ["a", "b"], bound)
    assert {r["event_id"]: r["status"] for r in out.collect()} == {
        0: 200, 1: 200, 2: 429, 3: 200, 4: 429, 5: 200, 6: 401, 7: 401, 8: 401}
    messages = {r["event_id"]: r["message"] for r in out.collect()}
    assert (messages[2], messages[7], messages[8]) == ("Rate limit exceeded", "Missing API key", "Invalid API key")
    counts = access.window_counts(df, 60, ["a", "b"])
    assert sorted((r["api_key"], r["calls"]) for r in counts.collect()) == [("a", 1), ("a", 3), ("b", 2)]


def test_status_lookup(spark):
    ledger = spark.createDataFrame([("tx-0", "m1", "PERSISTED", T0), ("tx-1", "m2", "PERSISTED", T0)],
                                   "transaction_id string, merchant_id string, status string, processed_at timestamp")
    owned = spark.createDataFrame([("a", "m1")], "api_key string, merchant_id string")
    out = access.status_lookup(calls(spark, ("a", 0), ("a", 0), ("a", 0), ("z", 0), (None, 0)), ledger, owned, ["a"])
    found = {r["event_id"]: (r["code"], r["status"]) for r in out.collect()}
    assert found == {0: (200, "PERSISTED"), 1: (403, None), 2: (404, None), 3: (401, None), 4: (401, None)}
    assert "merchant_id" not in out.columns


def signed(spark, *rows):
    schema = ("seq bigint, delivery_no int, merchant_id string, ts_header string, nonce string, idem_header string, "
              "body_key string, path string, body string, received_at timestamp, verify string")
    made = []
    for seq, changes in enumerate(rows):
        r = dict(merchant_id="m", ts_header="2026-03-20T12:00:00Z", nonce=f"n{seq}", idem_header="k", body_key="k",
                 path="/p", body="x" * 100, received_at=T0)
        r.update(changes)
        raw = base64.b64encode((r["body"] or "").encode()).decode() + "".join(
            r[c] or "" for c in ("path", "ts_header", "nonce", "idem_header")) + "salt"
        r.setdefault("verify", hashlib.sha256(raw.encode()).hexdigest().upper() + "###1")
        made.append((seq, 0, *[r[c] for c in ("merchant_id", "ts_header", "nonce", "idem_header", "body_key", "path",
                                              "body", "received_at", "verify")]))
    return spark.createDataFrame(made, schema)


def merchants(spark):
    return spark.createDataFrame([("m", "salt", "1"), ("blank", " ", "1")], "merchant_id string, salt string, salt_index string")


def test_signature_verdicts(spark):
    df = signed(
        spark, {}, {"body": ""}, {"nonce": " "}, {"merchant_id": "nobody"}, {"merchant_id": "blank"},
        {"ts_header": "2026-03-20"}, {"received_at": T0 + timedelta(seconds=120, milliseconds=900)},
        {"received_at": T0 - timedelta(seconds=121)}, {"verify": "WRONG###1"}, {"body_key": "other"},
        {"ts_header": "2026-03-20T17:30:00+05:30"})
    out = signatures.audit(df, merchants(spark))
    assert [v for _, v in sorted(by_seq(out, "verdict").items())] == [
        "OK", "OK", "Missing required auth headers", "Unknown merchant", "Unknown merchant", "Invalid timestamp format",
        "OK", "Request timestamp outside allowed skew", "Invalid signature", "OK", "OK"]
    assert [s for s, wrong in by_seq(out, "key_mismatch").items() if wrong] == [9]


@pytest.mark.parametrize("fold_rows", [100, 0])
def test_nonces_are_used_up_by_requests_that_reach_the_check(spark, fold_rows):
    df = signed(
        spark, {"nonce": "n", "ts_header": "bad"}, {"nonce": "n", "verify": "WRONG###1"}, {"nonce": "n"},
        {"nonce": "n", "ts_header": "2026-03-20T12:02:00Z", "received_at": T0 + timedelta(seconds=120)},
        {"nonce": "n", "ts_header": "2026-03-20T12:02:00Z", "received_at": T0 + timedelta(seconds=121)})
    out = signatures.nonce_audit(df, merchants(spark), fold_rows=fold_rows)
    assert [v for _, v in sorted(by_seq(out, "verdict").items())] == [
        "Invalid timestamp format", "Invalid signature", "Replay detected", "OK", "Replay detected"]


def test_digest_texts(spark):
    df = spark.createDataFrame([("", "abc"), (None, "abc"), ("y" * 200, "abc")], "body string, t string")
    found = df.select(signing.body_base64(F.col("body")).alias("b"), signing.digest(F.col("t")).alias("d"),
                      signing.body_hash(F.col("t")).alias("h")).collect()
    assert [r["b"] for r in found] == ["", "", base64.b64encode(b"y" * 200).decode()]
    assert found[0]["d"] == hashlib.sha256(b"abc").hexdigest().upper()
    assert found[0]["h"] == base64.b64encode(hashlib.sha256(b"abc").digest()).decode()


def test_instants(spark):
    df = spark.createDataFrame([("2026-03-20T12:00:00.5Z",), ("2026-03-20 12:00:00Z",), ("2026-02-30T12:00:00Z",), ("x",)], "v string")
    found = [r[0] for r in df.select(clock.instant(F.col("v"))).collect()]
    assert found == [T0 + timedelta(milliseconds=500), None, None, None]


def test_load_summary_and_marks(spark):
    df = spark.createDataFrame([(202, float(n)) for n in range(1, 100)] + [(503, 20000.0)], "status int, duration_ms double")
    run = loadrun.summary(df)
    row = run.first()
    assert (row["iterations"], row["accepted"], row["failed"], row["http_failed_rate"]) == (100, 99, 1, 0.01)
    assert (row["checks_rate"], row["app_check_rate"], row["med_ms"], row["max_ms"]) == (0.99, 0.99, 50.5, 20000.0)
    assert row == loadrun.summary(df, buffered=0).first()
    marks = {(r["metric"], r["rule"]): r["passed"] for r in loadrun.thresholds(run).collect()}
    assert marks[("http_req_failed", "rate==0")] is False and marks[("http_req_duration", "p(95)<1000")] is True
