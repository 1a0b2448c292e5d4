"""Time-limited keys against literal cases and a brute-force fold."""

import random
from datetime import timedelta

import pytest
from builders import T0, by_seq, request, requests

from ledgerloom.operators import hold as hold_module
from ledgerloom.operators.hold import hold
from ledgerloom.operators.idempotency import accepted_log, classify, first_wins, outcome_counts

HOUR = 3600


def literal_cases():
    def same_key(seq, tx, seconds):
        return request(seq, transaction_id=tx, idempotency_key="k", created_at=T0 + timedelta(seconds=seconds))
    return [
        same_key(1, "a", 0), same_key(2, "a", 1), same_key(3, "b", 1),
        same_key(4, "c", 48 * HOUR - 1), same_key(5, "d", 48 * HOUR), same_key(6, "a", 48 * HOUR + 1),
        request(7, idempotency_key="other"),
    ]


@pytest.mark.parametrize("fold_rows", [100, 0])
def test_outcomes_of_the_literal_cases(spark, fold_rows):
    done = classify(requests(spark, *literal_cases()), fold_rows=fold_rows)
    assert by_seq(done, "outcome") == {
        1: "PROCESSED", 2: "DUPLICATE_REPLAY", 3: "DUPLICATE_REJECTED", 4: "DUPLICATE_REJECTED",
        5: "PROCESSED", 6: "DUPLICATE_REJECTED", 7: "PROCESSED"}


def test_first_wins_has_no_expiry(spark):
    done = first_wins(requests(spark, *literal_cases()))
    assert [s for s, first in by_seq(done, "first").items() if first] == [1, 7]


def test_accepted_log_and_counts(spark):
    done = classify(requests(spark, *literal_cases()))
    log = accepted_log(done)
    assert sorted(by_seq(log, "status").items()) == [(1, "ACCEPTED"), (5, "ACCEPTED"), (7, "ACCEPTED")]
    assert log.select("event_id").distinct().count() == 3
    assert {r["outcome"]: r["n"] for r in outcome_counts(done).collect()} == {
        "PROCESSED": 3, "DUPLICATE_REPLAY": 1, "DUPLICATE_REJECTED": 3}


def test_scope_can_be_narrowed_to_the_account(spark):
    rows = [request(1, idempotency_key="k"), request(2, idempotency_key="k", account_id="acct-2")]
    assert by_seq(classify(requests(spark, *rows)), "outcome")[2] == "DUPLICATE_REJECTED"
    narrow = classify(requests(spark, *rows), scope=("account_id", "idempotency_key"))
    assert by_seq(narrow, "outcome")[2] == "PROCESSED"


def brute_force(rows, ttl):
    state, labels = {}, {}
    for r in sorted(rows, key=lambda r: (r["created_at"], r["seq"])):
        held = state.get(r["idempotency_key"])
        free = held is None or r["created_at"] >= held[0] + timedelta(seconds=ttl)
        if free:
            state[r["idempotency_key"]] = held = (r["created_at"], r["transaction_id"])
        labels[r["seq"]] = (free, held[1], held[0])
    return labels


def skewed(seed, rows=600):
    """A third of the rows share one key; many moments coincide, some gaps exceed the ttl."""
    rng = random.Random(seed)
    made = []
    for seq in range(rows):
        key = "hot" if rng.random() < 0.34 else f"k{rng.randrange(40)}"
        moment = rng.choice([rng.randrange(50), rng.randrange(4000), 3000 + rng.randrange(5)])
        made.append(request(seq, idempotency_key=key, transaction_id=f"tx-{rng.randrange(200)}",
                            created_at=T0 + timedelta(seconds=moment)))
    return made


@pytest.mark.parametrize("fold_rows,ttl,broadcast", [(10_000, 60, None), (30, 60, None), (0, 7, 0), (0, 900, None)])
def test_equals_the_fold_by_hand(spark, monkeypatch, fold_rows, ttl, broadcast):
    if broadcast is not None:
        monkeypatch.setattr(hold_module, "BROADCAST_HOLDS", broadcast)
    rows = skewed(ttl)
    done = hold(requests(spark, *rows), ["idempotency_key"], "created_at", ["seq", "delivery_no"],
                "transaction_id", ttl, fold_rows)
    assert by_seq(done, "acquired", "holder", "held_since") == brute_force(rows, ttl)


def with_nulls(seed, rows=400):
    """Skewed rows of which some lack a part of their key or their moment."""
    rng = random.Random(seed)
    return [r | {"merchant_id": rng.choice([None, "m"]), "created_at": rng.choice([None] + [r["created_at"]] * 9),
                 "idempotency_key": rng.choice([None, r["idempotency_key"], r["idempotency_key"]])}
            for r in skewed(seed, rows)]


def brute_force_with_nulls(rows, ttl):
    labels, groups = {}, {}
    for r in rows:
        if r["created_at"] is None:
            labels[r["seq"]] = (True, r["transaction_id"], None)
        else:
            groups.setdefault((r["merchant_id"], r["idempotency_key"]), []).append(r)
    for group in groups.values():
        labels |= brute_force([r | {"idempotency_key": "one"} for r in group], ttl)
    return labels


@pytest.mark.parametrize("fold_rows", [0, 30, 10_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_null_keys_and_moments_on_every_path(spark, fold_rows, seed):
    rows = with_nulls(seed)
    done = hold(requests(spark, *rows), ["merchant_id", "idempotency_key"], "created_at", ["seq", "delivery_no"],
                "transaction_id", 60, fold_rows)
    assert by_seq(done, "acquired", "holder", "held_since") == brute_force_with_nulls(rows, 60)


def test_only_rows_beyond_a_sure_hold_are_folded(spark, monkeypatch):
    folded, fold = [], hold_module._in_turn

    def counted(df, *rest):
        folded.extend(r["seq"] for r in df.collect())
        return fold(df, *rest)

    monkeypatch.setattr(hold_module, "_in_turn", counted)
    assert by_seq(classify(requests(spark, *literal_cases()), fold_rows=100), "outcome")[5] == "PROCESSED"
    assert sorted(folded) == [5, 6]
