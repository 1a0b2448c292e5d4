import random

import pytest
from llm_texts import SMALL, odd_texts

from ledgerloom.llm import mixing as M


def plain_schedule(shares):
    period, done, out = sum(shares), [0] * len(shares), []
    for t in range(period):
        ready = [(-(-(done[s] + 1) * period // a), s) for s, a in enumerate(shares)
                 if done[s] < a and done[s] * period // a <= t]
        _, s = min(ready)
        out.append((t, s, done[s], list(done)))
        done[s] += 1
    return out


@pytest.mark.parametrize("seed", range(5))
def test_schedule_stays_within_one_block(llm, seed):
    rng = random.Random(seed)
    shares = [rng.choice([1, 2, 3, 7, 20, 60]) for _ in range(rng.randrange(1, 9))]
    got = sorted((r["slot"], r["place"], r["number"], r["done"]) for r in M.schedule(llm, shares).collect())
    assert got == plain_schedule(shares)
    period = sum(shares)
    for t, s, number, done in got:
        assert number * period // shares[s] <= t < -(-(number + 1) * period // shares[s])
        assert all(abs(d - t * a / period) < 1 for d, a in zip(done, shares))


def test_rows_are_whole_and_in_share(make):
    rows = [(i, t) for i, t in enumerate(odd_texts(1, 150))] + [(3, "twice"), (3, "twice"), (None, None)]
    docs = make(rows)
    got = M.mixed(docs, {"s0": 3, "s1": 1, "s2": 2}, block_rows=2).collect()
    assert sorted(r["_position"] for r in got) == list(range(len(rows)))
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    in_order = sorted(got, key=lambda r: r["_position"])
    slots = [r["_slot"] for r in in_order]
    assert slots == sorted(slots)
    for r in got:
        assert r["_release"] <= r["_slot"] < r["_deadline"]
    # Until the first source ends, every source is within a block of its share.
    left = {s: sum(r["source"] == s for r in got) for s in ("s0", "s1", "s2")}
    seen = dict.fromkeys(left, 0)
    for n, r in enumerate(in_order, 1):
        seen[r["source"]] += 1
        for s, a in {"s0": 3, "s1": 1, "s2": 2}.items():
            assert abs(seen[s] - n * a / 6) < 2 * 2
        if seen[r["source"]] == left[r["source"]]:
            break


def test_null_source_and_empty_table(llm, make):
    docs = llm.createDataFrame([(i, "t", None if i % 2 else "a") for i in range(20)], "doc_id bigint, text string, source string")
    assert sorted(r["_position"] for r in M.mixed(docs).collect()) == list(range(20))
    assert M.mixed(make([])).count() == 0
    assert M.in_order(docs).columns == docs.columns and M.in_order(docs).count() == 20


def test_no_python_on_the_main_path(make):
    plan = M.mixed(make([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_over_the_given_table(llm):
    got = M.op2_pfair_mixing(llm, SMALL).collect()
    n = llm.read.parquet(f"{SMALL}/documents.parquet").count()
    assert sorted(r["position"] for r in got) == list(range(n))
