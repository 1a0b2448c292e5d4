"""Ranking, first rows and percentiles must not depend on how hot a group is."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import skew, webhooks
from ledgerloom.operators.loadrun import percentiles


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{i % 20}"), rng.randrange(40)) for i in range(900)]
    return spark.createDataFrame(rows, "id bigint, k string, t bigint").cache()


@pytest.mark.parametrize("rows", [1_000_000, 100, 0])
def test_ranked(hot, rows):
    want = hot.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")))
    got = skew.ranked(hot, ["k"], ["t", "id"], "n", rows)
    assert sorted(map(tuple, got.select("id", "n").collect())) == sorted(map(tuple, want.select("id", "n").collect()))


def test_hot_list_beyond_the_broadcast_bound_stays_a_table(hot, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_KEYS", 2)
    cold, warm, rows = skew.split_hot(hot, ["k"], 20)
    assert cold.count() + rows == 900 and warm.count() == rows
    assert warm.groupBy("k").count().filter("count <= 20").count() == 0
    assert cold.groupBy("k").count().filter("count > 20").count() == 0


def test_first_rows(hot):
    flagged = skew.is_first(hot, ["k"], ["t", "id"], "first")
    assert flagged.count() == 900
    firsts = {r["k"]: r["id"] for r in flagged.filter("first").collect()}
    want = {}
    for r in sorted(hot.collect(), key=lambda r: (r["t"], r["id"])):
        want.setdefault(r["k"], r["id"])
    assert firsts == want


@pytest.mark.parametrize("size", [1, 2, 501])
def test_percentiles_do_not_depend_on_the_way(spark, size):
    rng = random.Random(size)
    values = spark.createDataFrame([(round(rng.lognormvariate(3, 2), rng.randrange(3)),) for _ in range(size)], "v double")
    quantiles, names = (0.0, 0.5, 0.9, 0.99, 1.0), ("a", "b", "c", "d", "e")
    one = percentiles(values, "v", quantiles, names).first()
    many = percentiles(values, "v", quantiles, names, buffered=0).first()
    assert [round(x, 9) for x in one] == [round(x, 9) for x in many]


def test_hot_rows_are_ranked_where_they_were_sorted(hot):
    plan = skew.ranked(hot, ["k"], ["t", "id"], "n", 0)._jdf.queryExecution().optimizedPlan().toString()
    whole = plan[plan.index("_in_slice"):]
    assert "row_number" not in whole and "RepartitionByExpression" not in whole


def test_payloads_leave_event_ids_behind(spark):
    events = spark.createDataFrame([("e1", "https://a", "t", "ACCEPTED", "c", 1, 0, 1, 0)], (
        "event_id string, callback_url string, transaction_id string, status string, correlation_id string, "
        "seq long, delivery_no int, stage_no int, copy_no int")).withColumn("occurred_at", F.current_timestamp())
    done = webhooks.payloads(events, rows=0)
    assert done.count() == 1
    assert not any("event_id" in spark.read.parquet(f).columns for f in done.inputFiles())
