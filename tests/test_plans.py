"""Plans of the batch queries: no cross products, no Python in the row path, pruned scans."""

import os

import __spark_entry__ as entry
import pytest

SOURCE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SOURCE), reason="no test tables")
BATCH = sorted(n for n in entry.REGISTRY if not n.endswith("_stream"))
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas",
            "FlatMapGroupsInPandas", "CollectLimit")


def plan(spark, name):
    return entry.queries()[name](spark, SOURCE)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_unwanted_operator(spark, name):
    text = plan(spark, name)
    assert [word for word in UNWANTED if word in text] == []


@pytest.mark.parametrize("name,columns", [
    ("load_summary", "struct<event_type:string,value:double>"),
    ("rate_window_counts", "struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>"),
    ("config_keys", "struct<c_custkey:bigint>")])
def test_scans_read_only_what_is_used(spark, name, columns):
    assert f"ReadSchema: {columns}" in plan(spark, name)


def test_window_of_the_status_counts_combines_before_its_shuffle(spark):
    assert "partial_count" in plan(spark, "outcome_summary")
