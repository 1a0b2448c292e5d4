"""Every registered query against its SQL, and the entry points."""

import os

import __spark_entry__ as entry
import pytest
from compare import connect, difference

from ledgerloom.plans import derive

SOURCE = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SOURCE), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    return connect(SOURCE)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, database, name):
    assert difference(entry.queries()[name](spark, SOURCE), database, entry.oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert set(entry.REGISTRY) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert {r["outcome"] for r in entry.entry(spark).collect()} <= {"PROCESSED", "DUPLICATE_REPLAY", "DUPLICATE_REJECTED"}


def test_replay_derives_the_log_once(spark, monkeypatch):
    calls, whole = [], derive.delivered_log
    monkeypatch.setattr(derive, "delivered_log", lambda *a: calls.append(a) or whole(*a))
    assert entry.REGISTRY["replay_into_ledger"](spark, SOURCE).count() > 0
    assert len(calls) == 1
