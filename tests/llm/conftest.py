import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.llm.common import ready  # noqa: E402

from llm_texts import SMALL  # noqa: E402,F401


@pytest.fixture(scope="session")
def llm(spark):
    return ready(spark)


@pytest.fixture()
def make(llm):
    """Documents from (doc_id, text) rows, with extra columns of clashing names."""
    def build(rows, **more):
        table = [(i, t, "en", f"s{(i or 0) % 3}", 0, "x", 1) for i, t in rows]
        return llm.createDataFrame(
            table, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, start int"
        ).repartition(3)
    return build
