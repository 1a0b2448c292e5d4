import hashlib
import random
import re

import pytest
from llm_texts import SMALL, odd_texts

from ledgerloom.llm import content_sort as C


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is not None, i or 0))
    out = []
    for content, members in groups.items():
        members.sort()
        for k, (_, real, i) in enumerate(members):
            digest = hashlib.sha256(content.encode()).hexdigest()
            first = members[0]
            out.append((i if real else None, first[2] if first[1] else None, len(members), k == 0, digest))
    return out


def shown(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("parts", [1, 3, 65536])
def test_against_grouping_in_memory(make, monkeypatch, parts):
    monkeypatch.setattr(C, "PARTS", parts)
    rng = random.Random(parts)
    texts = odd_texts(parts, 60)
    texts += [(t or "").replace(" ", rng.choice(["", "  ", "\n"])) for t in texts]
    rows = list(enumerate(texts + ["hot copy " + " " * rng.randrange(3) for _ in range(80)])) + [
        (5, "twice"), (5, "twice"), (5, " twice"), (None, "no id"), (None, "no id"), (900, "noid")]
    rng.shuffle(rows)
    assert shown(tuple(r) for r in C.decided(make(rows)).collect()) == shown(plain(rows))
    kept = C.deduplicated(make(rows))
    assert kept.columns == make(rows).columns
    want = [r[0] for r in plain(rows) if r[3]]
    assert shown(r["doc_id"] for r in kept.collect()) == shown(want)


def test_empty_table(make):
    assert C.decided(make([])).count() == 0 and C.deduplicated(make([])).count() == 0


def test_no_python_and_one_text_shuffle(make):
    plan = C.compared(make([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_its_sql(llm):
    from compare import connect, difference
    assert difference(C.op7_content_sort(llm, SMALL), connect(SMALL), C.OP7_SQL) is None


def test_neighbours_are_those_of_the_content(make):
    rows = [(1, "b" * 40), (2, "\n" * 200 + "b" * 40), (3, "b" * 32 + "a"), (4, None)]
    plan = C.compared(make(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"lag\(content#\d+, -1, null\) windowspecdefinition\(head#\d+, part#\d+L?, content#", plan)
    assert shown(tuple(r) for r in C.decided(make(rows)).collect()) == shown(plain(rows))


def test_rows_that_begin_alike_are_cut_into_parts(make, monkeypatch):
    monkeypatch.setattr(C, "HEAD_ROWS", 5)
    rows = [(n, "x" * 40 + str(n % 7) + " " * (n % 3)) for n in range(90)]
    headed = make(rows).select(C.leading(C.F.col("text")).alias("head"))
    assert [tuple(r) for r in C._cuts(headed, 90).collect()] == [("x" * 32, 18)]
    assert shown(tuple(r) for r in C.decided(make(rows)).collect()) == shown(plain(rows))
