import math

import duckdb
import numpy as np
import pytest
from llm_texts import SMALL
from pyspark.sql import functions as F

from ledgerloom.llm import hard_negatives as H

DDL = "vec_id bigint, embedding array<float>, label int, rank string, score int, block string"


def table(llm, rows):
    return llm.createDataFrame([(i, v, k, "x", 7, "y") for i, v, k in rows], DDL).repartition(3)


def plain(rows, anchors, positives=5, negatives=3, low=50, high=95):
    """The definition over rows of distinct ids."""
    used = [(i, [math.floor(256 * float(np.float32(c))) for c in v], k) for i, v, k in rows
            if i is not None and k is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, x, k in used:
        if not anchors(i):
            continue
        scored = [(sum(a * b for a, b in zip(x, y)), j, m) for j, y, m in used if j != i]
        same = sorted(((-s, j) for s, j, m in scored if m == k))[:positives]
        for minus, j in same:
            p = -minus
            fits = sorted((-s, n) for s, n, m in scored if m != k and low * p <= 100 * s <= high * p)[:negatives]
            out += [(i, j, r, n, p, -s) for r, (s, n) in enumerate(fits, 1)]
    return sorted(out)


def vectors(seed, n, d, size=0.3, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, d)) * size
    x = centres[rng.integers(0, 6, n)] + rng.standard_normal((n, d)) * size * 0.5
    return [(i, [float(c) for c in row], int(rng.integers(0, labels))) for i, row in enumerate(x.astype(np.float32))]


def run(llm, rows, every=3, **how):
    got = H.mined(table(llm, rows), F.col("vec_id") % every == 0, **how).collect()
    return sorted(map(tuple, got))


@pytest.mark.parametrize("seed,n,d,size", [(1, 200, 16, 0.3), (2, 90, 3, 0.05), (3, 120, 5, 300.0), (4, 100, 4, 200_000.0)])
def test_equals_the_definition(llm, seed, n, d, size):
    rows = vectors(seed, n, d, size)
    want = plain(rows, lambda i: i % 3 == 0)
    assert run(llm, rows) == want and len(want) > 50


def test_blocks_strips_and_pieces_change_nothing(llm, monkeypatch):
    rows = vectors(5, 150, 6)
    want = plain(rows, lambda i: i % 2 == 0, 4, 2, 10, 99)
    for name, value in (("PIECE_ROWS", 7), ("ANCHOR_BLOCK", 20), ("STRIP_ROWS", 40), ("FIRST_ROWS", 1), ("SCORES_HELD", 64)):
        monkeypatch.setattr(H, name, value)
    assert run(llm, rows, 2, positives=4, negatives=2, low=10, high=99) == want


def test_ties_go_to_smaller_ids(llm):
    rows = [(i, [1.0, 0.5], i % 2) for i in range(20)] + [(i, [0.75, 0.25], i % 2) for i in range(20, 50)]
    got = run(llm, rows, 10)
    assert got == plain(rows, lambda i: i % 10 == 0) and got


def test_rows_that_take_no_part(llm):
    rows = vectors(6, 60, 4)
    odd = [(300, None, 1), (303, [1.0, None, 0.0, 0.0], 1), (306, [float("nan")] * 4, 1), (309, [1.0] * 4, None),
           (312, [float("-inf")] * 4, 2), (None, [1.0] * 4, 1), (315, [], 1), (318, [1.0], 1), (321, [1e30] * 4, 1)]
    assert run(llm, rows + odd) == plain(rows, lambda i: i % 3 == 0)


def test_repeated_rows_count_once(llm):
    rows = vectors(7, 60, 4)
    assert run(llm, rows + rows[:20] + [rows[0]] * 3) == plain(rows, lambda i: i % 3 == 0)


def test_one_id_with_other_vectors_answers_for_each(llm):
    rows = vectors(8, 40, 4)
    other = [(0, [0.9, 0.1, 0.4, 0.2], 1)]
    got = run(llm, rows + other, 50)
    first = [r for r in plain(rows, lambda i: i == 0)]
    second = [r for r in plain(rows[1:] + other, lambda i: i == 0)]
    # Either row may be a negative of the other, as their labels may differ.
    assert set(second) - set(got) == set() or any(r[3] == 0 for r in got)
    assert {r[1] for r in got} == {r[1] for r in first} | {r[1] for r in second}


def test_nothing_to_find(llm):
    assert run(llm, []) == [] and run(llm, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert run(llm, [(0, [1.0], 1)]) == [] and run(llm, [(0, [1.0], 1), (1, [1.0], 1)]) == []


def test_limits_round_inwards():
    scores = np.arange(-500, 500)
    least, most = H.bounds(scores, 50, 95)
    assert (least == -((-50 * scores) // 100)).all() and (most == 95 * scores // 100).all()


def test_scores_too_large_for_64_bits():
    with pytest.raises(OverflowError):
        H.layout_of([-(1 << 28)] * 512, [1 << 28] * 512)


def test_query_and_its_sql(llm):
    got = sorted(map(tuple, H.op13_hard_negatives(llm, SMALL).collect()))
    base = duckdb.connect()
    base.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    assert sorted(base.execute(H.OP13_SQL).fetchall()) == got and got
    rows = [(i, v, (k + 1) % 10 if i % 7 == 0 and k is not None else k) for i, v, k in
            llm.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got == plain(rows, lambda i: i % 50 == 0)
