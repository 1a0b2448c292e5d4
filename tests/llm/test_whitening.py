import math

import numpy as np
import pytest
from llm_texts import SMALL

from ledgerloom.llm import whitening as W

DDL = "vec_id bigint, embedding array<float>, label int, n string, component int"


def table(llm, rows):
    return llm.createDataFrame([(i, v, 1, "x", 7) for i, v in rows], DDL).repartition(3)


def numbers(vector):
    return [math.floor(1024 * float(np.float32(c))) + 100_000 for c in vector]


def plain(rows, most=8):
    """n, deviations, coordinates by the definition, and eigenvalues with their trace."""
    x = np.array([numbers(v) for _, v in rows], object)
    n, total = len(x), x.sum(0)
    deviation = [int(((n * r - total) ** 2).sum()) for r in x]
    centred = (n * x - total).astype(float) / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return n, deviation, centred @ u / np.sqrt(e), e, np.trace(cov)


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    mixed = rng.standard_normal((n, d)) * np.linspace(1, 0.1, d) @ rng.standard_normal((d, d)) / 3
    return [(i, [float(c) for c in row]) for i, row in enumerate(mixed.astype(np.float32))]


def compared(got, rows):
    n, deviation, coordinates, e, trace = plain(rows)
    k = len(e)
    assert len(got) == len(rows) * k
    by = {}
    for r in got:
        by.setdefault(r["component"], {})[r["vec_id"]] = r
    for c in range(1, k + 1):
        mine = np.array([by[c][i]["whitened"] for i, _ in rows])
        want = coordinates[:, c - 1]
        sign = np.sign(mine @ want)
        assert np.allclose(mine, sign * want, rtol=1e-7, atol=1e-8)
        for k2, (i, _) in enumerate(rows):
            r = by[c][i]
            assert r["n"] == n and r["deviation"] == deviation[k2] and r["identity_error"] <= 1e-9
            assert math.isclose(r["explained"], e[c - 1] / trace, rel_tol=1e-9)


@pytest.mark.parametrize("n,d,least", [(200, 12, 16), (40, 3, 1024)])
def test_equals_local_whitening(llm, monkeypatch, n, d, least):
    monkeypatch.setattr(W, "LEAST_ROWS", least)
    rows = vectors(1, n, d)
    compared(W.whitened(table(llm, rows)).collect(), rows)


def test_rows_that_take_no_part(llm):
    rows = vectors(2, 30, 4)
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [1.0, float("nan"), 0.0, 0.0]), (103, [float("inf")] * 4),
           (104, []), (105, [1.0, 2.0]), (106, [1e30, 0.0, 0.0, 0.0])]
    compared(W.whitened(table(llm, rows + odd)).collect(), rows)


def test_repeated_rows_count_and_null_ids_stay(llm):
    rows = vectors(3, 20, 3)
    got = W.whitened(table(llm, [*rows, rows[0], (None, rows[1][1])])).collect()
    assert len(got) == 22 * 3 and all(r["n"] == 22 for r in got)
    assert sum(r["vec_id"] is None for r in got) == 3 and sum(r["vec_id"] == 0 for r in got) == 6


def test_directions_without_variance(llm):
    flat = [(i, [*v, 0.5]) for i, v in vectors(4, 25, 2)]
    got = W.whitened(table(llm, flat)).collect()
    assert {r["component"] for r in got} == {1, 2} and all(r["identity_error"] < 1e-9 for r in got)
    assert W.whitened(table(llm, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert W.whitened(table(llm, [(1, None)])).count() == 0
    assert W.whitened(table(llm, [])).columns == [c.split()[0] for c in W.OUT.split(", ")]


def test_large_numbers_stay_exact(llm):
    rows = [(i, [v[0] * 1e6, v[1] * 1e6]) for i, v in vectors(5, 300, 2)]
    n, deviation, _, _, _ = plain(rows)
    got = {r["vec_id"]: r["deviation"] for r in W.whitened(table(llm, rows)).collect()}
    want = {i: d if d < 1 << 63 else None for (i, _), d in zip(rows, deviation)}
    assert got == want and any(d is None for d in want.values()) and any(d for d in want.values())


def test_query(llm):
    rows = [tuple(r) for r in llm.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    compared(W.op12_whitening(llm, SMALL).collect(), usable)
