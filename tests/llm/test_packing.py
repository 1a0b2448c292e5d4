import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_texts import SMALL, odd_texts
from tokenizers import Tokenizer

from ledgerloom.llm import packing

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def fewest(lengths, capacity):
    """Fewest bins by trying all ways, for a handful of pieces."""
    best = len(lengths)

    def put(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity:
                put(k + 1, bins[:i] + [bins[i] + lengths[k]] + bins[i + 1:])
        put(k + 1, [*bins, lengths[k]])

    put(0, [])
    return best


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_a_packing_near_the_best(seed):
    rng = np.random.default_rng(seed)
    lengths = sorted(rng.integers(1, 21, 9).tolist(), reverse=True)
    counts = np.bincount(lengths, minlength=21)
    patterns = packing.plan(counts, 20)
    used = np.zeros(21, int)
    for combination, times in patterns:
        assert sum(combination) <= 20 and times > 0
        for x in combination:
            used[x] += times
    assert (used == counts).all()
    assert sum(n for _, n in patterns) <= fewest(lengths, 20) + 1


def test_plan_fills_large_counts():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 500, 2049)
    counts[0] = 0
    patterns = packing.plan(counts, 2048)
    total = int((counts * np.arange(2049)).sum())
    plain = sum(n for _, n in packing.best_fit(counts, 2048))
    assert sum(n for _, n in patterns) <= min(plain, -(-total // 2048) * 1.02)
    assert len(patterns) < 5 * 2048


def test_indexes_follow_the_counts():
    index = packing.Complements(np.array([0, 2, 0, 1, 4]))
    index.take((1, 1), 1)
    index.take((4,), 2)
    fresh = packing.Complements(index.left)
    assert (index.pairs == fresh.pairs).all() and (index.there == fresh.there).all()


def check(rows, got, capacity=2048):
    t = Tokenizer.from_file(BYTE)
    want = []
    for number, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % capacity or capacity
        edges = [0, *range(first, len(ids) + 1, capacity)]
        want += [(number, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    key = lambda r: (r[0] is not None, *[x or 0 for x in r])
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in bins.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(r["length"] for r in got)
    return len(bins), -(-total // capacity)


def test_query_over_the_given_table(llm):
    rows = [(r["doc_id"], r["text"]) for r in llm.read.parquet(f"{SMALL}/documents.parquet").collect()]
    used, least = check(rows, packing.op3_best_fit_packing(llm, SMALL).collect())
    assert used <= least + 2


def test_odd_rows(make):
    rows = [(i, t) for i, t in enumerate(odd_texts(5, 80))] + [(1, ""), (None, "a b"), (None, None)]
    check(rows, packing.packed(make(rows), BYTE, 64).collect(), 64)
    assert packing.packed(make([]), BYTE).count() == 0
