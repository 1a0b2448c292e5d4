import random

import numpy as np
import pyarrow as pa
import pytest
from llm_texts import SMALL, odd_texts

from ledgerloom.llm import jaccard_join as J
from ledgerloom.llm.components import components


def plain_set(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = lowered.encode().split()
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    sets = [(i, plain_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, len(s), find(i)) for i, s in sets)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        words[at:at + 1] = [] if kind == 0 and len(words) > 1 else [rng.choice("pqrst") * 3] if kind == 1 else [words[at], "new"]
    return " ".join(words)


def corpus(seed, passage=()):
    rng = random.Random(seed)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 6, 9, 14, 30, 80, 300]))] + list(passage)
        texts += [edited(rng, base, rng.randrange(0, max(2, len(base) // 25))) for _ in range(rng.randrange(1, 5))]
    rng.shuffle(texts)
    return list(enumerate(texts + odd_texts(seed, 12)))


@pytest.mark.parametrize("seed", range(12))
def test_linked_sets_share_a_signature(seed):
    rows = corpus(seed, [f"p{k}" for k in range(seed * 4)])
    values, sizes = J.shingle_sets(pa.array([t or "" for _, t in rows]))
    assert sizes.tolist() == [len(plain_set(t)) for _, t in rows]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    frequent = np.unique(values)[:: 3 + seed] if seed % 2 else np.zeros(0, np.uint64)
    sig, owner = J.signatures(values, sizes, frequent)
    own = {k: set(sig[owner == k].tolist()) for k in range(len(rows))}
    linked = 0
    for i in range(len(rows)):
        for j in range(i):
            a, b = values[edges[i]:edges[i + 1]], values[edges[j]:edges[j + 1]]
            common = len(np.intersect1d(a, b))
            if len(a) and len(b) and 100 * common >= 80 * (len(a) + len(b) - common):
                linked += 1
                assert own[i] & own[j], (len(a), len(b), common)
    assert linked > 5


@pytest.mark.parametrize("seed", range(3))
def test_components_against_all_pairs(make, monkeypatch, seed):
    rows = corpus(seed, [f"p{k}" for k in range(20)])
    got = sorted(tuple(r) for r in J.joined(make(rows)).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("tries", [0, 1])
def test_crowded_signatures(make, monkeypatch, tries):
    monkeypatch.setattr(J, "FIRST_TRIES", tries)
    monkeypatch.setattr(J, "LOCAL_GROUP", 2)
    monkeypatch.setattr(J, "BLOCK_MEMBERS", 10)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, edited(rng, base, rng.randrange(4))) for i in range(60)] + [(100 + i, " ".join(base)) for i in range(9)]
    assert sorted(tuple(r) for r in J.joined(make(rows)).collect()) == brute(rows)


@pytest.mark.parametrize("sig, ids, sizes", [([1, 1, 1], [3, 3, 9], [10, 100, 100]), ([1, 1, 1], [3, 3, 9], [100, 10, 100]),
                                             ([1, 1, 2, 2], [3, 9, 3, 9], [10, 100, 100, 100])])
def test_any_size_of_an_id_gives_its_pairs(sig, ids, sizes):
    found = J._groups(np.array(sig, np.uint64), np.array(ids), np.array(sizes), np.zeros(len(sig), bool), True)
    assert [(a, b) for rows in found for k, a, b in zip(rows["kind"], rows["a"], rows["b"]) if k == J.PAIR] == [(3, 9)]


def test_any_text_of_an_id_links_in_a_bucket(llm, make, monkeypatch):
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10_000)}" for _ in range(n)]
    rows = [(1, " ".join(words(60)))]
    for k in range(12):
        text = words(60)
        rows += [(10 + 2 * k, " ".join(words(60))), (10 + 2 * k, " ".join(text)), (11 + 2 * k, " ".join(text[:58] + ["x", "y"]))]
        if k % 2:
            rows[-3], rows[-2] = rows[-2], rows[-3]
    values, sizes = J.shingle_sets(pa.array([t for _, t in rows]))
    bits = J.bitmaps(values, sizes)
    found = [(J.DOC, i, int(n), bytearray(b.tobytes())) for (i, _), n, b in zip(rows, sizes, bits)]
    found += [(J.MEMBER, 7, i, None) for i in sorted({i for i, _ in rows})]
    monkeypatch.setattr(J, "candidates", lambda docs: llm.createDataFrame(found, J.FOUND))
    assert sorted(tuple(r) for r in J.joined(make(rows)).collect()) == brute(rows)


def test_more_ids_in_pairs_than_are_broadcast(make, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_IDS", 3)
    rows = corpus(4, [f"p{k}" for k in range(20)])
    assert sorted(tuple(r) for r in J.joined(make(rows)).collect()) == brute(rows)


def test_pairs_found_in_several_parts_come_once(llm):
    rng = np.random.default_rng(1)
    pairs = rng.integers(0, 30, (400, 2))
    rows = [J._dealt_pairs(J._rows(J.PAIR, part[:, 0], part[:, 1]), 7) for part in np.split(pairs, 4)]
    table = [(J.PAIR, int(a), int(b), bytearray(bits)) for r in rows for a, b, bits in zip(r["a"], r["b"], r["bits"])]
    got = [tuple(r) for r in J.distinct_pairs(llm.createDataFrame(table, J.FOUND)).collect()]
    assert sorted(got) == sorted(set(map(tuple, pairs.tolist())))


@pytest.mark.parametrize("local", [2, 1000])
def test_ids_with_several_texts(make, monkeypatch, local):
    monkeypatch.setattr(J, "LOCAL_GROUP", local)
    rows = [(i if i % 5 else i // 10, t) for i, t in corpus(2, [f"p{k}" for k in range(20)])]
    assert sorted(tuple(r) for r in J.joined(make(rows)).collect()) == brute(rows)


def test_empty_and_rows_without_id(make):
    assert J.joined(make([])).count() == 0
    text = "one two three four five six"
    rows = [(None, text), (4, text), (2, text), (2, text), (7, None)]
    got = sorted((str(r[0]), r[1], str(r[2])) for r in J.joined(make(rows)).collect())
    assert got == [("2", 2, "2"), ("2", 2, "2"), ("4", 2, "2"), ("7", 0, "7"), ("None", 2, "None")]
    kept = sorted(str(r["doc_id"]) for r in J.thinned(make(rows)).collect())
    assert kept == ["2", "2", "7", "None"]


def test_long_chain_of_links(llm):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001)]
    got = {r["id"]: r["component_id"] for r in components(llm.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_query_over_the_given_table(llm):
    rows = [(r["doc_id"], r["text"]) for r in llm.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in J.op10_jaccard_join(llm, SMALL).collect()) == brute(rows)


def test_buckets_of_the_same_members_are_gone_through_once(make, monkeypatch):
    seen, real = [], J.survivors

    def noted(rows, tries=None):
        groups = {}
        for r in rows.collect():
            groups.setdefault(r["sig"], set()).add(r["id"])
        seen.append(sorted(map(sorted, groups.values())))
        return real(rows, tries)

    monkeypatch.setattr(J, "survivors", noted)
    shared = " ".join(f"w{n}" for n in range(300))
    rows = [(i, " ".join(f"own{i}x{n}" for n in range(60)) + " " + shared) for i in range(4)]
    got = J.joined(make(rows)).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, i) for i in range(4)}
    assert seen and seen[0]
    assert all(a != b for groups in seen for a, b in zip(groups, groups[1:]))


def passages_in_long_texts(seed, texts=10):
    """Texts apart that share passages, and are too long for bitmaps to tell them apart."""
    rng = random.Random(seed)
    shared = [[f"p{k}x{n}" for n in range(30)] for k in range(30)]
    return [(i, " ".join([f"own{i}x{n}" for n in range(2300)] + [w for p in shared if rng.random() < 0.6 for w in p]))
            for i in range(texts)]


@pytest.mark.parametrize("members", [2048, 4])
def test_a_pair_in_many_buckets_is_given_once(llm, make, monkeypatch, members):
    given, real, together = [], J.survivors, "spark.sql.adaptive.coalescePartitions.enabled"

    def noted(rows, tries=None):
        out = real(rows, tries)
        # One task would give equal pairs once anyway.
        llm.conf.set(together, "false")
        given.append([tuple(r) for r in out.collect()])
        llm.conf.set(together, "true")
        return out

    monkeypatch.setattr(J, "survivors", noted)
    monkeypatch.setattr(J, "BLOCK_MEMBERS", members)
    monkeypatch.setattr(J, "FIRST_TRIES", 0)
    rows = passages_in_long_texts(7)
    assert sorted(tuple(r) for r in J.joined(make(rows)).collect()) == brute(rows)
    assert len(given[1]) > 10
    assert len(given[1]) == len(set(given[1]))


@pytest.mark.parametrize("named", [1, 2])
def test_members_that_name_no_bucket_in_common(make, monkeypatch, named):
    monkeypatch.setattr(J, "NAMED", named)
    rows = passages_in_long_texts(8) + [(100 + i, t) for i, t in corpus(5, [f"p{k}" for k in range(20)])]
    assert sorted(tuple(r) for r in J.joined(make(rows)).collect()) == brute(rows)


def test_first_bucket_that_both_name():
    left = np.array([[5, 9, 9], [5, 9, 2], [1, 1, 1]])
    right = np.array([[9, 7, 2], [4, 9, 2], [2, 2, 2]])
    assert J._given_here(np.array([9, 2, 3]), left, right).tolist() == [True, False, True]
