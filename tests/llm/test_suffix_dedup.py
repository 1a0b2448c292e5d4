import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from llm_texts import SMALL, odd_texts

from ledgerloom.llm import suffix_dedup as S


def plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    seen, out = set(), []
    for number, text in order:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            piece = data[i:i + 100]
            if piece in seen:
                gone[i:i + 100] = b"\1" * 100
            seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((number, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shown(rows):
    return sorted(map(str, rows))


def test_cover_meets_every_difference():
    differences = {int(a - b) % S.PERIOD for a in S.COVER for b in S.COVER}
    assert differences == set(range(S.PERIOD))


@pytest.mark.parametrize("width", [1, 2, 44, 57, 100])
def test_window_hashes(monkeypatch, width):
    monkeypatch.setattr(S, "HASHED_BYTES", 64)
    data = np.random.default_rng(width).integers(0, 3, 400).astype(np.uint8)
    got = S.window_hashes(data, width, 1)
    classes = {}
    for i, h in enumerate(got.tolist()):
        assert classes.setdefault(data[i:i + width].tobytes(), h) == h
    assert len(set(classes.values())) == len(classes) and len(got) == 401 - width


def test_packing_round_trip():
    tags = {"id": np.array([5, S.NO_ID, 9]), "k": np.array([0, 1, 0]), "t": np.array([3, 3, 3])}
    docs, places = np.array([0, 0, 2, 2, 2]), np.array([7, 900, 0, 1, 1 << 33])
    got = S.unpacked(S.packed(tags, docs, places, np.arange(5, dtype=np.uint32)), np.uint32)
    assert got["place"].tolist() == places.tolist() and got["id"].tolist() == [5, 9]
    assert got["count"].tolist() == [2, 3] and got["extra"].tolist() == list(range(5))


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefghé "
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [make(n) for n in (60, 98, 99, 100, 101, 130, 157, 400)]
    texts = []
    for _ in range(50):
        text = make(rng.randrange(120))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(max(1, len(p) - 90))
            text += p[a:a + rng.randrange(80, 500)] + make(rng.randrange(30))
        texts.append(text)
    texts += [rng.choice(texts) for _ in range(12)] + ["z" * 350, "xy" * 200, "z" * 99]
    rng.shuffle(texts)
    return list(enumerate(texts + odd_texts(seed, 10)))


@pytest.mark.parametrize("seed", range(3))
def test_against_all_strings(make, monkeypatch, seed):
    monkeypatch.setattr(S, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(S, "BATCH_BYTES", [8 << 20, 500, 2000][seed])
    rows = corpus(seed)
    rows += [(7, "again " * 40), (7, "again " * 40), (7, rows[3][1]), (None, rows[5][1]), (None, "q" * 120)]
    got = [tuple(r) for r in S.cut(make(rows)).drop("kept_bytes").collect()]
    assert shown(got) == shown(plain(rows))


def test_kept_bytes(make):
    r = S.cut(make([(1, "é" * 60 + "end"), (2, "é" * 60 + "tail")])).filter("doc_id = 2").first()
    assert bytes(r["kept_bytes"]) == b"tail" and r["n_removed"] == 120 and r["n_spans"] == 1


def test_empty_table(make):
    assert S.cut(make([])).count() == 0


def test_query_over_the_given_table(llm):
    rows = [(r["doc_id"], r["text"]) for r in llm.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert shown(tuple(r) for r in S.op8_suffix_dedup(llm, SMALL).collect()) == shown(plain(rows))


def test_a_bucket_is_gathered_in_little_memory():
    n, docs = 400_000, 200
    tags = {"id": np.arange(docs), "k": np.zeros(docs, np.int64), "t": np.zeros(docs, np.int64)}
    doc, place = np.repeat(np.arange(docs), n // docs), np.tile(np.arange(n // docs), docs)
    half = [doc % 2 == h for h in (1, 0)]
    blobs = [S.packed(tags, doc[h], place[h], place[h].astype(np.uint64)) for h in half]
    tracemalloc.start()
    found = S._gathered(blobs, np.uint64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found["doc"] == doc).all() and (found["place"] == place).all() and (found["extra"] == place).all()
    assert peak < 50 * n
