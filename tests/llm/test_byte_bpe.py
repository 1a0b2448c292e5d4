import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from llm_texts import SMALL, odd_texts

from ledgerloom.llm import byte_bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def wanted(library, doc_id, text):
    ids = library.encode_ordinary(text or "")
    return (doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(library.decode_bytes(ids)).hexdigest())


def key(row):
    return tuple(str(x) for x in row)


def awkward():
    rng = random.Random(5)
    return [*odd_texts(3, 60), "x" * 3000, " " * 900 + "a", "a" + "\n \t" * 400 + "b" * 700 + "'s't", "!'tx" * 300, "日本語" * 400,
            "日本,語。" * 300, "12" * 600 + " 7", "".join(rng.choice(" \n'asé!1\xa0") for _ in range(4000)),
            "".join(rng.choice(["a" * 150, " " * 130, "'ll", "1", "é" * 90, "\n", "?!"]) for _ in range(200))]


@pytest.mark.parametrize("chunk,overlap", [(37, 11), (200, 64), (1000, 100), (1 << 16, 1 << 10)])
def test_equals_the_library_at_any_chunk_size(library, make, chunk, overlap):
    rows = list(enumerate(awkward())) + [(3, "again " * 50), (3, "again " * 50), (None, "no id " * 40)]
    got = B.digests(make(rows), PATH, chunk, overlap).collect()
    assert sorted(map(key, map(tuple, got))) == sorted(key(wanted(library, i, t)) for i, t in rows)


def test_pieces_join_to_the_ids_and_bytes_of_the_text(library, make):
    rows = [(i, t) for i, t in enumerate(awkward())]
    pieces = B.encoded(make(rows), PATH, 128, 32)
    ids, data, longest = {}, {}, 0
    for r in sorted(B.decoded(pieces, PATH).collect(), key=lambda r: (r["doc_id"], r["piece"])):
        ids.setdefault(r["doc_id"], []).extend(B.unpacked(r["ids"]))
        data[r["doc_id"]] = data.get(r["doc_id"], b"") + r["data"]
        longest = max(longest, r["piece"])
    assert longest > 10
    for i, t in rows:
        assert ids[i] == library.encode_ordinary(t or "") and data[i] == (t or "").encode()


def test_every_chunk_of_plain_text_is_a_piece_of_its_own(make):
    text = "some plain words, and then a few more. " * 200
    assert B.encoded(make([(1, text)]), PATH, 512, 64).count() == -(-len(text) // 512)


def test_runs_of_white_space_beyond_the_library(make):
    text = "a" + " " * 1_200_000 + "b"
    codec = B.RankCodec(PATH)
    (got,) = B.digests(make([(1, text)]), PATH).collect()
    assert got["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    # One space goes with the letter, the rest is one run.
    run = codec.single.encode_ordinary(" " * 1_199_999)
    assert got["n_tokens"] == len(run) + 2


def test_no_rows(make):
    assert B.digests(make([]), PATH).count() == 0


def test_query(library, llm):
    docs = llm.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = B.op11_byte_bpe(llm, SMALL).collect()
    assert sorted(map(key, map(tuple, got))) == sorted(key(wanted(library, r["doc_id"], r["text"])) for r in docs)
