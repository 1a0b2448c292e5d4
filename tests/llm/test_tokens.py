import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import simple8b, token_counts, token_files
from ledgerloom.llm.vocabulary import ByteLevelCodec, WordCounter
from llm_texts import SMALL, odd_texts

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(path, texts):
    t = Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("seed", range(4))
def test_codec_gives_the_ids_of_the_library(seed):
    texts = [t or "" for t in odd_texts(seed, 400)]
    flat, counts = ByteLevelCodec(BYTE).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == plain_ids(BYTE, texts)


@pytest.mark.parametrize("seed", range(4))
def test_counter_gives_the_counts_of_the_library(seed):
    texts = [t or "" for t in odd_texts(seed, 400)]
    got = token_counts.lengths_of(pa.array(texts), WordCounter(WORD))
    assert got.tolist() == [len(x) for x in plain_ids(WORD, texts)]


def test_long_texts_are_cut_whole():
    text = ("word " * 50 + "x" * 300 + "\n") * 20
    pieces = token_counts.safe_pieces(text, 100)
    assert "".join(pieces) == text and len(pieces) > 20
    assert token_counts.safe_pieces("y" * 500, 100) == ["y" * 500]


@pytest.mark.parametrize("seed", range(6))
def test_coding_round_trip(seed):
    rng = np.random.default_rng(seed)
    groups = rng.integers(0, 5000, 7)
    top = [1, 2, 50_000, 1 << 40, 1 << 60, (1 << 64) - 1][seed]
    values = rng.integers(0, top, int(groups.sum()), dtype=np.uint64, endpoint=seed == 5)
    words, strips, per_group, escapes = simple8b.encode(values, groups)
    edges, at = np.cumsum(per_group) - per_group, 0
    for g, (size, start, n) in enumerate(zip(groups, edges, per_group)):
        got = simple8b.decode(words[start:start + n], escapes[g])
        assert (got == values[at:at + size]).all()
        at += size


def test_strips_decode_alone():
    values = np.arange(5000, dtype=np.uint64)
    words, strips, _, escapes = simple8b.encode(values, np.array([5000]))
    assert (simple8b.decode_strip(words, strips, 2, escapes[0]) == values[2048:3072]).all()


def check_files(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for (number, _), ids in zip(order, plain_ids(BYTE, [t for _, t in order])):
        ids = np.array([*ids, 2], "<u4")
        want.append((number, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_files_read_back(llm, make, tmp_path):
    rows = [(i * 7 % 101, t) for i, t in enumerate(odd_texts(9, 101))] + [(5, "twice"), (5, "twice"), (None, "no id")]
    token_files.write(make(rows), BYTE, str(tmp_path / "files"))
    got = token_files.read(llm.read.parquet(str(tmp_path / "files"))).collect()
    check_files(rows, [tuple(r) for r in got])


def test_empty_table(llm, make, tmp_path):
    token_files.write(make([]), BYTE, str(tmp_path / "files"))
    assert token_files.read(llm.read.schema(token_files.BLOCK).parquet(str(tmp_path / "files"))).count() == 0
    assert token_counts.token_counts(make([]), WORD).count() == 0


def test_queries_over_the_given_table(llm):
    texts = [(r["doc_id"], r["text"]) for r in llm.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check_files(texts, [tuple(r) for r in token_files.op1_token_files(llm, SMALL).collect()])
    got = {r["doc_id"]: r for r in token_counts.op5_token_counts(llm, SMALL).collect()}
    for (number, text), ids in zip(texts, plain_ids(WORD, [t for _, t in texts])):
        r = got[number]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((text or "").encode()), len(ids), len(ids) > 2048)


def test_counts_of_odd_rows(make):
    rows = [(i, t) for i, t in enumerate(odd_texts(3, 60))] + [(1, ""), (None, "a b")]
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in token_counts.token_counts(make(rows), WORD).collect())
    assert got == sorted((i or -1, len(x)) for (i, _), x in zip(rows, plain_ids(WORD, [t for _, t in rows])))
