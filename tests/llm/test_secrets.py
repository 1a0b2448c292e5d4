import hashlib
import random
import re
import string

import pytest
from llm_texts import SMALL, odd_texts

from ledgerloom.llm import secrets as S

PATTERNS = (
    ("assign", r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
     lambda m: len(m[2]) >= 12),
    ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16))


def plain(text):
    spans, counts = [], []
    for k, (_, pattern, ok) in enumerate(PATTERNS):
        found = [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "", re.ASCII) if ok(m)]
        counts.append(len(found))
        spans += found
    return counts, ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(spans))


def secret_texts(seed):
    rng = random.Random(seed)
    bits = ["password", "PassWd: ", "secret='", "token = \"", "api_key=", "APIKEY:", "AKIA", "AKIAAKIA", "deadbeef" * 2, "0123456789abcde",
            "é", "😀", " ", "=", ":", "ABCDEFGHIJKLMN", "abcdefghijkl", "token=token:abcdefghijkl", "x" * 11, "\n", "K", "ſecret: aaaaaaaaaaaa"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(120)]


@pytest.mark.parametrize("seed", range(3))
def test_base_spans_against_regular_expressions(make, seed):
    rows = list(enumerate(secret_texts(seed) + odd_texts(seed, 20))) + [(3, "secret: abcdefghijkl")] * 2 + [(None, "deadbeef" * 3)]
    got = S.scanned(make(rows)).collect()
    want = []
    for i, t in rows:
        counts, spans = plain(t)
        want.append((i, *counts, hashlib.sha256(spans.encode()).hexdigest(), spans))
    shown = [(*tuple(r)[:5], ",".join(s for s in r["spans"].split(",") if not s.startswith("random"))) for r in got]
    assert sorted(map(str, shown)) == sorted(map(str, want))


def test_random_tokens_are_found_and_words_are_not(make):
    rng = random.Random(1)
    symbols = string.ascii_letters + string.digits
    keys = ["".join(rng.choice(symbols) for _ in range(48)) for _ in range(40)]
    words = ["".join(rng.choice(["the", "ation", "re", "en", "st", "ing", "er"]) for _ in range(14)) for _ in range(400)]
    rows = [(i, f"see {k} here") for i, k in enumerate(keys)] + [(1000 + i, f"a {w} b") for i, w in enumerate(words)]
    got = {r["doc_id"]: r["spans"] for r in S.scanned(make(rows)).collect()}
    hits = sum(got[i] == f"random:4:{4 + len(k)}" for i, k in enumerate(keys))
    assert hits >= 36
    assert sum(got[1000 + i] != "" for i in range(len(words))) <= 2


def _words(rng, pieces, size):
    made = ""
    while len(made) < size:
        made += rng.choice(pieces)
    return made[:size]


@pytest.mark.parametrize("size", [20, 24, 32])
@pytest.mark.parametrize("alphabet, case, pieces", [
    ("0123456789abcdef", "upper", ["2024", "0000", "1999", "FACADE", "DEAD", "BEEF", "CAFE", "31415"]),
    ("0123456789abcdef", "mixed", ["2024", "0000", "1999", "facade", "Dead", "beef", "Cafe", "31415"]),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "upper", ["THE", "ATION", "RE", "ENTER", "STONE", "ING", "22", "THERE"]),
    (string.ascii_letters + string.digits, "", ["the", "ation", "Re", "enter", "Stone", "ing", "2024", "there"])])
def test_few_short_keys_of_every_encoding_among_text(llm, alphabet, case, pieces, size):
    rng = random.Random(size)
    cased = {"upper": str.upper, "mixed": lambda c: rng.choice([c, c.upper()]), "": str}[case]
    keys = {"".join(cased(rng.choice(alphabet)) for _ in range(size)) for _ in range(60)}
    texts = {_words(rng, pieces, size) for _ in range(540)} - keys
    found = {r[0] for r in S.discovered(S.battery(llm.createDataFrame([(t,) for t in keys | texts], "token string"))).collect()}
    assert len(found & keys) >= 48
    assert len(found & texts) <= 3


def test_text_has_small_p_values_no_oftener_than_they_say():
    for _, alphabet in S.ENCODINGS:
        for last in S.KINDS_OF:
            assert sum(S._text_chance(alphabet, last, c) for c in alphabet) == pytest.approx(1)


def test_empty_table_and_native_plan(make):
    assert S.scanned(make([])).count() == 0
    for df in (S.places(S.matched(make([(1, "a")]))), S.discovered(S.battery(make([(1, "a")]).selectExpr("text AS token")))):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_query_over_the_given_table(llm):
    texts = {r["doc_id"]: r["text"] for r in llm.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in S.op9_secret_scan(llm, SMALL).collect():
        counts, spans = plain(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(r["spans"].split(","))
