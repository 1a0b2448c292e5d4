import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_texts import SMALL, odd_texts

from ledgerloom.llm import repetition as R


def plain(text):
    """Base counts and repeats by comparing all suffixes."""
    words = (text or "").encode().split()
    n = len(words)
    longest = [0] * n
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and words[i + k] == words[j + k]:
                k += 1
            longest[i], longest[j] = max(longest[i], k), max(longest[j], k)

    def covered(least):
        return len({p for i in range(n) if longest[i] >= least for p in range(i, i + longest[i])})

    windows = Counter(tuple(words[i:i + 8]) for i in range(n - 7))
    repeated = {p for i in range(n - 7) if windows[tuple(words[i:i + 8])] > 1 for p in range(i, i + 8)}
    assert len(repeated) == covered(8)
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    points = sum(len(w.decode()) for w in words)
    base_failed = n < 20 or 100 * covered(8) > 30 * n
    most = max(longest, default=0)
    kept = not (base_failed or covered(R.REPEAT_WORDS) > R.COVERED_SHARE * n
                or most > R.LONGEST_WORDS and most > R.LONGEST_SHARE * n)
    return (n, points, symbols, len(lines) - len(set(lines)), covered(8), base_failed, kept, covered(R.REPEAT_WORDS), most)


def texts_with_repeats(seed):
    rng = random.Random(seed)
    made = []
    for _ in range(25):
        words = [rng.choice("abcdefgh") * rng.choice([1, 1, 2]) for _ in range(rng.choice([5, 25, 60, 120]))]
        for _ in range(rng.randrange(3)):
            at, size = rng.randrange(len(words)), rng.randrange(1, 80)
            words += words[at:at + size]
        made.append("".join(w + rng.choice([" ", " ", "\n"]) for w in words))
    return made + ["x " * 90, "a b c d e f g h " * 20, "one line #\n" * 8]


@pytest.mark.parametrize("seed", range(4))
def test_against_comparing_all_suffixes(make, seed):
    rows = list(enumerate(texts_with_repeats(seed) + odd_texts(seed, 30))) + [(3, "again"), (3, "again"), (None, "no id")]
    got = [tuple(r) for r in R.repetition(make(rows)).collect()]
    key = lambda r: (r[0] is not None, *[x or 0 for x in r])
    assert sorted(got, key=key) == sorted([(i, *plain(t)) for i, t in rows], key=key)


@pytest.mark.parametrize("passage, size, kept", [(70, 500, False), (65, 20_000, False), (5000, 40_000, False),
                                                 (64, 500, True), (64, 20_000, True)])
def test_two_copies_of_a_passage_fail_by_their_length_alone(make, passage, size, kept):
    words = [f"w{i}" for i in range(size - passage)]
    at = size // 2
    text = " ".join(words[:at + passage] + ["between"] + words[at:])
    got = R.repetition(make([(1, text)])).collect()[0]
    assert (got["repeat_longest"], got["repeat_covered"]) == (passage, 2 * passage)
    assert got["repeat_covered"] < R.COVERED_SHARE * got["n_words"] and not got["base_failed"]
    assert got["kept"] == kept


def test_texts_do_not_repeat_each_other():
    words = np.array([1, 2, 3, 1, 2, 3])
    assert R.repeats(words, np.array([3, 3])).longest.tolist() == [0] * 6
    assert R.repeats(words, np.array([6])).longest.tolist() == [3, 2, 1, 3, 2, 1]


def test_empty_table(make):
    assert R.repetition(make([])).count() == 0


def test_query_over_the_given_table(llm):
    texts = {r["doc_id"]: r["text"] for r in llm.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in R.op4_suffix_repetition(llm, SMALL).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        if len(text) < 4000:
            assert tuple(got[i])[1:] == plain(text)
