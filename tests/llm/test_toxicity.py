import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_texts import odd_texts

from ledgerloom.llm import toxicity as X

TABLES = "/root/testdata/sf0.01"


def corpus(seed, n):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("bdfglmnrst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(600)]
    rude = ["wretchedquark", "vilexhog", "grubzapper"]
    texts, labels = [], []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(80)]
        toxic = k % 4 == 0
        for _ in range(4 * toxic):
            word = rng.choice(rude)
            if rng.random() < 0.5:
                at = rng.randrange(3, len(word))
                word = word[:at] + rng.choice("xyzqwvjkp") + word[at + 1:]
            words[rng.randrange(80)] = word
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, np.array(labels)


def test_unseen_misspellings_share_grams():
    texts, labels = corpus(1, 1000)
    model = X.train(texts[:800], labels[:800], np.ones(800))
    known = set(" ".join(texts[:800]).split())
    scores = X.scores_of(pa.array(texts[800:]), model)
    assert ((scores >= 0.5) == labels[800:]).mean() > 0.95
    assert any(w not in known for t in texts[800:] for w in t.split())


def misspelt(word, rng):
    at = rng.randrange(1, len(word) - 1)
    return rng.choice([word[:at] + rng.choice("xqw01") + word[at + 1:], word[:at] + word[at + 1:], word[:at] + word[at:at + 1] + word[at:]])


def test_texts_with_all_rude_words_misspelt():
    texts, labels = corpus(4, 900)
    model = X.train(texts[:600], labels[:600], np.ones(600))
    rng = random.Random(9)
    plain = {w for t, y in zip(texts, labels) if not y for w in t.split()}
    held = [" ".join(w if w in plain else misspelt(w, rng) for w in t.split()) for t in texts[600:]]
    found = X.scores_of(pa.array(held), model) >= 0.5
    assert found[labels[600:] == 1].mean() > 0.85 and found[labels[600:] == 0].mean() < 0.02


def test_two_inner_letters_in_changed_order():
    texts, labels = corpus(6, 900)
    model = X.train(texts[:600], labels[:600], np.ones(600))
    plain = {w for t, y in zip(texts, labels) if not y for w in t.split()}
    swapped = lambda w: w if w in plain else w[:4] + w[5] + w[4] + w[6:]
    held = [" ".join(map(swapped, t.split())) for t, y in zip(texts[600:], labels[600:]) if y]
    assert (X.scores_of(pa.array(held), model) >= 0.5).mean() > 0.9


def test_subwords_leave_runs_of_letters_open():
    word, gram = X.subwords(["idiot", "idoit", "a", ""])
    sets = [set(gram[word == k].tolist()) for k in range(4)]
    assert all(sets) and len(sets[0] & sets[1]) >= 2
    assert len(sets[2]) == len(sets[3]) == 1


def test_few_labels_are_enough():
    texts, labels = corpus(5, 1000)
    model = X.train(texts[:120], labels[:120], np.ones(120))
    found = X.scores_of(pa.array(texts[120:]), model) >= 0.5
    assert found[labels[120:] == 1].mean() > 0.9 and found[labels[120:] == 0].mean() < 0.02


def test_without_telling_subwords_the_prior_decides():
    same = ["one two three"] * 40
    scores = X.scores_of(pa.array(same), X.train(same, np.array([0, 0, 0, 1] * 10), np.ones(40)))
    assert np.allclose(scores, 0.25)


def test_one_label_or_none():
    texts = pa.array(["a b", ""])
    assert (X.scores_of(texts, X.train([], np.zeros(0, np.int64), np.zeros(0))) < 0.5).all()
    assert (X.scores_of(texts, X.train(["a"], np.array([1]), np.ones(1))) > 0.5).all()


def test_scores_do_not_depend_on_batches():
    texts, labels = corpus(2, 80)
    model = X.train(texts, labels, np.ones(len(texts)))
    texts = [t or "" for t in odd_texts(1, 50)] + texts + [" ".join(texts)]
    whole = X.scores_of(pa.array(texts), model)
    single = np.concatenate([X.scores_of(pa.array([t]), model) for t in texts])
    assert np.allclose(whole, single) and ((whole >= 0) & (whole <= 1)).all()


def test_rows_and_stage(llm, make):
    texts, labels = corpus(3, 240)
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (None, texts[0]), (5, texts[5])]
    table = llm.createDataFrame([(i, int(x)) for i, x in enumerate(labels)] + [(3, None), (None, 1)], "doc_id bigint, toxic int")
    docs = make(rows)
    model = X.fitted(docs, table)
    got = X.scored(docs, model).collect()
    assert len(got) == len(rows)
    kept = X.clean(docs, table)
    assert kept.columns == docs.columns
    want = sorted(str(r["doc_id"]) for r in got if r["score"] < 0.5)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want
    assert X.clean(make([]), table).count() == 0


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_query_learns_only_from_its_folds(llm):
    got = {r["doc_id"]: r for r in X.op6_toxicity(llm, TABLES).collect()}
    assert len(got) == llm.read.parquet(f"{TABLES}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    truth = {r["doc_id"]: r["toxic"] for r in llm.read.parquet(f"{TABLES}/labels.parquet").collect()}
    learnt = [got[i]["predicted"] == t for i, t in truth.items() if not got[i]["held_out"]]
    tested = [got[i]["predicted"] == t for i, t in truth.items() if got[i]["held_out"]]
    # Few rows are labelled at this size; see the README for the accuracy on larger tables.
    assert np.mean(learnt) > 0.97 and np.mean(tested) > 0.95
