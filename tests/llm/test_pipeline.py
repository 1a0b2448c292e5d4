import pytest
import test_content_sort
import test_jaccard
import test_packing
from llm_texts import SMALL, odd_texts

import corpus_pipeline
from ledgerloom.llm import mixing, toxicity

STAGES = dict(corpus_pipeline.STAGES)


def ids(df):
    return sorted(str(r["doc_id"]) for r in df.collect())


def test_stages_call_the_operators_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]


def test_against_the_plain_version_of_each_stage(llm):
    docs = llm.read.parquet(f"{SMALL}/documents.parquet")
    labels = llm.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.fitted(docs, labels)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    rows = [r for r in rows if scores[r[0]] < 0.5]
    stays = {r[0] for r in test_content_sort.plain(rows) if r[3]}
    rows = [r for r in rows if r[0] in stays]
    smallest = {i: c for i, _, c in test_jaccard.brute(rows)}
    rows = [r for r in rows if smallest[r[0]] == r[0]]
    assert 100 < len(rows) < docs.count()
    got = corpus_pipeline.run(llm, SMALL).collect()
    used, least = test_packing.check(rows, got)
    assert used <= least + 2


@pytest.mark.parametrize("name", list(STAGES)[:4])
def test_stages_keep_columns_and_odd_rows(llm, make, name):
    docs = make([(i, t) for i, t in enumerate(odd_texts(2, 40))] + [(3, "same"), (3, "same"), (None, "no id")])
    out = STAGES[name](llm, docs, SMALL)
    assert out.columns == docs.columns
    kept = ids(out)
    assert set(kept) <= set(ids(docs)) and "None" in kept
    assert STAGES[name](llm, make([]), SMALL).count() == 0


def test_mixture_is_written_in_order(llm, make, tmp_path):
    docs = make([(i, f"text {i}") for i in range(90)])
    place = {r["doc_id"]: r["_position"] for r in mixing.mixed(docs).collect()}
    STAGES["mixing sources to target weights"](llm, docs, SMALL).write.parquet(str(tmp_path / "mixed"))
    files = sorted((tmp_path / "mixed").glob("part-*.parquet"))
    seen = [r["doc_id"] for f in files for r in llm.read.parquet(str(f)).collect()]
    assert [place[i] for i in seen] == list(range(90))
