"""Token counts of whole texts: lengths only, in byte-balanced batches."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, documents, map_arrow, whole_text
from .vocabulary import PART_BYTES, WordCounter, distinct, opened, parts_by_bytes

LIMIT = 2048
# A longer text is cut at white space, where the tokenizer separates words anyway.
LONG_BYTES = 1 << 20


def safe_pieces(text: str, most: int = LONG_BYTES) -> list[str]:
    """Cut a long text before ASCII white space, at about ``most`` characters each.

    A stretch without white space stays whole, however long.
    """
    if len(text) <= most:
        return [text]
    pieces, start = [], 0
    while len(text) - start > most:
        cut = max(text.rfind(b, start + 1, start + most) for b in BLANKS)
        if cut < 0:
            later = [p for p in (text.find(b, start + most) for b in BLANKS) if p >= 0]
            if not later:
                break
            cut = min(later)
        pieces.append(text[start:cut])
        start = cut
    pieces.append(text[start:])
    return pieces


def lengths_of(texts: pa.Array, counter: WordCounter) -> np.ndarray:
    """Number of ids of each text."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    owner = np.arange(len(texts))
    if len(sizes) and sizes.max() > LONG_BYTES:
        cut = [safe_pieces(t) for t in texts.to_pylist()]
        owner = np.repeat(owner, [len(c) for c in cut])
        texts = pa.array([p for c in cut for p in c], texts.type)
    total = np.zeros(len(sizes), np.int64)
    for a, b in parts_by_bytes(texts, PART_BYTES):
        pieces, index, offsets = distinct(pc.ascii_split_whitespace(texts.slice(a, b - a)))
        counts = counter.counts(pieces)[index]
        sums = np.concatenate([[0], np.cumsum(counts)])
        np.add.at(total, owner[a:b], sums[offsets[1:]] - sums[offsets[:-1]])
    return total


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, bytes, ids and whether these exceed ``limit``, one row per row of ``docs``.

    A null or empty text has no bytes and no ids; repeated rows and null ids stay; other
    columns are not read. Each row's count is independent of all others.
    """
    def work(batches):
        counter = opened(WordCounter, path)
        for batch in batches:
            texts = batch.column("text")
            yield {"doc_id": batch.column("doc_id"), "n_bytes": pc.binary_length(texts),
                   "n_tokens": lengths_of(texts, counter)}

    rows = docs.select("doc_id", whole_text().alias("text"))
    counted = map_arrow(rows, "doc_id bigint, n_bytes bigint, n_tokens bigint", work)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark, sf_dir):
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
