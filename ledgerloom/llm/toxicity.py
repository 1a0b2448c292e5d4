"""Toxicity by a linear softmax over averaged subword vectors, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams, a text's vector the
mean over its words. Only n-grams that stand in clearly more texts of label 1 have vectors;
others are left out of a word's mean, so that a misspelt word that keeps a few n-grams of a
word seen in training weighs nearly as much. As the classifier is linear, a word contributes
one number, so scoring a text is a mean of numbers looked up once per distinct word of a batch.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, map_arrow, whole_text
from .vocabulary import parts_by_bytes, spread

GRAMS = (3, 4, 5, 6)
# Letters left open in n-grams of a length: first and number.
OPEN_RUNS = {6: ((1, 2), (2, 2), (3, 2))}
_BASE = np.uint64(0x100000001B3)
BUCKET_BITS = 20
WIDTH = 4
# A text's mean is small next to the weight of one word: the scale keeps steps even.
SCALE = 100.0
# Bounds of the training sample: rows of label 0 and of label 1, and characters of a row's text.
SAMPLE_ROWS = (3000, 1500)
SAMPLE_CHARS = 10_000
# An n-gram is trained if its rate in texts of label 1 exceeds that in others by so many
# standard errors, by as many words as this times the root of the number of texts, and is
# so many times as high.
LEAST_ERRORS, LEAST_EXCESS, LEAST_RATIO, PER_TEXT = 6.0, 0.8, 8.0, 3
# Counts as so many untrained n-grams in the mean of a word, which damps words with few.
UNTRAINED = 2.0
STEPS = 100
RATE = 0.05

# Bytes of text whose n-grams are held at a time.
SCORED_BYTES = 1 << 20

_STRIPPED = ".,;:!?\"'()[]{}«»„“”…"


class Model(NamedTuple):
    """Score of each n-gram bucket, which of them were trained, and the bias; log odds of label 1."""

    buckets: np.ndarray
    trained: np.ndarray
    bias: float


def _constant(bias: float) -> Model:
    return Model(np.zeros(1 << BUCKET_BITS, np.float32), np.zeros(1 << BUCKET_BITS, bool), bias)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word index and bucket of every n-gram of ``<word>`` (at least one per word).

    N-grams of the lengths in ``OPEN_RUNS`` come once more for each run of inner letters there that
    is left open, so that a changed letter, or two in changed order, leave some that cover it.
    """
    marked = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(marked)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    found_words, found = [], []

    def add(hashes: np.ndarray, at: np.ndarray) -> None:
        mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        found.append((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        found_words.append(owner[at].astype(np.int32))

    rolled = np.zeros(len(codes), np.uint64)
    for n in range(1, GRAMS[-1] + 1):
        rolled = rolled * _BASE
        rolled[:max(0, len(codes) - n + 1)] += codes[n - 1:]
        if n not in GRAMS:
            continue
        at = np.flatnonzero((left >= n) if n > GRAMS[0] else (left >= n) | (left == np.repeat(sizes, sizes)))
        whole = rolled[at]
        add(whole, at)
        for first, length in OPEN_RUNS.get(n, ()):
            hashes = whole.copy()
            for k in range(first, first + length):
                hashes -= codes[at + k] * np.uint64(pow(int(_BASE), n - 1 - k, 1 << 64))
            add(hashes, at)
    return np.concatenate(found_words), np.concatenate(found)


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-case words of the texts, the word of every place, and places per text."""
    split = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    offsets = split.offsets.to_numpy().astype(np.int64)
    coded = pc.dictionary_encode(split.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])))
    words = pc.utf8_trim(coded.dictionary, _STRIPPED).to_pylist()
    index = coded.indices.to_numpy().astype(np.int64)
    real = np.fromiter(map(bool, words), bool, len(words))
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    kept = real[index] if len(words) else np.zeros(0, bool)
    return words, index[kept], np.bincount(row[kept], minlength=len(texts))


# Texts whose n-grams are taken at a time in training.
CHUNK_TEXTS = 200


def _pairs(texts: list[str]) -> tuple:
    """Text and word of each pair of these, its share of the text, and the words' n-grams."""
    words, places, counts = words_of(pa.array(texts, pa.string()))
    pair, times = np.unique(np.repeat(np.arange(len(texts)), counts) * max(len(words), 1) + places, return_counts=True)
    row, word = pair // max(len(words), 1), pair % max(len(words), 1)
    owner, gram = subwords(words) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return row, word, times / counts[row], owner, gram, len(words)


def _spread_grams(word: np.ndarray, owner: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs with these words: how many n-grams each word has, and their places by word."""
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=n_words)
    starts = np.cumsum(counts) - counts
    return counts[word], order[spread(starts[word], counts[word])]


def telling_subwords(texts: list[str], labels: np.ndarray) -> np.ndarray:
    """Which buckets stand in clearly more words of texts of label 1; chunks bound the memory.

    A text counts with its distinct words that have the n-gram, up to ``PER_TEXT``.
    """
    size = 1 << BUCKET_BITS
    seen = np.zeros((2, size))
    for a in range(0, len(texts), CHUNK_TEXTS):
        row, word, _, owner, gram, n_words = _pairs(texts[a:a + CHUNK_TEXTS])
        counts, places = _spread_grams(word, owner, n_words)
        key, times = np.unique(np.repeat(row, counts) * size + gram[places], return_counts=True)
        for label in (0, 1):
            mine = labels[a + key // size] == label
            seen[label] += np.bincount(key[mine] % size, np.minimum(times[mine], PER_TEXT), size)
    n = np.bincount(labels, minlength=2)
    rate = seen / n[:, None]
    error = np.sqrt(np.maximum(seen.sum(0) / n.sum(), 1e-12) * (1 / n[0] + 1 / n[1]))
    excess = rate[1] - rate[0]
    return ((excess > LEAST_ERRORS * error) & (excess * n[1] > LEAST_EXCESS * np.sqrt(n[1]))
            & (rate[1] > LEAST_RATIO * rate[0]))


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray) -> Model:
    """Vectors and softmax by full-batch Adam on weighted cross entropy.

    The gradient of a bucket's vector is the sum over texts of its share times residual times
    the softmax weights, so sums per bucket are all that is needed.
    """
    if len(set(labels.tolist())) < 2:
        only = float(labels[0]) if len(labels) else 0.0
        return _constant(30.0 * (2 * only - 1))
    prior = np.log(np.array([float((weights * (labels == k)).sum()) for k in (0, 1)]))
    trained = telling_subwords(texts, labels)
    used = np.flatnonzero(trained)
    if not len(used):
        return _constant(float(prior[1] - prior[0]))
    place_of = np.zeros(len(trained), np.int64)
    place_of[used] = np.arange(len(used))
    keys, shares = [], []
    for a in range(0, len(texts), CHUNK_TEXTS):
        row, word, share, owner, gram, n_words = _pairs(texts[a:a + CHUNK_TEXTS])
        kept = trained[gram]
        owner, gram = owner[kept], gram[kept]
        counts, places = _spread_grams(word, owner, n_words)
        each = np.repeat(SCALE * share / (counts + UNTRAINED), counts)
        key, back = np.unique((a + np.repeat(row, counts)) * len(used) + place_of[gram[places]], return_inverse=True)
        keys.append(key)
        shares.append(np.bincount(back, each, len(key)))
    key, share = np.concatenate(keys), np.concatenate(shares)
    row, place = key // len(used), key % len(used)
    rng = np.random.default_rng(0)
    vectors = rng.standard_normal((len(used), WIDTH)) * 0.01
    softmax = rng.standard_normal((WIDTH, 2)) * 0.1
    bias = prior.copy()
    target = np.eye(2)[labels]
    weight = (weights / weights.sum())[:, None]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, softmax, bias)]
    for step in range(1, STEPS + 1):
        means = np.stack([np.bincount(row, share * vectors[place, k], len(texts)) for k in range(WIDTH)], 1)
        scores = means @ softmax + bias
        odds = np.exp(scores - scores.max(1, keepdims=True))
        residual = weight * (odds / odds.sum(1, keepdims=True) - target)
        sums = np.stack([np.bincount(place, share * residual[row, k], len(used)) for k in (0, 1)], 1)
        grads = (sums @ softmax.T, means.T @ residual, residual.sum(0))
        for p, g, (m, v) in zip((vectors, softmax, bias), grads, state):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    buckets = np.zeros(len(trained), np.float32)
    buckets[used] = vectors @ (softmax[:, 1] - softmax[:, 0]) * SCALE
    return Model(buckets, trained, float(bias[1] - bias[0]))


def scores_of(texts: pa.Array, model: Model) -> np.ndarray:
    """Probability of label 1 for each text; a text without words has that of the bias."""
    total, number = np.zeros(len(texts)), np.zeros(len(texts))
    for a, b in parts_by_bytes(texts, SCORED_BYTES):
        words, places, counts = words_of(texts.slice(a, b - a))
        if not len(places):
            continue
        word, bucket = subwords(words)
        known = np.bincount(word, model.trained[bucket], len(words))
        value = np.bincount(word, model.buckets[bucket], len(words)) / (known + UNTRAINED)
        row = np.repeat(np.arange(b - a), counts)
        total[a:b] = np.bincount(row, value[places], b - a)
        number[a:b] = counts
    logits = model.bias + total / np.maximum(number, 1)
    return 1.0 / (1.0 + np.exp(-np.clip(logits, -60, 60)))


def fold(doc_id: Column) -> Column:
    """Remainder by five of the checksum of the id as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fitted(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> Model:
    """A model from at most ``SAMPLE_ROWS`` rows of the labels (chosen by a hash of the id).

    ``learn`` restricts the labelled ids. Classes are weighted by their share of all
    usable labels, so that scores are probabilities in the table's own mixture.
    """
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if learn is not None:
        usable = usable.filter(learn)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [usable.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS[k])
              for k in (0, 1)]
    # No more ids than SAMPLE_ROWS are broadcast, and as many texts come to the driver.
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    sample = (docs.select("doc_id", whole_text().alias("text")).filter(F.length("text") <= SAMPLE_CHARS)
              .join(ids, "doc_id").select("doc_id", "text", "toxic").limit(2 * sum(SAMPLE_ROWS)).collect())
    sample.sort(key=lambda r: (r["doc_id"], r["text"]))
    toxic = np.array([r["toxic"] for r in sample], np.int64)
    seen = np.bincount(toxic, minlength=2)
    weights = np.array([totals[k] / seen[k] for k in toxic.tolist()])
    return train([r["text"] for r in sample], toxic, weights)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and score of every row.

    Null and empty texts get the score of the prior. Repeated rows and null ids stay;
    only ``doc_id`` and ``text`` are read.
    """
    def work(batches):
        for batch in batches:
            yield {"doc_id": batch.column("doc_id"), "score": scores_of(batch.column("text"), model)}

    return map_arrow(docs.select("doc_id", whole_text().alias("text")), "doc_id bigint, score double", work)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose text scores below one half, with all columns they came with.

    The model is fitted on all labels. Rows pass through whole; an empty table stays empty.
    """
    model = fitted(docs, labels)
    names = docs.columns

    def work(batches):
        for batch in batches:
            score = scores_of(pc.fill_null(batch.column("text"), ""), model)
            kept = batch.filter(pa.array(score < 0.5))
            yield {c: kept.column(c) for c in names}

    return map_arrow(docs, docs.schema.simpleString().removeprefix("struct<").removesuffix(">"), work)


def op6_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    model = fitted(docs, labels, ~held_out)
    return scored(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
