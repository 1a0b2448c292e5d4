"""Quality rules by repetition inside a text, from suffix arrays over its words.

The suffixes of all texts of a batch are sorted together by prefix doubling, each text
among itself; only suffixes not yet told apart are sorted again. The classes of every
doubling give the longest common prefixes of neighbours. A place whose longest common
prefix with a neighbour reaches the least length starts a maximal repeat, and the union of
these spans is what is repeated.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import documents, map_arrow, whole_text
from .vocabulary import PART_BYTES, parts_by_bytes

# Base rules: fixed values of the contract.
LEAST_WORDS = 20
WINDOW = 8
MOST_REPEATED_PERCENT = 30
SYMBOLS = "[#*$%&|<>]"

# The method's rule: repeats of at least so many words may cover this share of a text, and
# the longest may have so many words, whatever share that is: two copies of a passage cover
# twice its share, so a share of its own would leave the limit nothing to reject in long texts.
REPEAT_WORDS = 5
COVERED_SHARE = 0.30
LONGEST_WORDS = 64
LONGEST_SHARE = 0.0


class Repeats(NamedTuple):
    """The longest common prefix (in words) of each place with its better neighbour."""

    longest: np.ndarray

    def covered(self, least: int) -> np.ndarray:
        """Places inside a repeat of at least ``least`` words, first occurrences included."""
        starts = np.flatnonzero(self.longest >= least)
        steps = np.zeros(len(self.longest) + 1, np.int64)
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + self.longest[starts], -1)
        return np.cumsum(steps[:-1]) > 0


def repeats(words: np.ndarray, counts: np.ndarray) -> Repeats:
    """Repeats of consecutive texts given as word numbers and their lengths."""
    n = len(words)
    if not n:
        return Repeats(np.zeros(0, np.int64))
    end = np.repeat(np.cumsum(counts), counts)
    text = np.repeat(np.arange(len(counts)), counts)
    key = text * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    rank, open_places = _regroup(order, key[order], np.zeros(n, np.int64), np.zeros(n, np.int64))
    classes, width = [rank.copy()], 1
    place_in_order = np.empty(n, np.int64)
    place_in_order[order] = np.arange(n)
    while len(open_places):
        at = order[open_places]
        ahead = at + width
        inside = ahead < end[at]
        follow = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[at] * (n + 2) + follow
        by = np.argsort(key, kind="stable")
        order[open_places] = at[by]
        rank = rank.copy()
        group = rank[at[by]]
        fresh, still = _regroup(at[by], key[by], open_places, group)
        rank[at[by]] = fresh
        open_places = open_places[still]
        width *= 2
        classes.append(rank)
    left, right = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    for level in range(len(classes) - 1, -1, -1):
        step = 1 << level
        a, b = left + common, right + common
        inside = (a + step <= end[left]) & (b + step <= end[right])
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        equal = inside & (classes[level][a] == classes[level][b]) & (text[left] == text[right])
        common += step * equal
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    return Repeats(longest)


def _regroup(order, key, places, group):
    """Ranks for sorted keys (the sorted place of a group's first), and which stay open.

    First call: ``places`` and ``group`` are not used and ranks come by text position.
    """
    n = len(order)
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, n))
    if not places.any() and not group.any() and n == len(places):
        ranks = np.empty(n, np.int64)
        ranks[order] = np.repeat(first, sizes)
        return ranks, np.flatnonzero(np.repeat(sizes > 1, sizes))
    return np.repeat(places[first], sizes), np.repeat(sizes > 1, sizes)


def _per_text(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[edges[1:]] - sums[edges[:-1]]


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    split = pc.split_pattern(texts, "\n")
    offsets = split.offsets.to_numpy().astype(np.int64)
    coded = pc.dictionary_encode(split.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])))
    worded = pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)).to_numpy(zero_copy_only=False) > 0
    index = coded.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    kept = worded[index] if len(worded) else np.zeros(0, bool)
    row, index = row[kept], index[kept]
    distinct = np.unique(row * max(1, len(worded)) + index) // max(1, len(worded))
    return np.bincount(row, minlength=len(texts)) - np.bincount(distinct, minlength=len(texts))


def measured(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of texts and what the suffix arrays say."""
    split = pc.ascii_split_whitespace(texts)
    offsets = split.offsets.to_numpy().astype(np.int64)
    coded = pc.dictionary_encode(split.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])))
    index = coded.indices.to_numpy().astype(np.int64)
    points = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    symbols = pc.count_substring_regex(coded.dictionary, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    kept = points[index] > 0 if len(points) else np.zeros(0, bool)
    row, index = row[kept], index[kept]
    counts = np.bincount(row, minlength=len(texts)).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(counts)])
    found = repeats(index, counts)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, row, found.longest)
    return {"n_words": counts, "word_chars": _per_text(points[index], edges),
            "n_symbols": _per_text(symbols[index], edges), "n_dup_lines": repeated_lines(texts),
            "n_repeat_words": _per_text(found.covered(WINDOW), edges),
            "repeat_covered": _per_text(found.covered(REPEAT_WORDS), edges), "repeat_longest": longest}


def verdicts(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    words = m["n_words"]
    base_failed = (words < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED_PERCENT * words)
    too_much = m["repeat_covered"] > COVERED_SHARE * words
    too_long = (m["repeat_longest"] > LONGEST_WORDS) & (m["repeat_longest"] > LONGEST_SHARE * words)
    return {"base_failed": base_failed, "kept": ~(base_failed | too_much | too_long)}


OUT = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
       "base_failed boolean, kept boolean, repeat_covered bigint, repeat_longest bigint")


def repetition(docs: DataFrame) -> DataFrame:
    """Base counts, repeat measures and verdict of every row.

    A null or empty text has no words and fails. Repeated rows and null ids stay. Only
    ``doc_id`` and ``text`` are read; an empty table gives no rows.
    """
    def work(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in parts_by_bytes(texts, PART_BYTES):
                found = measured(texts.slice(a, b - a))
                yield {"doc_id": batch.column("doc_id").slice(a, b - a)} | found | verdicts(found)

    return map_arrow(docs.select("doc_id", whole_text().alias("text")), OUT, work)


def op4_suffix_repetition(spark, sf_dir):
    return repetition(documents(spark, sf_dir))
