"""Packing token pieces into sequences: exact complements first, best fit for the rest.

Only lengths decide a packing, and a length is at most the capacity. The plan is therefore
made from the counts per length (a table no longer than the capacity, however many
documents there are) and says how often each combination of lengths is used. The pieces
then take the places of their length by rank.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, map_arrow, staged, whole_text
from .vocabulary import ByteLevelCodec, opened, spread

CAPACITY = 2048
END_ID = 0

Pattern = tuple[tuple[int, ...], int]


class Complements:
    """Counts of available lengths, with indexes of their single and pair sums."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.there = (self.left > 0).astype(np.int64)
        # Ordered pairs of available lengths by their sum; triples are a length and a pair sum.
        self.pairs = np.rint(np.convolve(self.there, self.there)).astype(np.int64)

    def _present(self, length: int, now: bool) -> None:
        if bool(self.there[length]) == now:
            return
        step, top = (1, self.there) if now else (-1, self.there)
        if not now:
            self.there[length] = 0
        self.pairs[length:length + len(top)] += 2 * step * top
        self.pairs[2 * length] += step
        if now:
            self.there[length] = 1

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for length, copies in Counter(lengths).items():
            self.left[length] -= copies * times
            self._present(length, bool(self.left[length] > 0))

    def times(self, lengths: tuple[int, ...]) -> int:
        return min(int(self.left[x]) // copies for x, copies in Counter(lengths).items())

    def _pair(self, held: int, total: int) -> tuple[int, int] | None:
        if total < 2 or total >= len(self.pairs) or not self.pairs[total]:
            return None
        low = np.arange(max(1, total - len(self.left) + 1), total // 2 + 1)
        for a in low[(self.there[low] > 0) & (self.there[total - low] > 0)].tolist():
            if self.times((held, a, total - a)):
                return a, total - a
        return None

    def filling(self, length: int, capacity: int) -> tuple[int, ...] | None:
        """Available lengths that with ``length`` fill the capacity exactly: one, two or three more."""
        gap = capacity - length
        if gap < 1:
            return () if not gap else None
        if gap < len(self.left) and self.times((length, gap)):
            return (gap,)
        pair = self._pair(length, gap)
        if pair:
            return pair
        firsts = np.arange(1, gap - 1)
        firsts = firsts[(self.there[firsts] > 0) & (self.pairs[gap - firsts] > 0)]
        for a in firsts[::-1].tolist():
            pair = self._pair(length, gap - a)
            if pair and self.times((length, a, *pair)):
                return (a, *pair)
        return None


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit of decreasing lengths; equal bins are handled together."""
    left = counts.astype(np.int64).copy()
    open_bins: dict[int, list[list]] = {}
    for length in range(min(capacity, len(left) - 1), 0, -1):
        while left[length]:
            gap = min((g for g in open_bins if g >= length), default=None)
            if gap is None:
                fits = capacity // length
                for each, bins in ((fits, left[length] // fits), (left[length] % fits, 1)):
                    if each and bins:
                        open_bins.setdefault(capacity - int(each) * length, []).append([(length,) * int(each), int(bins)])
                left[length] = 0
                break
            pattern, bins = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap]
            filled = min(int(left[length]), bins)
            left[length] -= filled
            if bins > filled:
                open_bins.setdefault(gap, []).append([pattern, bins - filled])
            open_bins.setdefault(gap - length, []).append([(*pattern, length), filled])
    return [(p, n) for groups in open_bins.values() for p, n in groups]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Combinations of lengths and how many sequences each fills.

    ``counts[length]`` pieces of each length. Longest first, a length takes combinations
    that fill its gap exactly as often as all of them last; best fit packs what no exact
    combination is left for. Plain best fit replaces the plan where it needs fewer.
    """
    index = Complements(counts)
    patterns: list[Pattern] = []
    for length in range(min(capacity, len(counts) - 1), 0, -1):
        while index.left[length]:
            more = index.filling(length, capacity)
            if more is None:
                break
            lengths = (length, *more)
            times = index.times(lengths)
            index.take(lengths, times)
            patterns.append((lengths, times))
    patterns += best_fit(index.left, capacity)
    plain = best_fit(counts, capacity)
    return min(patterns, plain, key=lambda p: sum(n for _, n in p))


class Places:
    """Where the piece of each rank within its length goes."""

    def __init__(self, patterns: list[Pattern], capacity: int):
        used = np.zeros(capacity + 1, np.int64)
        rows, base = [], 0
        for lengths, times in patterns:
            offset = 0
            for length, copies in sorted(Counter(lengths).items()):
                rows.append((length, used[length], base, copies, offset))
                used[length] += copies * times
                offset += copies * length
            base += times
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.length, self.first, self.base, self.copies, self.offset = table.T
        # One ascending key per entry: all ranks of shorter lengths come before.
        self.before = np.concatenate([[0], np.cumsum(used)])[:-1]
        self.key = self.before[self.length] + self.first

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and rank within it (from 0)."""
        entry = np.searchsorted(self.key, self.before[lengths] + ranks, side="right") - 1
        inner = ranks - self.first[entry]
        copies = self.copies[entry]
        return self.base[entry] + inner // copies, self.offset[entry] + inner % copies * lengths


def cut(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number, start and length of the pieces of documents: all full but the first."""
    n = -(-lengths // capacity)
    row = np.repeat(np.arange(len(lengths)), n)
    number = spread(np.zeros(len(n), np.int64), n)
    first = lengths - (n - 1) * capacity
    start = np.where(number == 0, 0, first[row] + (number - 1) * capacity)
    return row, number, start, np.where(number == 0, first[row], capacity)


PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of the documents' ids, ranked per length within the task that made them."""
    def work(batches):
        codec, task = opened(ByteLevelCodec, path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            flat, counts = codec.encode(batch.column("text"))
            lengths = counts + 1
            ids = np.full(int(lengths.sum()), end_id, "<u4")
            edges = np.concatenate([[0], np.cumsum(lengths)])
            inner = np.ones(len(ids), bool)
            inner[edges[1:] - 1] = False
            ids[inner] = flat
            row, number, start, length = cut(lengths, capacity)
            at = edges[row] + start
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(at, at + length)]
            # Rank among the pieces of equal length that this task has made so far.
            order = np.argsort(length, kind="stable")
            per = np.bincount(length, minlength=capacity + 1)
            within = np.empty(len(length), np.int64)
            within[order] = spread(np.zeros(capacity + 1, np.int64), per)
            rank = seen[length] + within
            seen += per
            yield {"doc_id": batch.column("doc_id").take(pa.array(row)), "piece": number, "start": start,
                   "length": length, "ids_crc32": sums, "task": np.full(len(row), task), "rank": rank}

    return map_arrow(docs.select("doc_id", whole_text().alias("text")), PIECE, work)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its sequence and place.

    A null or empty text is one piece of the end id alone. Repeated rows, also of one
    ``doc_id`` or a null one, are packed each for itself. Columns other than ``doc_id``
    and ``text`` are not read. An empty table gives no rows.
    """
    made = staged(pieces(docs, path, capacity, end_id), "pieces")
    per_task = made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    # At most one row per length up to the capacity comes to the driver.
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    places = Places(plan(counts, capacity), capacity)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = made.join(offsets, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before"))

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sequence, offset = places.of(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            kept = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield {c: batch.column(c) for c in kept} | {"sequence_id": sequence, "offset": offset}

    return map_arrow(ranked.select(*made.columns), "doc_id bigint, piece int, start bigint, length bigint, "
                     "ids_crc32 bigint, sequence_id bigint, offset bigint", work)


def op3_best_fit_packing(spark, sf_dir):
    return packed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
