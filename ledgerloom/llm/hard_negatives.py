"""Hard negatives by exact integer scores from Kronecker-packed products.

Components are whole numbers. Biased by the least of their dimension they are not negative,
and the largest inner product that two rows can have gives the bits of a field. Several
candidates' components then stand in separate fields of one wide integer, which is
multiplied once per component of an anchor; as fields cannot overflow, the scores are read off
the sum. The wide integers are doubles while 53 bits hold at least one field (so that the sums
of products are a matrix product, and exact), else integers of 64 bits.

Anchors are dealt into blocks, rows into strips, and each block meets each strip in a task that
streams the strip past the block and keeps the best few rows of each anchor. A first pass
finds the positives, a second the negatives within the limits that these set.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, shuffle_parts, staged
from .vectors import commonest_width, embeddings, matrix, sums, usable, whole_numbers

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
# A negative's score lies between these shares, in hundredths, of the positive's.
LOW, HIGH = 50, 95
# Components beyond this are too large for scores of 64 bits.
LARGEST = float(1 << 20)

# Rows that travel together, anchors of a block, rows of a strip, and scores held at a time.
PIECE_ROWS = 4096
ANCHOR_BLOCK = 16_384
STRIP_ROWS = 4_000_000
SCORES_HELD = 1 << 21
# Rows of the first comparison, before there is a least score to beat; then twice as many.
FIRST_ROWS = 32

_LOWEST, _HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Layout(NamedTuple):
    """Least value per dimension, bits of a field, fields of a wide integer, type of a component."""

    least: np.ndarray
    bits: int
    fields: int
    kind: str


def layout_of(least: list[int], most: list[int]) -> Layout:
    bits = max(1, sum((b - a) ** 2 for a, b in zip(least, most)).bit_length())
    if bits > 62 or sum(max(a * a, b * b) for a, b in zip(least, most)) >= 1 << 62:
        raise OverflowError("scores of these vectors do not fit 64 bits")
    widest = max([b - a for a, b in zip(least, most)], default=0)
    return Layout(np.array(least, np.int64), bits, max(1, 53 // bits), np.min_scalar_type(widest).str)


def products(anchors: np.ndarray, rows: np.ndarray, layout: Layout) -> np.ndarray:
    """Inner products of all biased anchors with all biased rows."""
    if layout.bits > 53:
        return (anchors.astype(np.uint64) @ rows.T.astype(np.uint64)).astype(np.int64)
    high = -(-len(rows) // layout.fields)
    wide = np.zeros((high, rows.shape[1]))
    for k in range(layout.fields):
        part = rows[k * high:(k + 1) * high]
        wide[:len(part)] += part.astype(np.float64) * 2.0 ** (k * layout.bits)
    total = (anchors.astype(np.float64) @ wide.T).astype(np.int64)
    if layout.fields == 1:
        return total
    mask = (1 << layout.bits) - 1
    return np.concatenate([(total >> (k * layout.bits)) & mask for k in range(layout.fields)], 1)[:, :len(rows)]


class Rows(NamedTuple):
    """Ids, labels, biased components, for anchors also marks and scores of their positives."""

    ids: np.ndarray
    labels: np.ndarray
    biased: np.ndarray
    marks: np.ndarray
    limits: np.ndarray


def scores(anchors: Rows, rows: Rows, layout: Layout) -> np.ndarray:
    """Inner products of the components as they were before the bias."""
    least = layout.least
    of_rows = rows.biased.astype(np.int64) @ least
    of_anchors = anchors.biased.astype(np.int64) @ least + least @ least
    return products(anchors.biased, rows.biased, layout) + of_rows + of_anchors[:, None]


class Best:
    """The best few (score, id) of each of many lists: higher scores first, then smaller ids.

    An id counts once per score.
    """

    def __init__(self, lists: int, most: int):
        self.scores = np.full((lists, most), _LOWEST)
        self.ids = np.full((lists, most), _HIGHEST)

    @property
    def least(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(which):
            return
        most = self.scores.shape[1]
        touched = np.unique(which)
        which = np.concatenate([which, np.repeat(touched, most)])
        score = np.concatenate([score, self.scores[touched].ravel()])
        ids = np.concatenate([ids, self.ids[touched].ravel()])
        # The complement falls as the score rises, and has no overflow.
        order = np.lexsort((ids, ~score, which))
        which, score, ids = which[order], score[order], ids[order]
        fresh = np.ones(len(which), bool)
        fresh[1:] = (which[1:] != which[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        which, score, ids = which[fresh], score[fresh], ids[fresh]
        first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        rank = np.arange(len(which)) - np.repeat(first, np.diff(np.append(first, len(which))))
        kept = rank < most
        self.scores[touched], self.ids[touched] = _LOWEST, _HIGHEST
        self.scores[which[kept], rank[kept]], self.ids[which[kept], rank[kept]] = score[kept], ids[kept]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        which, rank = np.nonzero(self.ids != _HIGHEST)
        return which, self.scores[which, rank], self.ids[which, rank]


def _slices(rows: Rows, seen: int, anchors: int) -> Iterator[Rows]:
    """Parts of a piece, small while little has been seen and never too many scores."""
    a, n = 0, len(rows.ids)
    while a < n:
        b = min(n, a + max(1, min(max(FIRST_ROWS, seen + a), SCORES_HELD // max(anchors, 1))))
        yield Rows(*(x[a:b] for x in rows))
        a = b


class PositiveSearch:
    """Best other rows of an anchor's label."""

    def __init__(self, anchors: Rows, layout: Layout, most: int):
        self.anchors, self.layout = anchors, layout
        self.best = Best(len(anchors.ids), most)
        self.of_label = {k: np.flatnonzero(anchors.labels == k) for k in np.unique(anchors.labels).tolist()}
        self.seen = 0

    def add(self, rows: Rows) -> None:
        for part in _slices(rows, self.seen, len(self.anchors.ids)):
            for label in np.unique(part.labels).tolist():
                mine = self.of_label.get(label)
                if mine is None:
                    continue
                same = Rows(*(x[part.labels == label] for x in part))
                found = scores(Rows(*(x[mine] for x in self.anchors)), same, self.layout)
                enough = (found >= self.best.least[mine][:, None]) & (same.ids != self.anchors.ids[mine][:, None])
                which, column = np.nonzero(enough)
                self.best.add(mine[which], found[which, column], same.ids[column])
        self.seen += len(rows.ids)

    def found(self) -> Iterator[tuple]:
        which, score, ids = self.best.found()
        yield which, np.zeros(len(which), np.int32), score, ids


def bounds(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and most s with low * score <= 100 * s <= high * score, without overflow."""
    whole, rest = score // 100, score % 100
    return whole * low - (-rest * low) // 100, whole * high + rest * high // 100


class NegativeSearch:
    """Best rows of other labels within the limits of each positive of an anchor."""

    def __init__(self, anchors: Rows, layout: Layout, most: int, low: int, high: int):
        self.anchors, self.layout = anchors, layout
        # Absent positives have no room between their limits.
        absent = anchors.limits == _LOWEST
        least, self.high = bounds(np.where(absent, 0, anchors.limits), low, high)
        self.low, self.high = np.where(absent, _HIGHEST, least), np.where(absent, _LOWEST, self.high)
        self.best = Best(anchors.limits.size, most)
        self.seen = 0

    def add(self, rows: Rows) -> None:
        n, lists = self.anchors.limits.shape
        for part in _slices(rows, self.seen, n):
            least = np.maximum(self.low, self.best.least.reshape(n, lists))
            open_lists = least <= self.high
            any_least = np.where(open_lists, least, _HIGHEST).min(1)
            any_most = np.where(open_lists, self.high, _LOWEST).max(1)
            found = scores(self.anchors, part, self.layout)
            which, column = np.nonzero((found >= any_least[:, None]) & (found <= any_most[:, None]))
            other = part.labels[column] != self.anchors.labels[which]
            which, column = which[other], column[other]
            score = found[which, column]
            for k in range(lists):
                fits = (score >= least[which, k]) & (score <= self.high[which, k])
                self.best.add(which[fits] * lists + k, score[fits], part.ids[column[fits]])
        self.seen += len(rows.ids)

    def found(self) -> Iterator[tuple]:
        which, score, ids = self.best.found()
        lists = self.anchors.limits.shape[1]
        yield which // lists, which % lists, score, ids


PIECE = "number bigint, block int, ids binary, labels binary, biased binary, marks binary, limits binary"


def pieces(rows: DataFrame, layout: Layout, positives: int = 0) -> DataFrame:
    """Rows packed by some thousands of one ``block``, as arrays in binary columns.

    ``positives`` is the number of scores that anchors carry (in ``scores``), 0 without.
    """
    width = len(layout.least)

    def piece(number, block, columns):
        ids, labels, vectors, marks, limits = (np.concatenate(c) for c in columns)
        biased = whole_numbers(vectors, SCALE) - layout.least
        return {"number": [number], "block": [block], "ids": [ids.tobytes()], "labels": [labels.tobytes()],
                "biased": [biased.astype(layout.kind).tobytes()], "marks": [marks.tobytes()], "limits": [limits.tobytes()]}

    def padded(lists, n):
        out = np.full((n, positives), _LOWEST)
        for k, found in enumerate(lists.to_pylist() if positives else []):
            out[k, :len(found or [])] = found or []
        return out

    def work(batches):
        number, held, size, block = TaskContext.get().partitionId() << 33, [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(a, b - a)
                if held and (blocks[a] != block or size + b - a > PIECE_ROWS):
                    yield piece(number, block, zip(*held))
                    number, held, size = number + 1, [], 0
                block = int(blocks[a])
                held.append((part.column("vec_id").to_numpy(), part.column("label").to_numpy(),
                             matrix(part.column("vector"), width), part.column("mark").to_numpy(),
                             padded(part.column("scores"), b - a)))
                size += b - a
        if held:
            yield piece(number, block, zip(*held))

    return map_arrow(rows.select("vec_id", "label", "vector", "mark", "scores", "block"), PIECE, work)


def _unpacked(rows: list[dict], layout: Layout, positives: int) -> Rows:
    width = len(layout.least)
    ids, labels, marks, biased, limits = (
        np.frombuffer(b"".join(r[c] for r in rows), kind)
        for c, kind in (("ids", np.int64), ("labels", np.int64), ("marks", np.int64), ("biased", layout.kind), ("limits", np.int64)))
    return Rows(ids, labels, biased.reshape(len(ids), width), marks, limits.reshape(len(ids), positives))


FOUND = "vec_id bigint, mark bigint, place int, score bigint, other bigint"


def searched(cells: DataFrame, layout: Layout, positives: int, search) -> DataFrame:
    """What ``search`` finds for the anchors of each cell, which come before the cell's rows."""
    def closed(anchors: Rows, active) -> Iterator[dict]:
        for which, place, score, other in active.found():
            yield {"vec_id": anchors.ids[which], "mark": anchors.marks[which], "place": place, "score": score, "other": other}

    def work(batches):
        key, held, anchors, active = None, [], None, None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["block"], row["strip"]) != key:
                    if active:
                        yield from closed(anchors, active)
                    key, held, anchors, active = (row["block"], row["strip"]), [], None, None
                if not row["turn"]:
                    held.append(row)
                    continue
                if active is None:
                    anchors = _unpacked(held, layout, positives)
                    active = search(anchors, layout)
                active.add(_unpacked([row], layout, 0))
        if active:
            yield from closed(anchors, active)

    return map_arrow(cells, FOUND, work)


def _cells(anchors: DataFrame, rows: DataFrame, blocks: int, strips: int) -> DataFrame:
    """Every block of anchors beside every strip of rows."""
    each_strip = F.explode(F.sequence(F.lit(0), F.lit(strips - 1)))
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    placed = anchors.withColumn("strip", each_strip).withColumn("turn", F.lit(0)).unionByName(
        rows.withColumn("strip", F.pmod(F.xxhash64("number"), F.lit(strips)).cast("int"))
        .withColumn("block", each_block).withColumn("turn", F.lit(1)))
    parts = max(shuffle_parts(rows.sparkSession), blocks * strips)
    return placed.repartition(parts, "block", "strip").sortWithinPartitions("block", "strip", "turn")


def _best(found: DataFrame, most: int, *keys: str) -> DataFrame:
    """Best ``most`` per key of what the strips found; a strip gives no more than that."""
    dealt = found.repartition(*keys).dropDuplicates([*keys, "score", "other"])
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other")
    return dealt.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


OUT = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, "
       "negative_score bigint")


def mined(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
          low: int = LOW, high: int = HIGH) -> DataFrame:
    """Per anchor and positive the best rows of other labels whose score is within the limits.

    ``rows`` has ``vec_id``, ``label`` and ``embedding``; other columns are not read. No part
    take rows with a null id, label or vector, with a null or non-finite component or one beyond
    2^20, and rows whose vector is empty or not of the commonest length. Ties go to the smaller
    id. Repeated rows: a row of the anchor's own id is none of its positives, an id with the
    same score counts once for an anchor, and anchors that are equal answer once (of one id
    with other vectors or labels, each). An empty table, or one without anchors, gives no rows.
    """
    spark = rows.sparkSession
    whole = usable(rows.filter("vec_id IS NOT NULL AND label IS NOT NULL"), "vec_id",
                   F.col("label").cast("bigint").alias("label"), most=LARGEST)
    found = sums(whole, SCALE, 0)
    width = commonest_width(found)
    nothing = spark.createDataFrame([], OUT)
    if width is None:
        return nothing
    fit = found.filter(F.col("width") == width).orderBy("dim").collect()
    layout = layout_of([r["least"] for r in fit], [r["most"] for r in fit])
    whole = whole.filter(F.size("vector") == width)
    none = F.lit(None).cast("array<bigint>").alias("scores")
    marked = whole.filter(is_anchor).withColumn("mark", F.xxhash64("label", "vector")).dropDuplicates(["vec_id", "mark"])
    n_anchors = marked.count()
    if not n_anchors:
        return nothing
    blocks = -(-n_anchors // ANCHOR_BLOCK)
    strips = max(-(-shuffle_parts(spark) // blocks), -(-fit[0]["n"] // STRIP_ROWS))

    def in_blocks(anchors: DataFrame, n_scores: int) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id", "mark"), F.lit(blocks)).cast("int")
        together = anchors.withColumn("block", block).repartition("block").sortWithinPartitions("block")
        return pieces(together, layout, n_scores)

    unmarked = whole.select("*", F.lit(0).cast("bigint").alias("mark"), none, F.lit(0).alias("block"))
    dealt = staged(pieces(unmarked, layout), "rows").drop("block")
    cells = _cells(in_blocks(marked.withColumn("scores", none), 0), dealt, blocks, strips)
    best = searched(cells, layout, 0, lambda anchors, shape: PositiveSearch(anchors, shape, positives))
    chosen = staged(_best(best.drop("place"), positives, "vec_id", "mark").withColumn("place", F.col("rank") - 1), "positives")
    limits = chosen.groupBy("vec_id", "mark").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda p: p["score"]).alias("scores"))
    limited = marked.join(limits, ["vec_id", "mark"]).select("vec_id", "label", "vector", "mark", "scores")
    cells = _cells(in_blocks(limited, positives), dealt, blocks, strips)
    near = searched(cells, layout, positives, lambda anchors, shape: NegativeSearch(anchors, shape, negatives, low, high))
    ranked = _best(near, negatives, "vec_id", "mark", "place")
    pairs = chosen.select("vec_id", "mark", "place", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(pairs, ["vec_id", "mark", "place"]).select(
        F.col("vec_id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


# Labels of ids divisible by this are shifted by the query; ids divisible by the other are anchors.
SHIFTED, ANCHORS, LABELS = 7, 50, 10


def op13_hard_negatives(spark, sf_dir):
    label = F.col("label").cast("bigint")
    shifted = F.when(F.col("vec_id") % SHIFTED == 0, (label + 1) % LABELS).otherwise(label)
    rows = embeddings(spark, sf_dir).select("vec_id", shifted.alias("label"), "embedding")
    return mined(rows, F.col("vec_id") % ANCHORS == 0)


# The same by DuckDB.
OP13_SQL = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
       s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
