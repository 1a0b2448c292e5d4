"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks. With a share of ``a`` out of ``Q`` slots, its block ``k`` may
not come before slot ``floor(k * Q / a)`` and must come before slot ``ceil((k + 1) * Q / a)``.
Serving the earliest deadline among released blocks keeps every source within one block of
its share at all times. Shares are whole numbers, so the schedule repeats after ``Q`` slots:
one period is laid out, and every block finds its slot by division.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, shuffle_parts

# Documents of one source that are placed together.
BLOCK_ROWS = 8
# Slots the default shares are rounded to; the schedule has about as many rows.
RESOLUTION = 1000


def square_root_shares(rows: dict) -> dict:
    """Whole shares in proportion to the square root of each source's rows, at least one."""
    total = sum(n ** 0.5 for n in rows.values())
    return {s: max(1, round(RESOLUTION * n ** 0.5 / total)) for s, n in rows.items()}


def _list(values: list) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def schedule(spark, shares: list[int]) -> DataFrame:
    """One period: ``slot``, the ``place`` of its source in ``shares``, which of the source's
    blocks it takes (``number``), and how many blocks each source has ``done`` before.

    A fold over the slots; its state is the number of blocks each source has had.
    """
    period = sum(shares)
    listed = f"array({', '.join(f'{a}L' for a in shares)})"
    eligible = (f"filter(transform(sequence(0, {len(shares) - 1}), s -> struct("
                f"((state.done[s] + 1) * {period}L + share[s] - 1) div share[s] AS deadline, s AS place, "
                f"(state.done[s] * {period}L) div share[s] AS release)), "
                "b -> b.release <= t AND state.done[b.place] < share[b.place])")
    step = (f"transform(array(array_min({eligible})), best -> struct("
            "transform(state.done, (d, s) -> if(s = best.place, d + 1, d)) AS done, "
            "concat(state.taken, array(struct(t AS slot, best.place AS place, state.done[best.place] AS number, "
            "state.done AS done))) AS taken))[0]")
    start = ("struct(transform(share, s -> 0L) AS done, "
             "cast(array() AS array<struct<slot: bigint, place: int, number: bigint, done: array<bigint>>>) AS taken)")
    folded = (f"aggregate(sequence(0L, {period - 1}L), {start}, (state, t) -> {step}, state -> state.taken)")
    one = spark.range(1).select(F.expr(listed).alias("share"))
    return one.select(F.explode(F.expr(folded)).alias("r")).select("r.*")


def mixed(docs: DataFrame, shares: dict | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of ``docs`` with their place in the mixture.

    Adds ``_share``, ``_block`` (number within the source), ``_release``, ``_deadline`` and
    ``_slot`` in slots, and ``_position`` (gapless from 0). A source without rows left gives its
    slots up; no row is dropped or repeated. Rows of one source come in the order of a hash
    of id and text. A null source is a source of its own; null ids and texts and repeated rows
    are rows like others; an empty table stays empty. Shares are whole numbers per source
    (``None`` among the keys for the null source); each source needs one. They default to
    square roots of the sources' rows.
    """
    spark = docs.sparkSession
    # One row per source comes to the driver.
    rows = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(rows, key=lambda s: (s is not None, s or ""))
    if not order:
        return docs.select("*", *[F.lit(None).cast("bigint").alias(c) for c in ADDED])
    shares = shares or square_root_shares(rows)
    share, total = [shares[s] for s in order], [rows[s] for s in order]
    period = sum(share)
    sources = spark.createDataFrame(
        list(zip(order, range(len(order)), share)), f"_name {docs.schema['source'].dataType.simpleString()}, _place int, _share bigint")
    # A source may hold most rows: it is numbered in slices, each a window of its own.
    slices = 4 * shuffle_parts(spark)
    mark = F.xxhash64("doc_id", "text")
    keyed = docs.withColumn("_mark", mark).withColumn("_slice", F.pmod(F.shiftright("_mark", 8), F.lit(slices)))
    sizes = keyed.groupBy("source", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("source").alias("_of"), F.col("_slice").alias("_in"),
                          F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("source", "_slice").orderBy("_mark", "doc_id")) - 1
    numbered = keyed.withColumn("_within", within)
    # At most sources times slices rows, and as many as there are sources or slots.
    placed = (numbered
              .join(F.broadcast(starts), F.col("source").eqNullSafe(F.col("_of")) & (F.col("_slice") == F.col("_in")))
              .join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("_name"))))
    number = F.col("_start") + F.col("_within")
    block = F.expr(f"_number div {block_rows}")
    placed = placed.withColumn("_number", number).withColumn("_block", block).withColumn(
        "_turn", F.expr("_block % _share")).withColumn("_round", F.expr("_block div _share"))
    slots = F.broadcast(schedule(spark, share).select(
        F.col("place").alias("_p"), F.col("number").alias("_t"), F.col("slot").alias("_s"), F.col("done").alias("_done")))
    found = placed.join(slots, (F.col("_place") == F.col("_p")) & (F.col("_turn") == F.col("_t")))
    # Rows that all sources have given before a slot: full blocks, but no more than they have.
    given = F.zip_with(F.zip_with("_done", _list(share), lambda d, a: (d + F.col("_round") * a) * block_rows),
                       _list(total), lambda x, y: F.least(x, y))
    before = F.aggregate(given, F.lit(0).cast("bigint"), lambda x, y: x + y)
    return found.select(
        *docs.columns, "_share", "_block", F.expr(f"(_block * {period}L) div _share").alias("_release"),
        F.expr(f"((_block + 1) * {period}L + _share - 1) div _share").alias("_deadline"),
        (F.col("_round") * period + F.col("_s")).alias("_slot"),
        (before + F.expr(f"_number % {block_rows}")).alias("_position"))


ADDED = ("_share", "_block", "_release", "_deadline", "_slot", "_position")


def in_order(docs: DataFrame, shares: dict | None = None) -> DataFrame:
    """All rows of ``docs``, with its columns, sorted by their place in the mixture."""
    return (mixed(docs, shares).repartitionByRange("_position").sortWithinPartitions("_position")
            .select(*docs.columns))


def op2_pfair_mixing(spark, sf_dir):
    placed = mixed(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return placed.select("doc_id", "source", *[F.col(c).alias(c[1:]) for c in ADDED])
