"""Groups too large for one task: finding them, and ranking inside them.

A key may hold a third of all rows. Groups within a stated row bound take the plain
Spark operator; larger ones are cut into sorted slices, one per task, whose small
summaries are combined. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import setting, staged

# Most keys that may be broadcast as the list of hot groups.
BROADCAST_KEYS = 10_000
# Rows of one group a window task may sort (it spills); override per session.
WINDOW_ROWS = ("ledgerloom.window.rows", 1_000_000)

# Rows a slice of a hot group should have, and the most slices one sort is cut into; with
# more rows than both allow, the slices grow and their sorts spill.
SLICE_ROWS = 1_000_000
MOST_SLICES = 20_000

SLICE, PLACE = "_slice", "_in_slice"


def window_rows(df: DataFrame) -> int:
    return setting(df.sparkSession, *WINDOW_ROWS)


def slices(df: DataFrame, rows: int) -> int:
    least = setting(df.sparkSession, "spark.sql.shuffle.partitions", 200)
    return max(least, min(MOST_SLICES, rows // SLICE_ROWS + 1))


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str,
            extra: Column | None = None) -> DataFrame:
    """Null-safe equi-join on equally named columns, keeping those of the left side."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    tests = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    joined = left.join(other, reduce(lambda a, b: a & b, tests + ([] if extra is None else [extra])), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


class HotKeys(NamedTuple):
    """Keys of the hot groups and how many rows these groups have together."""

    keys: DataFrame
    rows: int


def hot_groups(df: DataFrame, keys: Sequence[str], rows: int) -> HotKeys | None:
    """Keys with more than ``rows`` rows; None if there are none.

    Counts combine before the shuffle, so the hot keys cost no more than the others.
    At most ``BROADCAST_KEYS`` keys reach the driver; a longer list stays a table.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = counted.filter(F.col("_n") > rows)
    found = hot.limit(BROADCAST_KEYS + 1).collect()
    if not found:
        return None
    if len(found) <= BROADCAST_KEYS:
        listed = df.sparkSession.createDataFrame(found, hot.schema).select(*keys)
        return HotKeys(F.broadcast(listed), sum(r["_n"] for r in found))
    table = staged(hot, "hot-keys")
    return HotKeys(table.select(*keys), table.agg(F.sum("_n").alias("n")).first()["n"])


def split_hot(df: DataFrame, keys: Sequence[str], rows: int,
              counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows of ordinary groups, rows of hot ones (None if there are none) and their number.

    ``counted`` may be a cheaper input with at least as many rows per key.
    """
    hot = hot_groups(df if counted is None else counted, keys, rows)
    if hot is None:
        return df, None, 0
    return matched(df, hot.keys, keys, "left_anti"), matched(df, hot.keys, keys, "left_semi"), hot.rows


def sliced(df: DataFrame, order: Sequence[str], rows: int, label: str, place: str | None = None) -> DataFrame:
    """About ``rows`` rows cut into sorted ranges of about equal size, numbered in ``_slice``.

    Staged, because the ranges come from a sample and must not be drawn twice. ``place`` names a
    column that numbers the rows of a slice in their order, without gaps.
    """
    ranged = df.repartitionByRange(slices(df, rows), *order)
    if place:
        # Spark's ids are consecutive in a partition, in the order of its rows.
        ranged = ranged.sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    return staged(ranged.withColumn(SLICE, F.spark_partition_id()), label)


def before_slice(per_slice: DataFrame, keys: Sequence[str], amount: str, name: str) -> DataFrame:
    """Total of ``amount`` in all earlier slices of the same key (slices are few)."""
    earlier = (Window.partitionBy(*keys).orderBy(SLICE)
               .rowsBetween(Window.unboundedPreceding, -1))
    return per_slice.withColumn(name, F.coalesce(F.sum(amount).over(earlier), F.lit(0))).drop(amount)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str,
           rows: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Row number of every row within its key; ``order`` must be a total order."""
    keys, order = list(keys), list(order)
    cold, hot, hot_rows = split_hot(df, keys, window_rows(df) if rows is None else rows, counted)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    plain = cold.withColumn(name, number)
    if hot is None:
        return plain
    # Rows are numbered where they are sorted and written once; only first numbers per slice follow.
    cut = sliced(hot, keys + order, hot_rows, "rank", PLACE)
    sizes = cut.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n"), F.min(PLACE).alias("_start"))
    offsets = before_slice(sizes, keys, "_n", "_before")
    # One row per slice and hot key.
    joined = matched(cut, F.broadcast(offsets), [*keys, SLICE], "inner")
    number = F.col("_before") + F.col(PLACE) - F.col("_start") + 1
    whole = joined.select(*df.columns, number.cast("bigint").alias(name))
    return plain.unionByName(whole)


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """First row of each key by ``order`` as one row of ``keys``, ``order`` and ``keep``.

    A minimum combines before the shuffle, so a hot key ships one row per task.
    """
    lead = F.min(F.struct(*order, *[c for c in keep if c not in order])).alias("_first")
    named = list(dict.fromkeys([*order, *keep]))
    return df.groupBy(*keys).agg(lead).select(
        *keys, *[F.col("_first")[c].alias(c) for c in named if c not in keys])


def is_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Flag the first row of each key.

    The winners join back on key *and* order, which is unique per row: the rows of a
    hot key spread over all tasks.
    """
    keys, order = list(keys), list(order)
    winners = first_of(df, keys, order, []).withColumn(name, F.lit(True))
    joined = matched(df, winners, keys + order, "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(False)))
