"""Keys held for a fixed time from their acquisition.

The first row of a key acquires it for ``ttl``; rows arriving while it is held are
duplicates and do not extend it; the first row at or after expiry acquires it anew.
Whether a row acquires depends on the last acquisition, so this is a fold in time order.

A null part of a key is a value like others. A row without a moment cannot be put in order:
it acquires for itself alone, is held by none and holds none.

Small groups fold inside one aggregate. In a hot group the acquisitions are found
without ever bringing the group together: every distinct moment links to the first
moment at or after its expiry, and the chain from the first moment is followed by
doubling the links, a join per doubling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import setting, staged
from .skew import SLICE, matched, sliced, split_hot

# Rows of one key the in-row fold may gather; override per session.
FOLD_ROWS = ("ledgerloom.fold.rows", 2_000)
# Acquisitions small enough to broadcast when labelling; beyond it they are salted.
BROADCAST_HOLDS = 200_000
SALTS = 64

AT, NEXT, SINCE = "_at", "_next", "_since"
HELD, HOLDER, ACQUIRED = "held_since", "holder", "acquired"


def hold(df: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], owner: str,
         ttl_seconds: int, fold_rows: int | None = None) -> DataFrame:
    """Add ``acquired``, ``holder`` (owner id of the holding row) and ``held_since``.

    ``at`` is a timestamp; ``order`` breaks its ties and identifies the row.
    """
    keys, order = list(keys), list(order)
    bound = setting(df.sparkSession, *FOLD_ROWS) if fold_rows is None else fold_rows
    ttl = ttl_seconds * 1_000_000
    cold, hot, _ = split_hot(df, keys, bound)
    folded = _folded(cold, keys, at, order, owner, ttl)
    if hot is None:
        return folded
    timed = hot.filter(F.col(at).isNotNull())
    alone = hot.filter(F.col(at).isNull()).select(
        *df.columns, F.lit(True).alias(ACQUIRED), F.col(owner).alias(HOLDER), F.lit(None).cast("timestamp").alias(HELD))
    return folded.unionByName(_linked(timed, keys, at, order, owner, ttl)).unionByName(alone)


def _folded(df: DataFrame, keys, at, order, owner, ttl: int) -> DataFrame:
    """Groups small enough for one task.

    A row without a moment, and one that comes a whole ``ttl`` after the row before it, acquire
    in any case, and what comes within ``ttl`` of such a row is held by it. Only rows beyond, of
    which no gap tells who holds them, are folded.
    """
    moment = F.unix_micros(at)
    in_order = Window.partitionBy(*keys).orderBy(moment, *order)
    before = F.lag(moment).over(in_order)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    begun = F.when(F.col(ACQUIRED), F.struct(F.col(AT), F.col(owner).alias("owner")))
    seen = (df.repartition(*keys).withColumn(AT, moment)
            .withColumn(ACQUIRED, F.coalesce(F.col(AT) - before < ttl, F.lit(False)) == F.lit(False))
            .withColumn(SINCE, F.last(begun, ignorenulls=True).over(so_far)))
    beyond = F.coalesce(F.col(AT) >= F.col(SINCE)[AT] + ttl, F.lit(False))
    clear = seen.filter(~beyond).select(
        *df.columns, ACQUIRED, F.col(SINCE)["owner"].alias(HOLDER), F.timestamp_micros(F.col(SINCE)[AT]).alias(HELD))
    rest = seen.filter(beyond).select(*df.columns, F.col(SINCE)[AT].alias(SINCE))
    return clear.unionByName(_in_turn(rest, keys, at, order, owner, ttl).drop(SINCE))


def _in_turn(df: DataFrame, keys, at, order, owner, ttl: int) -> DataFrame:
    """The fold itself, over the rows of each key and stretch that begins at ``_since``."""
    entry = F.struct(F.unix_micros(at).alias("at"), *order,
                     F.col(owner).alias("owner"), F.struct(*df.columns).alias("row"))
    # Rows lie by key already.
    grouped = df.groupBy(*keys, SINCE).agg(F.sort_array(F.collect_list(entry)).alias("_rows"))
    owner_type = df.schema[owner].dataType.simpleString()
    # The fold carries only the acquisitions: which row, when, and whose.
    none = F.array().cast(f"array<struct<i:int,at:bigint,owner:{owner_type}>>")
    start = F.struct(F.lit(0).alias("i"), F.lit(None).cast("bigint").alias("at"), none.alias("holds"))

    def step(state: Column, row: Column) -> Column:
        free = state["at"].isNull() | (row["at"] >= state["at"] + ttl)
        taken = F.array(F.struct(state["i"].alias("i"), row["at"].alias("at"), row["owner"].alias("owner")))
        return F.struct((state["i"] + 1).alias("i"), F.when(free, row["at"]).otherwise(state["at"]).alias("at"),
                        F.when(free, F.concat(state["holds"], taken)).otherwise(state["holds"]).alias("holds"))

    short = F.transform("_rows", lambda r: F.struct(r["at"].alias("at"), r["owner"].alias("owner")))
    only = F.get("_rows", F.lit(0))
    single = F.array(F.struct(F.lit(0).alias("i"), only["at"].alias("at"), only["owner"].alias("owner")))
    holds = F.when(F.size("_rows") == 1, single).otherwise(F.aggregate(short, start, step)["holds"])
    held = grouped.withColumn("_holds", holds)
    placed = held.select("_holds", F.posexplode("_rows").alias("_i", "r"))
    # Rows come in order, so the hold of a row is the last that began at it or before.
    own = F.element_at(F.filter("_holds", lambda h: h["i"] <= F.col("_i")), -1)
    return placed.withColumn("m", own).select(
        *[F.col("r")["row"][c].alias(c) for c in df.columns],
        (F.col("m")["i"] == F.col("_i")).alias(ACQUIRED),
        F.col("m")["owner"].alias(HOLDER),
        F.timestamp_micros(F.col("m")["at"]).alias(HELD),
    )


def _linked(hot: DataFrame, keys, at, order, owner, ttl: int) -> DataFrame:
    timed = hot.withColumn(AT, F.unix_micros(at))
    first = F.min(F.struct(*order, F.col(owner).alias("_owner"))).alias("_first")
    moments = staged(timed.groupBy(*keys, AT).agg(first), "moments")
    links = staged(_links(moments, keys, ttl), "links")
    holds = _chain(moments, links, keys)
    owned = matched(holds, moments, [*keys, AT], "inner")
    return _labelled(timed, owned, keys, at, order, ttl, hot.columns, holds.count())


def _links(moments: DataFrame, keys, ttl: int) -> DataFrame:
    """For each moment the first moment of its key at or after its expiry."""
    asks = moments.select(*keys, (F.col(AT) + ttl).alias("_p"), F.lit(0).alias("_kind"), AT)
    gives = moments.select(*keys, F.col(AT).alias("_p"), F.lit(1).alias("_kind"), AT)
    cut = sliced(asks.unionByName(gives), [*keys, "_p", "_kind"], 2 * moments.count(), "expiries")
    given = F.when(F.col("_kind") == 1, F.col("_p"))
    from_end = Window.partitionBy(*keys, SLICE).orderBy(F.desc("_p"), F.desc("_kind"))
    inside = cut.withColumn("_inside", F.last(given, ignorenulls=True).over(
        from_end.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_kind") == 0)
    heads = cut.groupBy(*keys, SLICE).agg(F.min(given).alias("_head"))
    later = (Window.partitionBy(*keys).orderBy(F.desc(SLICE))
             .rowsBetween(Window.unboundedPreceding, -1))
    beyond = heads.withColumn("_beyond", F.min("_head").over(later)).drop("_head")
    return (matched(inside, beyond, [*keys, SLICE], "inner")
            .select(*keys, AT, F.coalesce("_inside", "_beyond").alias(NEXT))
            .filter(F.col(NEXT).isNotNull()))


def _chain(moments: DataFrame, links: DataFrame, keys) -> DataFrame:
    """Moments reached from each key's first one; rounds grow with the log of the chain."""
    reached = staged(moments.groupBy(*keys).agg(F.min(AT).alias(AT)), "reached")
    size = reached.count()
    while True:
        onward = matched(reached, links, [*keys, AT], "inner").select(*keys, F.col(NEXT).alias(AT))
        grown = staged(reached.unionByName(onward).distinct(), "reached")
        grown_size = grown.count()
        if grown_size == size:
            return reached
        reached, size = grown, grown_size
        there = links.select(*keys, F.col(AT).alias(NEXT), F.col(NEXT).alias("_after"))
        links = staged(matched(links, there, [*keys, NEXT], "inner")
                       .select(*keys, AT, F.col("_after").alias(NEXT)), "links")


def _labelled(timed: DataFrame, owned: DataFrame, keys, at, order, ttl: int, columns, held: int) -> DataFrame:
    """Give each row the one hold that covers it.

    Holds of a key never overlap, so a time cell of one ttl meets at most two of them.
    """
    cell = F.floor(F.col(AT) / ttl).cast("bigint")
    covering = owned.select(
        *keys, F.col(AT).alias("_since"), "_first",
        F.explode(F.array(cell, cell + 1)).alias("_cell"))
    rows = timed.withColumn("_cell", cell)
    if held <= BROADCAST_HOLDS:
        covering, salted = F.broadcast(covering), []
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        covering = covering.withColumn("_salt", salts)
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int"))
        salted = ["_salt"]
    covers = (F.col("_since") <= F.col(AT)) & (F.col(AT) < F.col("_since") + ttl)
    met = matched(rows, covering, [*keys, "_cell", *salted], "inner", covers)
    is_holder = F.col(AT) == F.col("_since")
    for name in order:
        is_holder = is_holder & F.col(name).eqNullSafe(F.col("_first")[name])
    return met.select(
        *columns,
        is_holder.alias(ACQUIRED),
        F.col("_first")["_owner"].alias(HOLDER),
        F.timestamp_micros("_since").alias(HELD),
    )
