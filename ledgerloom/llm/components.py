"""Connected components by alternating stars, for link tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

# Rounds grow with the logarithm of the longest chain of links.
MOST_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    mark = F.expr("bit_xor(xxhash64(u, v))")
    return tuple(edges.agg(F.count(F.lit(1)), mark).first())


def components(links: DataFrame) -> DataFrame:
    """``id`` and the smallest ``component_id`` reachable from it, for all ids in links ``a``-``b``.

    Each round hangs the larger neighbours of every id on its smallest neighbour, then does
    the same among smaller ones, until nothing changes: all ids hang on their smallest.
    Minima combine before the shuffle; adaptive joins split an id with very many links.
    """
    edges = staged(links.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = _state(edges)
    for _ in range(MOST_ROUNDS):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = (both.filter("v > u").join(least, F.col("u") == F.col("x"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        hung = large.join(small, F.col("u") == F.col("x"))
        following = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(
            small.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct()
        edges = staged(following, "links")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
