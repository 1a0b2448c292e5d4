"""Fixed-window call counters on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import window_id
from ..operators.access import admissible
from .runs import drain, into_folders


def window_count_stream(calls: DataFrame, seconds: int, allowed: Sequence[str],
                        lateness: str | None = None) -> DataFrame:
    """Running count per key and window.

    Every window stays in the state, so that no call is too late to count. With ``lateness``
    closed windows leave it, and calls that come later than that are not counted.
    """
    timed = calls.filter(admissible(allowed))
    if lateness is not None:
        timed = timed.withWatermark("ts", lateness)
    counted = timed.groupBy("api_key", F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("calls"))
    return counted.select("api_key", window_id(F.col("w.start"), seconds).alias("window_id"), "calls")


def count_arrived(calls: DataFrame, seconds: int, allowed: Sequence[str], path: str, checkpoint: str,
                  lateness: str | None = None) -> DataFrame:
    """Count all arrived calls; of the updates of a window the last, largest one stands."""
    stream = window_count_stream(calls, seconds, allowed, lateness)
    drain(calls.sparkSession, stream.writeStream.outputMode("update").foreachBatch(into_folders(path)), checkpoint)
    updates = calls.sparkSession.read.schema(stream.schema).parquet(path)
    return updates.groupBy("api_key", "window_id").agg(F.max("calls").alias("calls"))
