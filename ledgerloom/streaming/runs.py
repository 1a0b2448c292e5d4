"""Running a stream over what has arrived, with its own checkpoint, and where its batches go.

A micro-batch is named by the run it belongs to and its number. The run is the id Spark
keeps in the checkpoint: a restarted stream goes on under its name, and one with a new
checkpoint, whose numbers begin at 0 again, never meets the folders of another.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..session import PLAIN_READS

QUERY_ID = "sql.streaming.queryId"
PLACE_FIELDS = (T.StructField("run_id", T.StringType()), T.StructField("batch_id", T.LongType()))


class Place(NamedTuple):
    """A run of a stream and one of its micro-batches."""

    run_id: str
    batch_id: int

    @classmethod
    def of(cls, batch: DataFrame, batch_id: int) -> Place:
        run = batch.sparkSession.sparkContext.getLocalProperty(QUERY_ID)
        if not run:
            raise RuntimeError("a micro-batch outside a running stream has no place")
        return cls(f"run-{run}", batch_id)

    def folder(self, path: str) -> str:
        return f"{path}/run_id={self.run_id}/batch_id={self.batch_id}"

    def is_other(self) -> Column:
        """Stored rows that an earlier attempt of this very batch has not written."""
        return (F.col("run_id") != self.run_id) | (F.col("batch_id") != self.batch_id)


def drain(spark: SparkSession, writer: DataStreamWriter, checkpoint: str) -> None:
    """Process everything that has arrived, then stop."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def batch_folder(df: DataFrame, path: str, place: Place) -> None:
    """Write one micro-batch into its own partition; a retry replaces it."""
    df.write.mode("overwrite").parquet(place.folder(path))


def batch_read(spark: SparkSession, schema: T.StructType, path: str, place: Place) -> DataFrame:
    """What a micro-batch has written."""
    return spark.read.options(**PLAIN_READS).schema(schema).parquet(place.folder(path))


def into_folders(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch_folder(batch, path, Place.of(batch, batch_id))
    return write
