"""What the operators of this subpackage share: session settings, text columns, Arrow maps."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..session import prepare, setting, staged

# The white space every word contract here separates words by.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = "[\\x20\\x09-\\x0D]"

SETTINGS = {
    # Python workers hold one batch at a time: bound it by rows and by bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    # Shuffle files of a finished job go at once; staged tables are what later jobs read.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


# Where this package lies; Python workers on machines with that folder find it there, whatever
# folder the session was started in. Elsewhere it has to be shipped (--py-files).
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# Python workers serve many tasks: large arrays that a task frees go back to the machine, not to
# a heap that only grows.
FOR_WORKERS = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20), "MALLOC_ARENA_MAX": "2"}


def ready(spark: SparkSession) -> SparkSession:
    prepare(spark)
    for_workers = spark.sparkContext.environment
    for name, value in FOR_WORKERS.items():
        for_workers.setdefault(name, value)
    listed = [p for p in for_workers.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in listed:
        for_workers["PYTHONPATH"] = os.pathsep.join([*listed, ROOT])
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def map_arrow(df: DataFrame, ddl: str, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]) -> DataFrame:
    """``mapInArrow`` for a function that yields dicts of columns in the schema ``ddl``."""
    schema = schema_of(ddl)
    shape = to_arrow_schema(schema)

    def run(batches):
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays(
                [_column(columns[f.name], f.type) for f in shape], schema=shape)

    return df.mapInArrow(run, schema)


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    if isinstance(values, np.ndarray) and values.dtype != object:
        return pa.array(values).cast(kind)
    return pa.array(values, type=kind)


def shuffle_parts(spark: SparkSession) -> int:
    return setting(spark, "spark.sql.shuffle.partitions", 200)


__all__ = ["BLANKS", "BLANK_CLASS", "documents", "map_arrow", "ready", "schema_of", "setting",
           "shuffle_parts", "staged", "whole_text"]
