"""Tables: the given parquet files, and the ledger and audit stores."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.clock import minutes_before

EVENTS = "events"
CUSTOMER = "customer"

# Declared schemas of the given tables, only the columns used here.
GIVEN = {
    EVENTS: T.StructType([
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())]),
    CUSTOMER: T.StructType([T.StructField("c_custkey", T.LongType())]),
}


def given_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def arriving_path(sf_dir: str, name: str) -> str:
    """The same table for a stream reader; the pattern takes one file or a folder of them."""
    return f"{sf_dir}/{{{name}.parquet}}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(GIVEN[name]).parquet(given_path(sf_dir, name))


def stored(spark: SparkSession, schema: T.StructType, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A store with a declared schema: files by default, ``jdbc`` by configuration."""
    reader = spark.read.format(fmt).options(**options)
    if fmt == "jdbc":
        return reader.option("dbtable", path).load().select(*schema.fieldNames())
    return reader.schema(schema).load(path)


def stored_or_empty(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """A store that may not have been written yet."""
    try:
        return stored(spark, schema, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # Known to be empty without a Python worker, so that joins with it fall away.
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]).limit(0)


def settings_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Stored read-access settings; if they cannot be read there are none, and defaults apply."""
    try:
        return stored(spark, schemas.SETTINGS, path, fmt, **options)
    except PySparkException:
        return spark.createDataFrame([], schemas.SETTINGS)


def ledger_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return stored(spark, schemas.LEDGER, path, fmt, **options)


def audit_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return stored(spark, schemas.AUDIT, path, fmt, **options)


def since(df: DataFrame, run_at: datetime, lookback_minutes: int) -> DataFrame:
    """Rows processed in the look-back window; the lower bound is inside, there is no upper one."""
    bound = minutes_before(F.lit(run_at.isoformat(sep=" ")).cast("timestamp"), lookback_minutes)
    recent = df.filter(F.col("processed_at") >= bound)
    # A store kept by day is pruned to the days of the window.
    return recent.filter(F.col("processed_date") >= F.to_date(bound)) if "processed_date" in df.columns else recent


def by_id(df: DataFrame, transaction_id: str) -> DataFrame:
    """Point lookup; the id is unique in the ledger."""
    return df.filter(F.col("transaction_id") == transaction_id)
