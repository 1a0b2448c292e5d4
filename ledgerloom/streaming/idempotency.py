"""Duplicate classification on a stream: micro-batches folded onto a stored table of holds.

A micro-batch meets the last hold of each of its keys and goes through the batch operator,
hot keys included. Holds are kept by day of acquisition; only days that can still hold
something for the batch's earliest row are read. Expiry is judged by event time alone, so
neither a pause nor a backlog frees a key early.

A row that arrives after a later row of its key has acquired the key cannot be judged any
more: it goes to the late rows. Rows of one micro-batch may come in any order. A row without
a moment acquires for itself, as in the batch operator.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..operators.hold import ACQUIRED, HELD, HOLDER, hold
from ..operators.idempotency import ARRIVAL, HOURS, outcome
from ..operators.skew import matched
from ..operators.validate import valid
from ..sources.tables import stored_or_empty
from .runs import PLACE_FIELDS, Place, batch_folder, drain

DAY, SINCE, OWNER = "since_date", "_since", "_owner"


@dataclass(frozen=True)
class HoldFolders:
    """Where a classifying stream keeps its labelled rows, late rows, holds and progress."""

    root: str

    @property
    def labelled(self) -> str:
        return f"{self.root}/labelled"

    @property
    def late(self) -> str:
        return f"{self.root}/late"

    @property
    def holds(self) -> str:
        return f"{self.root}/holds"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"


@dataclass(frozen=True)
class Rule:
    """Keys held from ``at`` for ``ttl_seconds`` in the name of ``owner``."""

    keys: tuple[str, ...]
    at: str
    order: tuple[str, ...]
    owner: str
    ttl_seconds: int


def _holds_schema(batch: DataFrame, rule: Rule) -> T.StructType:
    return T.StructType([*[batch.schema[k] for k in rule.keys], T.StructField(SINCE, T.TimestampType()),
                         T.StructField(OWNER, batch.schema[rule.owner].dataType),
                         T.StructField(DAY, T.DateType()), *PLACE_FIELDS])


def _last_holds(batch: DataFrame, rule: Rule, folders: HoldFolders, place: Place) -> DataFrame:
    """The last hold of each key of the batch that can reach its earliest row, or lies after it."""
    stored = stored_or_empty(batch.sparkSession, _holds_schema(batch, rule), folders.holds).filter(place.is_other())
    first = batch.agg(F.min(rule.at)).first()[0]
    if first is not None:
        stored = stored.filter(F.col(DAY) >= F.lit((first - timedelta(seconds=rule.ttl_seconds)).date()))
    mine = matched(stored, batch.select(*rule.keys).distinct(), rule.keys, "left_semi")
    last = mine.groupBy(*rule.keys).agg(F.max(F.struct(SINCE, OWNER)).alias("_h"))
    return last.select(*rule.keys, F.col("_h")[SINCE].alias(SINCE), F.col("_h")[OWNER].alias(OWNER))


def fold_batch(batch: DataFrame, rule: Rule, folders: HoldFolders, place: Place) -> None:
    """Label a micro-batch, set its late rows aside and store the holds it acquires."""
    holds = _last_holds(batch, rule, folders, place)
    met = matched(batch, holds, rule.keys, "left")
    is_late = F.coalesce(F.col(rule.at) < F.col(SINCE), F.lit(False))
    batch_folder(met.filter(is_late).drop(SINCE, OWNER), folders.late, place)
    # The stored hold goes before the rows of its moment and acquires its key again.
    before = holds.select(*rule.keys, F.col(SINCE).alias(rule.at), F.col(OWNER).alias(rule.owner), F.lit(0).alias("_turn"))
    rows = met.filter(~is_late).drop(SINCE, OWNER).withColumn("_turn", F.lit(1))
    held = hold(rows.unionByName(before, allowMissingColumns=True), rule.keys, rule.at, ["_turn", *rule.order],
                rule.owner, rule.ttl_seconds)
    batch_folder(held.filter("_turn = 1").drop("_turn"), folders.labelled, place)
    done = batch.sparkSession.read.parquet(place.folder(folders.labelled))
    acquired = done.filter(F.col(ACQUIRED) & F.col(rule.at).isNotNull()).select(
        *rule.keys, F.col(rule.at).alias(SINCE), F.col(rule.owner).alias(OWNER), F.to_date(rule.at).alias(DAY),
        F.lit(place.run_id).alias("run_id"), F.lit(place.batch_id).alias("batch_id"))
    (acquired.hint("rebalance", DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(DAY, "run_id", "batch_id").parquet(folders.holds))


def held_arrived(rows: DataFrame, rule: Rule, folders: HoldFolders,
                 then: Callable[[DataFrame, Place], None] | None = None) -> DataFrame:
    """Streaming counterpart of ``operators.hold.hold``: label everything that has arrived and
    return all rows labelled so far. ``then`` may work on the labels of each batch."""
    spark = rows.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        place = Place.of(batch, batch_id)
        if not batch.isEmpty():
            fold_batch(batch, rule, folders, place)
            if then:
                then(batch.sparkSession.read.parquet(place.folder(folders.labelled)), place)

    drain(spark, rows.writeStream.foreachBatch(step), folders.checkpoint)
    return labelled_so_far(spark, rows.schema, rule, folders)


def labelled_so_far(spark: SparkSession, schema: T.StructType, rule: Rule, folders: HoldFolders) -> DataFrame:
    out = T.StructType([*schema.fields, T.StructField(ACQUIRED, T.BooleanType()),
                        T.StructField(HOLDER, schema[rule.owner].dataType), T.StructField(HELD, T.TimestampType()),
                        *PLACE_FIELDS])
    return stored_or_empty(spark, out, folders.labelled).drop("run_id", "batch_id")


def late_so_far(spark: SparkSession, schema: T.StructType, folders: HoldFolders) -> DataFrame:
    """Rows that came too late to be judged."""
    return stored_or_empty(spark, T.StructType([*schema.fields, *PLACE_FIELDS]), folders.late).drop("run_id", "batch_id")


def key_rule(ttl_hours: int = fixed.IDEMPOTENCY_TTL_HOURS, scope: Sequence[str] = ("idempotency_key",)) -> Rule:
    return Rule(tuple(scope), "created_at", ARRIVAL, "transaction_id", ttl_hours * HOURS)


def classified_arrived(requests: DataFrame, root: str, ttl_hours: int = fixed.IDEMPOTENCY_TTL_HOURS,
                       scope: Sequence[str] = ("idempotency_key",)) -> DataFrame:
    """Streaming counterpart of ``operators.idempotency.classify`` over the valid requests."""
    held = held_arrived(valid(requests), key_rule(ttl_hours, scope), HoldFolders(root))
    return held.withColumn("outcome", outcome(F.col(ACQUIRED), F.col(HOLDER)))


def guarded_nonces_arrived(requests: DataFrame, root: str, ttl_minutes: int = fixed.NONCE_TTL_MINUTES) -> DataFrame:
    """First use of a merchant's nonce within its time to live is ``acquired``."""
    rule = Rule(("merchant_id", "nonce"), "received_at", ARRIVAL, "seq", ttl_minutes * 60)
    return held_arrived(requests, rule, HoldFolders(root))
