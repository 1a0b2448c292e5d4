"""Comparing the audit documents of a window with the ledger."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.clock import minutes_before
from ..session import staged
from ..sources.tables import since
from .skew import matched

ID = ["transaction_id"]


def missing_in_ledger(audit: DataFrame, ledger: DataFrame) -> DataFrame:
    """Distinct audited ids the ledger lacks; ids reduce to one row each before the join."""
    return matched(audit.select(*ID).distinct(), ledger.select(*ID), ID, "left_anti")


def run_row(audit: DataFrame, ledger: DataFrame, run_at: datetime, lookback_minutes: int) -> DataFrame:
    """One reconciliation row for the window before ``run_at``.

    Each side is scanned once and reduced per id; the counts and the few noted ids come
    from the same joined table.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return since(df, run_at, lookback_minutes).groupBy(*ID).agg(F.count(F.lit(1)).alias(name))

    both = staged(side(audit, "_audited").join(side(ledger, "_entered"), ID, "full"), "reconciled")
    absent = F.col("_entered").isNull()
    counts = both.agg(
        F.coalesce(F.sum("_audited"), F.lit(0)).alias("_audited"),
        F.coalesce(F.sum("_entered"), F.lit(0)).alias("_entered"),
        F.count_if(absent).alias("_missing"))
    noted = both.filter(absent).select(F.col("transaction_id").alias("_noted")).orderBy("_noted").limit(fixed.NOTED_IDS)
    # At most one row of counts and NOTED_IDS ids meet here.
    gathered = counts.unionByName(noted, allowMissingColumns=True).agg(
        F.max("_audited").alias("audit_count"), F.max("_entered").alias("ledger_count"),
        F.max("_missing").alias("missing_in_ledger"), F.array_sort(F.collect_list("_noted")).alias("_ids"))
    moment = F.lit(run_at.isoformat(sep=" ")).cast("timestamp")
    clean = F.col("missing_in_ledger") == 0
    return gathered.select(
        moment.alias("run_at"), minutes_before(moment, lookback_minutes).alias("window_start"),
        "audit_count", "ledger_count", "missing_in_ledger",
        F.when(clean, fixed.RECONCILED).otherwise(fixed.DRIFTED).alias("status"),
        F.when(clean, fixed.RECONCILED_NOTE)
        .otherwise(F.concat(F.lit(fixed.DRIFTED_NOTE), F.concat_ws(",", "_ids"))).alias("notes"))
