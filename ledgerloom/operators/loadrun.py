"""Summary of a load run and its pass marks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from .skew import SLICE, before_slice, sliced

# Distinct values one task may sort for exact percentiles.
BUFFERED_VALUES = 1_000_000
QUANTILES = (0.5, 0.9, 0.95, 0.99)
NAMES = ("med_ms", "p90_ms", "p95_ms", "p99_ms")


def percentiles(df: DataFrame, column: str, quantiles: Sequence[float], names: Sequence[str],
                buffered: int = BUFFERED_VALUES) -> DataFrame:
    """Exact interpolated percentiles as one row.

    Distinct values are counted, and each wanted position is read from the value whose
    running count covers it. Many distinct values are range-sorted into slices first; the
    positions and the interpolation are the same either way.
    """
    present = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_v"))
    size = present.agg(F.approx_count_distinct("_v").alias("distinct"), F.count(F.lit(1)).alias("total")).first()
    total, counted = size["total"], present.groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    if size["distinct"] <= buffered:
        ended = counted.withColumn("_end", F.sum("_n").over(Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    else:
        cut = sliced(counted, ["_v"], size["distinct"], "percentile")
        per_slice = cut.groupBy(SLICE).agg(F.sum("_n").alias("_total")).withColumn("_all", F.lit(0))
        offsets = before_slice(per_slice, ["_all"], "_total", "_before").drop("_all")
        running = F.sum("_n").over(Window.partitionBy(SLICE).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
        ended = (cut.withColumn("_within", running).join(F.broadcast(offsets), SLICE)
                 .withColumn("_end", F.col("_before") + F.col("_within")))
    placed = ended.withColumn("_start", F.col("_end") - F.col("_n"))

    def at(position: int) -> Column:
        return F.max(F.when((F.col("_start") <= position) & (F.col("_end") > position), F.col("_v")))

    wanted = []
    for q, name in zip(quantiles, names):
        exact = q * (total - 1)
        low = int(exact)
        high = min(low + 1, total - 1)
        wanted.append((at(low) + (at(high) - at(low)) * (exact - low)).alias(name))
    return placed.agg(*wanted)


def summary(requests: DataFrame, buffered: int = BUFFERED_VALUES) -> DataFrame:
    """Counts, rates and latency statistics of a run, as one row."""
    ok = F.col("status") == 202
    bad_http = ~F.col("status").between(200, 399)
    quick = F.col("duration_ms") < fixed.CHECK_CEILING_MS
    ratio = lambda test: F.count_if(test) / F.count(F.lit(1))
    basics = requests.agg(
        F.count(F.lit(1)).alias("iterations"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("failed"),
        ratio(bad_http).alias("http_failed_rate"), ratio(ok).alias("status_202_rate"),
        ((F.count_if(ok) + F.count_if(quick)) / (2 * F.count(F.lit(1)))).alias("checks_rate"),
        ratio(ok & quick).alias("app_check_rate"),
        F.avg("duration_ms").alias("avg_ms"), F.min("duration_ms").alias("min_ms"),
        F.max("duration_ms").alias("max_ms"), F.avg(F.when(ok, F.col("duration_ms"))).alias("accepted_avg_ms"))
    # One row on either side of the union; the maximum merges them.
    merged = basics.unionByName(percentiles(requests, "duration_ms", QUANTILES, NAMES, buffered),
                                allowMissingColumns=True)
    whole = ("iterations", "accepted", "failed")
    return merged.agg(*[
        F.max(c).alias(c) if c in whole else F.round(F.max(c), 6).alias(c) for c in merged.columns])


def thresholds(run: DataFrame) -> DataFrame:
    """Each pass mark of the run with the observed value and the verdict."""
    def mark(metric: str, rule: str, observed: str, test: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), F.lit(rule).alias("rule"),
                        F.col(observed).alias("observed"), test.alias("passed"))

    marks = F.array(
        mark("http_req_failed", "rate==0", "http_failed_rate", F.col("http_failed_rate") == 0),
        mark("status_202_rate", "rate==1", "status_202_rate", F.col("status_202_rate") == 1),
        mark("checks", "rate==1", "checks_rate", F.col("checks_rate") == 1),
        mark("app_check_rate", "rate==1", "app_check_rate", F.col("app_check_rate") == 1),
        mark("http_req_duration", "p(95)<1000", "p95_ms", F.col("p95_ms") < fixed.P95_CEILING_MS),
        mark("http_req_duration", "p(99)<2000", "p99_ms", F.col("p99_ms") < fixed.P99_CEILING_MS))
    return run.select(F.inline(marks))
