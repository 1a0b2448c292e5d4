"""What the operators on vectors share: usable rows, and their components as an array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, ready, staged

# Components beyond this have no place in whole numbers of 64 bits once they are scaled.
LARGEST = float(1 << 31)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/embeddings.parquet")


def usable(table: DataFrame, *others, most: float = LARGEST) -> DataFrame:
    """Rows with a vector of finite entries up to ``most``, as ``vector`` of doubles."""
    whole = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= most))
    rows = table.select(*others, F.col("embedding").cast("array<double>").alias("vector"))
    return rows.filter(F.col("vector").isNotNull() & whole)


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of one width as a two-dimensional array."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), width)


def sums(rows: DataFrame, scale: int, shift: int) -> DataFrame:
    """Per width and dimension: rows, and sum, least and most of floor(scale * c) + shift.

    Tasks report one row per width and dimension; the table is small and staged.
    """
    def work(batches):
        held: dict[int, list] = {}
        for batch in batches:
            vectors = batch.column("vector")
            widths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(widths[widths > 0]).tolist():
                x = whole_numbers(matrix(vectors.filter(pa.array(widths == width)), width), scale, shift)
                n, total, least, most = held.get(width, (0, 0, x[0], x[0]))
                # Totals are Python's whole numbers, which cannot overflow.
                held[width] = (n + len(x), total + x.sum(0).astype(object), np.minimum(least, x.min(0)), np.maximum(most, x.max(0)))
        for width, (n, total, least, most) in held.items():
            yield {"width": np.full(width, width), "dim": np.arange(width), "n": np.full(width, n),
                   "total": [str(t) for t in total], "least": least, "most": most}

    parts = map_arrow(rows.select("vector"), "width int, dim int, n bigint, total string, least bigint, most bigint", work)
    return staged(parts.groupBy("width", "dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"),
        F.min("least").alias("least"), F.max("most").alias("most")), "vector-sums")


def commonest_width(found: DataFrame) -> int | None:
    """The width of most rows (of equally many the largest); None without rows."""
    first = found.filter("dim = 0").orderBy(F.desc("n"), F.desc("width")).first()
    return first["width"] if first else None


def whole_numbers(values: np.ndarray, scale: int, shift: int = 0) -> np.ndarray:
    return np.floor(scale * values).astype(np.int64) + shift
