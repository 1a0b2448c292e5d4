"""PCA whitening of vectors by Spark's distributed block matrices.

Centred rows are indexed into blocks, a multiplication of the transposed matrix with itself
gives the scatter, its eigenvectors are found locally (a matrix of dimensions, not of rows),
and a second multiplication projects all rows. Blocks are filled up with rows of zeros, which
change neither.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, staged
from .vectors import commonest_width, embeddings, matrix, sums, usable, whole_numbers

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8

# Rows of a block: so many that the blocks, whose places the driver lists, stay few, and so
# few that a block stays small.
LEAST_ROWS, BLOCKS, BLOCK_BYTES = 1024, 20_000, 16 << 20
# Products of blocks that one task sums up.
BLOCKS_PER_SUM = 16

BLOCK = "part int, seq int, ids array<bigint>, deviations array<bigint>, data binary"
OUT = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
       "identity_error double")


def rows_per_block(n: int, width: int) -> int:
    return max(1, min(max(LEAST_ROWS, -(-n // BLOCKS)), BLOCK_BYTES // (8 * width)))


def blocks_of(rows: DataFrame, n: int, totals: list[int], spread: int, size: int) -> DataFrame:
    """Numbered blocks of ``size`` rows: ids, exact deviations, and centred rows as doubles.

    With S the sums, n * x - S is exact, and its quotient by n is rounded once. ``spread`` is
    the largest |n * x - S|, which decides whether squares fit whole numbers of 64 bits.
    """
    width = len(totals)
    fits = spread < 1 << 62 and max(map(abs, totals)) < 1 << 62
    squares_fit = fits and spread * spread * width < 1 << 63

    def block(seq: int, ids: list, values: np.ndarray) -> dict:
        x = whole_numbers(values, SCALE, SHIFT)
        off = n * x - np.array(totals, np.int64) if fits else n * x.astype(object) - np.array(totals, object)
        if squares_fit:
            deviations = (off * off).sum(1)
        else:
            # A deviation that 64 bits cannot hold has no value.
            deviations = [d if d < 1 << 63 else None for d in (off.astype(object) ** 2).sum(1)]
        centred = np.zeros((size, width))
        centred[:len(x)] = off.astype(np.float64) / n
        return {"part": [TaskContext.get().partitionId()], "seq": [seq], "ids": [ids],
                "deviations": [list(deviations)], "data": [centred.tobytes()]}

    def work(batches):
        seq, ids, held = 0, [], np.zeros((0, width))
        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            held = np.concatenate([held, matrix(batch.column("vector"), width)])
            while len(held) >= size:
                yield block(seq, ids[:size], held[:size])
                seq, ids, held = seq + 1, ids[size:], held[size:]
        if len(held):
            yield block(seq, ids, held)

    found = staged(map_arrow(rows.filter(F.size("vector") == width), BLOCK, work), "blocks")
    counts = found.groupBy("part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per task that wrote blocks.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return found.join(starts, "part").select(
        (F.col("_start") + F.col("seq")).cast("int").alias("number"), "ids", "deviations", "data")


def block_matrix(blocks: DataFrame, size: int, width: int) -> BlockMatrix:
    def placed(row):
        return (row[0], 0), DenseMatrix(size, width, np.frombuffer(row[1]), True)

    placed_blocks = blocks.select("number", "data").rdd.map(placed)
    return BlockMatrix(placed_blocks, size, width, blocks.count() * size, width)


def scatter(rows: BlockMatrix) -> np.ndarray:
    """The transposed matrix times itself; sums of products are split over many tasks."""
    splits = -(-rows.numRowBlocks // BLOCKS_PER_SUM)
    # The form of multiply that splits the inner dimension is not in the Python class.
    product = rows.transpose()._java_matrix_wrapper.call("multiply", rows._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, rows.colsPerBlock, rows.colsPerBlock).toLocalMatrix().toArray()


def principal(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, that rounding alone cannot explain, and their unit vectors."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = int((values > len(values) * np.finfo(float).eps * max(values[0], 0)).sum())
    return values[:min(kept, most)], vectors[:, :min(kept, most)]


def _values(blocks: RDD) -> RDD:
    return blocks.map(lambda placed: (placed[0][0], bytearray(placed[1].toArray().tobytes())))


def whitened(table: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Per usable row and principal component the whitened coordinate, and figures of the fit.

    Columns: ``vec_id``, ``component`` (from 1), ``n`` (rows of the fit), ``deviation`` (the
    row's sum over dimensions of (n * x - S) squared; null beyond 64 bits), ``whitened``,
    ``explained`` and ``identity_error``. Left out are rows with a null vector, with a null or
    non-finite entry or one beyond 2^31, and rows whose vector is empty or not of the
    commonest length. Repeated rows count as often as they stand there; a null id stays.
    Directions without variance are no components: equal rows, or none, give no result.
    Columns besides ``vec_id`` and ``embedding`` are not read.
    """
    spark = table.sparkSession
    rows = usable(table, "vec_id")
    found = sums(rows, SCALE, SHIFT)
    width = commonest_width(found)
    nothing = spark.createDataFrame([], OUT)
    if width is None:
        return nothing
    fit = found.filter(F.col("width") == width).orderBy("dim").collect()
    n, totals = fit[0]["n"], [int(r["total"]) for r in fit]
    spread = max(max(n * r["most"] - t, t - n * r["least"]) for r, t in zip(fit, totals))
    if not spread:
        return nothing
    size = rows_per_block(n, width)
    blocks = staged(blocks_of(rows, n, totals, spread, size), "numbered")
    kept = StorageLevel.MEMORY_AND_DISK
    centred = block_matrix(blocks, size, width).persist(kept)
    covariance = scatter(centred) / n
    values, vectors = principal(covariance, most)
    k = len(values)
    whitening = np.asfortranarray(vectors / np.sqrt(values))
    local = spark.sparkContext.parallelize([((0, 0), DenseMatrix(width, k, whitening.ravel("F")))], 1)
    projected = centred.multiply(BlockMatrix(local, width, k)).persist(kept)
    error = float(np.abs(scatter(projected) / n - np.eye(k)).max())
    coordinates = staged(spark.createDataFrame(_values(projected.blocks), "number int, coordinates binary"), "projected")
    # What remains is read from staged tables; the trace is that of the covariance.
    explained = values / np.trace(covariance)
    for held in (projected, centred):
        held._java_matrix_wrapper._java_model.blocks().unpersist(False)

    def unfold(batches):
        for batch in batches:
            for row in batch.to_pylist():
                m = len(row["ids"])
                values = np.frombuffer(row["coordinates"]).reshape(size, k)[:m]
                yield {"vec_id": pa.array(row["ids"], pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                       "component": np.tile(np.arange(1, k + 1), m), "n": np.full(m * k, n),
                       "deviation": pa.array(row["deviations"], pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                       "whitened": values.ravel(), "explained": np.tile(explained, m),
                       "identity_error": np.full(m * k, error)}

    return map_arrow(blocks.drop("data").join(coordinates, "number"), OUT, unfold)


def op12_whitening(spark, sf_dir):
    return whitened(embeddings(spark, sf_dir))
