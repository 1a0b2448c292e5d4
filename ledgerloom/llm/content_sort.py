"""Exact duplicates by sorting the normalised content.

Splitters sampled from the first characters of the content cut the rows into ranges. Inside a
range the rows are sorted externally by their whole content, and each is compared in full with
its neighbour. Where very many rows begin alike, as copies of one content do, they are cut into
parts by a hash of the id, each sorted and compared for itself. What the parts of one content
found is then combined by narrow rows, which know it by its digests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, documents, shuffle_parts, staged, whole_text

# Characters of the content that the splitters carry, and those of the text that mostly hold them.
SPLITTER_CHARS, LEADING_CHARS = 32, 128
# Rows that begin alike beyond which they are cut into parts: so many, or this share of a
# partition's rows; and the most parts.
HEAD_ROWS, HEAD_SHARE, PARTS = 20_000, 0.25, 65_536


def normalised(text: Column) -> Column:
    """The text without the white space of the contract."""
    return reduce(lambda t, b: F.replace(t, F.lit(b), F.lit("")), BLANKS, text)


def leading(text: Column) -> Column:
    """The first characters of the content; the whole text is read only if it begins with white space."""
    short = normalised(F.substring(text, 1, LEADING_CHARS))
    return F.substring(F.when(F.length(short) >= SPLITTER_CHARS, short).otherwise(normalised(text)), 1, SPLITTER_CHARS)


def _cuts(headed: DataFrame, rows: int) -> DataFrame:
    """Heads of very many rows, and into how many parts they are cut; at most a few per partition."""
    most = max(1, min(HEAD_ROWS, int(rows * HEAD_SHARE) // shuffle_parts(headed.sparkSession)))
    crowded = headed.groupBy("head").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    return staged(crowded.select("head", F.least(F.ceil(F.col("n") / most), F.lit(PARTS)).alias("cuts")), "heads")


def compared(docs: DataFrame) -> DataFrame:
    """A narrow row per document: digest, class among equal digests, length, and first or repeat.

    ``kin`` numbers the contents of one digest and hash that the sort has told apart (0
    throughout, unless digests collide). ``again`` marks a row equal in id and text length to
    the one before it.
    """
    headed = docs.select("doc_id", whole_text().alias("text")).withColumn("head", leading(F.col("text")))
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("cuts")), F.lit(0))
    placed = headed.join(F.broadcast(_cuts(headed.select("head"), docs.count())), "head", "left").select(
        "head", part.alias("part"), "doc_id", "text")
    place = ["head", "part"]
    content = placed.repartitionByRange(*place).select(
        *place, "doc_id", normalised(F.col("text")).alias("content"), F.length("text").alias("n_points"))
    order = Window.partitionBy(*place).orderBy("content", F.desc("n_points"), "doc_id")
    same = F.col("content").eqNullSafe(F.lag("content").over(order))
    again = (same & F.col("doc_id").eqNullSafe(F.lag("doc_id").over(order))
             & (F.col("n_points") == F.lag("n_points").over(order)))
    seen = content.select(*place, "doc_id", "content", "n_points", (~same).cast("int").alias("_new"), again.alias("again"))
    runs = seen.select(
        *place, "doc_id", "n_points", F.coalesce("again", F.lit(False)).alias("again"),
        F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
        F.sha2(F.col("content").cast("binary"), 256).alias("text_sha256"), F.xxhash64("content").alias("mark"))
    alike = Window.partitionBy(*place, "text_sha256", "mark").orderBy("run")
    return runs.select("doc_id", "text_sha256", "mark", "n_points", "again", (F.dense_rank().over(alike) - 1).alias("kin"))


def decided(docs: DataFrame) -> DataFrame:
    """Per row: which row of its class of equal contents stays, and how many rows it has.

    A null text counts as empty, so null, empty and blank texts form one class. Of equal
    rows with equal ids exactly one stays; a null id is the smallest. Only ``doc_id`` and
    ``text`` are read; an empty table gives no rows.
    """
    rows = staged(compared(docs), "content-sort")
    kind = ["text_sha256", "mark", "kin"]
    best = rows.groupBy(*kind).agg(
        F.min(F.struct((-F.col("n_points")).alias("less"), "doc_id")).alias("_best"),
        F.count(F.lit(1)).alias("group_size"))
    joined = rows.join(best, kind)
    stays = (F.col("doc_id").eqNullSafe(F.col("_best.doc_id"))
             & (F.col("n_points") == -F.col("_best.less")) & ~F.col("again"))
    return joined.select("doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size", stays.alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all columns they came with."""
    names = docs.columns
    stays = decided(docs).filter("kept").select(
        F.col("doc_id").alias("_keep_id"), F.col("text_sha256").alias("_keep_sha"))
    digest = F.sha2(normalised(whole_text()).cast("binary"), 256)
    marked = docs.withColumn("_sha", digest)
    found = marked.join(stays, marked["doc_id"].eqNullSafe(stays["_keep_id"])
                        & (marked["_sha"] == stays["_keep_sha"]), "left_semi")
    # Rows that share id and content, but of which one stays.
    repeated = marked.groupBy("doc_id", "_sha").count().filter("count > 1").select("doc_id", "_sha").limit(1)
    if not repeated.isEmpty():
        length = F.length(whole_text())
        first = F.row_number().over(Window.partitionBy("doc_id", "_sha").orderBy(length.desc()))
        found = found.withColumn("_n", first).filter("_n = 1")
    return found.select(*names)


def op7_content_sort(spark, sf_dir):
    return decided(documents(spark, sf_dir))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS points, regexp_replace(t, '[\x20\x09-\x0D]', '', 'g') AS content FROM d)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY content ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY content) AS group_size,
       row_number() OVER (PARTITION BY content ORDER BY points DESC, doc_id) = 1 AS kept,
       sha256(content) AS text_sha256
FROM n
"""
