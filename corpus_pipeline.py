"""From raw documents to packed training sequences, in stages that each write and reread Parquet.

Toxic documents go first, then exact copies, then near copies; what is left is put into the
order of the mixture and packed. All stages but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import content_sort, jaccard_join, mixing, packing, toxicity
from ledgerloom.llm.common import ready
from ledgerloom.session import fresh_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below one half; the model learns from all labels.

    Null and empty texts score as the prior. Rows stay whole, repeated ones too.
    """
    return toxicity.clean(docs, ready(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows equal but for white space the longest, then that of the smallest id.

    Null, empty and blank texts are copies of each other.
    """
    return content_sort.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each group of documents linked by shingles.

    Rows without words and rows with a null id have no links and stay.
    """
    return jaccard_join.thinned(docs)


def in_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, written in the order in which the mixture takes them."""
    return mixing.in_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its sequence and place in it."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources to target weights", in_mixture),
    ("best-fit packing", packed),
]

# A trained classifier decides what goes, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = fresh_path(spark, "stage-" + name.replace(" ", "-"))
        ready(spark)
        stage(spark, docs, sf_dir).write.mode("errorifexists").parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
