"""Token ids of documents in files of Simple-8b blocks, in ascending document order.

A block is one row of a Parquet file: whole documents up to about ``BLOCK_IDS`` ids, coded
as ranks in the block's own list of ids by frequency. Spark's writer commits the files, so
a lost executor leaves no half-written shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_path
from . import simple8b
from .common import documents, map_arrow, whole_text
from .vocabulary import ByteLevelCodec, opened

END_ID = 2
BLOCK_IDS = 1 << 18
# Up to here ids are counted by value, beyond by sorting.
COUNTED_IDS = 1 << 20

BLOCK = ("shard int, block int, ids_before bigint, n_ids bigint, doc_ids array<bigint>, doc_lengths array<bigint>, "
         "ranks binary, strips binary, words binary, escapes binary")


def _by_frequency(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, most frequent first, and the rank of every id."""
    if len(ids) and int(ids.max()) < COUNTED_IDS:
        counts = np.bincount(ids)
        table = np.flatnonzero(counts)
        table = table[np.argsort(-counts[table], kind="stable")]
        rank = np.zeros(len(counts), np.uint32)
        rank[table] = np.arange(len(table))
        return table.astype(np.uint64), rank[ids]
    table, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.uint64)
    rank[order] = np.arange(len(order))
    return table[order].astype(np.uint64), rank[inverse]


def blocks_of(ids: np.ndarray, lengths: np.ndarray) -> list[dict]:
    """Blocks of whole documents for consecutive ids and the documents' lengths."""
    totals = np.cumsum(lengths)
    group = (totals - lengths) // BLOCK_IDS
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(lengths)]])
    edges = np.concatenate([[0], totals])
    tables, ranks = [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        table, rank = _by_frequency(ids[edges[a]:edges[b]])
        tables.append(table)
        ranks.append(rank.astype(np.uint64))
    sizes = edges[cuts[1:]] - edges[cuts[:-1]]
    words, strips, per_block, escapes = simple8b.encode(np.concatenate(ranks), sizes)
    n_strips = -(-sizes // simple8b.STRIP)
    word_edges = np.concatenate([[0], np.cumsum(per_block)])
    strip_edges = np.concatenate([[0], np.cumsum(n_strips)])
    return [{
        "documents": (int(cuts[k]), int(cuts[k + 1])), "n_ids": int(sizes[k]),
        "ranks": tables[k].astype("<u8").tobytes(),
        "strips": strips[strip_edges[k]:strip_edges[k + 1]].astype("<u4").tobytes(),
        "words": words[word_edges[k]:word_edges[k + 1]].astype("<u8").tobytes(),
        "escapes": escapes[k].astype("<u8").tobytes()} for k in range(len(sizes))]


def ids_of(block: dict) -> np.ndarray:
    """The ids of one block row."""
    ranks = simple8b.decode(np.frombuffer(block["words"], "<u8"), np.frombuffer(block["escapes"], "<u8"))
    return np.frombuffer(block["ranks"], "<u8")[ranks.astype(np.int64)]


def encoded(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Block rows of ``doc_id`` and ``text``, shards and rows in ascending ``doc_id`` order.

    A null text counts as empty; rows that repeat a ``doc_id`` stand side by side, ordered
    by text, a null ``doc_id`` first. Other columns are not read. No rows give no blocks.
    """
    rows = (docs.select("doc_id", whole_text().alias("text"))
            .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))

    def work(batches):
        codec = opened(ByteLevelCodec, path)
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, counts = codec.encode(batch.column("text"))
            lengths = counts + 1
            ids = np.full(int(lengths.sum()), end_id, np.uint64)
            ends = np.cumsum(lengths) - 1
            inner = np.ones(len(ids), bool)
            inner[ends] = False
            ids[inner] = flat
            numbers = batch.column("doc_id")
            for made in blocks_of(ids, lengths):
                a, b = made.pop("documents")
                yield {k: [v] for k, v in made.items()} | {
                    "shard": [shard], "block": [block], "ids_before": [before],
                    "doc_ids": [numbers.slice(a, b - a).to_pylist()], "doc_lengths": [lengths[a:b].tolist()]}
                block += 1
                before += made["n_ids"]

    return map_arrow(rows, BLOCK, work)


def write(docs: DataFrame, path: str, folder: str) -> None:
    encoded(docs, path).write.mode("errorifexists").option("compression", "none").parquet(folder)


def read(blocks: DataFrame) -> DataFrame:
    """Per document of block rows: place, number of ids and their checksum."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shard, so this window holds no more rows than there are files.
    starts = totals.select("shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shard_start"))

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = ids_of(row).astype("<u4")
                lengths = np.array(row["doc_lengths"], np.int64)
                edges = np.concatenate([[0], np.cumsum(lengths)])
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(edges[:-1], edges[1:])]
                yield {"doc_id": pa.array(row["doc_ids"], pa.int64()), "shard": np.full(len(lengths), row["shard"]),
                       "within": row["ids_before"] + edges[:-1], "n_tokens": lengths, "ids_crc32": sums}

    rows = map_arrow(blocks, "doc_id bigint, shard int, within bigint, n_tokens bigint, ids_crc32 bigint", work)
    return rows.join(starts, "shard").select(
        "doc_id", (F.col("_shard_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_files(spark, sf_dir):
    docs = documents(spark, sf_dir)
    folder = fresh_path(spark, "token-files")
    write(docs, public_tokenizers.path("byte_bpe_50k.json"), folder)
    # A block row is large once it is decoded: a few at a time.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    return read(spark.read.parquet(folder))
