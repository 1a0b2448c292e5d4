"""Byte-level BPE by a rank file: long texts in overlapping chunks, and back to bytes.

A text of up to ``CHUNK_BYTES`` is encoded as it stands. A longer one is cut into chunks that
reach ``OVERLAP_BYTES`` into the next. All chunks are pre-tokenised in parallel, each from its
own first character, which need not begin a pre-token. As a match depends only on what follows
it, two chunks that share one boundary agree from there on: the first such boundary in their
overlap is where they are stitched. The pieces between stitches are encoded in parallel too,
and decoding joins the bytes of the ids.

A boundary serves only where the character before it is no white space, as the pattern looks
ahead from white space alone. A chunk's later boundaries are those of the text if it was
stitched to a chunk of which that holds, or once it has met a change from other characters to
white space, which always is a boundary. Chunks between which no boundary serves (one word or
one run of white space longer than the overlap) are encoded together.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, map_arrow, staged, whole_text
from .vocabulary import opened

CHUNK_BYTES = 1 << 16
OVERLAP_BYTES = 1 << 10

# The library's matcher fails on runs of white space of some hundred thousand characters.
_LONG_RUN = 50_000
_BLANK = regex.compile(r"\s")
_SURE = regex.compile(r"\S\s")


class RankCodec:
    """Ids by the ranks of a file, each match of the public pattern separately."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        # The same merges over a whole text taken as one match.
        self.single = tiktoken.Encoding("single", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.long_run = regex.compile(rf"\s{{{_LONG_RUN}}}")
        self.token_bytes = {rank: token for token, rank in ranks.items()}

    def encode(self, text: str) -> list[int]:
        if len(text) < _LONG_RUN or not self.long_run.search(text):
            return self.encoding.encode_ordinary(text)
        return [i for match in self.pattern.finditer(text) for i in self.single.encode_ordinary(match[0])]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def boundaries(self, text: str) -> list[int]:
        """Where pre-tokens begin or end with no white space before, and the text's own start."""
        ends = [match.end() for match in self.pattern.finditer(text)]
        return [0, *(e for e in ends if e < len(text) and not _BLANK.match(text, e - 1))]


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.array(ids, "<u4").tobytes()


def unpacked(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def _aligned(data: bytes, at: int) -> int:
    """The first place from ``at`` on where a character of UTF-8 begins."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(data))


def cut(data: bytes, chunk_bytes: int, overlap: int) -> list[tuple[int, int, int]]:
    """Start of each chunk, start of the next, and end with the overlap."""
    starts = [_aligned(data, a) for a in range(0, max(len(data), 1), chunk_bytes)]
    starts = [a for k, a in enumerate(starts) if not k or starts[k - 1] < a < len(data)]
    nexts = [*starts[1:], len(data)]
    return [(a, b, _aligned(data, b + overlap)) for a, b in zip(starts, nexts)]


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", whole_text().alias("text"))


CHUNK = "row bigint, doc_id bigint, chunk int, start bigint, next bigint, data binary"
TOKENISED = CHUNK + ", last boolean, head array<bigint>, tail array<bigint>, sure bigint"


def pretokenised(long: DataFrame, path: str, chunk_bytes: int, overlap: int) -> DataFrame:
    """Chunks of the texts with their boundaries in both overlaps, dealt over all tasks."""
    def split(batches):
        # Numbers rows within the task; the staged result fixes them.
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data = text.encode()
                for k, (a, b, end) in enumerate(cut(data, chunk_bytes, overlap)):
                    yield {"row": [number], "doc_id": [doc_id], "chunk": [k], "start": [a], "next": [b], "data": [data[a:end]]}
                number += 1

    def pretokenise(batches):
        codec = opened(RankCodec, path)
        for batch in batches:
            for row in batch.to_pylist():
                text, size, a, b = row["data"].decode(), len(row["data"]), row["start"], row["next"]
                chars = np.array(codec.boundaries(text), np.int64)
                # Only what lies in the overlaps becomes byte offsets.
                head_end = len(row["data"][:overlap + 4].decode(errors="ignore"))
                tail_start = len(text) - len(row["data"][b - a:].decode())
                head = [a + len(text[:c].encode()) for c in chars[chars <= head_end].tolist()] if row["chunk"] else []
                tail = [a + size - len(text[c:].encode()) for c in chars[chars >= tail_start].tolist()]
                sure = _SURE.search(text)
                known = 0 if not row["chunk"] else None if sure is None else a + len(text[:sure.start() + 1].encode())
                yield {k: [v] for k, v in row.items()} | {
                    "last": [a + size == b], "head": [head], "tail": [tail], "sure": [known]}

    chunks = map_arrow(long, CHUNK, split).repartition("row", "chunk")
    return staged(map_arrow(chunks, TOKENISED, pretokenise), "pretokens")


def stitches(chunks: DataFrame) -> DataFrame:
    """Per chunk the bytes ``low`` to ``high`` that are its own, and the piece they belong to.

    A window holds the chunks of one text without their bytes: a text has at most 2 GiB, which
    bounds the window whatever the table.
    """
    order = Window.partitionBy("row").orderBy("chunk")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    common = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
    met = chunks.select("row", "chunk", "start", "next", "sure", "last", common.alias("met"))
    lost = F.max(F.when(F.col("met").isNull(), F.col("chunk"))).over(so_far)
    certain = F.max(F.when(F.col("sure") <= F.col("met"), F.col("chunk"))).over(so_far)
    judged = met.withColumn("stitch", F.when(
        F.col("met").isNotNull() & (certain > F.coalesce(lost, F.lit(-1))), F.col("met")))
    before = F.lag("stitch").over(order)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    return judged.select(
        "row", "chunk", F.coalesce(before, F.col("start")).alias("low"),
        F.coalesce("stitch", "next").alias("high"),
        F.coalesce(F.count("stitch").over(earlier), F.lit(0)).cast("int").alias("piece"))


IDS = "row bigint, doc_id bigint, piece int, ids binary"


def stitched(long: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """Ids of the pieces of long texts: ``row`` (one number per text), ``doc_id``, ``piece``, ``ids``."""
    chunks = pretokenised(long, path, chunk_bytes, overlap)
    own = chunks.join(stitches(chunks), ["row", "chunk"]).select(
        "row", "doc_id", "piece", "chunk",
        F.expr("substring(data, int(low - start + 1), int(high - low))").alias("data"))
    pieces = own.repartition("row", "piece").sortWithinPartitions("row", "piece", "chunk")

    def encode(batches):
        codec = opened(RankCodec, path)
        key, doc_id, held = None, None, []

        def closed():
            ids = codec.encode(b"".join(held).decode())
            return {"row": [key[0]], "doc_id": [doc_id], "piece": [key[1]], "ids": [packed(ids)]}

        for batch in batches:
            for row in batch.to_pylist():
                if (row["row"], row["piece"]) != key:
                    if key:
                        yield closed()
                    key, doc_id, held = (row["row"], row["piece"]), row["doc_id"], []
                held.append(row["data"])
        if key:
            yield closed()

    return map_arrow(pieces, IDS, encode)


def _split(docs: DataFrame, chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    rows = rows_of(docs)
    long = F.octet_length("text") > chunk_bytes
    return rows.filter(~long), rows.filter(long)


def encoded(docs: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """``doc_id``, ``row``, ``piece`` and ``ids`` (little-endian unsigned 32-bit) of all texts.

    The ids of a text are those of its pieces in order. A short text is one piece and has a
    null ``row``; a longer one has a number of its own. Null texts count as empty and have no
    ids. Repeated rows and rows with a null id each give their own; other columns are not
    read; an empty table gives no rows.
    """
    short, long = _split(docs, chunk_bytes)

    def encode(batches):
        codec = opened(RankCodec, path)
        for batch in batches:
            n = batch.num_rows
            yield {"row": pa.nulls(n, pa.int64()), "doc_id": batch.column("doc_id"), "piece": np.zeros(n, np.int32),
                   "ids": [packed(codec.encode(t)) for t in batch.column("text").to_pylist()]}

    return map_arrow(short, IDS, encode).unionByName(stitched(long, path, chunk_bytes, overlap))


def decoded(pieces: DataFrame, path: str) -> DataFrame:
    """The pieces with ``data``, the bytes of their ids."""
    def decode(batches):
        codec = opened(RankCodec, path)
        for batch in batches:
            yield {c: batch.column(c) for c in ("row", "doc_id", "piece", "ids")} | {
                "data": [codec.decode(unpacked(x)) for x in batch.column("ids").to_pylist()]}

    return map_arrow(pieces.select("row", "doc_id", "piece", "ids"), IDS + ", data binary", decode)


DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class _Digest:
    def __init__(self):
        self.n, self.ids, self.data = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, codec: RankCodec, ids: list[int], data: bytes) -> _Digest:
        self.n += len(ids)
        self.ids.update(data)
        self.data.update(codec.decode(ids))
        return self

    def row(self, doc_id) -> dict:
        return {"doc_id": [doc_id], "n_tokens": [self.n], "ids_sha256": [self.ids.hexdigest()],
                "decoded_sha256": [self.data.hexdigest()]}


def digests(docs: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """Per row the number of ids, and the digests of the ids and of the bytes they decode to.

    Edge cases are those of ``encoded``. The ids of a long text pass through one task in
    order, a piece at a time, as its digest asks.
    """
    short, long = _split(docs, chunk_bytes)

    def whole(batches) -> Iterator[dict]:
        codec = opened(RankCodec, path)
        for batch in batches:
            made = []
            for text in batch.column("text").to_pylist():
                ids = codec.encode(text)
                made.append(_Digest().add(codec, ids, packed(ids)))
            yield {"doc_id": batch.column("doc_id"), "n_tokens": np.array([d.n for d in made], np.int64),
                   "ids_sha256": [d.ids.hexdigest() for d in made], "decoded_sha256": [d.data.hexdigest() for d in made]}

    def in_order(batches) -> Iterator[dict]:
        codec = opened(RankCodec, path)
        key, doc_id, digest = None, None, _Digest()
        for batch in batches:
            for row in batch.to_pylist():
                if row["row"] != key:
                    if key is not None:
                        yield digest.row(doc_id)
                    key, doc_id, digest = row["row"], row["doc_id"], _Digest()
                digest.add(codec, unpacked(row["ids"]), row["ids"])
        if key is not None:
            yield digest.row(doc_id)

    pieces = stitched(long, path, chunk_bytes, overlap).repartition("row").sortWithinPartitions("row", "piece")
    return map_arrow(short, DIGEST, whole).unionByName(map_arrow(pieces, DIGEST, in_order))


def op11_byte_bpe(spark, sf_dir):
    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
