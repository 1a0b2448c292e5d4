"""Repeated byte strings across documents, by difference-cover samples and suffix buckets.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts earlier. Suffixes
need to be told apart to that depth only, and suffixes equal to it are ranked by position.

Positions (from their document's start) whose remainder lies in a difference cover are
samples: for any two positions there is a shift below the period that makes both samples.
So if two strings are equal, a sample inside one equals a sample inside the other, to the
depth that is left after the largest shift. A first job ranks the samples alone, bucket by
bucket, and keeps those whose class has two members. A second job takes only the suffixes
that start at most one period before such a sample, deals them into buckets, and sorts one
bucket at a time by fingerprint, ties by document and position: all but the first of a
class are repeats. A third cuts the bytes that repeats cover.

Classes of samples and suffixes are fingerprints of their bytes: the samples' only narrow
the second job (a false match costs time), the suffixes' are of 64 bits beside the bits
that choose the bucket, from independent polynomials.

What one batch of documents holds twice is settled inside it, and one copy dealt on: a
string held by very many documents reaches its bucket once per batch. Documents that equal
an earlier one as a whole are known from their digests beforehand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_arrow, shuffle_parts, staged, whole_text
from .vocabulary import parts_by_bytes, spread

LENGTH = 100
# A perfect difference set, every remainder but 0 being one difference of two.
PERIOD = 57
COVER = np.array([0, 1, 3, 13, 32, 36, 43, 52])
DEPTH = LENGTH - PERIOD + 1

# Bytes of text a bucket of documents should hold, and those hashed at a time.
BUCKET_BYTES = 16 << 20
HASHED_BYTES = 1 << 20
BATCH_BYTES = 8 << 20

NO_ID = np.iinfo(np.int64).min
ROW = "t int, kind int, doc_id bigint, text string, payload binary"
PACKED = "t int, payload binary"

_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_TABLES = (_table(1), _table(2))
_MASK = (1 << 64) - 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def window_hashes(data: np.ndarray, width: int, which: int) -> np.ndarray:
    """Fingerprint of the ``width`` bytes from each place on, by doubling known widths."""
    base, table = _BASES[which], _TABLES[which]
    out = np.zeros(max(0, len(data) - width + 1), np.uint64)
    for a in range(0, len(out), HASHED_BYTES):
        part = data[a:a + HASHED_BYTES + width - 1]
        size, power, whole, done = 1, table[part], None, 0
        rest = width
        while True:
            if rest & 1:
                if whole is None:
                    whole, done = power, size
                else:
                    n = len(whole) - size
                    whole = whole[:n + 0] * np.uint64(pow(base, size, 1 << 64)) + power[done:done + n]
                    done += size
            rest >>= 1
            if not rest:
                break
            power = power[:len(power) - size] * np.uint64(pow(base, size, 1 << 64)) + power[size:]
            size *= 2
        whole = whole[:len(part) - width + 1]
        out[a:a + len(whole)] = whole
    return _mixed(out)


def laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts one after another, and their edges."""
    joined = pa.concat_arrays([texts.cast(pa.binary())])
    _, offsets, data = joined.buffers()
    edges = np.frombuffer(offsets, np.int32)[joined.offset:joined.offset + len(joined) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[edges[0]:edges[-1]], edges - edges[0]


# Entries of documents and places, packed for a bucket.

def _planes(values: np.ndarray) -> bytes:
    """Little-endian bytes by plane: the high planes of small numbers are zeros."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def packed(tags: dict, docs: np.ndarray, places: np.ndarray, extra: np.ndarray) -> bytes:
    """Entries in order of document and place: per document its tags and count, per entry its
    place as the difference from the one before, and an extra number (of one width)."""
    first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, int)
    count = np.diff(np.append(first, len(docs)))
    steps = places.astype(np.int64)
    steps[1:] -= places[:-1]
    steps[first] = places[first]
    parts = [np.ascontiguousarray(tags[c][docs[first]]).tobytes() for c in ("id", "k", "t")]
    parts += [count.astype(np.uint32).tobytes(), _planes(steps.astype(np.uint64)), np.ascontiguousarray(extra).tobytes()]
    head = np.array([len(p) for p in parts], np.int64)
    return head.tobytes() + b"".join(parts)


def unpacked(data: bytes, extra_kind: type) -> dict[str, np.ndarray]:
    head = np.frombuffer(data[:48], np.int64)
    cuts = np.concatenate([[48], 48 + np.cumsum(head)])
    ids, ks, ts, count, steps, extra = (data[a:b] for a, b in zip(cuts[:-1], cuts[1:]))
    count = np.frombuffer(count, np.uint32).astype(np.int64)
    steps = _from_planes(steps, np.uint64).astype(np.int64)
    sums = np.cumsum(steps)
    first = np.cumsum(count) - count
    before = np.where(first > 0, sums[np.maximum(first - 1, 0)], 0) if len(first) else first
    return {"id": np.frombuffer(ids, np.int64), "k": np.frombuffer(ks, np.int64), "t": np.frombuffer(ts, np.int64),
            "count": count, "place": sums - np.repeat(before, count), "extra": np.frombuffer(extra, extra_kind)}


def _gathered(blobs: list[bytes], kind: type) -> dict[str, np.ndarray] | None:
    """Entries of many blobs in order of id, row of the id, and place. Empties the list."""
    if not blobs:
        return None
    each = []
    while blobs:
        each.append(unpacked(blobs.pop(0), kind))
        each[-1]["place"] = each[-1]["place"].astype(np.int32)
    merged = {c: np.concatenate([e.pop(c) for e in each]) for c in list(each[0])}
    order = np.lexsort((merged["k"], merged["id"]))
    starts = np.cumsum(merged["count"]) - merged["count"]
    count = merged["count"][order]
    out = {c: merged[c][order] for c in ("id", "k", "t")}
    new = np.ones(len(order), bool)
    new[1:] = (out["id"][1:] != out["id"][:-1]) | (out["k"][1:] != out["k"][:-1])
    rows = spread(starts[order], count)
    place, extra = merged.pop("place")[rows], merged.pop("extra")[rows]
    del rows
    doc = np.repeat((np.cumsum(new) - 1).astype(np.int32), count)
    # A document mostly comes in one blob, and its places in their order.
    if ((doc[1:] == doc[:-1]) & (place[1:] < place[:-1])).any():
        by = np.lexsort((place, doc))
        doc, place, extra = doc[by], place[by], extra[by]
    return {c: out[c][new] for c in ("id", "k", "t")} | {"doc": doc, "place": place, "extra": extra}


# Walking over documents with what belongs to their bucket.

class Bucket:
    """What was sent to the documents of one bucket: whole copies, and places per document."""

    def __init__(self):
        self.copies: dict[int, set[bytes]] = {}
        self.blobs: list[bytes] = []
        self.places: dict[tuple[int, int], np.ndarray] | None = None

    def are_copies(self, ids: np.ndarray, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Which documents equal an earlier one as a whole (rows of one id are told apart by digest)."""
        out = np.zeros(len(ids), bool)
        for d, number in enumerate(ids.tolist()):
            if number in self.copies:
                out[d] = hashlib.sha256(data[edges[d]:edges[d + 1]]).digest() in self.copies[number]
        return out

    def of(self, number: int, k: int) -> np.ndarray | None:
        if self.places is None:
            found = _gathered(self.blobs, np.uint8)
            self.places, self.blobs = {}, []
            if found:
                edges = np.searchsorted(found["doc"], np.arange(len(found["id"]) + 1))
                self.places = {(i, r): found["place"][a:b] for i, r, a, b in zip(
                    found["id"].tolist(), found["k"].tolist(), edges[:-1], edges[1:])}
        return self.places.get((number, k))


def walked(batches) -> Iterator[tuple[int, Bucket, np.ndarray, np.ndarray, pa.Array]]:
    """Runs of documents of one bucket: bucket number and content, ids, row of each id, texts."""
    bucket, current, last, k = Bucket(), None, None, 0
    for batch in batches:
        ts = batch.column("t").to_numpy()
        kinds = batch.column("kind").to_numpy()
        cuts = np.flatnonzero((ts[1:] != ts[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ts)]):
            if a == b:
                continue
            if ts[a] != current:
                bucket, current, last, k = Bucket(), ts[a], None, 0
            ids = batch.column("doc_id").slice(a, b - a)
            if not kinds[a]:
                payloads = batch.column("payload").slice(a, b - a)
                for number, payload in zip(ids.to_pylist(), payloads.to_pylist()):
                    if number is not None:
                        bucket.copies.setdefault(number, set()).add(payload)
                    else:
                        bucket.blobs.append(payload)
                continue
            numbers = ids.fill_null(NO_ID).to_numpy()
            rows = np.zeros(b - a, np.int64)
            for i, number in enumerate(numbers.tolist()):
                k = k + 1 if number == last else 0
                last, rows[i] = number, k
            texts = batch.column("text").slice(a, b - a)
            for x, y in parts_by_bytes(texts, BATCH_BYTES):
                yield int(current), bucket, numbers[x:y], rows[x:y], texts.slice(x, y - x)


def _bucketed(docs: DataFrame, buckets: int, side: DataFrame) -> DataFrame:
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    none = F.lit(None).cast("binary")
    rows = docs.select(bucket.alias("t"), F.lit(1).alias("kind"), "doc_id", "text", none.alias("payload"))
    return (rows.unionByName(side.select("t", F.lit(0).alias("kind"), "doc_id", F.lit(None).cast("string").alias("text"), "payload"))
            .repartition(buckets, "t").sortWithinPartitions("t", "kind", "doc_id", "text"))


def _blobs(df: DataFrame) -> DataFrame:
    return df.select("t", F.lit(None).cast("bigint").alias("doc_id"), "payload")


def _copies(docs: DataFrame, buckets: int) -> DataFrame:
    """Documents that equal one of a smaller id as a whole."""
    keyed = docs.filter("doc_id IS NOT NULL").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    light = staged(keyed, "digests")
    first = light.groupBy("sha").agg(F.min("doc_id").alias("first"))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    return staged(light.join(first, "sha").filter("doc_id > first").select(
        bucket.alias("t"), "doc_id", F.unhex("sha").alias("payload")).distinct(), "copies")


def _first_mask(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which places hold the first of equal keys, and which keys occur again."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    again = np.zeros(len(keys), bool)
    again[:-1] = ~new[1:]
    first, repeated = np.empty(len(keys), bool), np.empty(len(keys), bool)
    first[order] = new
    repeated[order] = again | ~new
    return first, repeated


def _sent(tags: dict, docs: np.ndarray, places: np.ndarray, part: np.ndarray, extra: np.ndarray, parts: int):
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)).tolist():
        rows = order[edges[p]:edges[p + 1]]
        yield {"t": [p], "payload": [packed(tags, docs[rows], places[rows], extra[rows])]}


def _back(tags: dict, docs: np.ndarray, places: np.ndarray) -> Iterator[dict]:
    """Places on their way to their documents' buckets; sent rows of settled places are below 0."""
    if not len(docs):
        return
    targets = tags["t"][docs]
    order = np.argsort(targets, kind="stable")
    docs, places, targets = docs[order], places[order], targets[order]
    cuts = np.flatnonzero(targets[1:] != targets[:-1]) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(docs)]):
        yield {"t": [-1 - int(targets[a])], "payload": [packed(tags, docs[a:b], places[a:b], np.zeros(b - a, np.uint8))]}


def _through(df: DataFrame, parts: int, kind: type, decide) -> DataFrame:
    """Deal packed entries to their partition, decide there, and send places to their documents.

    Rows with a number below 0 are settled already and spread over all partitions.
    """
    def work(batches):
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for t, payload in zip(batch.column("t").to_pylist(), batch.column("payload").to_pylist()):
                if t < 0:
                    yield {"t": [-1 - t], "payload": [payload]}
                else:
                    held.setdefault(t, []).append(payload)
        while held:
            found = _gathered(held.popitem()[1], kind)
            chosen = decide(found.pop("extra"))
            for row in _back(found, found["doc"][chosen], found["place"][chosen]):
                yield {"t": [-1 - row["t"][0]], "payload": row["payload"]}

    return map_arrow(df.repartition(parts, "t"), PACKED, work)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _places(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and place of every byte; a text has fewer than 2^31 bytes, so small numbers do."""
    doc = np.repeat(np.arange(len(edges) - 1, dtype=np.int32), np.diff(edges))
    place = np.arange(edges[-1], dtype=np.int32)
    place -= edges[:-1].astype(np.int32)[doc]
    return doc, place


def _tags(t: int, ids: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
    return {"id": ids, "k": rows, "t": np.full(len(ids), t, np.int64)}


def repeated_samples(docs: DataFrame, buckets: int, parts: int, copies: DataFrame) -> DataFrame:
    """Cover samples whose first ``DEPTH`` bytes occur at another sample, by document."""
    def work(batches):
        for t, bucket, ids, rows, texts in walked(batches):
            data, edges = laid_out(texts)
            sizes = np.diff(edges)
            real = ~bucket.are_copies(ids, data, edges) & (sizes >= LENGTH)
            doc, place = _places(edges)
            at = np.flatnonzero(_IN_COVER[place % PERIOD] & (place <= (sizes - DEPTH).astype(np.int32)[doc]) & real[doc])
            if not len(at):
                continue
            keys = window_hashes(data, DEPTH, 0)[at]
            doc, place = doc[at], place[at]
            tags = _tags(t, ids, rows)
            first, again = _first_mask(keys)
            yield from _back(tags, doc[again], place[again])
            keys, doc, place = keys[first], doc[first], place[first]
            del first, again, at
            yield from _sent(tags, doc, place, _part(keys, parts), keys.astype(np.uint32), parts)

    signed = map_arrow(_bucketed(docs, buckets, copies), PACKED, work)
    return staged(_through(signed, parts, np.uint32, lambda keys: _first_mask(keys)[1]), "samples")


def repeated_suffixes(docs: DataFrame, buckets: int, parts: int, copies: DataFrame, samples: DataFrame) -> DataFrame:
    """Places whose ``LENGTH`` bytes also start earlier, by document."""
    def work(batches):
        for t, bucket, ids, rows, texts in walked(batches):
            flags = [bucket.of(i, k) for i, k in zip(ids.tolist(), rows.tolist())]
            kept = np.flatnonzero([f is not None for f in flags])
            if not len(kept):
                continue
            data, edges = laid_out(texts.take(pa.array(kept)))
            sizes = np.diff(edges)
            near = np.zeros(len(data) + 1, np.int32)
            for d, i in enumerate(kept.tolist()):
                np.add.at(near, edges[d] + np.maximum(flags[i] - PERIOD + 1, 0), 1)
                np.add.at(near, edges[d] + flags[i] + 1, -1)
            doc, place = _places(edges)
            at = np.flatnonzero((np.cumsum(near[:-1], dtype=np.int32) > 0) & (place <= (sizes - LENGTH).astype(np.int32)[doc]))
            del near
            if not len(at):
                continue
            keys, part = window_hashes(data, LENGTH, 0)[at], _part(window_hashes(data, LENGTH, 1)[at], parts)
            doc, place = doc[at], place[at]
            del at
            tags = _tags(t, ids[kept], rows[kept])
            first, _ = _first_mask(keys)
            yield from _back(tags, doc[~first], place[~first])
            keys, doc, place, part = keys[first], doc[first], place[first], part[first]
            del first
            yield from _sent(tags, doc, place, part, keys, parts)

    signed = map_arrow(_bucketed(docs, buckets, copies.unionByName(_blobs(samples))), PACKED, work)
    return staged(_through(signed, parts, np.uint64, lambda keys: ~_first_mask(keys)[0]), "suffixes")


CUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_bytes binary"


def cut(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """Every document without the bytes that a string of ``LENGTH`` bytes from earlier covers.

    A null text counts as empty. Order is by ``doc_id`` (a null one first), rows of one id by
    text; equal rows count one after the other. ``kept_bytes`` may cut a character in two,
    so it is binary. Only ``doc_id`` and ``text`` are read; an empty table gives no rows.
    """
    docs = docs.select("doc_id", whole_text().alias("text"))
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_parts(spark), total // BUCKET_BYTES + 1)
    copies = _copies(docs, buckets)
    samples = repeated_samples(docs, buckets, buckets, copies)
    suffixes = repeated_suffixes(docs, buckets, buckets, copies, samples)

    def work(batches):
        for _, bucket, ids, rows, texts in walked(batches):
            out = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes")}
            data, edges = laid_out(texts)
            copies = bucket.are_copies(ids, data, edges)
            for d, (number, k) in enumerate(zip(ids.tolist(), rows.tolist())):
                mine = data[edges[d]:edges[d + 1]]
                places = bucket.of(number, k)
                removed = spans = 0
                if copies[d] and len(mine) >= LENGTH:
                    removed, spans, mine = len(mine), 1, mine[:0]
                elif places is not None:
                    steps = np.zeros(len(mine) + 1, np.int32)
                    np.add.at(steps, places, 1)
                    np.add.at(steps, places + LENGTH, -1)
                    gone = np.cumsum(steps[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    mine = mine[~gone]
                kept = mine.tobytes()
                for c, v in zip(out, (None if number == NO_ID else number, int(edges[d + 1] - edges[d]), removed, spans,
                                      hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None)):
                    out[c].append(v)
            yield out

    return map_arrow(_bucketed(docs, buckets, copies.unionByName(_blobs(suffixes))), CUT, work)


def op8_suffix_dedup(spark, sf_dir):
    return cut(documents(spark, sf_dir), keep_bytes=False).drop("kept_bytes")
