"""Near duplicates by word shingles: exact Jaccard join by universe partition.

The universe of shingle hashes is cut into segments, more for larger sets. Two sets within
the wanted similarity differ in at most H shingles, so among any H + 1 segments one is equal
in both. A set therefore publishes signatures (hashes of its shingles in one segment) until
H + 1 segments worth publishing are out, and sets that share a signature are compared.

Which segments are worth it is a matter of cost, by content alone, so that two sets decide
alike on an equal segment: best those with two shingles that are rare in the corpus, else
those with one, else all that are not empty. Sets too small for H + 1 such segments add
the one-deletion neighbourhoods of their first segments, which count double. A set that
needs a cheaper rule publishes all its segments by that rule, so every stricter set finds
it.

Only enough pairs are verified to settle who is connected: first each bucket's smallest
member against the others, then pairs of the buckets whose members are still apart, first a
few for each member, and at last all that are left. Those pairs are gone through in blocks
of a bounded number of members and dropped where the parity bitmaps of the two sets differ
in more bits than linked sets may differ in shingles. A pair lies in many buckets, often
hundreds, but is given in one: the largest that both members name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_arrow, shuffle_parts, staged, whole_text
from .components import components
from .vocabulary import distinct, parts_by_bytes

WORDS = 5
# Similarity as a ratio of whole numbers: 100 * common >= 80 * united.
NEED, OF = 80, 100

# Average shingles in a segment of the largest set of a size window.
PER_SEGMENT = 2.5
# A shingle in more than this share of the documents (and so many at least) is frequent.
FREQUENT_SHARE, FREQUENT_LEAST = 0.001, 20
# Signatures collected before they are dealt out, and those one shuffle partition should hold.
FLUSH = 500_000
PER_PARTITION = 500_000
# Bytes of text whose shingles are held at a time.
SHINGLED_BYTES = 2 << 20
# Copies of a signature within one flush beyond which only the smallest id is dealt out.
LOCAL_GROUP = 8
# Bits of a set's parity bitmap, and members of a bucket compared in one block.
BITMAP_BITS = 1024
BLOCK_MEMBERS = 2048
# Largest buckets that a member names.
NAMED = 16

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _Q
    h = (h ^ (h >> np.uint64(29))) * _P
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of the texts, one after another, and their numbers.

    With fewer words than a shingle has, the whole sequence is one; no words give no shingle.
    """
    words, index, edges = distinct(pc.ascii_split_whitespace(pc.ascii_lower(texts)))
    listed = words.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, (w.encode() for w in listed)), np.uint64, len(listed))
    real = np.fromiter(map(bool, listed), bool, len(listed))
    row = np.repeat(np.arange(len(texts)), np.diff(edges))
    kept = real[index] if len(listed) else np.zeros(0, bool)
    value, row = hashes[index[kept]] if len(listed) else np.zeros(0, np.uint64), row[kept]
    counts = np.bincount(row, minlength=len(texts))
    ends = np.cumsum(counts)
    rolled = np.zeros(len(value), np.uint64)
    left = (ends[row] if len(row) else row) - np.arange(len(value))
    for k in range(WORDS):
        ahead = np.zeros(len(value), np.uint64)
        ahead[:max(0, len(value) - k)] = value[k:]
        rolled = np.where(left > k, rolled * _P + ahead + np.uint64(1), rolled)
    starts = ends - counts
    keep = left >= WORDS
    short = (counts > 0) & (counts < WORDS)
    keep[starts[short]] = True
    rolled[starts[short]] += counts[short].astype(np.uint64) * _Q
    rolled, row = mixed(rolled[keep]), row[keep]
    each = np.bincount(row, minlength=len(texts))
    ends = np.cumsum(each)
    for a, b in zip((ends - each).tolist(), ends.tolist()):
        rolled[a:b].sort()
    fresh = np.ones(len(rolled), bool)
    fresh[1:] = (rolled[1:] != rolled[:-1]) | (row[1:] != row[:-1])
    return rolled[fresh], np.bincount(row[fresh], minlength=len(texts))


def band_starts(most: int) -> np.ndarray:
    """Smallest size of each band: a set's partners lie in its own band or one beside it."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(starts[-1] * OF // NEED + 1)
    return np.array([*starts, starts[-1] * OF // NEED + 1, starts[-1] * 2], np.int64)


def most_differences(sizes: np.ndarray) -> np.ndarray:
    """H: shingles in which a set of this size may differ from a linked one at least as large."""
    largest = sizes * OF // NEED
    return (sizes + largest) * (OF - NEED) // (OF + NEED)


def _first_segments(values: np.ndarray, sizes: np.ndarray, window: np.ndarray, starts: np.ndarray,
                    frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets in the given size windows, and the set of each."""
    # A window joins two bands; its segments suit the largest set in it.
    top = starts[window + 2] - 1
    segments = np.maximum(np.ceil(top / PER_SEGMENT), most_differences(top) + 1).astype(np.int64)
    need = most_differences(sizes) + 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # Hashes ascend, so a set's segments are runs.
    segment = ((values >> np.uint64(32)) * segments[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    new = np.ones(len(values), bool)
    new[1:] = (segment[1:] != segment[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    content = np.add.reduceat(mixed(values * _Q + np.uint64(7)), first)
    rare = ~np.isin(values, frequent) if len(frequent) else np.ones(len(values), bool)
    n_rare = np.add.reduceat(rare.astype(np.int64), first)
    seg_owner, seg = owner[first], segment[first]
    place = mixed(window[seg_owner].astype(np.uint64) * _P + seg.astype(np.uint64) * _Q + np.uint64(3))
    signature = mixed(content ^ place)
    chosen = np.zeros(len(first), bool)
    settled = np.zeros(len(sizes), bool)
    for least, all_of_them in ((2, False), (1, True)):
        good = n_rare >= least
        so_far = np.cumsum(good)
        before = np.concatenate([[0], so_far])[np.searchsorted(seg_owner, np.arange(len(sizes)))]
        enough = np.bincount(seg_owner, good, len(sizes)).astype(np.int64) >= need
        take = enough & ~settled
        within = so_far - before[seg_owner] <= need[seg_owner]
        chosen |= take[seg_owner] & good & (within | all_of_them)
        settled |= enough
    chosen |= ~settled[seg_owner]
    out, out_owner = [signature[chosen]], [seg_owner[chosen]]
    # Sets with too few segments: deletion neighbourhoods of their first ones.
    short = need - np.bincount(seg_owner, minlength=len(sizes))
    for s in np.flatnonzero(~settled & (short > 0)).tolist():
        a, b = np.searchsorted(owner, [s, s + 1])
        for number in range(min(int(short[s]), int(segments[s]))):
            inside = values[a:b][segment[a:b] == number]
            parts = mixed(inside * _Q + np.uint64(7))
            total = np.array([parts.sum(dtype=np.uint64)], np.uint64)
            here = mixed(np.array([int(window[s]) * int(_P) + number * int(_Q) + 5 & (1 << 64) - 1], np.uint64))
            both = mixed(np.concatenate([total, total - parts]) ^ here)
            out.append(both)
            out_owner.append(np.full(len(both), s, np.int64))
    return np.concatenate(out), np.concatenate(out_owner)


def signatures(values: np.ndarray, sizes: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets (sorted hashes one after another) in both their windows, with the set of each."""
    starts = band_starts(int(sizes.max()) if len(sizes) else 1)
    real = np.flatnonzero(sizes)
    band = np.searchsorted(starts, sizes[real], side="right") - 1
    found = [_first_segments(values, sizes[real], window, starts, frequent)
             for window in (band + 0, band - 1)]
    return np.concatenate([f[0] for f in found]), real[np.concatenate([f[1] for f in found])]


# Tables of the first job: documents, links already certain, pairs to verify (packed, with the
# number of the part they go to), and members of signatures with three or more.
DOC, LINK, PAIR, MEMBER = 0, 1, 2, 3
FOUND = "kind tinyint, a bigint, b bigint, bits binary"


def _rows(kind: int, a: np.ndarray, b: np.ndarray, bits: np.ndarray | None = None) -> dict:
    return {"kind": np.full(len(a), kind, np.int8), "a": np.asarray(a, np.int64), "b": np.asarray(b, np.int64),
            "bits": pa.nulls(len(a), pa.binary()) if bits is None else [x.tobytes() for x in bits]}


def _dealt_pairs(rows: dict, parts: int) -> dict:
    """Pairs packed by the part that will drop those found under several signatures."""
    both = np.stack([rows["a"], rows["b"]], 1)
    part = (mixed(both[:, 0].astype(np.uint64) * _P ^ both[:, 1].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    both, edges = both[order], np.searchsorted(part[order], np.arange(parts + 1))
    used = np.flatnonzero(np.diff(edges))
    return {"kind": np.full(len(used), PAIR, np.int8), "a": used, "b": np.diff(edges)[used],
            "bits": [both[edges[p]:edges[p + 1]].tobytes() for p in used.tolist()]}


def distinct_pairs(found: DataFrame) -> DataFrame:
    """The packed pairs of ``found``, each once. Equal pairs lie in one part."""
    def work(batches):
        held, part = [], None

        def closed():
            both = np.unique(np.frombuffer(b"".join(held), np.int64).reshape(-1, 2), axis=0)
            return {"a": both[:, 0], "b": both[:, 1]}

        for batch in batches:
            for number, packed in zip(batch.column("a").to_pylist(), batch.column("bits").to_pylist()):
                if number != part and held:
                    yield closed()
                    held.clear()
                part = number
                held.append(packed)
        if held:
            yield closed()

    packed = found.filter(F.col("kind") == PAIR).select("a", "bits")
    return map_arrow(packed.repartition("a").sortWithinPartitions("a"), "a bigint, b bigint", work)


def bitmaps(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per set the parity of its shingles in each of the bitmap's places: two sets that differ
    in D shingles differ in at most D bits."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = (values & np.uint64(BITMAP_BITS - 1)).astype(np.int64)
    odd = np.bincount(owner * BITMAP_BITS + place, minlength=len(sizes) * BITMAP_BITS) & 1
    return np.packbits(odd.astype(bool).reshape(len(sizes), BITMAP_BITS), axis=1)


def _groups(sig: np.ndarray, ids: np.ndarray, sizes: np.ndarray, local: np.ndarray,
            fold: bool) -> Iterator[dict]:
    """Pairs with the smallest member of each signature, and members of the larger groups.

    ``local`` marks ids that stand for more of the same flush. With ``fold``, groups of the
    same members (and none that is local) are given once. An id may have rows of several
    texts: its pairs are given if any two sizes between the smallest and largest allow it.
    """
    order = np.lexsort((sizes, ids, sig))
    sig, ids, sizes, local = sig[order], ids[order], sizes[order], local[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
    if not len(sig):
        return
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(sig)) - 1
    keep_local = np.maximum.reduceat(local, starts)
    # For groups of the same members, an id with other sizes is another member.
    sig, ids, least, most, local = sig[new], ids[new], sizes[starts], sizes[ends], keep_local
    members = mixed(mixed(mixed(ids.astype(np.uint64)) + least.astype(np.uint64)) + most.astype(np.uint64))
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(sig)))
    lead = np.repeat(at, count)
    many = np.repeat(count, count) >= 2
    # What a flush holds of a signature may meet more elsewhere.
    wide = np.repeat(count >= (3 if fold else 2), count)
    any_local = np.maximum.reduceat(local, at)
    if fold:
        mark = np.add.reduceat(members, at) + count.astype(np.uint64)
        mark = np.where(any_local, sig[at], mark)
        _, once = np.unique(mark, return_index=True)
        kept = np.zeros(len(at), bool)
        kept[once] = True
        kept = np.repeat(kept, count)
        many, wide = many & kept, wide & kept
    wide |= np.repeat(any_local, count)
    a, b = ids[lead], ids
    small, large = np.minimum(most[lead], most), np.maximum(least[lead], least)
    pair = many & ~first & (OF * small >= NEED * large)
    both = np.unique(np.stack([a[pair], b[pair]], 1), axis=0)
    yield _rows(PAIR, both[:, 0], both[:, 1])
    yield _rows(MEMBER, sig[wide].astype(np.int64), ids[wide])


def _dealt(sig, ids, sizes, local, parts):
    """Rows of a flush by partition; the arrays are packed as bytes."""
    part = (sig % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)).tolist():
        rows = order[edges[p]:edges[p + 1]]
        yield {"part": [p], "sig": [sig[rows].tobytes()], "ids": [ids[rows].tobytes()],
               "sizes": [sizes[rows].astype(np.uint32).tobytes()], "local": [local[rows].tobytes()], "found": [None]}


PACKED = "part int, sig binary, ids binary, sizes binary, local binary, found binary"


def _packed_found(rows: dict, salt: int, bits: bytes | None = None) -> dict:
    packed = np.stack([rows["kind"].astype(np.int64), rows["a"], rows["b"]])
    return {"part": [salt], "sig": [bits], "ids": [None], "sizes": [None], "local": [None], "found": [packed.tobytes()]}


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """Shingles in many documents, the number of documents and of shingles.

    A shingle in a share of all documents reaches that share in some task; tasks report
    what does. At most (shingles per document / share) can reach it, so the list is short
    whatever the table's size. Which shingles are listed changes costs only, never results.
    """
    def work(batches):
        held, n = [], 0
        for batch in batches:
            texts = batch.column("text")
            for a, b in parts_by_bytes(texts, SHINGLED_BYTES):
                values, _ = shingle_sets(texts.slice(a, b - a))
                held.append(values)
                n += b - a
        values = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else []
        count = np.diff(np.append(first, len(values))).astype(np.int64)
        often = count >= max(4, FREQUENT_SHARE * n)
        listed = values[first][often].astype(np.int64) if len(values) else np.zeros(0, np.int64)
        yield {"hash": np.append(listed, 0), "n": np.append(count[often] if len(values) else [], len(values)).astype(np.int64),
               "docs": np.append(np.zeros(len(listed), np.int64), n)}

    local = staged(map_arrow(docs.select("text"), "hash bigint, n bigint, docs bigint", work), "frequent")
    totals = local.filter("docs > 0").agg(F.sum("docs"), F.sum("n")).first()
    n_docs, n_shingles = totals[0] or 0, totals[1] or 0
    least = max(FREQUENT_LEAST, FREQUENT_SHARE * n_docs)
    rows = (local.filter("docs = 0").groupBy("hash").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= least).select("hash").toArrow())
    return np.sort(rows.column(0).to_numpy().astype(np.uint64)), n_docs, n_shingles


def candidates(docs: DataFrame) -> DataFrame:
    """Documents with their set sizes, certain links, pairs to verify (packed) and bucket members."""
    frequent, _, n_shingles = frequent_shingles(docs)
    parts = max(shuffle_parts(docs.sparkSession), int(n_shingles * 0.5) // PER_PARTITION + 1)

    def sign(batches):
        held: list[tuple] = []
        seen: dict[bytes, int] = {}
        number = 0

        def flush():
            nonlocal number
            sig, ids, sizes = (np.concatenate(x) for x in zip(*held))
            held.clear()
            seen.clear()
            number += 1
            order = np.lexsort((ids, sig))
            sig, ids, sizes = sig[order], ids[order], sizes[order]
            at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            count = np.diff(np.append(at, len(sig)))
            crowd = np.repeat(count > LOCAL_GROUP, count)
            if crowd.any():
                none = np.zeros(int(crowd.sum()), bool)
                for rows in _groups(sig[crowd], ids[crowd], sizes[crowd], none, False):
                    if len(rows["a"]):
                        yield _packed_found(rows, number)
            head = np.zeros(len(sig), bool)
            head[at] = True
            out = ~crowd | head
            yield from _dealt(sig[out], ids[out], sizes[out], (crowd & head)[out], parts)

        for batch in batches:
            for a, b in parts_by_bytes(batch.column("text"), SHINGLED_BYTES):
                ids = batch.column("doc_id").slice(a, b - a).to_numpy()
                values, sizes = shingle_sets(batch.column("text").slice(a, b - a))
                edges = np.concatenate([[0], np.cumsum(sizes)])
                yield _packed_found(_rows(DOC, ids, sizes), number, bitmaps(values, sizes).tobytes())
                # Sets met before in this flush are linked to the first of them.
                fresh, links = [], []
                for k in range(len(ids)):
                    if sizes[k]:
                        key = hashlib.blake2b(values[edges[k]:edges[k + 1]].tobytes(), digest_size=16).digest()
                        if key in seen:
                            links.append((seen[key], ids[k]))
                        else:
                            seen[key] = ids[k]
                            fresh.append(k)
                if links:
                    both = np.array(links, np.int64)
                    yield _packed_found(_rows(LINK, both[:, 0], both[:, 1]), number)
                if not fresh:
                    continue
                fresh = np.array(fresh)
                new = np.zeros(len(ids), bool)
                new[fresh] = True
                sig, owner = signatures(values[np.repeat(new, sizes)], sizes[fresh], frequent)
                held.append((sig, ids[fresh][owner], sizes[fresh][owner]))
                if sum(len(h[0]) for h in held) >= FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    def pair(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["found"] is not None:
                    kind, a, b = np.frombuffer(row["found"], np.int64).reshape(3, -1)
                    bits = None if row["sig"] is None else np.frombuffer(row["sig"], np.uint8).reshape(len(a), -1)
                    yield _dealt_pairs(_rows(PAIR, a, b), parts) if kind[0] == PAIR else _rows(int(kind[0]), a, b, bits)
                else:
                    held.append((np.frombuffer(row["sig"], np.uint64), np.frombuffer(row["ids"], np.int64),
                                 np.frombuffer(row["sizes"], np.uint32).astype(np.int64), np.frombuffer(row["local"], bool)))
        if held:
            first, rest = _groups(*(np.concatenate(x) for x in zip(*held)), True)
            yield _dealt_pairs(first, parts)
            yield rest

    signed = map_arrow(docs.filter("doc_id IS NOT NULL").select("doc_id", "text"), PACKED, sign)
    return staged(map_arrow(signed.repartition(parts, "part"), FOUND, pair), "candidates")


# Pairs compared with one copy of their first document.
SALTS = 64
# Ids (eight bytes each) that may be broadcast, so that only the texts of pairs are shuffled.
BROADCAST_IDS = 2_000_000


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs ``a``, ``b`` whose shingle sets are similar enough, compared in full.

    Each text travels once per pair it stands second in; that of the first member once per
    salt, so that a document in very many pairs spreads over tasks. Texts in no pair stay where
    they are while the ids in pairs are few enough to broadcast; beyond, all texts meet the
    pairs in a shuffle.
    """
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    needed = staged(ends.distinct(), "paired")
    n_needed = needed.count()
    if not n_needed:
        return pairs.select("a", "b")
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt"))
    lines = salted.select("a", "salt", F.col("b").alias("id"), F.lit(1).alias("turn")).unionByName(
        salted.select("a", "salt", F.col("a").alias("id"), F.lit(0).alias("turn")).distinct())
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    if n_needed <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(needed), "id", "left_semi")
    ordered = (lines.join(texts, "id").repartition("a", "salt")
               .sortWithinPartitions("a", "salt", "turn").select("a", "salt", "turn", "id", "text"))

    def work(batches):
        group, firsts = None, []
        for batch in batches:
            values, sizes = shingle_sets(batch.column("text"))
            edges = np.concatenate([[0], np.cumsum(sizes)])
            left, right = [], []
            columns = (batch.column(c).to_pylist() for c in ("a", "salt", "turn", "id"))
            for k, (a, salt, turn, other) in enumerate(zip(*columns)):
                mine = values[edges[k]:edges[k + 1]]
                if (a, salt) != group:
                    group, firsts = (a, salt), []
                if not turn:
                    firsts.append(mine.copy())
                    continue
                for first in firsts:
                    common = len(np.intersect1d(first, mine, assume_unique=True))
                    if len(mine) and OF * common >= NEED * (len(first) + len(mine) - common):
                        left.append(a)
                        right.append(other)
                        break
            yield {"a": np.array(left, np.int64), "b": np.array(right, np.int64)}

    return map_arrow(ordered, "a bigint, b bigint", work)


def _apart(placed: DataFrame) -> DataFrame:
    """Buckets of members in different components, one for each set of members.

    Texts that are alike share many signatures; their pairs would be given once for each. Sets
    are known by two 64-bit hashes and their size.
    """
    members = placed.groupBy("sig").agg(
        F.min("own").alias("x"), F.max("own").alias("y"), F.count(F.lit(1)).alias("members"),
        F.bit_xor(F.xxhash64("id")).alias("u"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("v")).filter("x <> y")
    return members.groupBy("u", "v", "members").agg(F.min("sig").alias("sig"))


def _open_rows(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of the buckets still apart, with size, bitmap and the largest buckets of each member.

    All members name buckets in one order, so two that name a bucket in common agree which
    of those comes first. A member has no more buckets than signatures.
    """
    rows = placed.join(_apart(placed).select("sig", "members"), "sig")
    at = F.sort_array(F.collect_list(F.struct((-F.col("members")).alias("order"), "sig")))
    mine = rows.groupBy("id").agg(F.min("own").alias("own"), at.alias("at")).join(sets, "id")
    named = F.slice("at", 1, NAMED).getField("sig").alias("named")
    return mine.select("id", "own", "n", "bits", named, F.explode("at").alias("at")).select(
        F.col("at.sig").alias("sig"), (-F.col("at.order")).alias("members"), "id", "own", "n", "bits", "named")


# Pairs of a member that are tried before all of them are.
FIRST_TRIES = 2


def survivors(rows: DataFrame, tries: int | None = None) -> DataFrame:
    """Pairs ``a`` < ``b`` of a bucket, from different components, that may be similar enough.

    A large bucket is cut into blocks, and every two blocks meet in a task. With ``tries``
    only so many are given for each member of a block (most connect it); without, all. A pair
    comes from the first bucket that both name, and from each they share if they name none.
    """
    blocks = F.ceil(F.col("members") / BLOCK_MEMBERS).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    met = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = met.select("sig", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"),
                       "id", "own", "n", "bits", "mine", "named")
    ordered = dealt.repartition("sig", "low", "high").sortWithinPartitions("sig", "low", "high")

    def work(batches):
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("sig", "low", "high")], 1)
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            named = batch.column("named")
            start, end = named.offsets.to_numpy()[:-1, None], named.offsets.to_numpy()[1:, None]
            # Shorter lists repeat their last.
            named = named.values.to_numpy()[np.minimum(start + np.arange(NAMED), end - 1)]
            held.append((key, *(batch.column(c).to_numpy() for c in ("id", "own", "n")), bits,
                         batch.column("mine").to_numpy(), named))
            # The last group may go on in the next batch: it is kept back.
            whole = [np.concatenate(x) for x in zip(*held)]
            last = np.flatnonzero((whole[0] != whole[0][-1]).any(1))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [tuple(x[cut:] for x in whole)]
            if cut:
                yield from _close(*(x[:cut] for x in whole), tries)
        if held:
            yield from _close(*held[0], tries)

    return map_arrow(ordered, "a bigint, b bigint", work)


def _given_here(sig: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether the bucket is the first that both members of a pair name, or they name none in common."""
    common = np.zeros(left.shape, bool)
    for k in range(right.shape[1]):
        common |= left == right[:, k, None]
    first = left[np.arange(len(left)), common.argmax(1)]
    return (first == sig) | ~common.any(1)


def _close(key, ids, own, n, bits, block, named, tries: int | None) -> Iterator[dict]:
    """Pairs within groups of equal keys that neither sizes nor bitmaps exclude.

    Where two blocks meet, pairs of one block are left to the group of that block alone.
    """
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
    end = np.repeat(np.append(first[1:], len(key)), np.diff(np.append(first, len(key))))
    left = np.arange(len(key))
    out = [np.zeros((0, 2), np.int64)]
    alone = key[:, 1] == key[:, 2]
    split = not alone.all()
    tried = np.zeros(len(key), np.int64)
    for shift in range(1, len(key)):
        left = left[left + shift < end[left]]
        if not len(left):
            break
        a, b = left, left + shift
        small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        maybe = (own[a] != own[b]) & (OF * small >= NEED * large)
        if split:
            maybe &= alone[a] | (block[a] != block[b])
        a, b = a[maybe], b[maybe]
        most = (n[a] + n[b]) * (OF - NEED) // (OF + NEED)
        for words in (slice(0, 4), slice(0, None)):
            near = np.bitwise_count(bits[a, words] ^ bits[b, words]).sum(1, dtype=np.int64) <= most
            a, b, most = a[near], b[near], most[near]
        if len(a):
            here = _given_here(key[a, 0], named[a], named[b])
            a, b = a[here], b[here]
        if tries is not None:
            wanted = (tried[a] < tries) | (tried[b] < tries)
            a, b = a[wanted], b[wanted]
            tried[a] += 1
            tried[b] += 1
        if len(a):
            out.append(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])], 1))
    both = np.unique(np.concatenate(out), axis=0)
    yield {"a": both[:, 0], "b": both[:, 1]}


def joined(docs: DataFrame) -> DataFrame:
    """``doc_id``, size of its shingle set and the smallest ``doc_id`` of its component.

    Components only: links are verified until a component is connected, so neither linked
    pairs nor the number of links of a document are given.

    Null and empty texts have no shingles and no links. Rows of one ``doc_id`` count as one
    document wherever they link; a null id has no component. Columns besides ``doc_id`` and
    ``text`` are not read; an empty table gives no rows.
    """
    docs = docs.select("doc_id", whole_text().alias("text"))
    found = candidates(docs)
    pairs = staged(distinct_pairs(found), "pairs")
    kinds = {k: found.filter(F.col("kind") == k).select("a", "b") for k in (DOC, LINK, MEMBER)}
    links = staged(kinds[LINK].unionByName(verified(docs, pairs)), "links")
    near = staged(components(links), "near")
    member = kinds[MEMBER].select(F.col("a").alias("sig"), F.col("b").alias("id")).distinct()
    sets = found.filter(F.col("kind") == DOC).select(F.col("a").alias("id"), F.col("b").alias("n"), "bits")
    # Texts of one id each have a size and bitmap of their own; any of them may pass.
    sets = sets.dropDuplicates(["id", "n", "bits"])
    tested = pairs
    for tries in (FIRST_TRIES, None):
        # Buckets whose members are still apart.
        placed = staged(member.join(near, "id", "left").select(
            "sig", "id", F.coalesce("component_id", "id").alias("own")), "members")
        found_apart = staged(survivors(_open_rows(placed, sets), tries), "survivors")
        more = staged(found_apart.distinct().join(tested, ["a", "b"], "left_anti"), "untested")
        extra = staged(verified(docs, more), "links")
        if not extra.isEmpty():
            known = near.select(F.col("id").alias("a"), F.col("component_id").alias("b"))
            near = staged(components(known.unionByName(extra)), "near")
        tested = tested.unionByName(more)
    rows = kinds[DOC].select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    known = rows.join(near.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return known.unionByName(_without_id(docs))


def _without_id(docs: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            _, sizes = shingle_sets(batch.column("text"))
            yield {"doc_id": batch.column("doc_id"), "n_shingles": sizes, "component_id": batch.column("doc_id")}

    return map_arrow(docs.filter("doc_id IS NULL"), "doc_id bigint, n_shingles bigint, component_id bigint", work)


def thinned(docs: DataFrame) -> DataFrame:
    """One row of each component (that of the smallest id) and all rows without links."""
    leave = staged(joined(docs).filter("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return docs.join(leave, "doc_id", "left_anti").select(*docs.columns)


def op10_jaccard_join(spark, sf_dir):
    return joined(documents(spark, sf_dir))
