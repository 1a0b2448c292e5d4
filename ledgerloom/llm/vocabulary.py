"""Encoding whole texts by a public tokenizer, each distinct word once.

A text is cut where the tokenizer's own splitting always cuts, so that the ids of the
text are the ids of its pieces one after another. Arrow cuts the texts of a batch and
makes the pieces distinct; only words that this Python worker has not met before go to the
tokenizer, many in one string.
"""

from __future__ import annotations

import os
import re
from itertools import chain
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Letters of one code point that stay single letters under every normalisation used here.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
# Signs that may follow a word; a run of them is a pre-token of its own.
_SIGNS = ".,;:!?*%$#&"
# A word, perhaps after a line break, perhaps with signs after it.
_SIMPLE = f"^\n?[{_LETTERS}]+[{_SIGNS}]*$"
# White space as the splitting patterns of the tokenizers know it (not that of Python).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNSAFE = re.compile(f"^$|^\n?[{_SPACE}]|[{_SPACE}]$")
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")

# Words a worker remembers; later new ones are encoded again in each batch.
REMEMBERED = 300_000
# Words sent to the tokenizer in one string, and bytes of text taken at a time.
TOGETHER = 500
PART_BYTES = 8 << 20

_open: dict[tuple[type, str], object] = {}


def opened(kind: type, path: str):
    """One codec per worker process and file, so that what it remembers serves later tasks."""
    if (kind, path) not in _open:
        _open[kind, path] = kind(path)
    return _open[kind, path]


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions ``starts[k] .. starts[k] + counts[k] - 1`` for all k, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def parts_by_bytes(texts: pa.Array, most: int = PART_BYTES) -> list[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each (a longer text is a range of its own)."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(sizes):
        return []
    group = (np.cumsum(sizes) - sizes) // most
    cuts = np.flatnonzero(np.diff(group)) + 1
    edges = [0, *cuts.tolist(), len(sizes)]
    return list(zip(edges[:-1], edges[1:]))


def distinct(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct values of a list column, the value of every place, and the rows' edges."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = pc.dictionary_encode(lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])))
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), offsets - offsets[0]


def joined(words: list[str], between: str) -> list[str]:
    return [between.join(words[i:i + TOGETHER]) for i in range(0, len(words), TOGETHER)]


class IdStore:
    """Ids of keys, one after another in one array, with a place per key."""

    def __init__(self):
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)
        self.used_ids = self.used = self.known_at_mark = 0
        self.known: dict[str, int] = {}

    @staticmethod
    def _grown(array: np.ndarray, least: int) -> np.ndarray:
        if least <= len(array):
            return array
        return np.concatenate([array, np.zeros(max(least - len(array), len(array)), array.dtype)])

    def append(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Add consecutive entries; returns the place of the first."""
        first, a, b = self.used, self.used_ids, self.used_ids + len(ids)
        self.ids = self._grown(self.ids, b)
        self.ids[a:b] = ids
        self.starts, self.sizes = self._grown(self.starts, first + len(sizes)), self._grown(self.sizes, first + len(sizes))
        self.sizes[first:first + len(sizes)] = sizes
        self.starts[first:first + len(sizes)] = a + np.cumsum(sizes) - sizes
        self.used, self.used_ids = first + len(sizes), b
        return first

    def places(self, keys: list[str], learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Place of each key; unknown ones are learnt, and remembered while there is room."""
        known = self.known
        found = [known.get(k, -1) for k in keys]
        new = dict.fromkeys(k for k, f in zip(keys, found) if f < 0)
        if new:
            first = self.append(*learn(list(new)))
            new = dict(zip(new, range(first, self.used)))
            found = [new[k] if f < 0 else f for k, f in zip(keys, found)]
            if len(known) < REMEMBERED:
                known.update(new)
        return np.array(found, np.int64)

    def mark(self) -> tuple[int, int]:
        self.known_at_mark = len(self.known)
        return self.used, self.used_ids

    def forget(self, mark: tuple[int, int]) -> None:
        """Drop what was added after ``mark`` unless it is remembered."""
        if self.known_at_mark == len(self.known):
            self.used, self.used_ids = mark


class ByteLevelCodec:
    """Ids by a byte-level BPE file whose pattern starts words with their one space.

    A single space, or a single line break, between two characters that are no white space
    always begins a new pre-token; so does a change from letters to a full stop or comma.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.spaced[number] = token.startswith("Ġ")
        (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.store = IdStore()

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(found)), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _as_they_stand(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._ids([k[1:] for k in keys])

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each after one space or, if it begins with one, a line break.

        Words go to the tokenizer joined; where one begins shows in the ids, as only its
        first id holds a space or is the line break.
        """
        on_line = np.fromiter((w[0] == "\n" for w in words), bool, len(words))
        spaced = [w for w in words if w[0] != "\n"]
        flat, _ = self._ids([" " + t for t in joined(spaced, " ")])
        more, _ = self._ids(joined([w for w in words if w[0] == "\n"], ""))
        starts = np.concatenate([np.flatnonzero(self.spaced[flat]), len(flat) + np.flatnonzero(more == self.line)])
        flat = np.concatenate([flat, more])
        sizes = np.diff(np.append(starts, len(flat)))
        back = np.empty(len(words), np.int64)
        back[np.argsort(on_line, kind="stable")] = np.arange(len(words))
        return flat[spread(starts[back], sizes[back])], sizes[back]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a, b in parts_by_bytes(texts):
            mark = self.store.mark()
            flat, each = self._part(texts.slice(a, b - a))
            self.store.forget(mark)
            ids.append(flat)
            counts.append(each)
        return np.concatenate(ids), np.concatenate(counts)

    def _resolved(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the word and of the signs (or -1) of pieces, and which pieces are unsafe.

        A piece follows one space, or begins with a line break. Unsafe are those beside
        further white space.
        """
        simple = pc.match_substring_regex(pieces, _SIMPLE).to_numpy(zero_copy_only=False)
        place, sign, unsafe = np.full(len(pieces), -1), np.full(len(pieces), -1), np.zeros(len(pieces), bool)
        plain = pieces.filter(pa.array(simple))
        words = pc.utf8_rtrim(plain, _SIGNS)
        coded = pc.dictionary_encode(words)
        place[simple] = self.store.places(coded.dictionary.to_pylist(), self._words)[coded.indices.to_numpy()]
        signed = np.flatnonzero(pc.not_equal(pc.binary_length(words), pc.binary_length(plain)).to_numpy(zero_copy_only=False))
        taken = pa.array(signed)
        runs = ["\0" + p[len(w):] for p, w in zip(plain.take(taken).to_pylist(), words.take(taken).to_pylist())]
        sign[np.flatnonzero(simple)[signed]] = self.store.places(runs, self._as_they_stand)
        odd = np.flatnonzero(~simple)
        listed = pieces.take(pa.array(odd)).to_pylist()
        unsafe[odd] = [_UNSAFE.search(t) is not None for t in listed]
        chunks = [("\0" if t[0] == "\n" else "\0 ") + t for t, u in zip(listed, unsafe[odd]) if not u]
        place[odd[~unsafe[odd]]] = self.store.places(chunks, self._as_they_stand)
        return place, sign, unsafe

    def _part(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces, index, edges = distinct(pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " "))
        place, sign, unsafe = self._resolved(pieces)
        row = np.repeat(np.arange(len(texts)), np.diff(edges))
        irregular = np.zeros(len(texts), bool)
        irregular[row[unsafe[index]]] = True
        places, signs, sizes = place[index], sign[index], np.diff(edges)
        # The first piece of a text has no space before it: it is encoded as it stands.
        first = edges[:-1][~irregular]
        if len(first):
            heads = ["\0" + p for p in pieces.take(pa.array(index[first])).to_pylist()]
            places[first] = self.store.places(heads, self._as_they_stand)
            signs[first] = -1
        if irregular.any():
            places, signs, sizes = self._irregular(texts, irregular, places, signs, edges)
        # Word and signs alternate; absent signs have no ids.
        both = np.stack([places, signs], 1).ravel()
        counts = np.where(both >= 0, self.store.sizes[both], 0)
        ids = self.store.ids[spread(self.store.starts[both], counts)]
        totals = np.concatenate([[0], np.cumsum(counts)])
        edges = 2 * np.concatenate([[0], np.cumsum(sizes)])
        return ids, totals[edges[1:]] - totals[edges[:-1]]

    def _irregular(self, texts, irregular, places, signs, edges):
        """Texts with runs of white space are cut in whole chunks: white space, then the rest."""
        rows = np.flatnonzero(irregular)
        cut = [_CHUNK.findall(texts[int(r)].as_py()) for r in rows]
        chunks = list(dict.fromkeys(chain.from_iterable(cut)))
        usual = [c[1:] if c[0] == " " and c[1:2] != "\n" else c if c[0] == "\n" else "" for c in chunks]
        place, sign, unsafe = self._resolved(pa.array(usual, pa.string()))
        rest = np.flatnonzero(unsafe)
        place[rest] = self.store.places(["\0" + chunks[i] for i in rest], self._as_they_stand)
        number = dict(zip(chunks, range(len(chunks))))
        sizes = np.diff(edges)
        kept = ~np.repeat(irregular, sizes)
        sizes[rows] = list(map(len, cut))
        fresh = np.repeat(irregular, sizes)
        index = np.fromiter((number[c] for c in chain.from_iterable(cut)), np.int64, int(fresh.sum()))
        new_places, new_signs = np.empty(len(fresh), np.int64), np.empty(len(fresh), np.int64)
        new_places[~fresh], new_signs[~fresh] = places[kept], signs[kept]
        new_places[fresh], new_signs[fresh] = place[index], sign[index]
        return new_places, new_signs, sizes


class WordCounter:
    """Numbers of ids by a word-end BPE file that drops white space.

    White space separates pre-tokens, so a text may be cut at any of it; a change from
    letters to a full stop or comma separates them as well.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ending = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.ending[number] = token.endswith("</w>")
        self.known: dict[str, int] = {}

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[int]:
        """Counts of the distinct words, most of them remembered from earlier batches."""
        known = self.known
        new = [w for w in words if w not in known]
        counts: list[int] = []
        for e in self.tokenizer.encode_batch_fast(joined(new, " "), add_special_tokens=False):
            ends = np.flatnonzero(self.ending[np.array(e.ids, np.int64)])
            counts.extend(np.diff(np.concatenate([[-1], ends])).tolist())
        fresh = dict(zip(new, counts))
        if len(known) < REMEMBERED:
            known.update(fresh)
        return [known[w] if w in known else fresh[w] for w in words]

    def counts(self, pieces: pa.Array) -> np.ndarray:
        """Ids of each piece, which holds no ASCII white space."""
        simple = pc.match_substring_regex(pieces, f"^[{_LETTERS}]+[{_SIGNS}]*$").to_numpy(zero_copy_only=False)
        total = np.zeros(len(pieces), np.int64)
        plain = pieces.filter(pa.array(simple))
        trimmed = pc.utf8_rtrim(plain, _SIGNS)
        coded = pc.dictionary_encode(trimmed)
        if len(plain):
            total[simple] = np.array(self._words(coded.dictionary.to_pylist()), np.int64)[coded.indices.to_numpy()]
        signed = np.flatnonzero(pc.not_equal(pc.binary_length(trimmed), pc.binary_length(plain)).to_numpy(zero_copy_only=False))
        taken = pa.array(signed)
        runs = [p[len(w):] for p, w in zip(plain.take(taken).to_pylist(), trimmed.take(taken).to_pylist())]
        total[np.flatnonzero(simple)[signed]] += self._others(runs)
        odd = np.flatnonzero(~simple)
        total[odd] = self._others(pieces.take(pa.array(odd)).to_pylist())
        return total

    def _others(self, pieces: list[str]) -> np.ndarray:
        known = self.known
        new = list({"\0" + p for p in pieces} - known.keys())
        fresh = dict(zip(new, self._lengths([p[1:] for p in new])))
        if len(known) < REMEMBERED:
            known.update(fresh)
        keys = ["\0" + p for p in pieces]
        return np.fromiter((known[k] if k in known else fresh[k] for k in keys), np.int64, len(keys))
