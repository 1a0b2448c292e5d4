"""Simple-8b: unsigned integers in 64-bit words, vectorised over independent strips.

The top four bits of a word select how many values it holds and of how many bits. Values
are cut into strips of ``STRIP``; each strip starts a new word, and its word offset is
kept, so that strips decode independently. A value beyond 60 bits takes an escape word
whose value stands in a separate list.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the coding: values per word and bits per value, by selector.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)

STRIP = 1024
_TAG = np.uint64(60)


def _bits_needed(values: np.ndarray) -> np.ndarray:
    need = np.zeros(len(values), np.uint8)
    rest = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >> np.uint64(step)
        big = high > 0
        need[big] += step
        rest = np.where(big, high, rest)
    return need + (rest > 0).astype(np.uint8)


def _running_maxima(need: np.ndarray) -> dict[int, np.ndarray]:
    """For each count c of a selector, the largest need among c values from each place on."""
    def join(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        out = np.full(len(a), 255, np.uint8)
        if len(a) > shift:
            np.maximum(a[:-shift], b[shift:], out=out[:-shift])
        return out

    m = {1: need}
    for count, first, second in ((2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 4, 1), (6, 4, 2), (7, 4, 3), (8, 4, 4),
                                 (10, 8, 2), (12, 8, 4), (15, 8, 7), (20, 10, 10), (30, 15, 15), (60, 30, 30),
                                 (120, 60, 60)):
        m[count] = join(m[first], m[second], first)
    return m


def encode(values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Words of the values, whose consecutive ``groups`` (lengths) start strips of their own.

    Returns the words, the word offset of each strip, the words per group, and the
    escaped values per group.
    """
    values = values.astype(np.uint64, copy=False)
    strips_of = -(-groups // STRIP)
    group_start = np.cumsum(groups) - groups
    first = np.cumsum(strips_of) - strips_of
    number = np.arange(int(strips_of.sum())) - np.repeat(first, strips_of)
    starts = np.repeat(group_start, strips_of) + number * STRIP
    ends = np.minimum(starts + STRIP, np.repeat(group_start + groups, strips_of))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(groups), np.int64), [values[:0]] * len(groups)
    need = _bits_needed(values)
    room = np.repeat(ends, ends - starts) - np.arange(len(values))
    maxima = _running_maxima(need)
    best = np.zeros(len(values), np.uint8)
    for selector in range(15, 0, -1):
        count = int(COUNTS[selector])
        best[(maxima[count] <= BITS[selector]) & (room >= count)] = selector
    picked, owners = [], []
    place, strip = starts.copy(), np.arange(len(starts))
    while len(place):
        picked.append(place)
        owners.append(strip)
        place = place + COUNTS[best[place]]
        go_on = place < ends[strip]
        place, strip = place[go_on], strip[go_on]
    at, owner = np.concatenate(picked), np.concatenate(owners)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    chosen = best[at]
    words = chosen.astype(np.uint64) << _TAG
    for selector in range(2, 16):
        mine = np.flatnonzero(chosen == selector)
        if len(mine):
            count, bits = int(COUNTS[selector]), int(BITS[selector])
            for k in range(count):
                words[mine] |= values[at[mine] + k] << np.uint64(bits * k)
    per_strip = np.bincount(owner, minlength=len(starts))
    offsets = np.cumsum(per_strip) - per_strip
    of_group = np.repeat(np.arange(len(groups)), strips_of)
    per_group = np.bincount(of_group, weights=per_strip, minlength=len(groups)).astype(np.int64)
    escaped = at[chosen == 0]
    split = np.searchsorted(escaped, group_start + groups)
    escapes = np.split(values[escaped], split[:-1]) if len(groups) else []
    word_start = np.cumsum(per_group) - per_group
    return words, offsets - np.repeat(word_start, strips_of), per_group, escapes


def decode(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """All values of consecutive words."""
    chosen = (words >> _TAG).astype(np.int64)
    counts = COUNTS[chosen]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for selector in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == selector)
        if selector == 0:
            out[starts[mine]] = escapes
            continue
        count, bits = int(COUNTS[selector]), int(BITS[selector])
        if not bits:
            continue
        mask = np.uint64((1 << bits) - 1)
        taken = words[mine]
        for k in range(count):
            out[starts[mine] + k] = (taken >> np.uint64(bits * k)) & mask
    return out


def decode_strip(words: np.ndarray, offsets: np.ndarray, strip: int, escapes: np.ndarray) -> np.ndarray:
    """The values of one strip (blocks without escapes, or with those of this strip given)."""
    end = offsets[strip + 1] if strip + 1 < len(offsets) else len(words)
    return decode(words[offsets[strip]:end], escapes)
