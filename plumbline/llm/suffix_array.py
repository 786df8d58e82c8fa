"""Suffix arrays by two-stage sorting, in numpy.

A suffix is of type B if it is smaller than its successor (the suffix one byte later), else of type A. Type B
suffixes are sorted directly; type A ones are induced: buckets of equal first bytes are scanned from the
smallest, and each entry puts its predecessor, where that is of type A, behind what its bucket has so far.
"""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15


def powers(n: int) -> np.ndarray:
    """_ODD ** i modulo 2 ** 64 for i up to n."""
    p = np.full(n + 1, _ODD, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def inverse_powers(n: int) -> np.ndarray:
    p = np.full(n + 1, pow(_ODD, -1, 1 << 64), np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of width bytes, by differences of prefix sums."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers(n - 1), out=total[1:])
    return mixed((total[width:] - total[:-width]) * inverse_powers(n - width))


def words_at(data: np.ndarray) -> np.ndarray:
    """For each position the eight bytes from it on as a big-endian number (zeros beyond the end)."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data
    out = np.zeros(n, np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : n + j]
    return out


def smaller_than_successor(data: np.ndarray) -> np.ndarray:
    """True for type B. Equal neighbours take the type of the end of their run; the last suffix is of type A."""
    n = len(data)
    rise = np.zeros(n, bool)
    step = data[:-1] != data[1:]
    rise[:-1][step] = data[:-1][step] < data[1:][step]
    ends = np.append(np.flatnonzero(step), n - 1)
    return np.repeat(rise[ends], np.diff(ends, prepend=-1))


def sort_directly(data: np.ndarray, words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes at, ordered by their first depth bytes: eight at first, then five at a time for ties.

    Ties whose hashes of all depth bytes agree need no further sorting.
    """
    n = len(data)
    if len(at) < 2:
        return at
    hashes = window_hashes(data, depth)
    whole = mixed(np.arange(n, dtype=np.uint64))  # those too short to have one are each their own
    whole[: len(hashes)] = hashes
    order = at[np.argsort(words[at])]
    key = words[order]
    place, skip = np.arange(len(at)), 8
    while True:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(key)))
        own = whole[order[place]]
        tied = (size > 1) & (np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first))
        open_ = np.repeat(tied, size)
        place = place[open_]
        if not len(place) or skip >= depth:
            return order
        group = np.repeat(np.arange(int(tied.sum()), dtype=np.uint64), size[tied])
        members = order[place]
        beyond = members + skip
        next_ = np.where(beyond < n, words[np.minimum(beyond, n - 1)], 0) >> np.uint64(24)
        key = (group << np.uint64(40)) | next_
        by = np.argsort(key)
        order[place], key, skip = members[by], key[by], skip + 5


def suffix_array(data: np.ndarray, depth: int, is_b: np.ndarray | None = None, wanted: np.ndarray | None = None) -> np.ndarray:
    """The suffixes of data, ordered by their first depth bytes.

    is_b: smaller_than_successor(data), if at hand. wanted: the suffixes to sort, all by default; a wanted one of
    type A must have a wanted successor, which is what places it.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    is_b = smaller_than_successor(data) if is_b is None else is_b
    wanted = np.ones(n, bool) if wanted is None else wanted
    b = sort_directly(data, words_at(data), np.flatnonzero(is_b & wanted), depth)
    b_ends = np.searchsorted(data[b], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if wanted[-1]:
        waiting[data[-1]].append(np.array([n - 1]))  # what the empty suffix puts
    out = []
    for c in range(256):
        induced = []
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(wave):
            induced.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(data[before] == c) & wanted[before]]
        own = np.concatenate([*induced, b[b_ends[c] : b_ends[c + 1]]])
        waiting[c] = []
        if not len(own):
            continue
        out.append(own)
        before = own[own > 0] - 1
        first = data[before]
        up = (first > c) & wanted[before]
        before, first = before[up], first[up]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
        if len(before):
            for part in np.split(before, cuts):
                waiting[data[part[0]]].append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, among: np.ndarray | None = None) -> np.ndarray:
    """Bytes that each suffix in order shares with the one before it, counted up to most (a multiple of eight).

    among: the places in order to look at, all from the second on by default; others count 0.
    """
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    words, size = words_at(data), len(data)
    i = np.arange(1, n) if among is None else among
    for skip in range(0, most, 8):
        a, b = order[i] + skip, order[i - 1] + skip
        inside = (a < size) & (b < size)
        i, a, b = i[inside], a[inside], b[inside]
        differ = words[a] ^ words[b]
        same = differ == 0
        rest = differ[~same]
        # leading equal bytes of the word that differs, as far as both suffixes go
        lead = np.zeros(len(rest), np.int64)
        for byte in range(7, 0, -1):
            lead += rest >> np.uint64(8 * byte) == 0
        room = np.minimum(size - a, size - b)
        out[i[~same]] = np.minimum(skip + lead, skip + room[~same])
        out[i[same]] = skip + np.minimum(8, room[same])
        i = i[same]
        if not len(i):
            break
    return np.minimum(out, most)
