"""Suffix sorting of one byte array in two stages, by whole arrays.

A suffix is of type S if it is smaller than its successor (the suffix that
starts one byte later), else of type L. Only S suffixes are sorted directly, by
words of eight bytes as far as ties ask for. L suffixes are induced: buckets of
first bytes are scanned in order, and an L suffix is put in its bucket when its
successor is met, which gives the right order because the suffix is its first
byte followed by its successor. A run of one byte is induced in rounds inside
its bucket. All orders hold to ``depth`` bytes, beyond which ties stay open.
"""
from __future__ import annotations

import numpy as np


def words_at(padded: np.ndarray) -> np.ndarray:
    """The eight bytes at every position, as big-endian integers; ``padded`` is
    the array with at least eight more bytes."""
    w = padded.astype(np.uint64)
    w = (w[:-1] << np.uint64(8)) | w[1:]
    w = (w[:-2] << np.uint64(16)) | w[2:]
    return (w[:-4] << np.uint64(32)) | w[4:]


def _sort_directly(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by ``depth`` bytes or more: all by the first word, then
    only those that are still tied by the next one."""
    order = at[np.argsort(words[at], kind="stable")]
    key = words[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.cumsum(new)
    last = len(words) - 1
    for skip in range(8, depth, 8):
        tied = np.flatnonzero(~new | np.concatenate([~new[1:], [False]]))
        if not len(tied):
            break
        key = words[np.minimum(order[tied] + skip, last)]
        by = np.lexsort((key, group[tied]))
        order[tied], key, g = order[tied][by], key[by], group[tied]
        split = np.concatenate([[False], (g[1:] == g[:-1]) & (key[1:] != key[:-1])])
        new[tied[split]] = True
        group = np.cumsum(new)
    return order


def suffix_array(text: np.ndarray, depth: int, pad: int = 255) -> np.ndarray:
    """Positions of ``text`` (bytes) in the order of their suffixes, compared
    over ``depth`` bytes."""
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    # behind the end stands nothing: smaller than every byte, so the last suffix is of type L
    rise = np.sign(text[1:].astype(np.int16) - text[:-1]).astype(np.int8)
    rise = np.concatenate([rise, [-1]])
    where = np.where(rise != 0, np.arange(n), n)
    small = rise[np.minimum.accumulate(where[::-1])[::-1]] > 0             # type S
    padded = np.concatenate([text, np.zeros(depth + 16, dtype=np.uint8)])
    direct = _sort_directly(np.flatnonzero(small), words_at(padded), depth)
    s_of = np.split(direct, np.searchsorted(text[direct], np.arange(1, 256)))
    l_of: list[list[np.ndarray]] = [[] for _ in range(256)]
    l_of[text[n - 1]].append(np.array([n - 1], dtype=np.int64))
    out = []

    def induce(scanned: np.ndarray, c: int) -> np.ndarray:
        """Put the L predecessors of the scanned suffixes in their buckets;
        those of this very bucket are returned."""
        before = scanned[scanned > 0] - 1
        before = before[~small[before]]
        first = text[before]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
        own = before[:0]
        for part in np.split(before, cuts):
            if len(part):
                if text[part[0]] == c:
                    own = part
                else:
                    l_of[text[part[0]]].append(part)
        return own

    for c in range(256):
        for part in l_of[c]:
            out.append(part)
        scan = np.concatenate(l_of[c]) if l_of[c] else direct[:0]
        while len(scan):
            scan = induce(scan, c)
            out.append(scan)
        if len(s_of[c]):
            out.append(s_of[c])
            induce(s_of[c], c)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each place of ``order`` the length, up to ``limit``, of the common
    prefix with the place before it (0 for the first)."""
    padded = np.concatenate([text, np.zeros(limit + 16, dtype=np.uint8)])
    out = np.zeros(len(order), dtype=np.int64)
    alive = np.arange(1, len(order))
    words = words_at(padded)
    for skip in range(0, limit, 8):
        a, b = order[alive - 1] + skip, order[alive] + skip
        differ = words[a] ^ words[b]
        same = np.full(len(alive), 8)
        for k in range(8):
            same[(differ >> np.uint64(8 * k)) != 0] = 7 - k
        out[alive] += same
        alive = alive[same == 8]
    ends = len(text) - order
    out[1:] = np.minimum(out[1:], np.minimum(ends[1:], ends[:-1]))
    return np.minimum(out, limit)
