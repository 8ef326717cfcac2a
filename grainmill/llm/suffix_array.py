"""Suffix arrays of byte strings by two-stage sorting, and common prefixes of neighbours."""

from __future__ import annotations

import numpy as np

from grainmill.llm.common import travels

travels(__name__)


def smaller_than_next(s: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than the one that starts a byte later. The end is smaller than any byte."""
    n = len(s)
    out = np.zeros(n, dtype=bool)
    if n < 2:
        return out
    # A run of equal bytes has the type of its last byte: look for the next place where bytes differ.
    differs = np.append(s[:-1] != s[1:], True)
    at = np.where(differs, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    inner = at < n - 1
    out[inner] = s[at[inner]] < s[at[inner] + 1]
    return out


def eights(s: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian integer; beyond the end come zeros."""
    padded = np.concatenate([s, np.zeros(8, dtype=np.uint8)])
    out = np.zeros(len(s), dtype=np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + len(s)].astype(np.uint64)
    return out


def sort_direct(s: np.ndarray, positions: np.ndarray, depth: int) -> np.ndarray:
    """The positions in the order of their suffixes, compared up to `depth` bytes; a suffix that ends comes first."""
    keys = np.append(eights(s), np.uint64(0))
    order = positions
    if len(order) < 2:
        return order
    order = order[np.argsort(keys[order], kind="stable")]
    group = np.zeros(len(order), dtype=np.int64)
    group[1:] = np.cumsum(keys[order][1:] != keys[order][:-1])
    for at in range(8, depth, 8):
        same = group[1:] == group[:-1]
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        if not len(tied):
            break
        rest = np.minimum(order[tied] + at, len(s))
        key = keys[rest]
        moved = np.lexsort((key, group[tied]))
        order[tied], key = order[tied][moved], key[moved]
        # New groups among the tied rows; numbers only have to rise within the old group.
        old = group[tied]
        fresh = np.append(True, (old[1:] != old[:-1]) | (key[1:] != key[:-1]))
        first = np.maximum.accumulate(np.where(fresh, tied, 0))
        renumbered = np.arange(len(order))
        renumbered[tied] = first
        group = renumbered
    # Zeros beyond the end look like zero bytes: among equals the later start is the shorter suffix.
    same = group[1:] == group[:-1]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
    if len(tied):
        order[tied] = order[tied][np.lexsort((-order[tied], group[tied]))]
    return order


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of `s` in order; suffixes alike in `depth` bytes or more may stand in any order among them.

    Stage one sorts only the suffixes that are smaller than their successors. Stage two scans the buckets of first
    bytes upwards: a suffix's predecessor that is larger than it goes to the next free place of its own bucket.
    """
    n = len(s)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    small = smaller_than_next(s)
    direct = sort_direct(s, np.flatnonzero(small), depth)
    size = np.bincount(s, minlength=256)
    start = np.concatenate([[0], np.cumsum(size)])
    few = np.bincount(s[direct], minlength=256) if len(direct) else np.zeros(256, dtype=np.int64)
    out = np.full(n, -1, dtype=np.int64)
    at = 0
    for c in range(256):  # directly sorted suffixes close their buckets
        out[start[c + 1] - few[c] : start[c + 1]] = direct[at : at + few[c]]
        at += few[c]
    free = start[:256].copy()

    def induce(scanned: np.ndarray) -> None:
        before = scanned[scanned > 0] - 1
        before = before[~small[before]]
        if len(before):
            first = s[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            heads = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            counts = np.diff(np.append(heads, len(first)))
            out[np.repeat(free[first[heads]] - heads, counts) + np.arange(len(first))] = before
            free[first[heads]] += counts

    induce(np.array([n]))  # the end comes first, and the last suffix is larger than it
    for c in range(256):
        done = start[c]
        while done < free[c]:  # a run of one byte induces into its own bucket
            upto = free[c]
            induce(out[done:upto])
            done = upto
        induce(out[start[c + 1] - few[c] : start[c + 1]])
    return out


def common_prefixes(s: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """For each start but the first, the bytes it has in common with the start before it, up to `most`."""
    a, b = starts[:-1], starts[1:]
    out = np.zeros(len(a), dtype=np.int64)
    alive = np.arange(len(a))
    padded = np.concatenate([s.astype(np.int16), np.full(most, -1, dtype=np.int16)])
    for k in range(most):
        alive = alive[(padded[a[alive] + k] == padded[b[alive] + k]) & (padded[a[alive] + k] >= 0)]
        if not len(alive):
            break
        out[alive] = k + 1
    return out
