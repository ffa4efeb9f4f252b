"""Suffix array, Burrows-Wheeler transform, and the places whose common prefix reaches a minimum.

The transform is searched backwards and breadth first: the rows that begin with a string w form an interval;
extending w to the left by each symbol of that interval gives the intervals of the strings one longer. A
boundary between rows that an interval of length l is the first to show has a common prefix of l - 1, so
prefixes come in increasing order, each row is entered once, and the search stops at the minimum: boundaries
not shown until then have at least that much in common. No comparison of texts takes place.
"""

from __future__ import annotations

import numpy as np

from .words import ascending


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of symbols (0 to 511), and its inverse, by prefix doubling over unsettled rows."""
    n = len(symbols)
    key = np.zeros(n + 8, np.uint64)
    key[:n] = symbols
    shift = np.uint64(9)
    two = key[:-1] << shift | key[1:]
    three = two[:-1] << shift | key[2:]
    seven = two[:-2] << shift + shift | two[2:]
    seven = (seven[:-4] << shift + shift + shift | three[4 : 4 + len(seven) - 4])[:n]
    sa = np.argsort(seven)
    fresh = np.ones(n + 1, bool)
    s = seven[sa]
    fresh[1:n] = s[1:] != s[:-1]
    del s, key, two, three, seven
    rank = np.full(n + 1, -1, np.int64)
    place = np.arange(n)
    rank[sa] = np.maximum.accumulate(np.where(fresh[:n], place, 0))
    depth = 7
    while True:
        rows = np.flatnonzero(~(fresh[:-1] & fresh[1:]))
        if not len(rows):
            return sa, rank[:n]
        at = sa[rows]
        pair = rank[at] * (n + 1) + rank[np.minimum(at + depth, n)] + 1
        order = np.argsort(pair)
        at, pair = at[order], pair[order]
        sa[rows] = at
        new = np.ones(len(rows), bool)
        new[1:] = pair[1:] != pair[:-1]
        fresh[rows[new]] = True
        rank[at] = np.maximum.accumulate(np.where(new, rows, 0))
        depth *= 2


def long_common(symbols: np.ndarray, least: int) -> np.ndarray:
    """Sorted starts whose next `least` symbols (each 1 to 511) also start elsewhere in symbols."""
    if len(symbols) <= least:
        return np.zeros(0, np.int64)
    symbols = np.append(symbols, symbols.dtype.type(0))  # ends every suffix in a symbol of its own
    n = len(symbols)
    sa, isa = suffix_array(symbols)
    back = isa[sa - 1]  # row of the suffix one symbol longer; before the whole text comes the end
    ahead = np.empty(n, np.int64)  # its inverse
    ahead[back] = np.arange(n)
    head = symbols[sa]
    shown = np.zeros(n + 1, bool)
    shown[0] = shown[n] = True
    owner = np.empty(n, np.int32)
    low, high = np.zeros(1, np.int64), np.full(1, n - 1)
    for _ in range(least):
        size = high - low + 1
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        who = np.repeat(np.arange(len(low), dtype=np.int32), size)
        rows = np.arange(int(size.sum())) + np.repeat(low - first, size)
        owner[rows] = who
        rows = np.sort(back[rows])
        of, sym = owner[ahead[rows]], head[rows]
        cut = np.flatnonzero((of[1:] != of[:-1]) | (sym[1:] != sym[:-1]))
        low, high = rows[np.concatenate(([0], cut + 1))], rows[np.append(cut, len(rows) - 1)]
        new = ~shown[high + 1]
        low, high = low[new], high[new]
        if not len(low):
            break
        shown[high + 1] = True
    same = np.flatnonzero(~shown)
    return ascending(np.concatenate((sa[same], sa[same - 1])))
