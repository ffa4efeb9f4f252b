"""Re-Pair grammars of token ids.

Frequent pairs of neighbours are replaced by new symbols, round after round, until no pair is frequent. A round
replaces all frequent pairs at once: where two overlap the more frequent goes first, and of a run of equal pairs
(a a a a) every second one. A pair that keeps fewer than LEAST places that way waits for the next round, so every
rule stands for LEAST places or more. A symbol below `terminals` is an id, any other is rule number symbol -
terminals, a pair of earlier symbols.

Symbols are linked, so a round looks only at places beside the symbols that the round before made and at pairs it
left: the count of any other pair can only fall. All rounds together touch each replaced place a few times.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: A pair is frequent from so many places on: a rule takes 12 bytes of the store, each place saves 3.
LEAST = 4
_SLOTS = 20


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key * U64(0x9E3779B97F4A7C15)) >> U64(64 - _SLOTS)).astype(np.int64)


def _frequent(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values that occur LEAST times or more, ascending, how often, and for each key its number among them or -1."""
    s = np.sort(key)
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(s)))
    often = np.flatnonzero(count >= LEAST)
    chosen = s[first[often]]
    if not len(chosen):
        return chosen, count[often], np.full(len(key), -1, np.int32)
    if len(key) < 1 << 14:
        at = np.minimum(np.searchsorted(chosen, key), len(chosen) - 1).astype(np.int32)
    else:  # by slot, and by search where two chosen values share one
        slot, own = _slot(key), _slot(chosen)
        named = np.zeros(1 << _SLOTS, np.int32)
        named[own] = np.arange(len(chosen), dtype=np.int32)
        at = named[slot]
        lost = np.flatnonzero(named[own] != np.arange(len(chosen)))
        if len(lost):
            crowded = np.zeros(1 << _SLOTS, bool)
            crowded[own[lost]] = True
            lost = np.flatnonzero(crowded[slot])
            at[lost] = np.minimum(np.searchsorted(chosen, key[lost]), len(chosen) - 1)
    at[chosen[at] != key] = -1
    return chosen, count[often], at


def _apart(rank: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Which items are taken if the least rank goes first and takes out its neighbours; joined: item i and the next overlap."""
    taken, own = np.zeros(len(rank), bool), np.arange(len(rank))
    while len(own):
        won = np.ones(len(own), bool)
        won[1:] &= (rank[1:] < rank[:-1]) | ~joined[:-1]
        won[:-1] &= (rank[:-1] < rank[1:]) | ~joined[:-1]
        taken[own[won]] = True
        out = won.copy()
        out[1:] |= won[:-1] & joined[:-1]
        out[:-1] |= won[1:] & joined[:-1]
        rest = np.flatnonzero(~out)
        own, rank = own[rest], rank[rest]
        joined = np.append(joined[rest[:-1]] & (rest[1:] == rest[:-1] + 1), False) if len(rest) else joined[:0]
    return taken


def compress(ids: np.ndarray, terminals: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols, and rules as pairs of symbols. The end id stays by itself, so documents keep their bounds."""
    n, rules, known = len(ids), [], terminals
    s = np.append(ids.astype(np.uint32), np.uint32(end))  # place n: no neighbour
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[n] = before[0] = n
    live = np.ones(n + 1, bool)
    live[n] = False
    todo = np.arange(n)
    while len(todo):
        left, right = s[todo], s[after[todo]]
        key = left.astype(U64) << U64(32) | right
        free = (left != end) & (right != end)
        todo, key = todo[free], key[free]
        chosen, count, number = _frequent(key)
        hit = np.flatnonzero(number >= 0)
        if not len(hit):
            break
        todo, number = todo[hit], number[hit]
        joined = np.append(after[todo[:-1]] == todo[1:], False)
        # Every second place of a run of equal pairs stands behind its neighbours.
        same = np.flatnonzero(joined[:-1] & (number[1:] == number[:-1])) + 1
        odd = np.zeros(len(todo), np.int32)
        if len(same):
            start = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1] + 1)))
            odd[same] = 1 - (np.arange(len(same)) - np.repeat(start, np.diff(np.append(start, len(same))))) % 2
            count = count - np.bincount(number[same[odd[same] == 1]], minlength=len(chosen))
        standing = np.empty(len(chosen), np.int32)
        standing[np.argsort(-count, kind="stable")] = np.arange(len(chosen), dtype=np.int32)
        if (count < LEAST).any():
            own = (count >= LEAST)[number]
            joined = np.append(joined[:-1] & own[1:], False)[own]
            todo, number, odd = todo[own], number[own], odd[own]
        taken = _apart(2 * standing[number] + odd, joined)
        enough = np.bincount(number[taken], minlength=len(chosen)) >= LEAST
        if not enough.any():
            break
        taken &= enough[number]
        symbol = (np.cumsum(enough) - 1 + known).astype(np.uint32)
        place = todo[taken]
        gone = after[place]
        s[place] = symbol[number[taken]]
        live[gone] = False
        after[place] = after[gone]
        before[after[place]] = place
        rules.append(np.stack([chosen[enough] >> U64(32), chosen[enough] & U64(0xFFFFFFFF)], 1).astype(np.uint32))
        known += int(enough.sum())
        todo = _places(live, place, before[place], todo[~taken])
    return s[live], np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def _places(live: np.ndarray, *parts: np.ndarray) -> np.ndarray:
    """The distinct places of all parts that are live, ascending."""
    if 8 * sum(map(len, parts)) > len(live):
        mark = np.zeros(len(live), bool)
        for p in parts:
            mark[p] = True
        return np.flatnonzero(mark & live)
    out = np.sort(np.concatenate(parts))
    return out[np.append(out[1:] != out[:-1], True) & live[out]] if len(out) else out


def lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Ids that each rule stands for."""
    out = np.ones(terminals + len(rules), np.int64)
    for first, last in _rounds(rules, terminals):
        out[terminals + first : terminals + last] = out[rules[first:last]].sum(axis=1)
    return out[terminals:]


def _rounds(rules: np.ndarray, terminals: int):
    """Ranges of rules that only use symbols before the range."""
    first = 0
    reach = np.maximum.accumulate(rules.max(axis=1).astype(np.int64)) if len(rules) else np.zeros(0)
    while first < len(rules):
        last = max(first + 1, int(np.searchsorted(reach, terminals + first)))
        yield first, last
        first = last


def _gather(pool: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.cumsum(size)
    return pool[np.arange(int(total[-1]) if len(total) else 0) + np.repeat(first - (total - size), size)]


class Grammar:
    """Expands symbols; only the rules are expanded beforehand, so any part of a sequence can be read alone."""

    def __init__(self, rules: np.ndarray, expansion: np.ndarray, terminals: int):
        self.size = np.concatenate((np.ones(terminals, np.int64), expansion))
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        self.pool = np.zeros(int(self.at[-1]), np.uint32)
        self.pool[:terminals] = np.arange(terminals)
        for first, last in _rounds(rules, terminals):
            parts = rules[first:last].ravel()
            self.pool[self.at[terminals + first] : self.at[terminals + last]] = _gather(self.pool, self.at[parts], self.size[parts])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return _gather(self.pool, self.at[symbols], self.size[symbols])


def packed(symbols: np.ndarray) -> bytes:
    """Low 16 bits of all symbols, then their high bits: a byte each, or two where a symbol needs them."""
    high = symbols >> np.uint32(16)
    return symbols.astype("<u2").tobytes() + high.astype(np.uint8 if high.max(initial=0) < 256 else "<u2").tobytes()


def unpacked(data: bytes, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Symbols first to last of the n that packed() was given."""
    last = n if last is None else last
    size = len(data) // n - 2 if n else 1
    low = np.frombuffer(data, "<u2", last - first, 2 * first).astype(np.uint32)
    return low | np.frombuffer(data, np.uint8 if size == 1 else "<u2", last - first, 2 * n + size * first).astype(np.uint32) << np.uint32(16)
