"""XXH64 of many spans of one byte buffer at once, after the public specification of the algorithm."""

from __future__ import annotations

import numpy as np
import xxhash

from .words import eights

U64 = np.uint64
#: Spans of so many bytes go to the library one at a time.
LONG = 1 << 12
# The primes that the XXH64 specification fixes.
P1, P2, P3, P4, P5 = (U64(int(x, 16)) for x in ("9E3779B185EBCA87", "C2B2AE3D27D4EB4F", "165667B19E3779F9", "85EBCA77C2B2AE63", "27D4EB2F165667C5"))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return x << U64(r) | x >> U64(64 - r)


def _round(acc, word):
    return _rot(acc + word * P2, 31) * P1


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    size = ends - starts
    at = starts.astype(np.int64)
    word = eights(buf)
    alone = np.flatnonzero(size >= LONG)
    s = U64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(at), s + P5)
        long = np.flatnonzero((size >= 32) & (size < LONG))
        if len(long):
            lanes = np.tile(np.array([s + P1 + P2, s + P2, s, s - P1], U64)[:, None], (1, len(long)))
            left, place, own = size[long] // 32, at[long].copy(), np.arange(len(long))
            while len(own):
                for j in range(4):
                    lanes[j, own] = _round(lanes[j, own], word[place[own] + 8 * j])
                place[own] += 32
                left[own] -= 1
                own = own[left[own] > 0]
            acc = _rot(lanes[0], 1) + _rot(lanes[1], 7) + _rot(lanes[2], 12) + _rot(lanes[3], 18)
            for j in range(4):
                acc = (acc ^ _round(U64(0), lanes[j])) * P1 + P4
            h[long] = acc
            at[long] = place
        h += size.astype(U64)
        rest = ends - at
        rest[alone] = 0
        for _ in range(3):
            own = np.flatnonzero(rest >= 8)
            if not len(own):
                break
            h[own] = _rot(h[own] ^ _round(U64(0), word[at[own]]), 27) * P1 + P4
            at[own] += 8
            rest[own] -= 8
        own = np.flatnonzero(rest >= 4)
        h[own] = _rot(h[own] ^ (word[at[own]] & U64(0xFFFFFFFF)) * P1, 23) * P2 + P3
        at[own] += 4
        rest[own] -= 4
        for _ in range(3):
            own = np.flatnonzero(rest > 0)
            if not len(own):
                break
            h[own] = _rot(h[own] ^ (word[at[own]] & U64(0xFF)) * P5, 11) * P1
            at[own] += 1
            rest[own] -= 1
        h = (h ^ h >> U64(33)) * P2
        h = (h ^ h >> U64(29)) * P3
        h = h ^ h >> U64(32)
    for i in alone.tolist():
        h[i] = xxhash.xxh64_intdigest(memoryview(buf[starts[i] : ends[i]]), seed)
    return h
