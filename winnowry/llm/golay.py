"""Keys of 64-bit fingerprints from the perfect (23, 12, 7) Golay code.

Every 23-bit word lies within 3 bits of exactly one codeword. Two words one bit apart decode alike, or one of
them has the other's codeword among those of its 24 nearest words; as their parities differ, it is enough that
words of even parity give all of these (6 at most) and words of odd parity their own. A fingerprint is cut into
three segments, each padded with zeros to 23 bits. When two fingerprints differ in 3 bits or fewer, either
every segment has one error at most, or one segment has more and of the others one has at most one error and
the other none. So they share a key of three codewords, or one of a codeword and an equal segment.
"""

from __future__ import annotations

import functools

import numpy as np

from .words import mix

U64 = np.uint64
#: Bits of each segment, from the low end.
SEGMENTS = (22, 21, 21)
#: Generator polynomial of the code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1: a fixed value.
GENERATOR = 0b110001110101


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainder modulo the generator by high 12 bits and by low 11 bits, and the error of each remainder."""
    base = []
    for i in range(23):
        r = 1 << i
        for b in range(i, 10, -1):
            if r >> b & 1:
                r ^= GENERATOR << b - 11
        base.append(r)
    high = np.zeros(1 << 12, np.uint16)
    for i in range(12):
        high[1 << i : 1 << i + 1] = high[: 1 << i] ^ base[11 + i]
    one = np.array(base)
    bit = 1 << np.arange(23)
    error = np.zeros(1 << 11, np.int64)
    for i in range(23):
        error[one[i]] = bit[i]
        for j in range(i):
            error[one[i] ^ one[j]] = bit[i] | bit[j]
            for k in range(j):
                error[one[i] ^ one[j] ^ one[k]] = bit[i] | bit[j] | bit[k]
    return high, np.arange(1 << 11, dtype=np.uint16), error


def decode(word: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    high, low, error = tables()
    return (word ^ error[high[word >> 11] ^ low[word & 0x7FF]]) >> 11


def segment_keys(word: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, codeword index) of the keys of each segment."""
    own = decode(word)
    even = np.flatnonzero(np.bitwise_count(word) % 2 == 0)
    near = decode(word[even][:, None] ^ (1 << np.arange(bits)))
    near = np.sort(np.concatenate((own[even][:, None], near), axis=1), axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    odd = np.flatnonzero(np.bitwise_count(word) % 2 == 1)
    owner = np.concatenate((odd, even[np.nonzero(new)[0]]))
    order = np.argsort(owner, kind="stable")
    return owner[order], np.concatenate((own[odd], near[new]))[order]


def _cross(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every key of a with every key of b of the same owner."""
    count = np.bincount(b[0], minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    times = count[a[0]]
    owner = np.repeat(a[0], times)
    step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    return owner, np.repeat(a[1], times) << 12 | b[1][first[owner] + step]


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hashed key): fingerprints within 3 bits of each other share a key."""
    n, at, parts = len(prints), 0, []
    for bits in SEGMENTS:
        parts.append((prints >> U64(at) & U64((1 << bits) - 1)).astype(np.int64))
        at += bits
    near = [segment_keys(p, b) for p, b in zip(parts, SEGMENTS, strict=True)]
    owner, key = _cross(_cross(near[0], near[1], n), near[2], n)
    owners, hashed = [owner], [mix(key.astype(U64) << U64(4))]
    for exact in range(3):
        for fuzzy in range(3):
            if exact != fuzzy:
                o, k = near[fuzzy]
                owners.append(o)
                hashed.append(mix((parts[exact][o] << 12 | k).astype(U64) << U64(4) | U64(1 + 3 * exact + fuzzy)))
    return np.concatenate(owners), np.concatenate(hashed)
