"""Whole texts of an Arrow column as flat numpy arrays: words, their hashes, and hashes of word windows.

Nothing here depends on Spark. Texts lie end to end in one byte buffer; offsets[i]:offsets[i+1] is text i and
a null text is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE, _STEP = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
_powers = np.ones(1, U64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls have length zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and the place of one of each. By sorting, which is faster here than np.unique."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    order = np.argsort(values)
    s = values[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    return s[new], order[new]


def ascending(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending."""
    s = np.sort(values)
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of buf on, as one little-endian number, with zeros after the end. Nothing is copied but buf."""
    buf = np.concatenate((buf, np.zeros(8, np.uint8)))
    return np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))


def ends_of(word: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last eight bytes of spans of n bytes: all there is of up to 16 bytes. A span of fewer than eight has no last ones."""
    short = np.minimum(n, 8)
    a = word[starts] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - (short << 3).astype(U64)))
    b = word[starts + n - short]
    b[n < 8] = 0
    return a, b


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer: every input bit reaches every output bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 256)
        grown = np.full(size, _BASE)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """64-bit hash of each of the disjoint, ascending, non-empty spans of bytes."""
    out = np.empty(len(starts), U64)
    for i in range(0, len(starts), block):
        s, e = starts[i : i + block], ends[i : i + block]
        n = e - s
        first = np.concatenate(([0], np.cumsum(n)[:-1]))
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        got = (buf[place + np.repeat(s, n)].astype(U64) + U64(1)) * powers(int(n.max(initial=0)))[place]
        out[i : i + block] = np.add.reduceat(got, first) + n.astype(U64) * _STEP
    return mix(out)


def span_keys(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each of the non-empty spans; other seeds give independent ones. Not a polynomial: spans of over 16 bytes go by XXH64."""
    from .xxh64 import xxh64

    n = ends - starts
    a, b = ends_of(eights(buf), starts, n)
    out = mix(mix(a + mix(n.astype(U64) + U64(seed) * _BASE)) ^ (b * _STEP + U64(seed)))
    long = np.flatnonzero(n > 16)
    if len(long):
        out[long] = xxh64(buf, starts[long], ends[long], seed)
    return out


@dataclass
class Words:
    """Words of all texts: byte spans, and the range of words of each text."""

    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray  # words[offsets[i]:offsets[i+1]] are those of text i

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def left(self) -> np.ndarray:
        """For each word, how many words of its text are left, itself included."""
        return np.repeat(self.offsets[1:], self.counts) - np.arange(len(self.starts))


def segment(buf: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes outside breaks; a run ends with its text."""
    if not len(buf):
        zero = np.zeros(0, np.int64)
        return Words(zero, zero, np.zeros(len(offsets), np.int64))
    inside = ~breaks[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size hashes; runs may cross texts, which callers mask out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = hashes[:n].copy()
    for j in range(1, size):
        h *= _STEP
        h += hashes[j : j + n]
    return mix(h)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    step = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def covered(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which places at least one of the spans covers."""
    step = np.zeros(length + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0
