"""Token ids of whole texts, equal to those of the tokenizers library, with each distinct piece encoded once.

A text is cut only where every pre-tokenizer pattern of the supported vocabularies ends a match, whatever stands
around: between a letter and ASCII punctuation, around a single line feed, and before a single space. Pieces then
encode alone as they do inside their text. Each Python worker keeps the bytes and ids of the pieces it has met in
flat arrays, up to a documented bound, and looks them up for millions of pieces at once. A piece is found by a hash
and counts as found only if its bytes are equal; one whose hash is that of another piece is encoded anew. Texts that
hold the string of a special token are given to the library whole.
"""

from __future__ import annotations

import os

import numpy as np

from .words import U64, distinct, eights, ends_of, mix
from .xxh64 import xxh64

#: Pieces that a worker remembers; beyond it the memory starts anew, which costs time only.
REMEMBERED = 1 << 19
#: New pieces that the library gets as one text.
TOGETHER = 1 << 13

ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
PUNCT = np.zeros(256, bool)
PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
PUNCT[0x27] = False  # an apostrophe may begin a contraction
SOLID = ASCII_LETTER | PUNCT
SOLID[[0x27, *range(0x30, 0x3A)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def pieces(buf: np.ndarray, offsets: np.ndarray, spaces: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces. spaces: a single space belongs to the piece after it; else it is left out."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c3 = buf == 0xC3
    letter = ASCII_LETTER[buf]
    lead = np.flatnonzero(c3[:-1])
    lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]  # the signs for times and division
    letter[lead] = letter[lead + 1] = True
    solid = SOLID[buf] | letter
    punct = PUNCT[buf]
    cut = np.zeros(n + 1, bool)
    cut[1:n] = letter[:-1] & punct[1:] | punct[:-1] & letter[1:]
    alone = np.zeros(n, bool)  # white space of one character between solid ones
    alone[1:-1] = solid[:-2] & solid[2:]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    alone &= ~edge[:-1] & ~edge[1:]
    alone[0] = alone[-1] = False
    space = alone & (buf == 0x20)
    feed = np.flatnonzero(alone & (buf == 0x0A))
    cut[:-1] |= space
    cut[feed] = cut[feed + 1] = True
    if not spaces:
        cut[1:] |= space
    cut |= edge
    cut[0] = cut[n] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    if not spaces:
        inside = ~(space[starts] | ((ends - starts == 1) & (buf[starts] == 0x0A)))
        starts, ends = starts[inside], ends[inside]
    return starts, ends


class Pieces:
    """Spans of a buffer: their lengths, first and last eight bytes (all there is of up to 16 bytes) and hashes."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.starts, self.ends, self.n = starts, ends, ends - starts
        self.buf = buf
        self.a, self.b = ends_of(eights(buf), starts, self.n)
        self.h = mix(self.a * U64(0x9E3779B97F4A7C15) + (self.b ^ (self.b >> U64(29))) * U64(0xD6E8FEB86659FD93) + self.n.astype(U64))
        long = np.flatnonzero(self.n > 16)
        if len(long):
            self.h[long] = mix(xxh64(buf, starts[long], ends[long]))

    def bytes_of(self, some: np.ndarray) -> np.ndarray:
        n = self.n[some]
        return self.buf[np.arange(int(n.sum())) + np.repeat(self.starts[some] - (np.cumsum(n) - n), n)]


class Encoder:
    """encode() gives the ids of all texts of a buffer end to end, and where each text's ids start."""

    def __init__(self, path: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.spaces = Tokenizer.from_file(path), spaces
        self.special = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        #: Stands between pieces that are encoded together: one id, which no piece without its character has.
        self.between = "\n" if spaces else " ~ "
        self.mark = self.model.encode(self.between, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self._room(1 << 16)
        self.used = 0
        self.at = np.zeros(1 << 16, np.int64)  # first id of each remembered piece
        self.ids = np.zeros(1 << 18, np.uint32)
        self.a, self.b, self.n, self.from_ = np.zeros(1 << 16, U64), np.zeros(1 << 16, U64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.long, self.long_used = np.zeros(1 << 16, np.uint8), 0  # bytes of pieces of over 16

    def _room(self, slots: int) -> None:
        self.key = np.zeros(slots, U64)
        self.slot = np.full(slots, -1, np.int32)

    def _start(self, h: np.ndarray) -> np.ndarray:
        return (h & U64(len(self.key) - 1)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of the remembered piece of each hash, -1 for others."""
        place, last = self._start(h), len(self.key) - 1
        out = self.slot[place]
        rest = np.flatnonzero((out >= 0) & (self.key[place] != h))
        place = (place[rest] + 1) & last
        while len(rest):
            slot = self.slot[place]
            out[rest] = slot
            go = (slot >= 0) & (self.key[place] != h[rest])
            rest, place = rest[go], (place[go] + 1) & last
        return out

    def _equal(self, number: np.ndarray, p: Pieces) -> np.ndarray:
        """Whether each piece has the bytes of the remembered one."""
        out = (self.a[number] == p.a) & (self.b[number] == p.b) & (self.n[number] == p.n)
        long = np.flatnonzero(out & (p.n > 16))
        if len(long):
            n = p.n[long]
            first = np.cumsum(n) - n
            held = self.long[np.arange(int(n.sum())) + np.repeat(self.from_[number[long]] - first, n)]
            out[long] = np.logical_and.reduceat(held == p.bytes_of(long), first)
        return out

    def _encoded(self, p: Pieces, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces in an order of their own, their ids end to end, and how many each has."""
        data = p.buf.tobytes()
        texts = [data[s:e].decode() for s, e in zip(p.starts[some].tolist(), p.ends[some].tolist(), strict=True)]
        first = p.starts[some] + (p.buf[p.starts[some]] == 0x20)
        head, last, before = p.buf[np.minimum(first, p.ends[some] - 1)], p.buf[p.ends[some] - 1], p.buf[np.maximum(p.ends[some] - 2, p.starts[some])]
        plain = (SOLID[head] | (head == 0xC3)) & (SOLID[last] | (before == 0xC3) & (last >= 0x80))
        sign = self.between.strip(" ")
        plain &= np.fromiter((sign not in t for t in texts), bool, len(texts)) & (len(self.mark) == 1)
        order, ids, sizes = [], [], []
        own = np.flatnonzero(plain)
        for i in range(0, len(own), TOGETHER):
            k = own[i : i + TOGETHER]
            got = np.array(self.model.encode_batch_fast([self.between.join([texts[j] for j in k.tolist()])], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(got == self.mark[0])
            if len(cut) != len(k) - 1:  # cannot happen with the supported vocabularies
                plain[k] = False
                continue
            order.append(k)
            ids.append(got[got != self.mark[0]])
            sizes.append(np.diff(np.concatenate(([-1], cut, [len(got)]))) - 1)
        alone = np.flatnonzero(~plain)
        if len(alone):
            got = [x.ids for x in self.model.encode_batch_fast([texts[k] for k in alone.tolist()], add_special_tokens=False)]
            order.append(alone)
            ids.append(np.array([i for x in got for i in x], np.uint32))
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
        return some[np.concatenate(order)], np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, p: Pieces, some: np.ndarray, named: bool) -> np.ndarray:
        """Remember pieces, named: under their hashes, and return them in the order of their numbers."""
        some, flat, size = self._encoded(p, some)
        first, end = int(self.at[self.used]), self.used + len(some)
        while end + 1 > len(self.at):
            for name in ("at", "a", "b", "n", "from_"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate((old, np.zeros_like(old))))
        while first + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.at[self.used + 1 : end + 1] = first + np.cumsum(size)
        self.ids[first : first + len(flat)] = flat
        self.a[self.used : end], self.b[self.used : end], self.n[self.used : end] = p.a[some], p.b[some], p.n[some]
        n = np.where(p.n[some] > 16, p.n[some], 0)
        total = self.long_used + int(n.sum())
        while total > len(self.long):
            self.long = np.concatenate((self.long, np.zeros_like(self.long)))
        self.from_[self.used : end] = self.long_used + np.cumsum(n) - n
        self.long[self.long_used : total] = p.bytes_of(some[n > 0])
        self.long_used = total
        if named:
            if 2 * end > len(self.key):
                held = self.slot >= 0
                key, slot = self.key[held], self.slot[held]
                self._room(1 << (4 * end - 1).bit_length())
                self._insert(key, slot)
            self._insert(p.h[some], np.arange(self.used, end, dtype=np.int32))
        self.used = end
        return some

    def _insert(self, h: np.ndarray, number: np.ndarray) -> None:
        place, rest, last = self._start(h), np.arange(len(h)), len(self.key) - 1
        while len(rest):
            free = self.slot[place] < 0
            self.slot[place[free]] = number[rest[free]]  # of several the last stays
            took = free & (self.slot[place] == number[rest])
            self.key[place[took]] = h[rest[took]]
            rest, place = rest[~took], (place[~took] + 1) & last

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = []
        data = buf.tobytes()
        if any(s in data for s in self.special):
            whole = [i for i in range(len(offsets) - 1) if any(s in data[offsets[i] : offsets[i + 1]] for s in self.special)]
        p = Pieces(buf if self.spaces else LOWER[buf], *pieces(buf if self.spaces else LOWER[buf], offsets, self.spaces))
        if self.used > REMEMBERED:
            self.forget()
        number = self._find(p.h)
        new = np.flatnonzero(number < 0)
        if len(new):
            h, one = distinct(p.h[new])
            self._learn(p, new[one], True)
            number[new] = self._find(p.h[new])
        odd = np.flatnonzero(~self._equal(number, p))
        if len(odd):
            used = self.used
            number[self._learn(p, odd, False)] = used + np.arange(len(odd), dtype=np.int32)
        first = self.at[number]
        size = self.at[number + 1] - first
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.arange(int(total[-1])) + np.repeat(first - total[:-1], size)]
        bounds = total[np.searchsorted(p.starts, offsets)]
        if whole:
            parts = [ids[bounds[i] : bounds[i + 1]] for i in range(len(offsets) - 1)]
            for i in whole:
                parts[i] = np.array(self.model.encode(data[offsets[i] : offsets[i + 1]].decode(), add_special_tokens=False).ids, np.uint32)
            return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        return ids, bounds


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaces: bool) -> Encoder:
    """The encoder of this worker for a vocabulary file. spaces: whether white space is part of its tokens."""
    if (path, spaces) not in _encoders:
        _encoders[path, spaces] = Encoder(path, spaces)
    return _encoders[path, spaces]
