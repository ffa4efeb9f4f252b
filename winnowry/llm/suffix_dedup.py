"""Exact repeats of byte strings: threshold-bounded interval expansion on a Burrows-Wheeler transform.

A repeat of `least` bytes holds, in both places, the same least-hashed gram of its first window (its anchor), so
only strings around a gram that is some window's anchor twice in the corpus need to meet.

1. Chunks send the hashes of their anchors to the owners of the hash space; owners answer which occur again, and
   which occur HOT times or more.
2. Around each of these a chunk sends the bytes of all windows that have it as anchor (its context). Equal
   contexts become one with a count; an owner joins the distinct ones of an anchor, builds their transform
   (bwt.py) and expands intervals until common prefixes reach the minimum. Windows of a context that occurs
   more than once are repeats by its count, whatever the transform finds.
3. Chunks cut out the union of the repeats.

The windows of a hot anchor are dealt by more of their bytes: by the place of the anchor in them, in CLASSES ranges,
and by all bytes that the windows of a range have in common around the anchor (seven eighths of a window). Equal
windows meet as before, but a gram that a third of all texts hold doesn't bring their surroundings into one task.

A context is at most 2 * least - gram bytes, however long the text, and copies of it travel as positions, so
neither a long run of one byte nor thousands of copies make the exchanged bytes grow with their square.

Nulls: a null text is empty; a null doc_id is returned as null. Repeated rows repeat each other. An empty table
gives an empty result. A very long text is scanned in parts that overlap. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks as C
from .bwt import long_common
from .shared import freed, table
from .substring_dedup import runs_by_text
from .words import U64, covered, flat, mix

GRAM = 16
#: Symbols that one transform covers; groups of an anchor stay together.
TRANSFORM = 1 << 18
BLOCK = 1 << 20
#: Places of an anchor from which on its windows are dealt by more bytes, and the ranges of its place in a window then.
HOT, CLASSES = 1 << 14, 8
SCHEMA = "doc_id long, n_bytes long, n_removed long, kept binary, spans array<struct<start:long,end:long>>"


def _grams(buf: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place of buf (its last GRAM - 1 places have none)."""
    h = buf.astype(U64)
    for j in (1, 2, 4):
        h = h[:-j] | h[j:] << U64(8 * j)
    return mix(h[:-8] * U64(0x9E3779B97F4A7C15) + mix(h[8:]))


def _least(h: np.ndarray, size: int) -> np.ndarray:
    """Place of the least value, the leftmost of equals, in each window of h."""
    key = (h >> U64(32)) << U64(32) | np.arange(len(h), dtype=U64)
    width = 1
    while 2 * width <= size:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < size:
        key = np.minimum(key[: len(key) - (size - width)], key[size - width :])
    return (key & U64(0xFFFFFFFF)).astype(np.int64)


def anchors(buf: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each anchor, the start and end of the bytes of the windows that have it, and its place."""
    hashes, starts, ends, places = [], [], [], []
    size = least - GRAM + 1
    for first, last in _spans(offsets, least):
        h = _grams(buf[first:last])
        at = _least(h, size)  # anchor of the window from each place
        inner = offsets[(offsets > first) & (offsets < last)] - first
        if len(inner):
            crosses = np.zeros(len(at), bool)
            for e in inner.tolist():
                crosses[max(0, e - least + 1) : e] = True
            own = np.flatnonzero(~crosses)
        else:
            own = np.arange(len(at))
        if not len(own):
            continue
        new = np.flatnonzero(np.concatenate(([True], (at[own[1:]] != at[own[:-1]]) | (own[1:] != own[:-1] + 1))))
        hashes.append(mix(h[at[own[new]]] + U64(1)))
        starts.append(own[new] + first)
        ends.append(own[np.append(new[1:], len(own)) - 1] + first + least)
        places.append(at[own[new]] + first)
    if not hashes:
        return np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3))
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends), np.concatenate(places)


def parted(data: bytes, start: int, end: int, place: int, least: int):
    """(key, start, end) of the windows between start and end by the range in which the place of their anchor lies."""
    edges = [k * (least - GRAM + 1) // CLASSES for k in range(CLASSES + 1)]
    for k, (a, b) in enumerate(itertools.pairwise(edges)):  # the anchor is a to b - 1 bytes after a window's start
        first, last = max(start, place - b + 1), min(end - least, place - a)
        if first <= last:
            yield xxhash.xxh64_intdigest(data[place - a : place - b + 1 + least], k), first, last + least


def _spans(offsets: np.ndarray, least: int):
    """Ranges of bytes to scan at a time: whole texts, or parts of a long text that overlap by a window less one."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1)
        first, last = int(offsets[i]), int(offsets[j])
        if last - first <= BLOCK or j > i + 1:
            if last - first >= least:
                yield first, last
        else:
            while last - first >= least:
                yield first, min(first + BLOCK, last)
                first += BLOCK - least + 1
        i = j


def repeats(contexts: list[bytes], least: int) -> list[np.ndarray]:
    """For each distinct context the starts of its windows that also start elsewhere among contexts."""
    size = np.fromiter(map(len, contexts), np.int64, len(contexts)) + 1
    at = np.concatenate(([0], np.cumsum(size)))
    symbols = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.uint16) + np.uint16(2)
    symbols[at[1:] - 1] = 1
    found = long_common(symbols, least)
    of = np.searchsorted(at, found, side="right") - 1
    place = found - at[of]
    inside = place + least < size[of]
    of, place = of[inside], place[inside]
    return np.split(place, np.searchsorted(of, np.arange(1, len(contexts))))


def dedup_bytes(docs: DataFrame, least: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row its doc_id, n_bytes, n_removed, kept (bytes left) and the removed spans of bytes."""
    if least < 2 * GRAM:
        raise ValueError(f"least must be {2 * GRAM} or more")
    packed = C.pack(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))

    def offer(batch, _, n):
        h = anchors(*flat(batch.column(1)), least)[0]
        order, at = C.by_bucket(h, n)
        low = h.astype(np.uint32)[order]
        for k in np.flatnonzero(np.diff(at)):
            yield int(k), low[at[k] : at[k + 1]].tobytes()

    def shared(asked):
        sent = [np.frombuffer(p, np.uint32) for _, p in asked]
        every = np.sort(np.concatenate(sent))
        first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        count = np.diff(np.append(first, len(every)))
        again, often = every[first[count > 1]], every[first[count >= HOT]]
        for (c, _), s in zip(asked, sent, strict=True):
            hit = C.among(s, again)
            if hit.any():
                yield c, np.packbits(hit).tobytes() + (np.packbits(C.among(s, often)).tobytes() if len(often) else b"")

    hit = C.answer(C.ask(packed, offer), shared, "anchors")

    def contexts(batch, got, n):
        if not got:
            return
        buf, offsets = flat(batch.column(1))
        h, starts, ends, where = anchors(buf, offsets, least)
        order, at = C.by_bucket(h, n)
        data = buf.tobytes()
        sent: dict[int, dict] = defaultdict(lambda: defaultdict(list))
        for k, bits in got.items():
            mine = order[at[k] : at[k + 1]]
            bits, size = np.frombuffer(bits, np.uint8), -(-len(mine) // 8)
            hit = np.unpackbits(bits[:size], count=len(mine)).view(bool)
            hot = np.unpackbits(bits[size:], count=len(mine)).view(bool) if len(bits) > size else np.zeros(len(mine), bool)
            some = mine[hit & ~hot]
            for a, s, e in zip(h[some].tolist(), starts[some].tolist(), ends[some].tolist(), strict=True):
                sent[k][a, data[s:e]].append(s)
            some = mine[hit & hot]
            for s, e, p in zip(starts[some].tolist(), ends[some].tolist(), where[some].tolist(), strict=True):
                for a, first, last in parted(data, s, e, p, least):
                    sent[(a >> 32) * n >> 32][a, data[first:last]].append(first)
        for k, places in sent.items():
            yield k, b"".join((
                np.uint64(len(places)).tobytes(),
                np.array([a for a, _ in places], np.uint64).tobytes(),
                np.array([(len(x), len(p)) for (_, x), p in places.items()], np.uint32).tobytes(),
                np.array([p for ps in places.values() for p in ps], np.uint32).tobytes(),
                b"".join(x for _, x in places),
            ))

    def expand(asked):
        known: dict[int, dict[bytes, list[tuple[int, np.ndarray]]]] = defaultdict(lambda: defaultdict(list))
        for c, p in asked:
            m = int(np.frombuffer(p, np.uint64, 1)[0])
            keys = np.frombuffer(p, np.uint64, m, 8).tolist()
            sizes = np.frombuffer(p, np.uint32, 2 * m, 8 + 8 * m).reshape(m, 2)
            total = int(sizes[:, 1].sum())
            places = np.frombuffer(p, np.uint32, total, 8 + 16 * m)
            i, j = 0, 8 + 16 * m + 4 * total
            for a, (size, count) in zip(keys, sizes.tolist(), strict=True):
                known[a][p[j : j + size]].append((c, places[i : i + count]))
                i, j = i + count, j + size
        spans = defaultdict(list)

        def solve(group):
            for (_, where), found in zip(group, repeats([x for x, _ in group], least), strict=True):
                if len(found):
                    cut = np.flatnonzero(np.diff(found) > least)
                    first, last = found[np.concatenate(([0], cut + 1))], found[np.append(cut, len(found) - 1)] + least
                    for c, at in where:
                        spans[c].append(np.stack([(at[:, None] + first).ravel(), (at[:, None] + last).ravel()], 1))

        group, held = [], 0
        for own in known.values():
            for x, where in own.items():
                if len(where) > 1 or len(where[0][1]) > 1:
                    for c, at in where:
                        spans[c].append(np.stack([at.astype(np.int64), at.astype(np.int64) + len(x)], 1))
            if len(own) > 1:
                group += own.items()
                held += sum(map(len, own))
                if held >= TRANSFORM:
                    solve(group)
                    group, held = [], 0
        if group:
            solve(group)
        for c, s in spans.items():
            yield c, np.concatenate(s).astype(np.uint32).tobytes()

    found = C.answer(C.ask(packed, contexts, hit), expand, "repeats")

    def cut(batches):
        for _, batch, got in C.opened(batches):
            buf, offsets = flat(batch.column(1))
            s = np.concatenate([np.frombuffer(p, np.uint32) for p in got.values()]).reshape(-1, 2).astype(np.int64) if got else np.zeros((0, 2), np.int64)
            drop = covered(len(buf), s[:, 0], s[:, 1])
            first, last = runs_by_text(drop, offsets)
            doc = np.searchsorted(offsets, first, side="right") - 1
            at = np.searchsorted(doc, np.arange(len(offsets)))
            removed = np.concatenate(([0], np.cumsum(drop)))[offsets]
            kept = buf[~drop]
            kept = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer((offsets - removed).astype(np.int64)), pa.py_buffer(kept)])
            base = offsets[doc]
            spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(first - base, pa.int64()), pa.array(last - base, pa.int64())], names=["start", "end"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(np.diff(removed), pa.int64()), kept.cast(pa.binary()), spans], names=["doc_id", "n_bytes", "n_removed", "kept", "spans"])

    return C.joined(packed, found).mapInArrow(freed(cut), SCHEMA)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents without the bytes of its 200-byte strings that also start elsewhere."""
    return dedup_bytes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_suffix_array_dedup": op2_suffix_array_dedup}
