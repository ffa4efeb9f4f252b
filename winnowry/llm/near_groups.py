"""Near-duplicate texts by exact similarity: SimHash fingerprints with Golay keys propose pairs, the sets of word shingles decide.

1. A text's set is the XXH64 hashes of its word shingles. Texts with equal sets are one node from here on.
2. A node's fingerprint has BITS bits, each set if over half of the set's hashes, mixed anew for each 64 bits, have it.
   Texts of a Jaccard similarity of 0.8 differ in 15 % of the bits (155 of 1024), unlike ones in half.
3. Fixed permutations cut the fingerprint into segments of 23 bits. The codeword of the Golay code nearest to a segment
   (golay.py) is a key, with exact further bits where there are many nodes; layout() says how many.
4. Owners of the key space check all nodes that share a key: those whose sizes allow a similarity of SIMILARITY and
   whose fingerprints differ in RADIUS bits or fewer are candidates.
5. Candidates of a Jaccard similarity of SIMILARITY or more are edges; their components are the groups.

ROUNDS compare neighbours by size under a few keys first, so that groups of near copies join there. The last round then
compares all nodes of a key that are in different groups, under all keys: nothing that shares a key is left out. Only the
sets of candidates are moved.

Nulls: a null text has no shingles, and texts without any are one node; a null doc_id names no group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .components import components
from .golay import decode
from .shared import BROADCAST_ROWS, freed, stash, width
from .words import U64, flat, mix, segment
from .xxh64 import xxh64

SIMILARITY = 0.8
WORDS = 16
BITS = 64 * WORDS
#: Of the first 64 bits, the first 128 and all of them, how many may differ. Sets of under SMALL shingles differ in more.
RADIUS_64, RADIUS_128, RADIUS = 28, 42, 202
SMALL, RADIUS_SMALL = 64, 252
#: How many nodes are to share a key at most, on average.
CELL = 256
#: Chances at a similarity of 0.8 that a segment gives one codeword and that a bit is equal, and that no key is shared.
ONE_WORD, ONE_BIT, MISS = 0.12, 0.848, 1e-6
#: Keys and places (by size, under one key) that the first rounds look at.
ROUNDS = ((8, 4), (16, 8))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BATCH = 1 << 20
_PAIRS = 1 << 21
_LANES = U64(0x0101010101010101)
_SEEDS = np.random.default_rng(8).integers(0, 1 << 63, WORDS).astype(U64)


def shingle_hashes(buf: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The hash of each shingle (of all words where they are fewer), the number of its text, and how many texts there are."""
    words = segment(buf, offsets)
    if not len(words.starts):
        return np.zeros(0, U64), np.zeros(0, np.int64), len(offsets) - 1
    # Words with one space after each, so that a shingle is a span.
    size = words.ends - words.starts
    at = np.concatenate(([0], np.cumsum(size + 1)))
    joined = np.full(int(at[-1]), 32, np.uint8)
    shift = np.repeat(words.starts - at[:-1], size)
    place = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
    joined[place] = LOWER[buf[place + shift]]
    left = words.left()
    count = words.counts
    short = count < shingle
    start = np.flatnonzero((left >= shingle) | (np.repeat(short, count) & (left == np.repeat(count, count))))
    span = np.minimum(left[start], shingle)
    h = xxh64(joined, at[start], at[start + span] - 1, 42)
    return h, np.searchsorted(words.offsets, start, side="right") - 1, len(count)


def sets(column: pa.Array, shingle: int):
    """In parts of a column: number of the first text, hashes in order, and the bounds of each text's in them."""
    buf, offsets = flat(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _BATCH, side="right")) - 1)
        h, own, n = shingle_hashes(buf[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], shingle)
        order = np.lexsort((h, own))
        h, own = h[order], own[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
        h, own = h[new], own[new]
        yield first, h, np.concatenate(([0], np.cumsum(np.bincount(own, minlength=n)))).astype(np.int64)
        first = last


def names(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    out = np.zeros(len(at) - 1, U64)
    has = np.flatnonzero(np.diff(at))
    if len(has):
        out[has] = xxh64(np.ascontiguousarray(h).view(np.uint8), 8 * at[has], 8 * at[has + 1], 42)
    return out


def fingerprints(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of WORDS numbers for each set, zero for an empty one."""
    out = np.zeros((len(at) - 1, WORDS), U64)
    size = np.diff(at)
    has = np.flatnonzero(size)
    if not len(has):
        return out
    size = size[has]
    # Blocks of 255 hashes at most, so that eight counts of a byte each fit a number.
    blocks = -(-size // 255)
    first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    start = np.repeat(at[has], blocks) + 255 * (np.arange(int(blocks.sum())) - np.repeat(first, blocks))
    count = np.empty((len(start), 64), np.uint8)
    for w in range(WORDS):
        word = mix(h ^ _SEEDS[w])
        for bit in range(8):
            count[:, bit::8] = np.add.reduceat(word >> U64(bit) & _LANES, start).view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(count, first, axis=0, dtype=np.int64)
        out[has, w] = np.packbits(2 * total > size[:, None], axis=1, bitorder="little").view(U64).ravel()
    return out


def layout(nodes: int) -> tuple[int, int]:
    """How many keys a node gets, and how many exact bits follow the codeword in each, so that CELL nodes share one on average."""
    extra = max(0, math.ceil(math.log2(max(1, nodes) / (CELL << 12))))
    return math.ceil(math.log(MISS) / math.log(1 - ONE_WORD * ONE_BIT**extra)), extra


def cell_keys(prints: np.ndarray, keys: int, extra: int) -> np.ndarray:
    """A row of hashed keys for each fingerprint: of each segment its number, the nearest codeword and the exact bits."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
    long = 23 + extra
    each = BITS // long
    out = np.empty((len(prints), keys), U64)
    for turn in range(-(-keys // each)):
        order = np.random.default_rng((9, turn)).permutation(BITS)
        n = min(each, keys - turn * each)
        parts = bits[:, order[: n * long]].reshape(len(prints), n, long)
        word = parts[:, :, :23].astype(np.int64) @ (1 << np.arange(23))
        rest = parts[:, :, 23:].astype(np.int64) @ (1 << np.arange(extra))
        key = decode(word) << extra | rest
        out[:, turn * each : turn * each + n] = mix(key.astype(U64) << U64(16) | np.arange(turn * each, turn * each + n).astype(U64))
    return out


def _keyed(rows: DataFrame, shingle: int) -> DataFrame:
    """doc_id, node, size and fingerprint of each row of (doc_id, text)."""

    def keyed(batches):
        for b in batches:
            for first, h, at in sets(b.column(1), shingle):
                size = np.diff(at)
                prints = pa.array([p.tobytes() for p in fingerprints(h, at)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(size)), pa.array(names(h, at).view(np.int64)), pa.array(size), prints], names=["doc_id", "node", "size", "print"])

    return rows.mapInArrow(freed(keyed), "doc_id long, node long, size long, print binary")


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """node and hashes (8 bytes each, in order) of each row of (doc_id, text) that has any."""

    def held(batches):
        for b in batches:
            for _, h, at in sets(b.column(1), shingle):
                node = names(h, at).view(np.int64)
                has = np.flatnonzero(np.diff(at))
                for i in range(0, len(has), 1000):
                    some = has[i : i + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array([h[at[k] : at[k + 1]].tobytes() for k in some], pa.binary())], names=["node", "hashes"])

    return rows.mapInArrow(freed(held), "node long, hashes binary")


def similar(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a Jaccard similarity of SIMILARITY or more."""

    def verified(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for k in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[k].as_buffer(), U64) for c in (2, 3))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep[k] = both / (len(x) + len(y) - both) >= SIMILARITY
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))

    both = pairs.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(freed(verified), "a long, b long")


def _alike(label: np.ndarray, size: np.ndarray, bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) of places have different labels, sizes that allow SIMILARITY, and first 128 bits that are near."""
    keep = np.flatnonzero((label[a] != label[b]) & (np.minimum(size[a], size[b]) >= SIMILARITY * np.maximum(size[a], size[b])))
    near = np.bitwise_count(bits[a[keep], 0] ^ bits[b[keep], 0])
    keep, near = keep[near <= RADIUS_64], near[near <= RADIUS_64]
    return keep[near + np.bitwise_count(bits[a[keep], 1] ^ bits[b[keep], 1]) <= RADIUS_128]


def _compared(key: np.ndarray, node: np.ndarray, label: np.ndarray, size: np.ndarray, bits: np.ndarray, places: int | None):
    """Pairs of nodes that are alike among those that share a key: all of different labels, or those up to some places apart by size."""
    order = np.lexsort((node, size, key) if places else (label, key))
    key, node, label, size, bits = key[order], node[order], label[order], size[order], bits[order]
    if places:
        for step in range(1, places + 1):
            a = np.flatnonzero(key[step:] == key[:-step])
            a = a[_alike(label, size, bits, a, a + step)]
            yield node[a], node[a + step]
        return
    # Each goes with all that follow its label's run in its key.
    new = np.concatenate(([True], key[1:] != key[:-1], [True]))
    run = new.copy()
    run[1:-1] |= label[1:] != label[:-1]
    place = np.arange(len(key))
    ends, low = (e[np.searchsorted(e, place, side="right")] for e in (np.flatnonzero(new), np.flatnonzero(run)))
    to = np.concatenate(([0], np.cumsum(ends - low)))
    i = 0
    while i < len(key) and to[i] < to[-1]:
        j = max(i + 1, int(np.searchsorted(to, to[i] + _PAIRS, side="right")) - 1)
        a = np.repeat(np.arange(i, j), np.diff(to[i : j + 1]))
        b = low[a] + np.arange(len(a)) - (to[a] - to[i])
        keep = _alike(label, size, bits, a, b)
        yield node[a[keep]], node[b[keep]]
        i = j


def _dealt(node: np.ndarray, rows: np.ndarray, n: int, kind: int) -> pa.RecordBatch:
    """Rows of numbers as one packed row a bucket of their nodes."""
    order, at = C.by_bucket(mix(node.view(U64)), n)
    rows = np.ascontiguousarray(rows[order])
    used = np.flatnonzero(np.diff(at)).tolist()
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([kind] * len(used), pa.int32()), pa.array([rows[at[k] : at[k + 1]].tobytes() for k in used], pa.binary())], names=["bucket", "kind", "payload"])


def _meet(batches):
    """For each bucket the prints of its nodes, ascending by node, and the rows that ask for them, each once."""
    held = {}
    for b in batches:
        for k, kind, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held.setdefault(k, ([], []))[kind].append(np.frombuffer(p, np.int64))
    for k in list(held):
        told, asked = held.pop(k)
        if asked:
            told = np.concatenate(told).reshape(-1, 2 + WORDS)
            yield told[np.argsort(told[:, 0])], asked


def candidates(nodes: DataFrame, keys: int, extra: int, places: int | None) -> DataFrame:
    """Pairs (a, b) of nodes (node, label, size, print) of different labels that share a key and are near by size and fingerprint.

    Three exchanges of packed rows: the owners of keys give pairs that are near by 128 bits, those of a drop repeated
    pairs and add a's fingerprint, those of b compare the whole of it.
    """
    n = width(nodes.sparkSession)

    def fields(b):
        node, label, size = (b.column(c).to_numpy() for c in range(3))
        return node, label, size, np.array([np.frombuffer(p.as_buffer(), U64) for p in b.column(3)], U64).reshape(-1, WORDS)

    def keyed(batches):
        for batch in batches:
            node, label, size, prints = fields(batch)
            for i in range(0, len(node), 1 << 12):
                some = cell_keys(prints[i : i + (1 << 12)], keys, extra)
                key, own = some.ravel(), np.repeat(np.arange(i, i + len(some)), keys)
                order, at = C.by_bucket(key, n)
                own = own[order]
                parts = key.astype(np.uint32)[order], node[own], mix(label.view(U64)).astype(np.uint32)[own], size.astype(np.uint32)[own], np.ascontiguousarray(prints[own, :2])
                used = np.flatnonzero(np.diff(at)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array([x[at[k] : at[k + 1]].tobytes() for k in used], pa.binary()) for x in parts)], names=["bucket", "key", "node", "label", "size", "bits"])

    def near(batches):
        held = {}
        for b in batches:
            for k, *parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(k, []).append(parts)
        for k in list(held):
            parts = [np.concatenate([np.frombuffer(p, t) for p in x]) for x, t in zip(zip(*held.pop(k), strict=True), (np.uint32, np.int64, np.uint32, np.uint32, U64), strict=True)]
            for a, b in _compared(*parts[:4], parts[4].reshape(-1, 2), places):
                pairs = np.column_stack((np.minimum(a, b), np.maximum(a, b)))
                if len(pairs):
                    yield _dealt(pairs[:, 0].copy(), pairs, n, 1)

    def told(batches):
        for batch in batches:
            node, _, size, prints = fields(batch)
            yield _dealt(node, np.column_stack((node, size, prints.view(np.int64))), n, 0)

    def once(batches):
        for table, asked in _meet(batches):
            pairs = np.concatenate(asked).reshape(-1, 2)
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            pairs = pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(axis=1)))]
            for i in range(0, len(pairs), 1 << 16):
                some = pairs[i : i + (1 << 16)]
                at = np.searchsorted(table[:, 0], some[:, 0])
                yield _dealt(some[:, 1].copy(), np.column_stack((some[:, 1], table[at])), n, 1)

    def checked(batches):
        for table, asked in _meet(batches):
            for rows in asked:
                rows = rows.reshape(-1, 3 + WORDS)
                other = table[np.searchsorted(table[:, 0], rows[:, 0])]
                apart = np.bitwise_count((rows[:, 3:] ^ other[:, 2:]).view(U64)).sum(axis=1, dtype=np.int64)
                rows = rows[apart <= np.where(np.minimum(rows[:, 2], other[:, 1]) < SMALL, RADIUS_SMALL, RADIUS)]
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 1].copy()), pa.array(rows[:, 0].copy())], names=["a", "b"])

    nodes = nodes.select("node", "label", "size", "print")
    meet = lambda rows: rows.repartitionById(n, F.col("bucket"))
    packed = "bucket int, kind int, payload binary"
    prints = nodes.mapInArrow(freed(told), packed)
    pairs = meet(nodes.mapInArrow(freed(keyed), "bucket int, key binary, node binary, label binary, size binary, bits binary")).mapInArrow(freed(near), packed)
    asked = meet(prints.unionAll(pairs)).mapInArrow(freed(once), packed)
    return meet(prints.unionAll(asked)).mapInArrow(freed(checked), "a long, b long")


def _few(table: DataFrame) -> DataFrame:
    """A stashed table, broadcast while it is short."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _held(rows: DataFrame, own: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """node and hashes of the nodes of pairs, from one text each."""
    wanted = _few(stash(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct(), "wanted"))
    ids = _few(stash(own.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("_id")).select("_id").distinct(), "ids"))
    texts = rows.join(ids, rows["doc_id"].eqNullSafe(ids["_id"]), "left_semi")
    return stash(_sets(texts, shingle).join(wanted, "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes")), "held")


def groups(rows: DataFrame, shingle: int) -> DataFrame:
    """For each row of (doc_id, text) doc_id and component_id, the least doc_id of those that similar pairs join."""
    own = stash(_keyed(rows, shingle), "sets")
    nodes = stash(own.where("size > 0").groupBy("node").agg(F.first("size").alias("size"), F.first("print").alias("print")), "nodes")
    keys, extra = layout(nodes.count())
    labelled, tested, edges = nodes.withColumn("label", F.col("node")), None, None
    for some, places in (*ROUNDS, (keys, None)):
        pairs = candidates(labelled, some, extra, places)
        pairs = stash(pairs.join(tested, ["a", "b"], "left_anti") if tested is not None else pairs, "pairs")
        tested = tested.unionAll(pairs) if tested is not None else pairs
        found = stash(similar(pairs, _held(rows, own, pairs, shingle)), "similar")
        edges = edges.unionAll(found) if edges is not None else found
        root = components(edges)
        labelled = nodes.join(root, "node", "left").select("node", "size", "print", F.coalesce("root", "node").alias("label"))
    least = own.groupBy("node").agg(F.min("doc_id").alias("least")).join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    least = stash(least, "least")
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.select("doc_id", "node").join(least.join(named, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
