"""Exact repeats of word sequences, by fixed-block anchors.

1. Every text is cut into words. Non-overlapping blocks of (window + 1) // 2 words are the index; every rolling
   window of that size is a probe. A repeat of `window` words holds a whole block of its first occurrence, so
   the other occurrence probes that block.
2. Hits extend to whole windows: windows of `window` words around a hit are matched, each against the smallest
   doc_id that has it. The union of the windows that match are the maximal repeats.

Blocks and probes travel as 32-bit values inside buckets of the hash space (chunks.py), so the index holds no
document twice in one task and a hot passage costs one entry a chunk. A probe's false hit only adds a window to
step 2, which decides. There a chunk names each distinct window once, with the least of its own doc_ids, by two
independent 64-bit hashes of the words; of 10^13 windows the chance that any two unlike ones agree in both is 10^-13.

Nulls: a null text has no words; a null doc_id counts as larger than any other and is returned as null. Repeated
rows with one doc_id don't count as earlier than each other. An empty table gives an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks as C
from .shared import freed, table
from .words import covered, flat, runs, segment, span_keys, windows

LAST = np.iinfo(np.int64).max
SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:long,end:long>>"


def _read(batch: pa.RecordBatch):
    buf, offsets = flat(batch.column(1))
    words = segment(buf, offsets)
    return buf, words, span_keys(buf, words.starts, words.ends)


class Found:
    """The windows of a batch that hold a block hit, and the distinct ones: two hashes and the least doc_id of each."""

    def __init__(self, batch: pa.RecordBatch, size: int, block: int, hits: dict[int, bytes], n: int):
        buf, words, hashes = _read(batch)
        self.start = _candidates(words, hashes, size, block, hits, n)
        h = windows(hashes, size)[self.start]
        other = windows(span_keys(buf, words.starts, words.ends, 1), size)[self.start]
        self.doc = batch.column(0).fill_null(LAST).to_numpy()[np.searchsorted(words.offsets, self.start, side="right") - 1]
        order = np.argsort(h)
        if len(h) and ((h[order][1:] == h[order][:-1]) & (other[order][1:] != other[order][:-1])).any():
            order = np.lexsort((other, h))
        first = starts_of(h[order], other[order])
        self.h, self.other = h[order][first], other[order][first]
        self.least = np.minimum.reduceat(self.doc[order], first) if len(first) else self.doc[:0]
        self.of = np.empty(len(h), np.int64)  # number of each window's distinct one
        self.of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        self.order, self.at = C.by_bucket(self.h, n)


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _candidates(words, hashes, size, block, hits: dict[int, bytes], n: int) -> np.ndarray:
    """Starts of the windows that hold a block hit."""
    probes = np.flatnonzero(words.left() >= block)
    h = windows(hashes, block)[probes]
    order, at = C.by_bucket(h, n)
    hit = np.zeros(len(hashes) + size, bool)
    for k, got in hits.items():
        mine = order[at[k] : at[k + 1]]
        hit[probes[mine[np.unpackbits(np.frombuffer(got, np.uint8), count=len(mine)).view(bool)]]] = True
    inside = np.zeros(len(hashes), bool)
    for j in range(size - block + 1):
        inside |= hit[j : j + len(hashes)]
    return np.flatnonzero(inside & (words.left() >= size))


def dedup_substrings(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row its doc_id, n_words, n_removed, kept_text (kept words joined by a space) and the removed spans of words."""
    block = (window + 1) // 2
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    packed = C.pack(rows)

    def probe(batch, _, n):
        _, words, hashes = _read(batch)
        left = words.left()
        probes = np.flatnonzero(left >= block)
        h = windows(hashes, block)[probes]
        order, at = C.by_bucket(h, n)
        place = probes - np.repeat(words.offsets[:-1], words.counts)[probes]
        low, anchor = h.astype(np.uint32)[order], (place % block == 0)[order]
        for k in np.flatnonzero(np.diff(at)):
            mine = slice(at[k], at[k + 1])
            some = low[mine]
            yield int(k), np.uint32(len(some)).tobytes() + some.tobytes() + some[anchor[mine]].tobytes()

    def hits(asked):
        probes, blocks = [], []
        for _, p in asked:
            a = np.frombuffer(p, np.uint32)
            probes.append(a[1 : 1 + a[0]])
            blocks.append(a[1 + a[0] :])
        both = np.intersect1d(C.repeated(np.concatenate(probes)), np.concatenate(blocks))
        for (c, _), p in zip(asked, probes, strict=True):
            hit = C.among(p, both)
            if hit.any():
                yield c, np.packbits(hit).tobytes()

    hit = C.answer(C.ask(packed, probe), hits, "anchors")

    def extend(batch, got, n):
        if not got:
            return
        found = Found(batch, window, block, got, n)
        for k in np.flatnonzero(np.diff(found.at)):
            mine = found.order[found.at[k] : found.at[k + 1]]
            yield int(k), found.h[mine].tobytes() + found.other[mine].tobytes() + found.least[mine].tobytes()

    def later(asked):
        """Which of the windows that a chunk names start in a smaller doc_id than its own."""
        sent = [np.frombuffer(p, np.uint64).reshape(3, -1) for _, p in asked]
        h, other, least = np.concatenate(sent, axis=1)
        order = np.argsort(h)
        if ((h[order][1:] == h[order][:-1]) & (other[order][1:] != other[order][:-1])).any():
            order = np.lexsort((other, h))
        first = starts_of(h[order], other[order])
        least = least.view(np.int64)
        gone = np.empty(len(h), bool)
        gone[order] = least[order] > np.repeat(np.minimum.reduceat(least[order], first), np.diff(np.append(first, len(h))))
        at = 0
        for (c, _), x in zip(asked, sent, strict=True):
            mine = gone[at : at + x.shape[1]]
            at += x.shape[1]
            if mine.any():
                yield c, np.packbits(mine).tobytes()

    gone = C.answer(C.ask(packed, extend, hit), later, "repeats")

    def cut(batches):
        for _, batch, hits_, got in C.opened(batches):
            buf, offsets = flat(batch.column(1))
            words = segment(buf, offsets)
            n = len(words.starts)
            start = np.zeros(0, np.int64)
            if hits_:
                found = Found(batch, window, block, hits_, buckets)
                earlier = np.zeros(len(found.h), bool)
                for k, p in got.items():
                    mine = found.order[found.at[k] : found.at[k + 1]]
                    earlier[mine[np.unpackbits(np.frombuffer(p, np.uint8), count=len(mine)).view(bool)]] = True
                start = found.start[earlier[found.of] | (found.doc > found.least[found.of])]
            drop = covered(n, start, start + window)
            first, last = runs_by_text(drop, words.offsets)
            doc = np.searchsorted(words.offsets, first, side="right") - 1
            removed = np.concatenate(([0], np.cumsum(drop)))[words.offsets]
            at = np.searchsorted(doc, np.arange(len(words.offsets)))
            data, kept = buf.tobytes(), []
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]].split()
                if removed[i + 1] > removed[i]:
                    own = [w for w, d in zip(own, drop[words.offsets[i] : words.offsets[i + 1]].tolist(), strict=True) if not d]
                kept.append(b" ".join(own))
            base = words.offsets[:-1][doc] if len(doc) else doc
            spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(first - base, pa.int64()), pa.array(last - base, pa.int64())], names=["start", "end"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.counts, pa.int64()), pa.array(np.diff(removed), pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), spans], names=["doc_id", "n_words", "n_removed", "kept_text", "spans"])

    buckets = C.width(docs.sparkSession)
    return C.joined(packed, hit, gone).mapInArrow(freed(cut), SCHEMA)


def runs_by_text(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of True, cut where a text ends."""
    first, last = runs(mask)
    if not len(first):
        return first, last
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(mask))]
    inner = np.unique(inner[mask[inner] & mask[inner - 1]]) if len(inner) else inner
    return np.sort(np.concatenate((first, inner))), np.sort(np.concatenate((last, inner)))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents with the repeats of 13 words that start in a smaller doc_id removed."""
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLES = {
    "op10_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)),
first AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
gone AS (SELECT DISTINCT win.doc_id, k + j AS p FROM win JOIN first USING (s), range(0, 13) t(j) WHERE least < win.doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (SELECT count(*) FROM gone WHERE gone.doc_id = d.doc_id)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
}
