"""Benchmark passages in texts: SimHash of item-sized windows, multi-index Hamming blocks, exact similarity.

Words are runs of letters and digits, lower-cased; punctuation and spacing don't count. For each benchmark item,
windows of the item's number of words slide over a text. A window is a candidate if its SimHash of BITS bits over
five-word shingles is within RADIUS bits of the item's. Fingerprints are cut into BLOCKS blocks. Of two that are so
near, AGREE blocks at least differ by NEAR bits or fewer, for otherwise BLOCKS - AGREE + 1 blocks would differ by
NEAR + 1 each, more than RADIUS. So each item is listed under all values within NEAR of each of its blocks, a window
looks up its own, and the items that it meets in AGREE blocks are compared: 3 in 100 of unlike ones. A text with
fewer words than an item is one window for it, the whole text; its candidates are the items with so many shingles in
common that the threshold can be reached. Candidates are verified: the weighted Jaccard similarity of their
shingles, weights being counts, must reach the threshold; it is carried on from a window to the next.

A window without any shingle of an item of its size can't reach the threshold, so only windows that hold one are
hashed: this is a condition of the result, not a shortcut past it. Items travel to the executors by broadcast, at
most BROADCAST bytes of text and ITEMS of them, which are counted (an item's index takes some 10 kB); larger
benchmarks are taken in slices, each a pass over the corpus. Texts never move.

At a similarity of 0.8 fingerprints of 256 bits differ by about 39 bits, with a deviation of 5.7; RADIUS leaves 3.5
deviations: two in 10,000 windows of that very similarity are lost, and as good as none above 0.82. Items of fewer than nine shingles reach 0.8 by equality alone, and equal bags have one fingerprint.

Nulls: a null text holds nothing, a null item text or item_id is no item; a null doc_id is returned as null.
Items of fewer than five words are one shingle of all their words. Repeated rows and items are matched each; of
equally similar windows the first counts. Long texts and items take memory in proportion to their length. Empty
tables give an empty result; other columns are ignored, whatever their names, and kept by clean().
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import freed, table
from .words import U64, ascending, flat, mix, segment, span_keys, windows

SHINGLE, SIMILARITY = 5, 0.8
BITS, RADIUS, BLOCKS, NEAR, AGREE = 256, 59, 22, 2, 3
EDGES = [b * BITS // BLOCKS for b in range(BLOCKS + 1)]
#: Bytes of benchmark text, and items, that one broadcast may hold.
BROADCAST, ITEMS = 32 << 20, 8000
#: Windows that are hashed at a time.
AT_ONCE = 1 << 15
PART = 1 << 20
FOUND = "doc_id long, item_id long, similarity double, start long, n_words long"

# What is not part of a word: ASCII other than letters and digits.
BREAKS = np.zeros(256, bool)
BREAKS[:128] = True
BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def hashed(column: pa.Array):
    """Hash of each word of the texts of a column, and each text's range of words."""
    buf, offsets = flat(column)
    words = segment(buf, offsets, BREAKS)
    return span_keys(LOWER[buf], words.starts, words.ends), words.offsets


def shingles(h: np.ndarray) -> np.ndarray:
    """The shingles of one sequence of words; of all of them where they are few."""
    return windows(h, min(SHINGLE, len(h))) if len(h) else h


def simhashes(h: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the runs of `size` hashes from each start: a row of BITS bits; one is set where over half of the hashes have it."""
    out = np.empty((len(starts), BITS), bool)
    ones = np.zeros(len(h) + 1, np.int32)
    salt = np.arange(BITS // 64, dtype=U64) * U64(0xA0761D6478BD642F)
    for b in range(BITS):
        own = mix(h + salt[b // 64]) if b % 64 == 0 else own
        np.cumsum((own >> U64(b % 64) & U64(1)).astype(np.uint8), out=ones[1:])
        out[:, b] = 2 * (ones[starts + size] - ones[starts]) > size
    return out


def _block(bits: np.ndarray, b: int) -> np.ndarray:
    """The value of a block of each row of bits."""
    own = bits[:, EDGES[b] : EDGES[b + 1]]
    return own @ (1 << np.arange(own.shape[1]))


def _listed(bits: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """All values within NEAR bits of a block of each row, in order, with the rows they belong to."""
    near = np.array([sum(1 << i for i in some) for r in range(NEAR + 1) for some in combinations(range(EDGES[b + 1] - EDGES[b]), r)])
    key = (_block(bits, b)[:, None] ^ near).ravel()
    order = np.argsort(key, kind="stable")
    return key[order].astype(np.uint16), (order // len(near)).astype(np.int32)


class Index:
    """The items by number of words: which have a shingle, and their fingerprints by blocks."""

    def __init__(self, ids: list[int], texts: list[str]):
        h, at = hashed(pa.array(texts, pa.string()))
        items = defaultdict(list)
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            if b > a:
                items[b - a].append((ids[i], shingles(h[a:b])))
        self.sizes = sorted(items)
        self.items = {n: [i for i, _ in items[n]] for n in self.sizes}
        self.grams = {n: np.stack([g for _, g in items[n]]) for n in self.sizes}
        self.prints, self.blocks, self.bags = {}, {}, {}
        for n in self.sizes:
            m = self.grams[n].shape[1]
            bits = np.concatenate([simhashes(g, np.zeros(1, np.int64), m) for g in self.grams[n]])
            self.prints[n] = np.packbits(bits, axis=1).view(U64)
            self.blocks[n] = [_listed(bits, b) for b in range(BLOCKS)]
            # Each item's distinct shingles with their counts.
            self.bags[n] = [np.unique(g, return_counts=True) for g in self.grams[n]]
        # Which sizes a shingle of each length belongs to.
        self.long = self._places([n for n in self.sizes if n >= SHINGLE])
        self.short = {n: ascending(self.grams[n].ravel()) for n in self.sizes if n < SHINGLE}
        # Shingles of each size in order, with their items.
        self.postings = {}
        for n in self.sizes:
            own = self.grams[n].ravel()
            order = np.argsort(own, kind="stable")
            self.postings[n] = own[order], order // self.grams[n].shape[1]

    def _places(self, sizes):
        pairs = sorted({(g, n) for n in sizes for g in self.grams[n].ravel().tolist()})
        return np.array([g for g, _ in pairs], U64), np.array([n for _, n in pairs], np.int64)

    def met(self, n: int, bits: np.ndarray) -> np.ndarray:
        """Rows (window, item) that agree in AGREE blocks."""
        pairs = []
        for b, (keys, items) in enumerate(self.blocks[n]):
            value = _block(bits, b).astype(np.uint16)
            low, high = np.searchsorted(keys, value), np.searchsorted(keys, value, side="right")
            size = high - low
            own = np.repeat(np.arange(len(value)), size)
            pairs.append(own * len(self.items[n]) + items[np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)])
        pairs = np.sort(np.concatenate(pairs))
        many = ascending(pairs[AGREE - 1 :][pairs[AGREE - 1 :] == pairs[: len(pairs) - AGREE + 1]])
        return np.stack(np.divmod(many, len(self.items[n])), 1)

    def candidates(self, n: int, bits: np.ndarray) -> np.ndarray:
        """Rows (window, item) whose fingerprints are within RADIUS."""
        pair = self.met(n, bits)
        prints = np.packbits(bits, axis=1).view(U64)
        return pair[np.bitwise_count(prints[pair[:, 0]] ^ self.prints[n][pair[:, 1]]).sum(axis=1) <= RADIUS]

    def sharing(self, n: int, bag: np.ndarray, threshold: float) -> list[int]:
        """The items of n words with which a bag may have a similarity of threshold, by the shingles in common."""
        values, of = self.postings[n]
        first, last = np.searchsorted(values, bag), np.searchsorted(values, bag, side="right")
        # Equal shingles count once a pair, which is no less than the lesser count.
        common = np.bincount(np.concatenate([of[a:b] for a, b in zip(first, last, strict=True)]), minlength=len(self.items[n]))
        total = len(bag) + self.grams[n].shape[1]
        return np.flatnonzero(common >= threshold / (1 + threshold) * total - 1e-6).tolist()


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the lesser counts over the sum of the greater counts of two bags of hashes."""
    values, of = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = np.bincount(of[: len(a)], minlength=len(values)), np.bincount(of[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def slide(h: np.ndarray, starts: np.ndarray, size: int, bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Weighted Jaccard similarity of a bag of `size` hashes and the windows of h from each start, which ascend."""
    values, wanted = bag
    first = int(starts[0])
    some = h[first : int(starts[-1]) + size]
    own = np.minimum(np.searchsorted(values, some), len(values) - 1)
    own[values[own] != some] = -1
    own, room, common, out, low, high = own.tolist(), wanted.tolist(), 0, [], 0, 0
    for s in (starts - first).tolist():
        while high < s + size:  # room: how many more of a shingle would count
            g = own[high]
            if g >= 0:
                room[g] -= 1
                common += room[g] >= 0
            high += 1
        while low < s:
            g = own[low]
            if g >= 0:
                common -= room[g] >= 0
                room[g] += 1
            low += 1
        out.append(common / (2 * size - common))
    return np.array(out)


def search(index: Index, column: pa.Array, threshold: float):
    """(text number, item, similarity, first word, words) of the best window of each text and item."""
    h, at = hashed(column)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    grams = {SHINGLE: windows(h, SHINGLE)}
    starts = defaultdict(list)
    keys, sizes = index.long
    if len(keys):
        seen = np.zeros(1 << 20, bool)
        seen[(keys & U64((1 << 20) - 1)).astype(np.int64)] = True
        maybe = np.flatnonzero(seen[(grams[SHINGLE] & U64((1 << 20) - 1)).astype(np.int64)])
        first, last = np.searchsorted(keys, grams[SHINGLE][maybe]), np.searchsorted(keys, grams[SHINGLE][maybe], side="right")
        for p, a, b in zip(maybe.tolist(), first.tolist(), last.tolist(), strict=True):
            for n in sizes[a:b].tolist():
                starts[n].append(p)
    for n, own in index.short.items():
        grams[n] = windows(h, n)
        hit = np.flatnonzero(np.isin(grams[n], own))
        if len(hit):
            starts[n] = hit.tolist()
    for n, places in starts.items():
        k = min(n, SHINGLE)
        hit = ascending(np.array(places))
        doc = np.searchsorted(at, hit, side="right") - 1
        inside = hit + k <= at[doc + 1]
        hit, doc = hit[inside], doc[inside]
        # Texts shorter than the items, and not so short that the threshold is out of reach: one window each.
        length = at[doc + 1] - at[doc]
        for d in ascending(doc[(length < n) & (length - k + 1 >= threshold * (n - k + 1) - 1e-6)]).tolist():
            bag = grams[k][at[d] : at[d + 1] - k + 1]
            for j in index.sharing(n, bag, threshold):
                s = weighted_jaccard(bag, index.grams[n][j])
                if s >= threshold and s > best.get((d, index.items[n][j]), (0.0,))[0]:
                    best[d, index.items[n][j]] = (s, 0, int(at[d + 1] - at[d]))
        # Windows of n words within the text that hold a shingle of an item of that size: ranges of starts.
        m = n - k + 1
        low, high = np.maximum(hit - m + 1, at[doc]), np.minimum(hit, at[doc + 1] - n)
        low, high, doc = (x[low <= high] for x in (low, high, doc))
        if not len(low):
            continue
        new = np.concatenate(([True], low[1:] > np.maximum.accumulate(high)[:-1]))
        ends = np.maximum.reduceat(high, np.flatnonzero(new)) + 1
        runs = [(s, min(s + AT_ONCE, b), d) for a, b, d in zip(low[new].tolist(), ends.tolist(), doc[new].tolist(), strict=True) for s in range(a, b, AT_ONCE)]
        while runs:
            size = np.cumsum([b - a for a, b, _ in runs])
            batch, runs = runs[: (i := max(1, int(np.searchsorted(size, AT_ONCE)))) ], runs[i:]
            own = np.concatenate([np.arange(a, b) for a, b, _ in batch])
            of = np.repeat([d for _, _, d in batch], [b - a for a, b, _ in batch])
            gap = np.repeat(np.arange(len(batch)) * (m - 1), [b - a for a, b, _ in batch])
            pair = index.candidates(n, simhashes(np.concatenate([grams[k][a : b - 1 + m] for a, b, _ in batch]), np.arange(len(own)) + gap, m))
            key = of[pair[:, 0]] * len(index.items[n]) + pair[:, 1]
            order = np.argsort(key, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(order) else ():
                j, d, at_ = int(pair[some[0], 1]), int(of[pair[some[0], 0]]), own[pair[some, 0]]
                similar = slide(grams[k], at_, m, index.bags[n][j])
                w = int(similar.argmax())
                if similar[w] >= threshold and similar[w] > best.get((d, index.items[n][j]), (0.0,))[0]:
                    best[d, index.items[n][j]] = (float(similar[w]), int(at_[w] - at[d]), n)
    return [(d, i, *v) for (d, i), v in sorted(best.items())]


def slices(benchmark: DataFrame, item_id: str, text: str) -> list[DataFrame]:
    """The items in tables of at most BROADCAST bytes of text and ITEMS rows, which are counted; a longer item is alone."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    total, count = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    n = max(-(-2 * total // BROADCAST), -(-2 * count // ITEMS)) if total > BROADCAST or count > ITEMS else 1
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)] if n > 1 else [rows]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each row of docs and item that a window of it matches: doc_id, item_id, similarity, start (word) and n_words of the best window."""
    out = None
    for part in slices(benchmark, item_id, item_text):
        one = _search(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), part, threshold, FOUND)
        out = one if out is None else out.unionAll(one)
    return out


def _collected(spark: SparkSession, items: DataFrame):
    rows = items.collect()  # at most BROADCAST bytes of text
    return uuid.uuid4().hex, spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))


_index: dict[str, Index] = {}


def _of(items) -> Index:
    """The index of a broadcast, once in each worker."""
    name, held = items
    if name not in _index:
        _index.clear()
        _index[name] = Index(*held.value)
    return _index[name]


def parts(column: pa.Array):
    """Ranges of rows of about PART bytes."""
    from .chunks import _lengths

    total = np.concatenate(([0], np.cumsum(_lengths(column))))
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(total, total[first] + PART, side="right")) - 1)
        yield first, last
        first = last


def _search(rows: DataFrame, part: DataFrame, threshold: float, schema: str) -> DataFrame:
    items = _collected(rows.sparkSession, part)

    def found(batches):
        for b in batches:
            for first, last in parts(b.column(1)):
                got = search(_of(items), b.column(1).slice(first, last - first), threshold)
                if got:
                    d, i, s, w, n = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first).take(pa.array(d)), pa.array(i, pa.int64()), pa.array(s), pa.array(w, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "item_id", "similarity", "start", "n_words"])

    return rows.mapInArrow(freed(found), schema)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns."""
    at = docs.columns.index(text)
    out = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)))
    schema = T.StructType(out.schema.fields)
    for part in slices(benchmark, item_id, item_text):
        items = _collected(docs.sparkSession, part)

        def kept(batches, items=items):
            for b in batches:
                for first, last in parts(b.column(at)):
                    some = b.slice(first, last - first)
                    stay = np.ones(some.num_rows, bool)
                    stay[[d for d, *_ in search(_of(items), some.column(at), threshold)]] = False
                    if stay.any():
                        yield some.filter(pa.array(stay))

        out = out.mapInArrow(freed(kept), schema)
    return out.toDF(*docs.columns)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_benchmark_decontamination": op7_benchmark_decontamination}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z0-9\\x{{80}}-\\x{{10ffff}}]+')"
ORACLES = {
    "op7_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, v, len(v) AS n, least({SHINGLE}, len(v)) AS k FROM (SELECT item_id, {_WORDS} AS v FROM benchmark) WHERE len(v) > 0),
gi AS (SELECT item_id, n, k, s, count(*) AS c FROM (SELECT item_id, n, k, unnest(list_transform(range(1, n - k + 2), lambda p: array_to_string(v[p:p + k - 1], ' '))) AS s FROM i) GROUP BY ALL),
gd AS (SELECT doc_id, m, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT doc_id, w, len(w) AS m, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i))),
place AS (SELECT DISTINCT doc_id, m, item_id, n, k, p - j AS start FROM gd JOIN gi USING (k, s), LATERAL (SELECT unnest(range(0, n - k + 1)) AS j)),
bag AS (SELECT a.doc_id, a.item_id, a.n, a.k, start, gd.s, count(*) AS c FROM place a JOIN gd ON gd.doc_id = a.doc_id AND gd.k = a.k AND gd.p BETWEEN start AND start + a.n - a.k WHERE start >= 1 AND start + a.n - 1 <= a.m GROUP BY ALL),
sim AS (SELECT doc_id, item_id, n, start, sum(least(bag.c, gi.c)) / (2 * (n - k + 1) - sum(least(bag.c, gi.c)))::DOUBLE AS similarity FROM bag JOIN gi USING (item_id, n, k, s) GROUP BY doc_id, item_id, n, k, start)
SELECT doc_id, item_id, similarity, start - 1 AS start, n AS n_words FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS q FROM sim WHERE similarity >= {SIMILARITY}) WHERE q = 1"""
}
