"""Lines that occur earlier in the corpus, up to one edit, by a deletion-neighbourhood join.

A line is its words joined by single spaces; lines without a word always stay. A line goes if an equal line, or one
that a single inserted, deleted or changed character turns into it, occurs at an earlier place: a smaller doc_id,
or the same and a smaller line number. A call's min_edit says from how many characters on an edit is allowed (16,
where none is stated: one letter changes what a short line says); shorter lines must be equal. What occurs earlier is
judged on the input, not on what is left. Lines count as equal if two independent 64-bit hashes of them agree, of
which one is no polynomial; among 10^12 distinct lines the chance of one mistake is 10^-15.

1. Chunks send the hash and first place of each distinct line, and the hashes of the line without each of PARTS
   equal parts. Owners of the hash space tell which lines occur earlier elsewhere, and which of the rests another
   line shares: an edit falls within one part, so a line none of whose rests is shared has no near partner.
2. The chunk with a line's first place emits its deletion neighbourhood: the hash of the line, and of the line
   without each of its characters. Two lines that agree without the character of the same place differ there only;
   a line that equals another without one character differs by that one. So owners need the earliest of each group
   alone, never its pairs, and name it to the others.
3. The two lines of each such pair meet and their edit distance is verified.

Nulls: a null text has no lines and stays null; a null doc_id comes after all others. Rows with the same doc_id and
line number are equally early, so repeated rows stay. A text that loses all lines becomes empty. A very long text is a
chunk of its own. An empty table gives an empty result. Other columns are kept as they are, whatever their names; with
counts, columns n_lines and n_removed of docs give way to the counts.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chunks as C
from .shared import freed, table
from .substring_dedup import starts_of
from .words import _BASE, U64, ascending, flat, mix, powers, segment, span_keys

MIN_EDIT, PARTS = 16, 4
#: Bytes of text of a chunk: its characters, powers and deletions take some hundred bytes each.
CHUNK_BYTES = 1 << 20
LAST = np.iinfo(np.int64).max
FULL = np.uint32(0xFFFFFFFF)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_SALT = U64(0xA0761D6478BD642F)
_inverse = np.ones(1, U64)


def inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        grown = np.full(max(n, 2 * len(_inverse), 256), _INVERSE)
        grown[0] = 1
        _inverse = np.multiply.accumulate(grown)
    return _inverse


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys stand together, and where each group starts in it."""
    order = np.argsort(keys[0])
    if len(starts_of(keys[0][order])) != len(starts_of(*(k[order] for k in keys))):  # the first key alone doesn't tell them apart
        order = np.lexsort(keys[::-1])
    return order, starts_of(*(k[order] for k in keys))


class Lines:
    """The lines of a batch's texts: all of them by text, and those with a word as code points with hashes."""

    def __init__(self, ids: pa.Array, texts: pa.Array):
        self.buf, offsets = flat(texts)
        feed = np.flatnonzero(self.buf == 10)
        null = texts.is_null().to_numpy(zero_copy_only=False)
        count = np.where(null, 0, np.diff(np.searchsorted(feed, offsets)) + 1)
        self.at = np.concatenate(([0], np.cumsum(count)))  # lines of each text
        first = np.zeros(int(self.at[-1]), bool)
        first[self.at[:-1][count > 0]] = True
        self.starts, self.ends = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        self.starts[first], self.starts[~first] = offsets[:-1][count > 0], feed + 1
        last = np.append(first[1:], True) if len(first) else first
        self.ends[last], self.ends[~last] = offsets[1:][count > 0], feed
        # Lines with a word, as code points with single spaces.
        words = segment(self.buf, offsets)
        size = words.ends - words.starts
        at = np.concatenate(([0], np.cumsum(size + 1)))
        joined = np.full(int(at[-1]), 32, np.uint8)
        place = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
        joined[place] = self.buf[place + np.repeat(words.starts - at[:-1], size)]
        line = np.searchsorted(self.starts, words.starts, side="right") - 1
        new = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
        self.number = line[new]
        # Identity of a line besides its polynomial.
        self.own = span_keys(joined, at[new], at[np.append(new[1:], len(size))[: len(new)]] - 1, 1)
        chars = np.concatenate(([0], np.cumsum((joined & 0xC0) != 0x80)))
        self.text = np.frombuffer(joined.tobytes().decode().encode("utf-32-le"), np.uint32)
        self.s, self.e = chars[at[new]], chars[at[np.append(new[1:], len(size))[: len(new)]] - 1] if len(new) else chars[:0]
        self.size = self.e - self.s
        # Polynomial of each line by its own powers, so that parts of it are differences.
        longest = int(self.size.max(initial=0)) + 2
        local = np.arange(len(self.text)) - np.repeat(self.s, np.diff(np.append(self.s, len(self.text))))
        with np.errstate(over="ignore"):
            self.sum = np.concatenate((np.zeros(1, U64), np.cumsum((self.text.astype(U64) + U64(1)) * powers(longest)[local], dtype=U64)))
        self.hash = mix(self.sum[self.e] - self.sum[self.s] + self.size.astype(U64) * _SALT)
        # Distinct lines: the first place of each comes first.
        doc = np.searchsorted(self.at, self.number, side="right") - 1
        self.doc_id = ids.fill_null(LAST).to_numpy()[doc]
        self.line = (self.number - self.at[doc]).astype(np.uint32)
        order, at = groups(self.own, self.hash)
        size = np.diff(np.append(at, len(order)))
        names = ids.fill_null(LAST).to_numpy()
        rank = np.searchsorted(np.sort(names), names)  # documents with one id are equally early
        place = (rank[doc].astype(np.int64) << 32 | self.line)[order]
        least = np.repeat(np.minimum.reduceat(place, at), size) if len(at) else place
        own = np.flatnonzero(place == least)
        number = np.repeat(np.arange(len(at)), size)
        own = own[np.lexsort((order[own], number[own]))] if len(own) > len(at) else own
        self.first = order[own[starts_of(number[own])]]  # of each distinct line
        self.of = np.empty(len(order), np.int64)
        self.of[order] = number

    def rests(self, min_edit: int) -> tuple[np.ndarray, np.ndarray]:
        """(distinct line, hash) of lines without each part, as partners of equal or greater and of lesser length have them."""
        own = np.flatnonzero(self.size[self.first] >= min_edit - 1)
        lines = self.first[own]
        s, e, n = self.s[lines], self.e[lines], self.size[lines]
        inverse = inverse_powers(int(n.max(initial=0)) + 2)
        owners, hashes = [], []
        for base in (n, n - 1):
            for i in range(PARTS):
                before, after = base * i // PARTS, base - base * (i + 1) // PARTS
                head = self.sum[s + before] - self.sum[s]
                tail = (self.sum[e] - self.sum[e - after]) * inverse[n - after]
                owners.append(own)
                hashes.append(mix(mix(head + base.astype(U64) * _SALT) ^ (tail + U64(i + 1))))
        return np.concatenate(owners), np.concatenate(hashes)

    def neighbourhood(self, some: np.ndarray):
        """(distinct line, place of the deleted character or FULL, hash) of the lines and their deletions."""
        lines = self.first[some]
        n = self.size[lines]
        own = np.repeat(np.arange(len(some)), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        s, e = self.s[lines][own], self.e[lines][own]
        left = self.sum[s + k] - self.sum[s]
        right = (self.sum[e] - self.sum[s + k + 1]) * _INVERSE
        cut = mix(left + right + (n[own] - 1).astype(U64) * _SALT)
        return np.concatenate((some, some[own])), np.concatenate((np.full(len(some), FULL), k.astype(np.uint32))), np.concatenate((self.hash[lines], cut))

    def string(self, i: int) -> str:
        j = self.first[i]
        return self.text[self.s[j] : self.e[j]].tobytes().decode("utf-32-le")


def within_one(a: str, b: str) -> bool:
    """Whether one inserted, deleted or changed character at most turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _bits(p: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.unpackbits(np.frombuffer(p, np.uint8, -1, at), count=n).view(bool)


def _offer(lines: Lines, n: int, min_edit: int):
    """What round 1 sends to each bucket: numbers of distinct lines, and rests by their owners."""
    h = lines.hash[lines.first]
    order, at = C.by_bucket(h, n)
    owner, rest = lines.rests(min_edit)
    order2, at2 = C.by_bucket(rest, n)
    return h, order, at, owner, rest, order2, at2


def _first_answers(lines: Lines, got: dict[int, bytes], n: int, min_edit: int):
    """Which distinct lines occur earlier elsewhere, and which share a rest."""
    _, order, at, owner, _, order2, at2 = _offer(lines, n, min_edit)
    gone, shares = np.zeros(len(lines.first), bool), np.zeros(len(lines.first), bool)
    for k, p in got.items():
        mine, rests = order[at[k] : at[k + 1]], order2[at2[k] : at2[k + 1]]
        gone[mine[_bits(p, len(mine))]] = True
        shares[owner[rests[_bits(p, len(rests), -(-len(mine) // 8))]]] = True
    return gone, shares


def _least_places(key: np.ndarray, other: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Which entries have a smaller place under the same two keys."""
    order, first = groups(key, other)
    size = np.diff(np.append(first, len(key)))
    least = np.repeat(np.minimum.reduceat(doc[order], first), size)
    line_ = np.where(doc[order] == least, line[order].astype(np.int64), LAST)
    low = np.repeat(np.minimum.reduceat(line_, first), size)
    out = np.empty(len(key), bool)
    out[order] = (doc[order] > least) | (line_ > low)
    return out


def _round_one(asked):
    parts = []
    for c, p in asked:
        m, r = np.frombuffer(p, np.uint32, 2).tolist()
        parts.append((c, np.frombuffer(p, U64, 2 * m, 8).reshape(2, m), np.frombuffer(p, np.int64, m, 8 + 16 * m), np.frombuffer(p, np.uint32, m, 8 + 24 * m), np.frombuffer(p, np.uint32, 2 * r, 8 + 28 * m).reshape(2, r)))
    hashes = np.concatenate([x[1] for x in parts], axis=1)
    later = _least_places(hashes[0], hashes[1], np.concatenate([x[2] for x in parts]), np.concatenate([x[3] for x in parts])) if hashes.size else np.zeros(0, bool)
    keys = np.concatenate([x[4][0] for x in parts])
    pairs = ascending(keys.astype(U64) << U64(32) | np.concatenate([x[4][1] for x in parts]))
    shared = C.repeated((pairs >> U64(32)).astype(np.uint32))
    at = 0
    for c, h, _, _, (key, _) in parts:
        h = h[0]
        gone, hit = later[at : at + len(h)], C.among(key, shared)
        at += len(h)
        if gone.any() or hit.any():
            yield c, np.packbits(gone).tobytes() + np.packbits(hit).tobytes()


def _round_two(asked):
    """Of each group that agrees, name the earliest line to the others, and tell it that it is wanted."""
    key, place, line, chunk, doc, number, own = [], [], [], [], [], [], []
    at = 0
    for c, p in asked:
        n, m = np.frombuffer(p, np.uint32, 2).tolist()
        key.append(np.frombuffer(p, U64, n, 8))
        place.append(np.frombuffer(p, np.uint32, n, 8 + 8 * n))
        line.append(np.frombuffer(p, np.uint32, n, 8 + 12 * n).astype(np.int64) + at)
        o = 8 + 16 * n
        doc.append(np.frombuffer(p, np.int64, m, o + 8 * m))
        own.append(np.frombuffer(p, U64, m, o))
        number.append(np.frombuffer(p, np.uint32, 2 * m, o + 16 * m).reshape(2, m))
        chunk += [c] * m
        at += m
    key, place, line, doc, own = map(np.concatenate, (key, place, line, doc, own))
    number = np.concatenate(number, axis=1)
    some = np.flatnonzero(C.among(key, C.repeated(key)))
    if not len(some):
        return
    key, place, line = key[some], place[some], line[some]
    turn = np.empty(len(doc), np.int64)  # place in the corpus as a rank; equal places have equal ranks
    order = np.lexsort((number[1], doc))
    turn[order] = np.cumsum(np.concatenate(([0], (doc[order][1:] != doc[order][:-1]) | (number[1][order][1:] != number[1][order][:-1]))))
    pairs = set()

    def named(group: np.ndarray, members: np.ndarray, leaders: np.ndarray):
        """Each member with a leader of its group that is earlier; the earliest leader is enough."""
        o = leaders[np.lexsort((turn[line[leaders]], group[leaders]))]
        o = o[np.concatenate(([True], group[o][1:] != group[o][:-1]))] if len(o) else o
        if not len(o) or not len(members):
            return
        i = np.minimum(np.searchsorted(group[o], group[members]), len(o) - 1)
        ok = (group[o][i] == group[members]) & (turn[line[o[i]]] < turn[line[members]])
        pairs.update(zip(line[members[ok]].tolist(), line[o[i[ok]]].tolist(), strict=True))

    full = place == FULL
    cut, whole = np.flatnonzero(~full), np.flatnonzero(full)
    same = mix(key + (place.astype(U64) + U64(1)) * _SALT)
    named(same, cut, cut)
    named(key, cut, whole)
    named(key, whole, cut)
    to = defaultdict(lambda: ([], []))
    for a, b in pairs:
        to[chunk[a]][0].append((number[0][a], own[b]))
        to[chunk[b]][1].append(number[0][b])
    for c, (ask, wanted) in to.items():
        yield c, np.uint32(len(ask)).tobytes() + np.array([x for x, _ in ask], np.uint32).tobytes() + np.array([y for _, y in ask], U64).tobytes() + np.unique(np.array(wanted, np.uint32)).tobytes()


def _round_three(asked):
    """Verify the edit distance of the lines of each pair."""
    known, asks = {}, []
    for c, p in asked:
        t = C.from_ipc(p)
        for h, i, s in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), t.column(2).to_pylist(), strict=True):
            if i is None:
                known[h] = s
            else:
                asks.append((c, h, i, s))
    gone = defaultdict(set)
    for c, h, i, s in asks:
        if h in known and within_one(s, known[h]):
            gone[c].add(i)
    for c, x in gone.items():
        yield c, np.array(sorted(x), np.uint32).tobytes()


def _pairs(got: dict[int, bytes]):
    ask, wanted = set(), set()
    for p in got.values():
        n = int(np.frombuffer(p, np.uint32, 1)[0])
        ask.update(zip(np.frombuffer(p, np.uint32, n, 4).tolist(), np.frombuffer(p, U64, n, 4 + 4 * n).tolist(), strict=True))
        wanted.update(np.frombuffer(p, np.uint32, -1, 4 + 12 * n).tolist())
    return sorted(ask), sorted(wanted)


def dedup_lines(docs: DataFrame, counts: bool = False, doc_id: str = "doc_id", text: str = "text", min_edit: int = MIN_EDIT) -> DataFrame:
    """docs with the lines that occur earlier taken out of text; counts: and columns n_lines and n_removed. min_edit: characters from which on one edit is allowed."""
    if counts:
        docs = docs.drop("n_lines", "n_removed")
    names, ids, at = docs.columns, docs.columns.index(doc_id), docs.columns.index(text)
    rows = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(names)))
    packed = C.pack(rows, f"c{at}", CHUNK_BYTES)

    def read(batch):
        return Lines(batch.column(ids).cast(pa.int64()), batch.column(at))

    def offer(batch, _, n):
        lines = read(batch)
        h, order, a, owner, rest, order2, b = _offer(lines, n, min_edit)
        doc, line, other = lines.doc_id[lines.first], lines.line[lines.first], lines.own[lines.first]
        for k in np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0)):
            mine, rests = order[a[k] : a[k + 1]], order2[b[k] : b[k + 1]]
            yield int(k), np.array([len(mine), len(rests)], np.uint32).tobytes() + h[mine].tobytes() + other[mine].tobytes() + doc[mine].tobytes() + line[mine].tobytes() + rest[rests].astype(np.uint32).tobytes() + h[owner[rests]].astype(np.uint32).tobytes()

    first = C.answer(C.ask(packed, offer), _round_one, "lines")

    def emit(batch, got, n):
        if not got:
            return
        lines = read(batch)
        gone, shares = _first_answers(lines, got, n, min_edit)
        own = np.flatnonzero(shares & ~gone & (lines.size[lines.first] >= min_edit - 1))
        line, place, key = lines.neighbourhood(own)
        order, a = C.by_bucket(key, n)
        for k in np.flatnonzero(np.diff(a)):
            mine = order[a[k] : a[k + 1]]
            some = ascending(line[mine])
            of = np.searchsorted(some, line[mine])
            where = lines.first[some]
            yield int(k), b"".join((
                np.array([len(mine), len(some)], np.uint32).tobytes(), key[mine].tobytes(), place[mine].tobytes(), of.astype(np.uint32).tobytes(),
                lines.hash[where].tobytes(), lines.doc_id[where].tobytes(), some.astype(np.uint32).tobytes(), lines.line[where].tobytes(),
            ))

    second = C.answer(C.ask(packed, emit, first), _round_two, "neighbours")

    def meet(batch, got, n):
        if not got:
            return
        lines = read(batch)
        ask, wanted = _pairs(got)
        sent = defaultdict(list)
        for i, h in ask:
            if lines.size[lines.first[i]] >= min_edit:
                sent[(h >> 32) * n >> 32].append((h, i, lines.string(i)))
        for i in wanted:
            if lines.size[lines.first[i]] >= min_edit:
                h = int(lines.hash[lines.first[i]])
                sent[(h >> 32) * n >> 32].append((h, None, lines.string(i)))
        for k, x in sent.items():
            h, i, s = zip(*x, strict=True)
            yield k, C.to_ipc(pa.RecordBatch.from_arrays([pa.array(h, pa.uint64()), pa.array(i, pa.uint32()), pa.array(s, pa.large_string())], names=["h", "i", "s"]))

    third = C.answer(C.ask(packed, meet, second), _round_three, "verified")
    schema = T.StructType([*rows.schema.fields, *([T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())] if counts else [])])

    def cut(batches):
        for _, batch, one, three in C.opened(batches):
            lines = read(batch)
            gone, _ = _first_answers(lines, one, int(n_buckets), min_edit)
            for p in three.values():
                gone[np.frombuffer(p, np.uint32)] = True
            first_ = np.zeros(len(lines.number), bool)
            first_[lines.first] = True
            # Equal lines at the same place (repeated rows) are equally early.
            j = lines.first[lines.of]
            first_ |= (lines.doc_id == lines.doc_id[j]) & (lines.line == lines.line[j])
            drop = np.zeros(int(lines.at[-1]), bool)
            drop[lines.number[gone[lines.of] | ~first_]] = True
            removed = np.concatenate(([0], np.cumsum(drop)))[lines.at]
            data = lines.buf.tobytes()
            column = batch.column(at)
            texts = column.to_pylist()
            for d in np.flatnonzero(np.diff(removed)).tolist():
                a, b = lines.at[d], lines.at[d + 1]
                texts[d] = b"\n".join(data[s:e] for s, e, x in zip(lines.starts[a:b].tolist(), lines.ends[a:b].tolist(), drop[a:b].tolist(), strict=True) if not x).decode()
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if counts:
                columns += [pa.array(np.diff(lines.at), pa.int64()), pa.array(np.diff(removed), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    n_buckets = C.width(docs.sparkSession)
    out = C.joined(packed, first, third).mapInArrow(freed(cut), schema)
    return out.toDF(*names, *(("n_lines", "n_removed") if counts else ()))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its lines, those removed, and a digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, counts=True).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_SQL = f"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
norm AS (SELECT doc_id, n, l, trim(regexp_replace(l, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS t FROM raw),
places AS (SELECT t, min({{'d': doc_id, 'n': n}}) AS p, length(t) AS k FROM norm WHERE t <> '' GROUP BY t),
near AS (SELECT * FROM places WHERE k >= {MIN_EDIT}),
halves AS (SELECT *, unnest([h // 2, (h - 1) // 2]) AS q, 0 AS z FROM (SELECT *, k AS h FROM near)),
keys AS (SELECT DISTINCT t, p, k, q, side, CASE side WHEN 0 THEN left(t, q) ELSE right(t, q) END AS part FROM halves, (VALUES (0), (1)) s(side)),
pairs AS (SELECT DISTINCT a.t AS a, b.t AS b FROM keys a JOIN keys b USING (q, side, part) WHERE b.p < a.p AND a.t <> b.t AND abs(a.k - b.k) <= 1),
hits AS (SELECT DISTINCT a FROM pairs WHERE len(list_filter(range(0, greatest(length(a), length(b))), lambda i:
  left(a, i) = left(b, i) AND (CASE WHEN length(a) >= length(b) THEN a[i + 2:] ELSE a[i + 1:] END) = (CASE WHEN length(b) >= length(a) THEN b[i + 2:] ELSE b[i + 1:] END))) > 0),
judged AS (SELECT m.doc_id, m.n, m.l, m.t <> '' AND ({{'d': m.doc_id, 'n': m.n}} > p.p OR m.t IN (SELECT a FROM hits)) AS gone FROM norm m LEFT JOIN places p USING (t))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY n) FILTER (NOT coalesce(gone, false)), '')) AS kept_sha256
FROM judged GROUP BY doc_id UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL"""
QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLES = {"op9_line_dedup": _SQL}
