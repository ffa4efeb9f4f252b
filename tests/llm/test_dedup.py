"""Deduplicating operators against plain versions, on texts with every odd case."""

import random
from collections import Counter

import numpy as np
import pytest

from winnowry.llm import bwt, chunks, golay, line_dedup, simhash_dedup, substring_dedup, suffix_dedup
from winnowry.llm.components import components
from winnowry.llm.xxh64 import xxh64

from . import brute


def test_substring(docs, rows):
    got = substring_dedup.dedup_substrings(docs).collect()
    assert Counter((g.doc_id, g.n_words, g.n_removed, g.kept_text) for g in got) == Counter(brute.substring([r[:2] for r in rows]))
    assert all(sum(s.end - s.start for s in g.spans) == g.n_removed for g in got)


def test_substring_other_window(docs, rows):
    got = substring_dedup.dedup_substrings(docs, 4).collect()
    assert Counter((g.doc_id, g.n_words, g.n_removed, g.kept_text) for g in got) == Counter(brute.substring([r[:2] for r in rows], 4))


@pytest.mark.parametrize("least", [200, 40])
def test_suffix(docs, rows, least):
    got = suffix_dedup.dedup_bytes(docs, least).collect()
    assert Counter((g.doc_id, g.n_bytes, g.n_removed, len(g.spans), bytes(g.kept)) for g in got) == Counter(brute.suffix([r[:2] for r in rows], least))


def test_suffix_small_blocks(docs, rows, monkeypatch):
    """Long texts are scanned in parts that overlap."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    buf = np.frombuffer((brute.words(rows[-3][1])[0] * 300).encode(), np.uint8)
    h, starts, ends, _ = suffix_dedup.anchors(buf, np.array([0, len(buf)]), 200)
    covered = np.zeros(len(buf) - 199, int)
    for s, e in zip(starts, ends):
        covered[s : e - 199] += 1
    assert (covered == 1).all()


@pytest.mark.parametrize("hot", [2, 5])
def test_suffix_hot_anchors(docs, rows, monkeypatch, hot):
    """Windows of hot anchors are dealt by more of their bytes, with the same result."""
    from winnowry.llm import suffix_dedup as S

    text = " ".join(brute.words(rows[-3][1])[:60])
    for s, e, p in ((0, 330, 150), (3, 203, 3), (10, 380, 190)):
        own = [(a, b) for _, a, b in S.parted(text.encode() * 3, s, e, p, 200)]
        covered = [w for a, b in own for w in range(a, b - 199)]
        assert sorted(covered) == list(range(s, e - 199))
    buf, own = rows, S.dedup_bytes
    monkeypatch.setattr(S, "HOT", hot)
    got = own(docs, 40).collect()
    assert Counter((g.doc_id, g.n_bytes, g.n_removed, len(g.spans), bytes(g.kept)) for g in got) == Counter(brute.suffix([r[:2] for r in buf], 40))


def test_long_common_matches_counting():
    for t in range(60):
        r = np.random.default_rng(t)
        s = r.integers(1, 4, r.integers(5, 120)).astype(np.uint16)
        s = np.concatenate([s, s[: len(s) // 2]]) if t % 3 == 0 else s
        m = int(r.integers(2, 12))
        c = Counter(tuple(s[i : i + m]) for i in range(len(s) - m + 1))
        assert bwt.long_common(s, m).tolist() == [i for i in range(len(s) - m + 1) if c[tuple(s[i : i + m])] > 1]


def test_xxh64():
    xxhash = pytest.importorskip("xxhash")
    r = np.random.default_rng(1)
    buf = r.integers(0, 256, 5000).astype(np.uint8)
    s = r.integers(0, 4000, 500)
    e = s + r.integers(0, 200, 500)
    assert xxh64(buf, s, e).tolist() == [xxhash.xxh64_intdigest(buf[i:j].tobytes(), 42) for i, j in zip(s, e)]


def test_golay_covers_the_space_and_near_prints_share_a_key():
    assert set(np.bincount(golay.decode(np.arange(1 << 23)), minlength=4096)) == {2048}
    r = np.random.default_rng(2)
    p = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    q = p.copy()
    for k in range(3):
        q[k * 1000 :] ^= np.uint64(1) << r.integers(0, 64, len(p) - k * 1000).astype(np.uint64)
    a, b = (set(zip(*(x.tolist() for x in golay.keys(v)))) for v in (p, q))
    assert {o for o, _ in a & b} == set(range(len(p)))


def test_simhash(docs, rows):
    got = simhash_dedup.near_duplicates(docs).collect()
    assert Counter((g.doc_id, g.fingerprint, g.component_id) for g in got) == Counter(brute.components([r[:2] for r in rows]))


def test_simhash_large_group_makes_few_edges(spark):
    """Fingerprints that all lie near each other are joined by a tree, not by their pairs."""
    prints = [(i,) for i in range(1, 129)]
    edges = simhash_dedup.links(spark.createDataFrame([(1 << a | 1 << b,) for a in range(40) for b in range(a)], "fp long")).collect()
    assert len(prints) < len(edges) < 780 * 60
    root = components(spark.createDataFrame(edges, "a long, b long")).select("root").distinct().count()
    assert root == 1


def test_keep_one(docs, rows):
    """Of rows that a chain of similar pairs joins one doc_id stays; exact sets of 3-word shingles decide."""
    kept = simhash_dedup.keep_one(docs, 3)
    assert kept.columns == docs.columns
    sets = []
    for _, t, *_ in rows:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        w = brute.words(w)
        sets.append({tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if root[a] != root[b] and (x == y or len(x & y) / len(x | y) >= 0.8):
                root = [root[b] if r == root[a] else r for r in root]
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root[k]] = min(least.get(root[k], brute.LAST), r[0])
    assert Counter(k.doc_id for k in kept.collect()) == Counter(r[0] for k, r in enumerate(rows) if r[0] is None or r[0] == least[root[k]])


def test_components(spark):
    r = random.Random(0)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 80)] + [(r.randrange(2000, 2200), r.randrange(2000, 2200)) for _ in range(150)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    import itertools

    group = {}
    for a, b in edges:
        x, y = group.setdefault(a, {a}), group.setdefault(b, {b})
        if x is not y:
            x |= y
            for m in y:
                group[m] = x
    for n in got:
        assert {m for m in got if got[m] == got[n]} == group[n] & got.keys()
    assert set(got) == set(itertools.chain(*(e for e in edges if e[0] != e[1])))


def test_lines(docs, rows):
    got = line_dedup.dedup_lines(docs, counts=True).collect()
    seen = []
    plain = Counter()
    order = sorted(((brute.LAST if r[0] is None else r[0], n, " ".join(line.split())) for r in rows if r[1] is not None for n, line in enumerate(r[1].split("\n"))))
    for d, n, s in order:
        if s:
            seen.append((d, n, s))
    earlier = lambda p, s: any((d, n) < p and (x == s or (min(len(x), len(s)) >= 16 and line_dedup.within_one(x, s))) for d, n, x in seen)
    for i, t, *rest in rows:
        if t is None:
            plain[i, None, 0, 0] += 1
            continue
        own = t.split("\n")
        keep = [x for n, x in enumerate(own) if not (" ".join(x.split()) and earlier((brute.LAST if i is None else i, n), " ".join(x.split())))]
        plain[i, "\n".join(keep), len(own), len(own) - len(keep)] += 1
    assert Counter((g.doc_id, g.text, g.n_lines, g.n_removed) for g in got) == plain
    assert line_dedup.dedup_lines(docs).columns == docs.columns


def test_lines_against_all_pairs(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcd é") for _ in range(r.randint(10, 40))) for _ in range(20)]
    rows = []
    for i in range(150):
        own = []
        for _ in range(r.randint(0, 4)):
            x = list(r.choice(base))
            for _ in range(r.randint(0, 2)):
                k = r.randrange(len(x))
                x[k : k + r.randrange(2)] = r.choice(["", "b", "é"])
            own.append("".join(x))
        rows.append((i, "\n".join(own)))
    got = {g.doc_id: g.n_removed for g in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()}
    seen = []
    for i, t in rows:
        n = 0
        for line in t.split("\n"):
            s = " ".join(line.split())
            if s:
                n += any(s == x or (min(len(s), len(x)) >= 16 and line_dedup.within_one(s, x)) for x in seen)
                seen.append(s)
        assert got[i] == n


def test_empty_tables(empty):
    assert substring_dedup.dedup_substrings(empty).count() == 0
    assert suffix_dedup.dedup_bytes(empty).count() == 0
    assert simhash_dedup.near_duplicates(empty).count() == 0
    assert simhash_dedup.keep_one(empty).count() == 0
    assert line_dedup.dedup_lines(empty, counts=True).count() == 0


def test_chunks_hold_every_row(docs, rows, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 500)
    packed = chunks.pack(docs.select("doc_id", "text"))
    got = Counter()
    for c in packed.collect():
        b = chunks.from_ipc(bytes(c.payload))
        got.update(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    assert got == Counter(r[:2] for r in rows)
    assert packed.select("chunk").distinct().count() == packed.count() > 5


def test_query_digests(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.op10_substring_dedup(spark, d).collect()}
    assert got == {i: (n, m, brute.sha(k)) for i, n, m, k in brute.substring(docs)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op2_suffix_array_dedup(spark, d).collect()}
    assert got == {i: (n, m, s, brute.sha(k)) for i, n, m, s, k in brute.suffix(docs, 200)}


def jaccard(a, b, size=5):
    a, b = ({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_keep_one_finds_isolated_pairs_at_the_threshold(spark):
    """Pairs with no third copy, from just under 0.8 up: those at 0.8 or more lose one, the others stay whole."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows, alike = [], set()
    for g in range(200):
        base = [word() for _ in range(r.choice([60, 304]))]
        other = list(base)
        step = max(1, round(len(base) / (r.uniform(0.02, 0.14) * len(base) / 5 + 1)))
        for k in range(step // 2, len(base), step):
            other[k] = word()
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
        if jaccard(rows[-2][1], rows[-1][1]) >= 0.8:
            alike.add(2 * g + 1)
    assert 50 < len(alike) < 190
    kept = {x.doc_id for x in simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, _ in rows} - kept == alike


def test_keep_one_compares_all_of_a_key(spark):
    """Families of one base whose members are joined by their exact similarities only, in whatever order they lie."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = []
    for _ in range(6):
        base = [word() for _ in range(80)]
        for _ in range(25):
            own = list(base)
            for k in r.sample(range(80), r.randint(0, 3)):
                own[k] = word()
            rows.append((len(rows), " ".join(own)))
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if root[a] != root[b] and jaccard(rows[a][1], rows[b][1]) >= 0.8:
                root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    kept = {x.doc_id for x in simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(root)


def test_fingerprints_and_golay_keys_find_similar_sets():
    """Majority bits as a plain count gives them; sets of a similarity of 0.8 share a Golay key and lie within the radius."""
    from winnowry.llm import near_groups as G
    from winnowry.llm.words import mix

    r = np.random.default_rng(11)
    sets, at = [], [0]
    for shared, more, other in [(4, 0, 1), (8, 1, 1), (240, 0, 60), (272, 34, 34)] + 100 * [(56, 7, 7)]:
        both = r.integers(0, 1 << 63, shared).astype(np.uint64)
        for n in (more, other):
            sets.append(np.concatenate([both, r.integers(0, 1 << 63, n).astype(np.uint64)]))
            at.append(at[-1] + len(sets[-1]))
    got = G.fingerprints(np.concatenate(sets), np.array(at))
    for k in (0, 4, 7):
        for w in (0, G.WORDS - 1):
            h = mix(sets[k] ^ G._SEEDS[w]).tolist()
            assert int(got[k, w]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    for nodes in (1, 1 << 24):
        keys, extra = G.layout(nodes)
        k = G.cell_keys(got, keys, extra)
        assert (k[::2] == k[1::2]).any(axis=1).all()
        assert ((k[:-2:2] == k[2::2]).sum() < 40) and len(np.unique(k)) > 0
    assert (np.bitwise_count(got[8::2] ^ got[9::2]).sum(axis=1) <= G.RADIUS).all()
