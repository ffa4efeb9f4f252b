"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

LAST = 1 << 62


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def substring(rows, size=13):
    """(doc_id, n_words, n_removed, kept) of each row, in order."""
    rank = lambda i: LAST if i is None else i
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, LAST), rank(i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < rank(i):
                gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def suffix(rows, size):
    count = Counter(b[k : k + size] for _, t in rows for b in [(t or "").encode()] for k in range(len(b) - size + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if count[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def fingerprint(text, size):
    import xxhash

    w = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    s = [b" ".join(w[k : k + size]) for k in range(len(w) - size + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows, size=3, radius=3):
    prints = [fingerprint(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), LAST), i)
    return [(i, f"{p:016x}", least.get(find(k))) for k, ((i, _), p) in enumerate(zip(rows, prints))]


def statistics(text):
    w = words(text)
    count = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    twice = [False] * len(w)
    for k in range(len(w) - 4):
        if count[tuple(w[k : k + 5])] > 1:
            twice[k : k + 5] = [True] * 5
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, sum(twice)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
