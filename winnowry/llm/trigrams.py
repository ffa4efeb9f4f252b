"""Boolean trigram queries that every match of a regular expression satisfies.

A query is a list of sets: a text can only match if it holds all trigrams of one of the sets, in lower case. None
means that the expression has matches without any mandatory trigram.
"""

from __future__ import annotations

import re._parser as syntax
from itertools import product

#: Strings that a part of an expression may stand for before it counts as open.
FEW = 64


def query(pattern: str) -> list[frozenset[str]] | None:
    words, found = _sequence(syntax.parse(pattern))
    if words is not None:
        found = _both(found, _of(words))
    return None if frozenset() in found else _least(found)


def _of(words: set[str]) -> list[frozenset[str]]:
    """A text that holds one of the words holds all trigrams of one of these sets."""
    return _least([frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in words])


def _least(sets: list[frozenset[str]]) -> list[frozenset[str]]:
    return sorted({s for s in sets if not any(t < s for t in sets)}, key=sorted)


def _both(a: list[frozenset[str]], b: list[frozenset[str]]) -> list[frozenset[str]]:
    return _least([x | y for x, y in product(a, b)])


def _sequence(parts) -> tuple[set[str] | None, list[frozenset[str]]]:
    """All strings that the parts stand for, or None if many, and the query of what precedes them."""
    words, found, closed = {""}, [frozenset()], True
    for part in parts:
        own, inner = _one(part)
        found = _both(found, inner)
        if own is not None and len(words) * len(own) <= FEW:
            words = {a + b for a, b in product(words, own)}
            continue
        closed = False
        found = _both(found, _of(words))
        words = {""}
        if own is not None:
            words = own
    if closed:
        return words, found
    return None, _both(found, _of(words))


def _one(part) -> tuple[set[str] | None, list[frozenset[str]]]:
    kind, value = str(part[0]), part[1]
    free = [frozenset()]
    if kind == "LITERAL":
        return {chr(value).lower()}, free
    if kind == "IN":
        chars: set[str] = set()
        for what, x in value:
            if str(what) == "LITERAL":
                chars.add(chr(x).lower())
            elif str(what) == "RANGE" and x[1] - x[0] < 4:
                chars |= {chr(i).lower() for i in range(x[0], x[1] + 1)}
            else:
                return None, free
        return (chars, free) if len(chars) <= 8 else (None, free)
    if kind == "SUBPATTERN":
        return _sequence(value[-1])
    if kind == "BRANCH":
        each = [_sequence(x) for x in value[1]]
        if all(w is not None for w, _ in each) and sum(len(w) for w, _ in each) <= FEW:
            return set().union(*(w for w, _ in each)), free
        return None, _least([s for w, q in each for s in (q if w is None else _both(q, _of(w)))])
    if kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, inner = value
        words, found = _sequence(inner)
        if low == 0:
            return ({""} | words, free) if high == 1 and words is not None else (None, free)
        if low == high == 1:
            return words, found
        return None, found if words is None else _both(found, _of(words))
    return ({""}, free) if kind == "AT" else (None, free)
