"""Alignments that look at what came before: a cursor in a stream of letters, words of a page, two readings of it.

Each works on one document at a time, which is small; documents are dealt over the cluster.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Letters to look ahead and around, the first letters of a key that may stand for it, and from what length on.
AHEAD, AROUND, PREFIX, LONG, LEAST = 400, 3000, 16, 24, 2


def key(text: str) -> str:
    return re.sub("[^a-z0-9]", "", text.lower())


def find_near(stream: str, wanted: str, cursor: int) -> tuple[int, int]:
    """Range of a key's letters close to the cursor: beginning at most AHEAD letters on, else within AROUND of it; of a
    long key that isn't there, the range of its first letters. Empty at -1 if there is none."""
    for probe in (wanted, wanted[:PREFIX] if len(wanted) >= LONG else ""):
        places = (stream.find(probe, cursor, cursor + AHEAD + len(probe)), stream.find(probe, max(0, cursor - AROUND), cursor + AROUND)) if probe else ()
        at = next((p for p in places if p >= 0), -1)
        if at >= 0:
            return at, at + len(probe)
    return -1, -1


def labels_by_position(lines: list[str], events: list[tuple[str, str]]) -> list[str | None]:
    """The label of each line: that of most of its letters in the stream of labelled texts, found near a moving cursor."""
    stream = "".join(key(t) for t, _ in events)
    owner = [label for t, label in events for _ in key(t)]
    out, cursor = [], 0
    for line in lines:
        k = key(line)
        at, end = find_near(stream, k, cursor) if len(k) >= LEAST else (-1, -1)
        if at < 0:
            out.append(None)
            continue
        out.append(Counter(owner[at:end]).most_common(1)[0][0])
        cursor = max(cursor, end)
    return out


def align_labels(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, label) of docs(doc_id, lines array<string>, events array<struct<text,label>>)."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, lines, events in zip(f["doc_id"], f["lines"], f["events"], strict=True):
                lines = [] if lines is None else list(lines)
                events = [] if events is None else [(e["text"] or "", e["label"]) for e in events]
                rows += [(d, i, line, label) for i, (line, label) in enumerate(zip(lines, labels_by_position(lines, events), strict=True))]
            yield pd.DataFrame(rows, columns=["doc_id", "line_no", "line", "label"])

    return docs.select("doc_id", "lines", "events").mapInPandas(each, "doc_id long, line_no int, line string, label string")


def match_words(line: str, words: list[str], taken: set[int]) -> list[int]:
    """Numbers of the page's words that spell a line: a run of all of them, else the longest run that is free."""
    want = [key(w) for w in line.split() if key(w)]
    have = [key(w) for w in words]
    best: list[int] = []
    for start in range(len(have)):
        run = []
        for k, w in enumerate(want):
            i = start + k
            if i >= len(have) or i in taken or have[i] != w:
                break
            run.append(i)
        if len(run) > len(best):
            best = run
        if len(best) == len(want):
            break
    return best


def match_lines(lines: list[str], words: list[str]) -> list[list[int]]:
    """Words of each line; lines that match in full take theirs first."""
    taken: set[int] = set()
    out: list[list[int]] = [[] for _ in lines]
    for full in (True, False):
        for n, line in enumerate(lines):
            if not out[n]:
                got = match_words(line, words, taken)
                if got and (not full or len(got) == len([w for w in line.split() if key(w)])):
                    out[n] = got
                    taken.update(got)
    return out


# Letters that a gap must have to count, that a page and a run-together word need, the share of them that
# makes a page an image, the share that makes a gap bad, and words whose marks are no run-together words.
MIN_MISSING, MIN_PAGE, MIN_GLUED, IMAGE_SHARE, BAD_SHARE = 12, 60, 8, 0.2, 0.05
NOT_GLUED = re.compile(r"@|/|www\.|https?:|\.(?:com|org|edu|net|io)\b", re.IGNORECASE)


class Letters:
    """Words of a reading, their letters end to end, and the word that each letter belongs to."""

    def __init__(self, text: str):
        self.words = re.sub(r"\(cid:\d+\)", " ", text).split()
        self.keys = [key(w) for w in self.words]
        self.stream = "".join(self.keys)
        self.owner = [i for i, k in enumerate(self.keys) for _ in k]


def compare_readings(extracted: str, seen: str) -> dict:
    """What one reading of a page has that the other lacks.

    The letters of both are aligned. Where the page shows MIN_MISSING letters more than the text, its words that the text
    holds nowhere are missing. A word of the text is run together if its letters are those of several words of the page.
    """
    e, v = Letters(extracted), Letters(seen)
    missing, lost, matched, parts = [], 0, 0, {}
    for kind, a, a_end, b, b_end in difflib.SequenceMatcher(None, e.stream, v.stream, autojunk=False).get_opcodes():
        if kind == "equal":
            matched += a_end - a
            for i, j in zip(range(a, a_end), range(b, b_end), strict=True):
                parts.setdefault(e.owner[i], set()).add(v.owner[j])
        elif (b_end - b) - (a_end - a) >= MIN_MISSING:
            gone = [i for i in sorted(set(v.owner[b:b_end])) if v.keys[i] not in e.stream]
            letters = sum(len(v.keys[i]) for i in gone)
            if letters >= MIN_MISSING:
                missing.append(" ".join(v.words[i] for i in gone))
                lost += letters
    glued = []
    for i, own in sorted(parts.items()):
        pieces = sorted(own)
        apart = len(pieces) > 1 and len(re.sub("[^A-Za-z0-9]", "", e.words[i])) >= MIN_GLUED and not NOT_GLUED.search(e.words[i])
        if apart and "".join(v.keys[j] for j in pieces) == e.keys[i] and sum(len(v.keys[j]) > 1 for j in pieces) > 1:
            glued.append(e.words[i])
    n = len(v.stream)
    return {
        "coverage": round(matched / n, 3) if n else 1.0, "missing": missing, "missing_share": round(lost / n, 3) if n else 0.0,
        "glued": glued, "image_only": n >= MIN_PAGE and len(e.stream) < IMAGE_SHARE * n,
    }


def reading_risks(compared: dict) -> list[tuple[str, str]]:
    """(level, kind) of what a comparison shows; one ok if nothing."""
    out = []
    if compared["image_only"]:
        out.append(("bad", "image only"))
    elif compared["missing"]:
        out.append(("bad" if compared["missing_share"] >= BAD_SHARE else "warn", "text missing"))
    if compared["glued"]:
        out.append(("warn", "words run together"))
    return out or [("ok", "readings agree")]


def visual_risks(pages: DataFrame) -> DataFrame:
    """(doc_id, level, kind, coverage, missing, glued), a row a risk, of pages(doc_id, text, seen): seen comes from a reader of the image."""

    def each(frames):
        for f in frames:
            rows = []
            for d, t, s in zip(f["doc_id"], f["text"], f["seen"], strict=True):
                c = compare_readings(t or "", s or "")
                rows += [(d, level, kind, c["coverage"], c["missing"], c["glued"]) for level, kind in reading_risks(c)]
            yield pd.DataFrame(rows, columns=["doc_id", "level", "kind", "coverage", "missing", "glued"])

    return pages.select("doc_id", "text", "seen").mapInPandas(each, "doc_id long, level string, kind string, coverage double, missing array<string>, glued array<string>")


def concatenation_of(text: str, parts: set[str]) -> bool:
    """Whether a key is two or more known keys run together."""
    k = key(text)
    whole = {key(p) for p in parts} - {""}
    reach = {0: 0}
    for end in range(1, len(k) + 1):
        counts = [reach[s] for s in range(end) if s in reach and k[s:end] in whole]
        if counts:
            reach[end] = max(counts) + 1
    return reach.get(len(k), 0) >= 2


def merge_wrapped(lines: list[tuple[str, float, float, float]], width: float) -> list[tuple[str, list[int]]]:
    """(text, numbers of its parts) of blocks of lines (text, left, right, size): a line goes on the one before if that
    reached the margin where the next word would not have fitted, both look alike, and it begins no item; a hyphen at the
    break is taken out."""
    out: list[tuple[str, list[int]]] = []
    for n, (text, left, _, size) in enumerate(lines):
        if out:
            whole, parts = out[-1]
            _, left0, right0, size0 = lines[parts[-1]]
            first = text.split(" ", 1)[0]
            fits = right0 + 0.5 * size * (len(first) + 1) <= width
            alike = abs(size - size0) < 0.5 and left >= left0 - 1
            if text and whole and not fits and alike and not re.match(r"[-•*·▪◦●■–]\s|\d+[.)]\s", text) and not whole.endswith((".", ":", "!", "?")):
                glue = whole[:-1] + text if re.search(r"[a-z]-$", whole) and text[:1].islower() else f"{whole} {text}"
                out[-1] = (glue, [*parts, n])
                continue
        out.append((text, [n]))
    return out
