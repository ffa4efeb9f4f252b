"""Language of texts by error-correcting output codes over hashed byte n-grams.

Every language has a codeword. For each bit a binary logistic classifier is learned; a text's bits are weighed by
the loss of their margins against each codeword and the codeword of least total loss is the language. The score
is the softmax of the negative losses. A text is ambiguous if its signs lie farther from the codeword than half
the least distance of the code, or if the runner-up's loss is within MARGIN of the best.

Classifiers are learned from a bounded sample: SAMPLE texts a language at most, taken by a hash of doc_id, of the
rows whose crc32(doc_id) is not divisible by FOLDS; features cover whole texts. The model is as large as the
number of languages that have labels, and doesn't grow with the corpus.

Nulls: a null text, and one without a letter, is `und` with score 0; rows without lang are never learned from; a
null doc_id counts as held out and is returned as null. Repeated rows are each returned. An empty table gives an
empty result; without any label every text is `und`. Codewords of equal loss go to the language first in order. A very
long text is counted in one piece, some 20 bytes a byte. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import freed, table
from .words import U64, flat

FEATURES = 1 << 11
SAMPLE, FOLDS, MARGIN = 1000, 5, 0.5
PASSES, RATE, SHRINK = 150, 4.0, 1e-5
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 512
UNKNOWN = "und"
LETTER = np.full(256, 0x20, np.uint8)
LETTER[128:] = np.arange(128, 256)
LETTER[97:123] = LETTER[65:91] = np.arange(97, 123)


def code(classes: int) -> np.ndarray:
    """A codeword of signs for each class: all ways to part few classes, else the best of random codes."""
    if classes < 2:
        return np.ones((classes, 1))
    if classes <= 7:
        columns = np.arange(1, 1 << (classes - 1))
        return np.where(np.concatenate((np.zeros((1, len(columns)), int), columns[None] >> np.arange(classes - 1)[:, None] & 1)), 1.0, -1.0)
    rng = np.random.default_rng(0)
    draws = (rng.choice((-1.0, 1.0), (classes, 10 * math.ceil(math.log2(classes)))) for _ in range(200))
    return max(draws, key=distance_of)


def distance_of(words: np.ndarray) -> int:
    """Least number of bits in which two codewords differ."""
    apart = (words.shape[1] - words @ words.T) / 2
    return int((apart + np.eye(len(words)) * words.shape[1]).min()) if len(words) > 1 else words.shape[1]


def vectors(column: pa.Array):
    """For ranges of rows: (first, last, unit vectors of root counts)."""
    buf, offsets = flat(column)
    first = 0
    while first < len(column):
        last = min(first + BLOCK_ROWS, max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1))
        b = LETTER[buf[offsets[first] : offsets[last]]].astype(np.uint32)
        own = offsets[first : last + 1] - offsets[first]
        n = last - first
        total = np.zeros(n * FEATURES)
        row = np.repeat(np.arange(n, dtype=np.int64) * FEATURES, np.diff(own))
        two = b[:-1] << np.uint32(8) | b[1:]
        three = two[:-1] << np.uint32(8) | b[2:]
        for grams, size, salt, blank in ((two, 2, 0x9E3779B1, 0x2020), (three, 3, 0x85EBCA77, 0x202020)):
            slot = (grams * np.uint32(salt)) >> np.uint32(21)
            same = (row[: len(grams)] == row[size - 1 :]) & (grams != blank)
            total += np.bincount((row[: len(grams)] + slot)[same], minlength=n * FEATURES)
        x = np.sqrt(total).reshape(n, FEATURES)
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        yield first, last, (x / np.maximum(norm, 1e-12)).astype(np.float32)
        first = last


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logistic weights and offsets of each column of signs y, by gradient descent with momentum."""
    weight, bias = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    speed, pace = np.zeros_like(weight), np.zeros_like(bias)
    center = x.mean(axis=0)
    x = x - center
    share = np.float32(1 / len(x))
    for _ in range(PASSES):
        pull = -y / (1 + np.exp(np.clip(y * (x @ weight + bias), -30, 30))) * share
        speed = 0.9 * speed - RATE * (x.T @ pull + SHRINK * weight)
        pace = 0.9 * pace - RATE * pull.sum(axis=0)
        weight, bias = (weight + speed).astype(np.float32), (bias + pace).astype(np.float32)
    return weight, (bias - center @ weight).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text is divisible by FOLDS."""
    return F.pmod(F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)), F.lit(FOLDS)) == 0


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"):
    """(languages, codewords, weights, offsets), or None without labels; learned in one task from the bounded sample."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # A hash of doc_id in [0, 1) takes SAMPLE rows of each language or all, up to chance; the learner keeps the first SAMPLE.
    place = (F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / (1 << 30)).alias("place")
    count = rows.groupBy("lang").count().select("lang", (F.lit(1.3 * SAMPLE) / F.col("count")).alias("rate"))
    some = rows.select("lang", "text", place).join(F.broadcast(count), "lang").where("place < rate").select("lang", "place", "text")

    def vector(batches):
        for b in batches:
            for first, last, x in vectors(b.column(2)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), b.column(1).slice(first, last - first), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "place", "x"])

    def train(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by([("lang", "ascending"), ("place", "ascending")])
        langs = np.array(t.column("lang").to_pylist(), object)
        names = sorted(set(langs.tolist()))
        keep = np.concatenate([np.flatnonzero(langs == n)[:SAMPLE] for n in names])
        x = np.frombuffer(b"".join(t.column("x").take(pa.array(keep)).to_pylist()), np.float32).reshape(len(keep), FEATURES)
        words = code(len(names))
        y = words[np.searchsorted(names, langs[keep].tolist())].astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((names, words, *fit(x, y)))], pa.binary())], names=["model"])

    got = some.mapInArrow(freed(vector), "lang string, place double, x binary").repartition(1).mapInArrow(freed(train), "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else None  # written by train() above


def decode(margins: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, score and ambiguity of each row of margins."""
    loss = np.logaddexp(0, -margins[:, None, :] * words[None]).sum(axis=2)
    best = loss.argmin(axis=1)
    share = np.exp(loss.min(axis=1, keepdims=True) - loss)
    score = 1 / share.sum(axis=1)
    apart = ((margins > 0) != (words[best] > 0)).sum(axis=1)
    close = np.partition(loss, 1, axis=1)[:, 1] - loss.min(axis=1) < MARGIN if len(words) > 1 else np.zeros(len(best), bool)
    return best, score, close | (apart > (distance_of(words) - 1) // 2)


def identify(docs: DataFrame, model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row doc_id, held_out, lang_pred, score and ambiguous."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches):
        names, words, weight, bias = sent.value if sent.value else ([], None, None, None)
        for b in batches:
            column = b.column(2)
            buf, offsets = flat(column)
            ascii_ = np.concatenate(([0], np.cumsum((LETTER[buf] != 0x20) & (buf < 128))))[offsets]
            has = np.diff(ascii_) > 0
            for i in np.flatnonzero(~has & (np.diff(offsets) > 0)).tolist():
                has[i] = any(c.isalpha() for c in column[i].as_py())
            langs, scores, unsure = [UNKNOWN] * len(column), np.zeros(len(column)), ~has
            if names:
                for first, last, x in vectors(column):
                    best, score, close = decode((x @ weight + bias).astype(np.float64), words)
                    langs[first:last] = [names[k] for k in best.tolist()]
                    scores[first:last], unsure[first:last] = score, close | unsure[first:last]
            langs = [n if h else UNKNOWN for n, h in zip(langs, has.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(np.where(has, scores, 0.0)), pa.array(unsure)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(freed(predicted), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the folds that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))


QUERIES = {"op5_language_id": op5_language_id}
