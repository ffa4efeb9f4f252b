"""Scores of documents against a posting: weighted keywords, TF-IDF and vectors."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.terms import any_pattern

# Weight by level, and the share of a term that no taxonomy knows.
LEVEL_WEIGHT = {"required": 2.0, "preferred": 1.0}
UNCURATED = 0.5


@dataclass(frozen=True)
class Requirement:
    name: str
    surface: str
    level: str = "required"
    curated: bool = True
    group: str | None = None

    @property
    def weight(self) -> float:
        return LEVEL_WEIGHT[self.level] * (1 if self.curated else UNCURATED)


class Scorer(Protocol):
    """What screening needs of a scorer: a name, and a Column of scores for a posting."""

    name: str

    def score(self, text: Column | str, requirements: list[Requirement]) -> Column: ...


def units(requirements: list[Requirement]) -> list[list[Requirement]]:
    """Alternatives of one group count as one unit, others alone."""
    out: dict[str, list[Requirement]] = {}
    for r in requirements:
        out.setdefault(r.group or f"\0{r.name}", []).append(r)
    return list(out.values())


@dataclass(frozen=True)
class Keyword:
    """Share of a posting's weight whose units occur. taxonomy: forms by skill, and skills by broader skill, also match."""

    taxonomy: object | None = None
    name: str = "keyword"

    def forms(self, r: Requirement) -> list[str]:
        more = self.taxonomy.match_forms(r.name) if self.taxonomy is not None and r.curated else []
        return list(dict.fromkeys([r.surface, *more]))

    def hit(self, text: Column | str, r: Requirement) -> Column:
        text = F.col(text) if isinstance(text, str) else text
        return F.coalesce(text.rlike(any_pattern(self.forms(r))), F.lit(False))

    def explain(self, text: Column | str, requirements: list[Requirement]) -> Column:
        """struct(score, matched, missing). Each term is looked for once a document."""
        parts = []
        for unit in units(requirements):
            hit = reduce(Column.__or__, [self.hit(text, r) for r in unit])
            parts.append(F.struct(hit.alias("hit"), F.lit(float(max(r.weight for r in unit))).alias("w"), F.lit(" / ".join(r.surface for r in unit)).alias("label")))
        if not parts:
            none = F.array().cast("array<string>")
            return F.struct(F.lit(0.0).alias("score"), none.alias("matched"), none.alias("missing"))
        total = sum(max(r.weight for r in u) for u in units(requirements))

        def told(found):
            label = lambda want: F.transform(F.filter(found, lambda x: x["hit"] == want), lambda x: x["label"])
            score = F.aggregate(found, F.lit(0.0), lambda a, x: a + F.when(x["hit"], x["w"]).otherwise(0.0)) / total
            return F.struct(score.alias("score"), label(True).alias("matched"), label(False).alias("missing"))

        return F.transform(F.array(F.array(*parts)), told)[0]

    def score(self, text: Column | str, requirements: list[Requirement]) -> Column:
        total = sum(max(r.weight for r in u) for u in units(requirements))
        got = [F.when(reduce(Column.__or__, [self.hit(text, r) for r in u]), float(max(r.weight for r in u))).otherwise(0.0) for u in units(requirements)]
        return reduce(Column.__add__, got) / total if got else F.lit(0.0)


# English words that TF-IDF leaves out where the caller gives no list of its own.
STOP_WORDS = tuple("a about after all also an and any are as at be because been before but by can could did do does for from had has have he her his how i if in into is it its just like me more most my no not of on one only or other our out over she so some such than that the their them then there these they this to under up us was we were what when where which who will with would you your".split())


def term_list(text: Column | str, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-case words without stop words, then their pairs: stop words are gone before pairs are formed."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w[\w+#]*"), F.lit(0)), lambda w: ~w.isin(*stop))

    def grams(own):
        pairs = F.when(F.size(own) > 1, F.transform(F.sequence(F.lit(0), F.size(own) - 2), lambda i: F.concat_ws(" ", own[i], own[i + 1]))).otherwise(F.array().cast("array<string>"))
        return F.concat(own, pairs)

    return F.transform(F.array(words), grams)[0]


def term_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(doc_id, term, tf), dealt by document: texts are sent there whole, for their terms and pairs take several times as much."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return own.select("doc_id", F.explode(term_list("text", stop)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def fit_idf(counts: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + n) / (1 + df)) + 1. n_docs: one row with n."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n_docs)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


class NotFitted(RuntimeError):
    """A scorer that needs a pool was asked before it saw one."""


class TfIdf:
    """TF-IDF against postings, fitted once on a pool and its postings, so that variants of a text never change weights."""

    name = "tfidf"

    def __init__(self, stop: tuple[str, ...] = STOP_WORDS):
        self.stop, self.idf = stop, None

    def counts(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        return term_counts(rows, key, text, self.stop)

    def fit(self, pool: DataFrame, postings: DataFrame, doc_id: str = "doc_id", posting_id: str = "posting_id", text: str = "text") -> TfIdf:
        both = pool.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("t")).unionAll(postings.select(F.concat(F.lit("posting "), F.col(posting_id).cast("string")), F.col(text)))
        self.idf = fit_idf(self.counts(both, "id", "t"), both.agg(F.count("*").alias("n")))
        return self

    def score(self, pool: DataFrame, postings: DataFrame, doc_id: str = "doc_id", posting_id: str = "posting_id", text: str = "text") -> DataFrame:
        """(doc_id, posting_id, score) of the pairs with a common term."""
        if self.idf is None:
            raise NotFitted("fit() comes first")
        own = weigh(self.counts(postings, posting_id, text), self.idf)
        return cosine(weigh_against(self.counts(pool, doc_id, text), self.idf, own), own)


def weigh(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(doc_id, term, w): unit vectors of tf * idf; terms the fit doesn't know are left out."""
    raw = counts.join(idf.select("term", "idf"), "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("x"))
    each = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.collect_list(F.struct("term", "x")).alias("terms"))
    return each.select("doc_id", "norm", F.inline("terms")).select("doc_id", "term", (F.col("x") / F.col("norm")).alias("w"))


def weigh_against(counts: DataFrame, idf: DataFrame, postings: DataFrame) -> DataFrame:
    """weigh(), with only those terms left that a posting has: one shuffle by term, one by document, each row a document's own.

    A document's length takes all its terms, so it is summed before the others go.
    """
    known = idf.select("term", "idf").join(postings.select("term").distinct().withColumn("wanted", F.lit(True)), "term", "left")
    raw = counts.join(known, "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("x"), "wanted")
    each = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.collect_list(F.when(F.col("wanted"), F.struct("term", "x"))).alias("terms"))
    return each.select("doc_id", "norm", F.inline("terms")).select("doc_id", "term", (F.col("x") / F.col("norm")).alias("w"))


#: Rows of posting vectors that a broadcast may hold; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def small(rows: DataFrame) -> DataFrame:
    """rows, sent to all executors while they are few, which is counted."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def cosine(docs: DataFrame, posting: DataFrame) -> DataFrame:
    """(doc_id, posting_id, score) from two tables of unit vectors; pairs without a common term score nothing and have no row."""
    other = posting.select(F.col("doc_id").alias("posting_id"), "term", F.col("w").alias("v"))
    return docs.join(small(other), "term").groupBy("doc_id", "posting_id").agg(F.sum(F.col("w") * F.col("v")).alias("score"))


def contributions(docs: DataFrame, posting: DataFrame, k: int = 8) -> DataFrame:
    """(doc_id, posting_id, terms): the k terms that add most to the score, ties by term."""
    other = posting.select(F.col("doc_id").alias("posting_id"), "term", F.col("w").alias("v"))
    each = docs.join(small(other), "term").select("doc_id", "posting_id", F.struct((-F.round(F.col("w") * F.col("v"), 9)).alias("x"), "term").alias("e"))
    return each.groupBy("doc_id", "posting_id").agg(F.slice(F.array_sort(F.collect_list("e")), 1, k).alias("e")).select("doc_id", "posting_id", F.transform("e", lambda x: x["term"]).alias("terms"))


def lengths(counts: DataFrame, others: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(doc_id, norm) of the vectors of counts, fitted on them and others: terms go to one place once, where their documents are counted and weighed."""
    both = counts.select("doc_id", "term", "tf", F.lit(True).alias("own")).unionAll(others.select(F.lit(None), "term", "tf", F.lit(False)))
    both = both.withColumn("df", F.count("*").over(Window.partitionBy("term"))).where("own").crossJoin(F.broadcast(n_docs))
    x = F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    return both.groupBy("doc_id").agg(F.sqrt(F.sum(x * x)).alias("norm"))


def against_postings(counts: DataFrame, postings: DataFrame, n_docs: DataFrame, k: int | None = None) -> DataFrame | None:
    """What cosine() gives, or with k contributions(), of counts fitted on themselves and on the counts of postings.

    A document meets the postings' vectors, which are sent to all workers, in one row: pairs are never shuffled, sorted or
    kept, and leave the worker as results. None if the vectors have more than BROADCAST_ROWS rows, which is counted.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if postings.count() > BROADCAST_ROWS:
        return None
    terms = F.broadcast(postings.select("term").distinct())
    near = counts.join(terms, "term")
    idf = fit_idf(near.select("term").unionAll(postings.select("term")), n_docs)
    rows = weigh(postings, idf).join(idf.select("term", "idf"), "term").select("doc_id", "term", "w", "idf").collect()
    ids = sorted({r.doc_id for r in rows})
    number, by_term = {d: i for i, d in enumerate(ids)}, {}
    for r in sorted(rows, key=lambda r: (r.term.encode(), number[r.doc_id])):
        by_term.setdefault(r.term, (len(by_term), r.idf, [], []))
        by_term[r.term][2].append(number[r.doc_id])
        by_term[r.term][3].append(r.w)
    sent = counts.sparkSession.sparkContext.broadcast((ids, list(by_term), by_term))
    kinds = counts.schema["doc_id"].dataType.simpleString(), postings.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(postings.schema["doc_id"].dataType)

    def results(batches):
        import numpy as np
        import pyarrow as pa

        ids, names, by_term = sent.value
        vectors = {t: (n, idf, np.array(at), np.array(w)) for t, (n, idf, at, w) in by_term.items()}
        names = np.array(names, dtype=object)
        for batch in batches:
            for i in range(batch.num_rows):
                doc, norm, own = batch["doc_id"][i], batch["norm"][i].as_py(), batch["terms"][i].as_py()
                found = [(*vectors[t["term"]], t["tf"]) for t in own]
                sizes = [len(f[2]) for f in found]
                at, x = np.concatenate([f[2] for f in found]), np.concatenate([f[4] * f[1] / norm * f[3] for f in found])
                if k is None:
                    score, hit = np.bincount(at, x, len(ids)), np.flatnonzero(np.bincount(at, minlength=len(ids)))
                    value = pa.array(score[hit])
                else:
                    term, x = np.repeat([f[0] for f in found], sizes), np.floor(x * 1e9 + 0.5)
                    order = np.lexsort((term, -x, at))
                    at, term = at[order], term[order]
                    hit, first = np.unique(at, return_index=True)
                    value = pa.array([list(names[term[a:min(a + k, z)]]) for a, z in zip(first, [*first[1:], len(at)])], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(hit), doc.type), pa.array([ids[j] for j in hit], id_type), value], names=["doc_id", "posting_id", "score" if k is None else "terms"])

    near = near.groupBy("doc_id").agg(F.collect_list(F.struct("term", "tf")).alias("terms"))
    near = near.join(lengths(counts, postings, n_docs), "doc_id")
    return near.mapInArrow(results, f"doc_id {kinds[0]}, posting_id {kinds[1]}, " + ("score double" if k is None else "terms array<string>"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column | str) -> Column:
    """The vector at length one; a zero vector stays."""
    v = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def vector_score(a: Column | str, b: Column | str) -> Column:
    """Similarity of unit vectors, never below zero."""
    return F.greatest(F.lit(0.0), dot(a, b))


def mean_vector(chunks: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): mean of a document's chunk vectors at length one. Vectors are summed whole, on the map side first."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    each = chunks.groupBy(key).agg(Summarizer.mean(array_to_vector(vector)).alias("m"))
    return each.select(key, unit(vector_to_array("m")).alias("vector"))
