"""Vectors of text chunks without a language model: TF-IDF and a truncated singular value decomposition.

Which backend makes vectors is chosen once and goes with them, for vectors of different ones can't be compared.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.linalg import DenseMatrix
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunks
from .scoring import STOP_WORDS, dot, unit

MOST_DIMENSIONS = 100
FALLBACK = "lsa"


def choose_backend(encoder: object | None = None, forced: str | None = None, allow_fallback: bool = True) -> str:
    """The name of the backend: that of a sentence encoder if there is one, else the decomposition.

    forced: "lsa", or the encoder's name, which is then an error if it is not there.
    """
    name = getattr(encoder, "name", None)
    if forced == FALLBACK:
        return FALLBACK
    if name and forced in (None, name):
        return name
    if forced or not allow_fallback:
        raise RuntimeError(f"no encoder {forced or ''}".strip())
    return FALLBACK


def chunked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, chunk)."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(chunks(text)).alias("n", "chunk"))


def weights(rows: DataFrame, idf: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((key, term, w), idf): unit vectors of (1 + ln tf) * idf over words that are no stop words. rows: distinct key, chunk."""
    words = F.filter(F.regexp_extract_all(F.lower("chunk"), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))
    tf = rows.select("key", F.explode(words).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    if idf is None:
        n = rows.agg(F.count("*").alias("n"))
        idf = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, "term").select("key", "term", ((1 + F.log("tf")) * F.col("idf")).alias("x"))
    each = raw.groupBy("key").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.collect_list(F.struct("term", "x")).alias("t"))
    return each.select("key", "norm", F.inline("t")).select("key", "term", (F.col("x") / F.col("norm")).alias("w")), idf


@dataclass
class Lsa:
    """terms: (term, idf, v) with each term's place in the space, an array of `dimensions` numbers."""

    terms: DataFrame
    dimensions: int
    name: str = FALLBACK

    @classmethod
    def fit(cls, docs: DataFrame, dimensions: int | None = None) -> Lsa:
        """From distinct chunks; 2 to MOST_DIMENSIONS dimensions, fewer than there are chunks. The decomposition is distributed by chunk."""
        rows = chunked(docs).select("chunk").distinct().withColumn("key", F.xxhash64("chunk"))
        w, idf = weights(rows)
        vocabulary = idf.select("term").rdd.map(lambda r: r[0]).sortBy(lambda t: t).zipWithIndex().toDF("term string, i long")
        size = vocabulary.count()
        numbered = w.join(vocabulary, "term").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("v")).persist()
        k = dimensions or max(2, min(MOST_DIMENSIONS, numbered.count() - 1))
        k = min(k, size)
        matrix = RowMatrix(numbered.rdd.map(lambda r: OldVectors.sparse(size, [x["i"] for x in r["v"]], [x["w"] for x in r["v"]])), numCols=size)
        found = matrix.computeSVD(k)
        v = DenseMatrix(found.V.numRows, found.V.numCols, found.V.values).toArray()
        numbered.unpersist()
        spark = docs.sparkSession
        places = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "i long, v array<double>")
        return cls(vocabulary.join(places, "i").join(idf, "term").select("term", "idf", "v"), v.shape[1])

    def encode(self, rows: DataFrame) -> DataFrame:
        """(key, vector) of rows (key, chunk): unit vectors; a chunk without a known term has none."""
        w, _ = weights(rows, self.terms.select("term", "idf"))
        each = w.join(self.terms.select("term", "v"), "term").select("key", F.transform("v", lambda x: x * F.col("w")).alias("v"))
        total = each.groupBy("key").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(self.dimensions))).alias("v"))
        return total.select("key", unit("v").alias("vector"))


def score(docs: DataFrame, posting: str, model: Lsa) -> DataFrame:
    """(doc_id, score, backend): the greatest similarity of the posting's chunks and a document's mean vector, never below zero."""
    spark = docs.sparkSession
    rows = chunked(docs)
    vectors = model.encode(rows.select("chunk").distinct().withColumn("key", F.xxhash64("chunk")))
    from .scoring import mean_vector

    own = mean_vector(rows.withColumn("key", F.xxhash64("chunk")).join(vectors, "key"), "doc_id", "vector")
    asked = spark.createDataFrame([(0, posting)], "doc_id int, text string")
    wanted = model.encode(chunked(asked).select("chunk").distinct().withColumn("key", F.xxhash64("chunk"))).select(F.col("vector").alias("p"))
    return own.crossJoin(F.broadcast(wanted)).groupBy("doc_id").agg(F.greatest(F.lit(0.0), F.max(dot("vector", "p"))).alias("score")).withColumn("backend", F.lit(model.name))
