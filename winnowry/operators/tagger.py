"""A learned label for each line: hashed n-grams and shapes, a multinomial classifier, headings fed back.

Labels of the first pass say which lines are headings; the second pass sees the heading above each line. A
correction is learned by fitting again on a bounded memory in which corrected documents weigh more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lines as L
from .sampling import newest

GRAMS, WORDS, MEMORY, NEW_WEIGHT = 4096, 2048, 30_000, 3.0


def features(rows: DataFrame, is_heading) -> DataFrame:
    """rows (doc_id, line_no, line) with a vector `features`: n-grams of the line and of the heading above it, words around it, shape."""
    own = L.heading_context(L.neighbours(rows), is_heading)
    own = own.withColumns({"g_line": L.ngrams("line"), "g_head": L.ngrams("heading_above"), "w_near": F.concat(L.words(F.lower("before")), L.words(F.lower("after")))})
    own = own.join(L.shape(rows).withColumnRenamed("features", "shape"), ["doc_id", "line_no"]).withColumn("shape", array_to_vector("shape"))
    stages = [HashingTF(inputCol=c, outputCol=f"h_{c}", numFeatures=n) for c, n in (("g_line", GRAMS), ("g_head", GRAMS), ("w_near", WORDS))]
    for s in (*stages, VectorAssembler(inputCols=["h_g_line", "h_g_head", "h_w_near", "shape"], outputCol="features")):
        own = s.transform(own)
    return own.drop("g_line", "g_head", "w_near", "h_g_line", "h_g_head", "h_w_near", "shape", "before", "after")


@dataclass
class Tagger:
    """labels: names by number. model: of the number."""

    labels: tuple[str, ...]
    model: LogisticRegressionModel | PipelineModel

    @classmethod
    def fit(cls, rows: DataFrame, labels: tuple[str, ...] = L.LABELS, passes: int = 30) -> Tagger:
        """From lines with a column label (lines without one are context only), and a weight if there is one."""
        known = F.create_map(*(F.lit(x) for i, n in enumerate(labels) for x in (n, float(i))))
        own = features(rows, F.col("label") == "heading").where(F.col("label").isNotNull()).withColumn("y", F.element_at(known, F.col("label")))
        weigh = {"weightCol": "weight"} if "weight" in rows.columns else {}
        return cls(labels, LogisticRegression(labelCol="y", maxIter=passes, regParam=1e-4, family="multinomial", **weigh).fit(own))

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with predicted: a pass with headings by their look, then one with those it found."""
        names = F.array(*map(F.lit, self.labels))
        rows = rows.select("doc_id", "line_no", "line")
        once = self.model.transform(features(rows, L.looks_like_heading("line"))).select("doc_id", "line_no", "line", (names[F.col("prediction").cast("int")] == "heading").alias("_h"))
        twice = self.model.transform(features(once, F.col("_h")))
        return twice.select("doc_id", "line_no", "line", names[F.col("prediction").cast("int")].alias("predicted"))

    def learn(self, memory: DataFrame, corrected: DataFrame) -> tuple[Tagger, DataFrame]:
        """The tagger after a correction, and the memory with it. memory: lines with label and seq; the newest MEMORY stay."""
        new = corrected.withColumn("weight", F.lit(NEW_WEIGHT))
        kept = newest(memory.select("doc_id", "line_no", "line", "label", "seq"), "seq", MEMORY)
        both = kept.withColumn("weight", F.lit(1.0)).unionByName(new.select("doc_id", "line_no", "line", "label", "seq", "weight"))
        return Tagger.fit(both, self.labels), newest(kept.unionByName(new.select(*kept.columns)), "seq", MEMORY)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, labels: tuple[str, ...] = L.LABELS) -> Tagger | None:
        """None where there is no model that can be read."""
        from py4j.protocol import Py4JJavaError
        from pyspark.errors import PySparkException

        try:
            return cls(labels, LogisticRegressionModel.load(path))
        except (Py4JJavaError, PySparkException):
            return None


def parse(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """docs (doc_id, text) with fields from the sections that the tagger finds."""
    from ..functions.fields import parse as parse_fields

    rows = tagger.predict(L.exploded(docs))
    found = L.labelled_sections(rows.withColumnRenamed("predicted", "label"))
    own = docs.join(found.select("doc_id", F.col("sections").alias("_sections"), F.col("name").alias("_name")), "doc_id", "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return parse_fields(own, "text", F.coalesce("_sections", none), F.col("_name")).drop("_sections", "_name")


def blend(text: dict[str, Column], other: dict[str, Column], weight: float = 0.5, shared: tuple[str, ...] = ("heading", "name")) -> dict[str, Column]:
    """Probabilities by label of two models as one: those of the shared labels averaged, `weight` being the other's share;
    what is left is split among the remaining labels as the first model says."""
    out = {n: (1 - weight) * text[n] + weight * other[n] for n in shared}
    rest = [n for n in text if n not in shared]
    left = F.greatest(F.least(1 - sum(out.values(), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    total = F.greatest(sum((text[n] for n in rest), F.lit(0.0)), F.lit(1e-9))
    return out | {n: text[n] / total * left for n in rest}


# Names of a line's geometry numbers, and how far training copies are perturbed.
GEOMETRY = (
    "has_geometry", "size_ratio", "is_largest", "bold", "italic", "colored", "x0", "x1", "width",
    "right_aligned", "centered", "gap_above", "gap_below", "letter_spacing", "single_letter_words",
    "rule_below", "shaded", "in_table", "in_box", "indent_change",
)
HIDDEN, SIZE, GAP, SHIFT = 0.15, (0.85, 1.15), (0.5, 2.0), 0.05
SPRINKLED = {"italic": (0.4, 0.25), "bold": (0.3, 0.1), "colored": (0.15, 0.1)}


def perturbed(rows: DataFrame, seed: int = 0) -> DataFrame:
    """rows (doc_id, line_no, label, geometry) with the geometry changed as another renderer might have it.

    Sizes and gaps are scaled and margins shifted by one draw a document, style marks are sprinkled over body lines, and
    some documents lose their geometry. Draws are hashes of seed, document, line and purpose, so any run repeats them.
    """
    at = {n: i for i, n in enumerate(GEOMETRY)}

    def draw(*parts: str, line: bool = False) -> Column:
        key = ["doc_id", "line_no"] if line else ["doc_id"]
        return F.pmod(F.xxhash64(*key, *(F.lit(p) for p in (str(seed), *parts))), F.lit(1_000_000)) / 1_000_000

    within = lambda u, low, high: low + u * (high - low)
    noise = lambda name: (draw(name, "a", line=True) + draw(name, "b", line=True) + draw(name, "c", line=True) - 1.5) * 2  # noqa: E731  # spread near 1
    g = {n: F.col("geometry")[i] for n, i in at.items()}
    new = dict(g)
    new["size_ratio"] = g["size_ratio"] * within(draw("size"), *SIZE) + 0.01 * noise("size")
    for n in ("gap_above", "gap_below"):
        new[n] = F.least(F.greatest(g[n] * within(draw(n), *GAP) + 0.02 * noise(n), F.lit(0.0)), F.lit(1.0))
    for n in ("x0", "x1"):
        new[n] = F.when(g["has_geometry"] > 0, F.least(F.greatest(g[n] + within(draw("shift"), -SHIFT, SHIFT), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    body = ~F.coalesce(F.col("label").isin("heading", "name"), F.lit(False))
    for n, (chance, share) in SPRINKLED.items():
        new[n] = F.when((draw(n) < chance) & body & (draw(n, "line", line=True) < share), within(draw(n, "much", line=True), 0.2, 1.0)).otherwise(g[n])
    shown = F.array(*(F.least(F.greatest(new[n].cast("double"), F.lit(-0.5)), F.lit(1.0)) for n in GEOMETRY))
    return rows.withColumn("geometry", F.when(draw("hidden") < HIDDEN, F.array(*(F.lit(0.0) for _ in GEOMETRY))).otherwise(shown))


class Store:
    """Taggers below a folder: the base, and the current one after corrections, each with the version of what it was trained on.

    A model is written into a folder of its own and counts once its entry in the log is there, so a reader never sees half
    of one. Folders can be of any file system that Spark writes.
    """

    LOG = "kind string, version int, path string, lines long, seq int"

    def __init__(self, spark: SparkSession, folder: str, version: int = 1):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), version

    def _log(self) -> list:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(self.LOG).json(f"{self.folder}/log").orderBy("seq").collect()  # an entry a correction
        except AnalysisException:
            return []

    def _add(self, kind: str, tagger: Tagger | None, lines: int) -> None:
        seq = len(self._log())
        path = f"{self.folder}/model-{seq}"
        if tagger is not None:
            tagger.save(path)
        self.spark.createDataFrame([(kind, self.version, path, lines, seq)], self.LOG).coalesce(1).write.mode("append").json(f"{self.folder}/log")

    def put_base(self, tagger: Tagger) -> None:
        self._add("base", tagger, 0)

    def put(self, tagger: Tagger, lines: int) -> None:
        self._add("current", tagger, lines)

    def reset(self) -> None:
        """Forget the corrections; the base stays."""
        self._add("reset", None, 0)

    def load(self) -> Tagger | None:
        """The current tagger, else the base, else none; one of another version doesn't count."""
        for e in reversed(self._log()):
            if e["kind"] == "reset":
                return self._base()
            if e["kind"] == "current" and e["version"] == self.version and (found := Tagger.load(e["path"])):
                return found
        return self._base()

    def _base(self) -> Tagger | None:
        own = [e for e in self._log() if e["kind"] == "base" and e["version"] == self.version]
        return Tagger.load(own[-1]["path"]) if own else None

    def info(self) -> dict:
        log = self._log()
        since = max((e["seq"] for e in log if e["kind"] == "reset"), default=-1)
        taught = [e for e in log if e["kind"] == "current" and e["seq"] > since]
        return {"ready": self.load() is not None, "version": self.version, "corrections": len(taught), "lines": sum(e["lines"] for e in taught), "labels": list(L.LABELS)}


def line_accuracy(tagger: Tagger, rows: DataFrame) -> float:
    """Share of the labelled lines that the tagger labels alike."""
    from .metrics import accuracy

    got = tagger.predict(rows).join(rows.select("doc_id", "line_no", "label"), ["doc_id", "line_no"])
    return accuracy(got, "label", "predicted").first()["accuracy"]


def learning_curve(base: Tagger, memory: DataFrame, stream: list[DataFrame], test: DataFrame) -> list[tuple[str, int, float]]:
    """(condition, step, line accuracy): the base left alone, taught with true labels, and taught with its own.

    One correction after the other changes the model, so steps are in order; each step's work is distributed. stream:
    corrected documents (doc_id, line_no, line, label, seq).
    """
    out = [(c, 0, line_accuracy(base, test)) for c in ("frozen",)]
    out += [("frozen", k, out[0][2]) for k in range(1, len(stream) + 1)]
    for condition in ("corrected", "self"):
        now, held = base, memory
        out.append((condition, 0, out[0][2]))
        for k, doc in enumerate(stream, 1):
            if condition == "self":
                doc = now.predict(doc).join(doc.select("doc_id", "line_no", "seq"), ["doc_id", "line_no"]).withColumnRenamed("predicted", "label")
            now, held = now.learn(held, doc)
            out.append((condition, k, line_accuracy(now, test)))
    return out


def by_training_size(train: list[DataFrame], counts: list[int], test: DataFrame) -> list[tuple[int, float]]:
    """(k, line accuracy) of taggers trained on the first k of several formats; 0 formats are an error, not a guess."""
    out = []
    for k in counts:
        if not 0 < k <= len(train):
            raise ValueError(f"{k} of {len(train)} formats")
        rows = train[0]
        for more in train[1:k]:
            rows = rows.unionByName(more)
        out.append((k, line_accuracy(Tagger.fit(rows), test)))
    return out
