"""JSON and CSV inputs with fixed schemas: people, postings, skills, resumes, exported labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOB = "struct<title:string,company:string,location:string,start:string,end:string,bullets:array<string>>"
PEOPLE = (
    "id string, intent string, name string, email string, phone string, location string, "
    "education struct<degree:string,degree_level:string,field:string,school:string,location:string,grad_date:string,gpa:double>, "
    f"skills array<string>, experience array<{JOB}>, projects array<struct<name:string,bullets:array<string>>>, application struct<work_authorized:boolean,needs_sponsorship:boolean>"
)
POSTINGS = "id string, title string, text string, knockouts struct<grad_window:array<string>,min_gpa:double,degree_fields:array<string>,min_degree_level:string,require_work_authorization:boolean,no_sponsorship:boolean>"
SKILLS = "skills array<struct<name:string,aliases:array<string>,category:string,broader:string>>"
LABELS = "version string, lines array<string>, labels array<string>, geometry array<array<double>>"


def people(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PEOPLE).json(path, multiLine=True)


def postings(spark: SparkSession, path: str) -> DataFrame:
    """All files of a folder, in the order of their names."""
    return spark.read.schema(POSTINGS).json(path, multiLine=True).withColumn("file", F.input_file_name()).orderBy("file")


def posting_from_file(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, text, knockouts) of one file: JSON with rules, or plain text, whose title is guessed and which states no rules."""
    from ..functions.text import guess_title

    if path.endswith(".json"):
        return postings(spark, path).drop("file")
    name = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    none = F.lit(None).cast(POSTINGS.split("knockouts ", 1)[1])
    return spark.read.text(path, wholetext=True).select(F.lit(name).alias("id"), guess_title("value").alias("title"), F.col("value").alias("text"), none.alias("knockouts"))


def write_vectors(vectors: DataFrame, path: str, backend: str) -> None:
    """Vectors by the hash of their chunk, added to those of the backend."""
    vectors.select(F.lit(backend).alias("backend"), F.xxhash64("chunk").alias("key"), "vector").write.mode("append").parquet(path)


def skills(spark: SparkSession, path: str) -> DataFrame:
    """name, aliases, category, broader and the order in the file."""
    return spark.read.schema(SKILLS).json(path, multiLine=True).select(F.posexplode("skills").alias("ord", "s")).select("ord", "s.*")


def resumes_csv(spark: SparkSession, path: str, categories: list[str] | None = None, per_category: int | None = None, seed: int = 0) -> DataFrame:
    """id (with a prefix), text (white space squeezed) and category of a CSV of ID, Resume_str and Category."""
    from ..operators.sampling import stratified

    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', schema="ID string, Resume_str string, Category string")
    if categories:
        rows = rows.where(F.upper("Category").isin(*(c.upper() for c in categories)))
    rows = rows.select(F.concat(F.lit("public-"), "ID").alias("id"), F.trim(F.regexp_replace("Resume_str", r"\s+", " ")).alias("text"), F.col("Category").alias("category"))
    return stratified(rows, "category", "id", per_category, seed) if per_category else rows


def exported_labels(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Corrections that were exported; geometry of another width is dropped."""
    rows = spark.read.schema(LABELS).json(path)
    fits = F.forall("geometry", lambda g: F.size(g) == width) & (F.size("geometry") == F.size("lines"))
    return rows.withColumn("geometry", F.when(fits, F.col("geometry")))


def export_labels(rows: DataFrame, path: str) -> None:
    """Masked lines with their labels, a document a line. Spark commits a folder at once, so a reader never sees half of it."""
    rows.write.mode("overwrite").json(path)


def vector_cache(spark: SparkSession, path: str, backend: str) -> DataFrame:
    """Vectors that this backend made before, by the hash of their chunk; another backend's don't count."""
    return spark.read.parquet(path).where(F.col("backend") == backend)


def not_cached(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct chunks without a vector."""
    return chunks.select(F.xxhash64("chunk").alias("key"), "chunk").distinct().join(cache, "key", "left_anti")
