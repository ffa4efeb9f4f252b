"""Lines of documents as rows: neighbours, headings above, shapes, labels from a source, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fields import EMAIL, HEADINGS, PHONE, heading_map
from ..functions.text import full_lines, lines, normal_heading, tokens, words

# The labels a line can have.
LABELS = ("name", "contact", "heading", "summary", "education", "experience", "projects", "skills", "other")


def exploded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", trimmed: bool = True) -> DataFrame:
    """(doc_id, line_no, line). trimmed: only lines that aren't empty, without the space around them."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode((full_lines if trimmed else lines)(text)).alias("line_no", "line"))


def of_document() -> Window:
    return Window.partitionBy("doc_id").orderBy("line_no")


def running_section(rows: DataFrame, section: Column, start: str = "header") -> DataFrame:
    """rows with the last known section up to each line."""
    w = of_document().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("section", F.coalesce(F.last(section, ignorenulls=True).over(w), F.lit(start)))


def neighbours(rows: DataFrame, column: str = "line") -> DataFrame:
    w = of_document()
    return rows.withColumns({"before": F.lag(column, 1, "").over(w), "after": F.lead(column, 1, "").over(w)})


def nearest_known(rows: DataFrame, column: str) -> DataFrame:
    """The nearest value before and after each line, among the lines that have one."""
    back, on = of_document().rowsBetween(Window.unboundedPreceding, -1), of_document().rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumns({f"{column}_before": F.last(column, True).over(back), f"{column}_after": F.first(column, True).over(on)})


def heading_context(rows: DataFrame, is_heading: Column) -> DataFrame:
    """rows with the heading above (headings in a row are joined) and how many lines ago it ended; no heading: empty and -1."""
    rows = rows.withColumn("_h", F.coalesce(is_heading, F.lit(False)))
    w = of_document()
    rows = rows.withColumn("_island", F.sum((F.col("_h") & ~F.lag("_h", 1, False).over(w)).cast("int")).over(w))
    run = Window.partitionBy("doc_id", "_island")
    name = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_h"), F.struct("line_no", "line"))).over(run)), lambda x: x["line"]), " ")
    end = F.max(F.when(F.col("_h"), F.col("line_no"))).over(run)
    above = F.when(F.col("_island") > 0, name).otherwise("")
    return rows.withColumns({"heading_above": above, "lines_since": F.when(F.col("_island") > 0, F.col("line_no") - end).otherwise(-1)}).drop("_h", "_island")


def looks_like_heading(line: Column | str) -> Column:
    line = F.col(line) if isinstance(line, str) else line
    own = words(line)
    known = F.element_at(heading_map(HEADINGS), normal_heading(line)).isNotNull()
    shaped = F.size(own).between(1, 5) & ~line.rlike(r"[\d.,;@|]") & line.rlike(r"(?U)\p{L}") & ((F.upper(line) == line) | line.endswith(":"))
    return known | shaped


def shape(rows: DataFrame) -> DataFrame:
    """(doc_id, line_no, features): 20 numbers about the look of a line and its place."""
    line, w = F.col("line"), Window.partitionBy("doc_id")
    n = F.greatest(F.length("line"), F.lit(1))
    own = words(line)
    flag = lambda c: c.cast("double")
    rate = lambda p: F.regexp_count(line, F.lit(p)) / n
    features = [
        F.log1p(F.length("line").cast("double")), F.log1p(F.size(own).cast("double")), rate(r"(?U)\p{Lu}"), rate(r"\d"), rate(r"(?U)[^\w\s]"),
        flag(line.rlike(EMAIL)), flag(line.rlike(PHONE)), flag(line.rlike(r"(?i)https?://|www\.|\.com\b")), flag(line.rlike(r"(?:19|20)\d\d")), flag(line.rlike(r"^[-•*·▪◦●■–]")),
        flag(line.endswith(":")), flag(line.endswith(".")), flag(F.contains(line, F.lit(","))), flag(F.contains(line, F.lit("|"))), flag(F.upper(line) == line),
        flag(F.forall(own, lambda x: x.rlike(r"(?U)^\W*\p{Lu}"))), flag(looks_like_heading(line)), F.col("line_no") / F.greatest(F.max("line_no").over(w), F.lit(1)),
        flag(F.col("line_no") == 0), F.log1p(F.col("line_no").cast("double")),
    ]
    return rows.select("doc_id", "line_no", F.array(*(f.cast("double") for f in features)).alias("features"))


def best_match(rows: DataFrame, references: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, line_no, label, containment): of the references of the same document that with the most of the line's tokens, then the highest Jaccard, then the first; below `least` none.

    references: (doc_id, ord, label, tokens), tens a document. Tokens join lines with references, so only those with a token in common meet.
    """
    own = rows.select("doc_id", "line_no", F.array_distinct(tokens("line")).alias("t"))
    ref = references.select("doc_id", "ord", "label", F.array_distinct("tokens").alias("r"))
    pairs = own.select("doc_id", "line_no", F.size("t").alias("nt"), F.explode("t").alias("x")).join(ref.select("doc_id", "ord", "label", F.size("r").alias("nr"), F.explode("r").alias("x")), ["doc_id", "x"])
    each = pairs.groupBy("doc_id", "line_no", "ord", "label", "nt", "nr").agg(F.count("*").alias("both")).withColumns({"containment": F.col("both") / F.col("nt"), "jaccard": F.col("both") / (F.col("nt") + F.col("nr") - F.col("both"))})
    best = each.groupBy("doc_id", "line_no").agg(F.max_by(F.struct("label", "containment"), F.struct("containment", "jaccard", -F.col("ord"))).alias("b"))
    return best.where(F.col("b.containment") >= least).select("doc_id", "line_no", "b.label", "b.containment")


def labelled_sections(rows: DataFrame, label: str = "label") -> DataFrame:
    """(doc_id, sections, name): lines of each label joined in order; headings are no section."""
    own = rows.where(~F.col(label).isin("heading", "name")).groupBy("doc_id", label).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    own = own.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col(label), F.array_join(F.transform("l", lambda x: x["line"]), "\n")))).alias("sections"))
    name = rows.where(F.col(label) == "name").groupBy("doc_id").agg(F.min_by("line", "line_no").alias("name"))
    return own.join(name, "doc_id", "full")


def rule_labels(rows: DataFrame, known: dict[str, tuple[str, ...]] = HEADINGS) -> DataFrame:
    """Label of each line by the heading list alone: headings, and the section that runs."""
    section = F.element_at(heading_map(known), normal_heading("line"))
    out = running_section(rows.withColumn("_s", section), F.col("_s"))
    keep = F.when(F.col("section").isin("education", "experience", "projects", "skills"), F.col("section")).when((F.col("section") == "header") & (F.col("line_no") == 0), "name").when(F.col("section") == "header", "contact").otherwise("other")
    return out.withColumn("label", F.when(F.col("_s").isNotNull(), "heading").otherwise(keep)).drop("_s")


def carried_labels(parts: DataFrame) -> DataFrame:
    """(doc_id, block, label) of joined lines: that of their first part. parts: doc_id, block, part_no, label."""
    return parts.groupBy("doc_id", "block").agg(F.min_by("label", "part_no").alias("label"))


def ngrams(text: Column | str, low: int = 2, high: int = 4) -> Column:
    """Character n-grams of the lower-case text between spaces."""
    own = F.concat(F.lit(" "), F.lower(F.col(text) if isinstance(text, str) else text), F.lit(" "))
    return F.flatten(F.array(*(_grams(own, n) for n in range(low, high + 1))))


def _grams(own: Column, n: int) -> Column:
    return F.when(F.length(own) >= n, F.transform(F.sequence(F.lit(1), F.length(own) - n + 1), lambda i: F.substring(own, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
