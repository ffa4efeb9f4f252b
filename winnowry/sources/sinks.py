"""Results as files: CSV, a JSON summary, Markdown tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str) -> None:
    """A folder of CSV files with a header; Spark commits it at once."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_summary(rows: DataFrame, path: str) -> None:
    """One JSON object a row, nulls left out."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def markdown_table(rows: DataFrame, decimals: int = 3, most: int = 1000) -> str:
    """A small table as Markdown, numbers with so many decimals; a table of over `most` rows is an error, not a part of it."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a table of over {most} rows")
    shown = lambda v: "" if v is None else f"{v:.{decimals}f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"| {' | '.join(rows.columns)} |", f"|{'---|' * len(rows.columns)}"]
    return "\n".join([*lines, *(f"| {' | '.join(map(shown, r))} |" for r in got)])


def report(matched: DataFrame, doc_id, title: str = "Analysis") -> str:
    """What screening.match() tells of one document, as Markdown."""
    rows = matched.where(F.col("doc_id") == doc_id).collect()
    if not rows:
        raise KeyError(doc_id)
    out = [f"# {title}: {doc_id}"]
    for r in rows:
        out += ["", f"Status: **{r['status']}**", f"Score: {r['score']:.4f}, rank {r['rank']} of {r['of']} (top {r['top_percent']} %)"]
        for name, items in (("Reasons", r["reasons"]), ("Missing", r["missing"]), ("Terms found", r["terms_found"]), ("Terms not found", r["terms_missing"])):
            if items:
                out += ["", f"## {name}", *(f"- {x}" for x in items)]
    return "\n".join(out) + "\n"
