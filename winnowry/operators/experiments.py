"""Controlled changes to a pool and what they do to scores and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.terms import has_term, replace_term
from ..functions.text import show_date
from .screening import standings, step

# Verbs and what a small edit makes of them, the edits, and the bullet that one of them adds.
VERBS = {
    "Built": "Developed", "Designed": "Created", "Trained": "Developed", "Wrote": "Authored",
    "Ran": "Performed", "Used": "Applied", "Led": "Headed", "Analyzed": "Evaluated", "Modeled": "Simulated",
    "Supported": "Assisted with", "Managed": "Oversaw", "Created": "Produced", "Maintained": "Kept up",
    "Followed": "Adhered to", "Revised": "Updated", "Applied": "Used", "Grew": "Increased",
    "Tracked": "Monitored", "Prepared": "Made", "Mentored": "Coached", "Resolved": "Fixed",
    "Tutored": "Taught", "Fine-tuned": "Adapted", "Shipped": "Delivered", "Optimized": "Improved",
}
EDITS = ("verb_swap", "reorder_bullets", "date_format", "add_teamwork_bullet", "all_edits")
EXTRA_BULLET = "Collaborated with cross-functional teams to meet project deadlines"
TOP_K = 5


def with_swaps(pool: DataFrame, pairs: DataFrame, text: str = "text") -> DataFrame:
    """pool with a row for each (term, other) of the small table `pairs` that the text mentions: the text before, and with the term replaced.

    Patterns come from rows, so one scan serves all pairs.
    """
    return pool.crossJoin(F.broadcast(pairs)).withColumn("pattern", swap_pattern("term")).where(F.rlike(F.col(text), F.col("pattern"))).withColumn("swapped", F.regexp_replace(F.col(text), F.col("pattern"), F.regexp_replace("other", r"([\\$])", r"\\\\$1"))).drop("pattern")


def swap_pattern(term: str) -> Column:
    """The pattern of functions.terms for a column of terms, in their own case up to three characters."""
    body = F.regexp_replace(F.regexp_replace(F.col(term), r"([^\w\s])", r"\\\\$1"), r"\s+", r"\\\\s+")
    return F.concat(F.when(F.length(term) <= 3, "(?U)").otherwise("(?iU)"), F.lit(r"(?<![\w+#&])"), body, F.lit(r"(?![\w+#&])"))


def swap(text: Column | str, term: str, other: str) -> Column:
    return replace_term(text, term, other)


def mentions(text: Column | str, term: str) -> Column:
    return has_term(text, term)


def changes(rows: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """delta, and the change relative to the score before: null, not NaN, where that is zero."""
    return rows.withColumns({"delta": F.col(after) - F.col(before), "rel_delta": F.try_divide(F.col(after) - F.col(before), F.nullif(F.col(before), F.lit(0.0)))})


def rank_changes(pool: DataFrame, variants: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """variants with rank_before and rank_after: one more than the pool scores that are better, the own entry left out.

    pool: a row a document with its score `before`, of at most four decimals. Ranks come from the distribution of these
    scores, at most 10,001 steps; pool rows and variants never meet.
    """
    steps = F.broadcast(standings(pool.select(F.col(before).alias("score")), variants.select(F.col(after).alias("score"))))
    out = variants
    for name, score in (("_before", before), ("_after", after)):
        out = out.join(steps.select(F.col("step").alias(f"{name}_step"), F.col("better").alias(name)), step(F.col(score)) == F.col(f"{name}_step"))
    own = (F.col("_before_step") > F.col("_after_step")).cast("long")  # the own entry doesn't stand above its variant
    return out.select(*variants.columns, (F.col("_before") + 1).alias("rank_before"), (F.col("_after") + 1 - own).alias("rank_after"))


def stability(pool: DataFrame, variants: DataFrame, top: int = TOP_K) -> DataFrame:
    """variants (before, after) with ranks, abs_rank_change, and whether the row enters or leaves the first `top`."""
    got = rank_changes(pool, variants)
    return got.withColumns({"abs_rank_change": F.abs(F.col("rank_after") - F.col("rank_before")), "top_k_flip": (F.col("rank_before") <= top) != (F.col("rank_after") <= top)})


def stuffing(posting_text: str, terms: list[str], attack: str) -> str:
    """What an attack adds to a text: the posting's terms three times, or the posting on one line."""
    if attack in ("keyword_list", "hidden_keywords"):
        return " ".join([", ".join(terms)] * 3)
    if attack == "hidden_posting":
        return " ".join(posting_text.split())
    raise ValueError(f"unknown attack {attack!r}")


def stuffed(text: Column | str, added: Column | str, visible: bool, drop_invisible: bool = False) -> Column:
    """The text as a reader gets it: what is added counts unless it is hidden and invisible text is dropped."""
    text, added = (F.col(c) if isinstance(c, str) else c for c in (text, added))
    return text if drop_invisible and not visible else F.concat_ws("\n", text, added)


def edited_bullets(bullets: Column | str, edit: str) -> Column:
    """An edit of a job's bullets that should not matter: a verb in the first place swapped, the order reversed, one bullet more, or all of it."""
    b = swapped_verbs(bullets) if edit in ("verb_swap", "all_edits") else F.col(bullets) if isinstance(bullets, str) else bullets
    if edit in ("reorder_bullets", "all_edits"):
        b = F.reverse(b)
    if edit in ("add_teamwork_bullet", "all_edits"):
        b = F.array_append(b, F.lit(EXTRA_BULLET))
    return b


def swapped_verbs(bullets: Column | str) -> Column:
    """Bullets whose first word is one of VERBS, in that spelling, with the other verb in its place."""
    verbs = F.create_map(*(F.lit(x) for kv in VERBS.items() for x in kv))

    def swapped(x):
        first = F.regexp_substr(x, F.lit(r"\S+"))
        other = F.element_at(verbs, first)
        return F.when(other.isNotNull() & x.startswith(first), F.concat(other, F.substring(x, F.length(first) + 1, F.lit(1 << 30)))).otherwise(x)

    return F.transform(bullets, swapped)


def edited_date(iso: Column | str, edit: str) -> Column:
    return show_date(iso, "numeric" if edit in ("date_format", "all_edits") else "short")


def plain_resume(people: DataFrame, edit: str | None = None) -> Column:
    """A person of the schema of sources.people as text: name, contacts, education, experience with bullets, projects, skills."""
    title = lambda t: F.concat(F.lit("\n\n"), F.lit(t), F.lit("\n"))

    def job(x, i):
        when = F.concat_ws(" - ", edited_date(x["start"], edit or ""), F.coalesce(edited_date(x["end"], edit or ""), F.lit("Present")))
        head = F.concat_ws(" | ", x["title"], x["company"], when)
        # One more bullet goes to the first job alone.
        more = edited_bullets(x["bullets"], edit or "")
        plain = edited_bullets(x["bullets"], {"add_teamwork_bullet": ""}.get(edit or "", edit or ""))
        plain = F.slice(plain, 1, F.size(plain) - 1) if edit == "all_edits" else plain
        own = F.when(i == 0, more).otherwise(plain)
        return F.concat(head, F.array_join(F.transform(own, lambda b: F.concat(F.lit("\n- "), b)), ""))

    e = people["education"]
    study = F.concat(F.concat_ws(" in ", e["degree"], e["field"]), F.lit("\n"), e["school"], F.lit(", "), edited_date(e["grad_date"], edit or ""), F.when(e["gpa"].isNotNull(), F.format_string("\nGPA: %.2f", e["gpa"])).otherwise(""))
    return F.concat(
        people["name"], F.lit("\n"), F.concat_ws(" | ", people["email"], people["phone"], people["location"]), title("EDUCATION"), study,
        title("EXPERIENCE"), F.array_join(F.transform(people["experience"], job), "\n"),
        title("PROJECTS"), F.array_join(F.transform(people["projects"], lambda p: F.concat(p["name"], F.array_join(F.transform(swapped_verbs(p["bullets"]) if edit in ("verb_swap", "all_edits") else p["bullets"], lambda b: F.concat(F.lit("\n- "), b)), ""))), "\n"),
        title("SKILLS"), F.array_join(people["skills"], ", "),
    )


def against_baseline(rows: DataFrame, keys: list[str], layout: str, values: list[str], base: str = "single") -> DataFrame:
    """rows with value_single of the base layout of the same keys: a window in place of a self join, so one shuffle."""
    w = Window.partitionBy(*keys)
    return rows.withColumns({f"{v}_{base}": F.max(F.when(F.col(layout) == base, F.col(v))).over(w) for v in values})
