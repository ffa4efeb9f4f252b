"""What may go wrong when a document is read, and what must be masked before lines are shared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fields import EMAIL, PHONE
from ..functions.text import doubled_words, full_lines, likely_headings, looks_doubled, unmapped_glyphs, words

#: A character of the private use area, which is taken out of lines.
MARK = "\uf8ff"
LINK = r"(?i)\b(?:https?://\S+|www\.\S+|(?:linkedin|github)\.com/\S+)"


def risks(text: Column | str, visible: Column | None = None, known_sections: Column | None = None) -> Column:
    """array of struct(kind, level, detail), empty if nothing is found."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    n = F.size(words(text))

    def risk(kind, level, detail, when):
        return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level"), detail.cast("string").alias("detail")))

    found = [
        risk("no text", "bad", F.lit(""), n == 0),
        risk("little text", "warn", n, (n > 0) & (n < 30)),
        risk("unmapped glyphs", "bad", unmapped_glyphs(text), unmapped_glyphs(text) > 0),
        risk("doubled letters", "bad", F.size(doubled_words(text)), looks_doubled(text)),
        risk("long lines", "info", F.size(full_lines(text)), (n > 200) & (F.size(full_lines(text)) <= 3)),
        risk("no headings", "warn", F.lit(0), (n >= 30) & (F.size(likely_headings(text)) == 0)),
    ]
    if visible is not None:
        hidden = F.length(text) - F.length(F.coalesce(visible, F.lit("")))
        found.append(risk("hidden text", "bad", hidden, hidden > 0))
    if known_sections is not None:
        found.append(risk("few known sections", "warn", F.size(known_sections), F.size(known_sections) < 2))
    return F.array_compact(F.array(*found))


def level(found: Column) -> Column:
    """The worst of the risks' levels."""
    has = lambda x: F.exists(found, lambda r: r["level"] == x)
    return F.when(has("bad"), "bad").when(has("warn"), "warn").when(has("info"), "info").otherwise("ok")


def mask(line: Column | str, label: Column | None = None, name_words: Column | None = None) -> Column:
    """struct(line, masked): contacts, links and the person's name replaced, and how many replacements that took.

    A line labelled as the name is replaced whole. name_words: words of the person's name, masked wherever they stand.
    """
    line = F.col(line) if isinstance(line, str) else line
    steps = ((EMAIL, "[email]"), (LINK, "[link]"), (PHONE, "[phone]"))
    # Each pattern runs once: replacements leave a mark that no line has, and the marks are counted.
    out = F.translate(line, MARK, "")
    for pattern, word in steps:
        out = F.regexp_replace(out, pattern, F.lit(MARK + word).cast("string"))
    count = F.length(out) - F.length(F.translate(out, MARK, ""))
    out = F.translate(out, MARK, "")
    if name_words is not None:
        own = F.filter(F.array_distinct(name_words), lambda w: F.length(w) >= 2)
        some = F.concat(F.lit(r"(?iU)(?<!\w)(?:"), F.array_join(F.transform(own, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), "|"), F.lit(r")(?!\w)"))
        any_ = F.size(own) > 0
        count = count + F.when(any_, F.regexp_count(out, some)).otherwise(0)
        out = F.when(any_, F.regexp_replace(out, some, F.lit("[name]"))).otherwise(out)
    if label is not None:
        whole = label == "name"
        count, out = F.when(whole, 1).otherwise(count), F.when(whole, "[name]").otherwise(out)
    return F.struct(out.alias("line"), count.cast("int").alias("masked"))
