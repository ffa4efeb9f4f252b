"""HTML as events of text, sections and headings."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EVENTS = "array<struct<text:string,section:string,is_heading:boolean>>"
_SILENT = ("script", "style", "head", "template")
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Events(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str | None]] = []
        self.out: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag not in _VOID:
            self.open.append((tag, dict(attrs).get("id")))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        text = " ".join(data.split())
        if text and not any(t in _SILENT for t, _ in self.open):
            section = next((i for _, i in reversed(self.open) if i), None)
            self.out.append({"text": text, "section": section, "is_heading": any(t in _HEADINGS for t, _ in self.open)})


def html_events(page: str | None) -> list[dict]:
    """Texts in order, each with the nearest id around it and whether a heading holds it. Broken markup is read as far as it goes."""
    reader = _Events()
    reader.feed(page or "")
    reader.close()
    return reader.out


# Ids of sections in exported resumes, the class of their titles, and the label of each section's lines.
SECTION_ID = re.compile(r"SECTION_([A-Z]{4})")
SECTION_TITLE = "sectiontitle"
CODE_LABELS = {
    "NAME": None,
    "EXPR": "experience", "WRKH": "experience", "MILI": "experience", "EXFU": "experience", "EEXP": "experience",
    "EDUC": "education",
    "SKLL": "skills", "HILT": "skills", "TSKL": "skills", "LANG": "skills",
    "SUMM": "summary", "OBJC": "summary",
    "PRIN": "contact", "ALNK": "contact",
}


class _Sections(HTMLParser):
    """Texts with the code of the last section that began, and whether a title holds them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.code, self.titles = None, []  # for each open div whether it is a title
        self.out: list[tuple[str, str | None, bool]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "div":
            own = dict(attrs)
            found = SECTION_ID.match(own.get("id") or "")
            self.code = found[1] if found else self.code
            self.titles.append(SECTION_TITLE in (own.get("class") or "").split())

    def handle_endtag(self, tag):
        if tag == "div" and self.titles:
            self.titles.pop()

    def handle_data(self, data):
        if data.strip():
            self.out.append((data, self.code, any(self.titles)))


def section_events(page: str | None) -> list[tuple[str, str | None]]:
    """(text, label) in order: headings, else what the section's code says; none before the first section and for the name."""
    reader = _Sections()
    reader.feed(page or "")
    reader.close()
    unknown = lambda code: code is None or code == "NAME"
    return [(text, None if unknown(code) else "heading" if title else CODE_LABELS.get(code, "other")) for text, code, title in reader.out]


def labelled(html: Column | str) -> Column:
    """section_events() of pages, as align_labels() takes them."""

    @F.pandas_udf("array<struct<text:string,label:string>>")
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: [{"text": t, "label": n} for t, n in section_events(p)])

    return read(html)


def events(html: Column | str) -> Column:
    @F.pandas_udf(EVENTS)
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(html_events)

    return read(html)


def plain_text(html: Column | str) -> Column:
    """Texts in order, a line each."""

    @F.pandas_udf("string")
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else "\n".join(e["text"] for e in html_events(p)))

    return read(html)


def headings_apart(html: Column | str, own: Column) -> Column:
    """Texts of heading tags that aren't made of the person's own words: own is an array of lower-case tokens."""
    from ..functions.text import tokens

    return F.array_distinct(F.filter(heading_texts(html), lambda x: (F.size(tokens(x)) > 0) & (F.size(F.array_except(tokens(x), own)) > 0)))


def heading_texts(html: Column | str) -> Column:
    """Texts of heading tags by patterns alone: for pages whose headings hold plain text."""
    html = F.col(html) if isinstance(html, str) else html
    inner = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))
    return F.transform(inner, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), r"\s+", " ")))
