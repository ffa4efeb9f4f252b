"""Text of files by their suffix: txt, md, docx and html. PDF needs a library that isn't part of Python, and is refused."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tagger import GEOMETRY

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_FALLBACK = "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback"
SUPPORTED = ("txt", "md", "docx", "html", "htm")


class UnsupportedFormat(ValueError):
    """No reader for this kind of file."""


def _paragraph(p) -> str:
    """Text of a paragraph itself, without that of boxes anchored in it."""
    out = []
    for node in p:
        if node.tag in (f"{_W}r", f"{_W}hyperlink", f"{_W}ins", f"{_W}smartTag"):
            for x in node:
                if x.tag == f"{_W}t":
                    out.append(x.text or "")
                elif x.tag == f"{_W}tab":
                    out.append("\t")
                elif x.tag == f"{_W}br":
                    out.append("\n")
                elif x.tag == f"{_W}r":
                    out += [t.text or "" for t in x.findall(f"{_W}t")]
    return "".join(out)


def _boxes(p) -> list[str]:
    """Lines of the text boxes anchored in a paragraph; the copy for older readers is skipped."""
    out, stack = [], [p]
    while stack:
        node = stack.pop(0)
        if node.tag == _FALLBACK:
            continue
        if node.tag == f"{_W}txbxContent":
            out += _blocks(node, True)
            continue
        stack[:0] = list(node)
    return out


def _blocks(parent, boxes: bool) -> list[str]:
    out = []
    for node in parent:
        if node.tag == f"{_W}p":
            out.append(_paragraph(node))
            if boxes:
                out += _boxes(node)
        elif node.tag == f"{_W}tbl":
            for row in node.findall(f"{_W}tr"):
                for cell in row.findall(f"{_W}tc"):
                    merged = cell.find(f"{_W}tcPr/{_W}vMerge")
                    if merged is None or merged.get(f"{_W}val") == "restart":
                        out += [x for x in _blocks(cell, boxes) if x.strip()]
        elif node.tag == f"{_W}sdt":
            content = node.find(f"{_W}sdtContent")
            out += _blocks(content, boxes) if content is not None else []
    return out


def docx_text(data: bytes, layout_aware: bool = False) -> str:
    """Paragraphs and table cells in document order, merged cells once; layout_aware: text boxes after their anchor."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    return "\n".join(_blocks(body, layout_aware)) if body is not None else ""


def _number(node, name: str, default: float) -> float:
    try:
        return float(node.get(f"{_W}{name}")) if node is not None else default
    except (TypeError, ValueError):
        return default


def _on(node) -> bool:
    return node is not None and node.get(f"{_W}val") not in ("0", "false", "none")


def _look(p, normal: float, table: bool, box: bool) -> dict:
    """Formatting of a paragraph; what its runs say counts by their letters."""
    parts = {"size": 0.0, "bold": 0.0, "italic": 0.0, "colored": 0.0, "spacing": 0.0}
    letters = 0
    for r in p.iter(f"{_W}r"):
        n = sum(len(t.text or "") for t in r.findall(f"{_W}t"))
        own = r.find(f"{_W}rPr")
        find = (lambda tag: own.find(f"{_W}{tag}")) if own is not None else (lambda tag: None)  # noqa: B023
        color = find("color")
        value = "" if color is None else (color.get(f"{_W}val") or "").lower()
        parts["size"] += n * _number(find("sz"), "val", 2 * normal) / 2
        parts["bold"] += n * _on(find("b"))
        parts["italic"] += n * _on(find("i"))
        parts["colored"] += n * (value not in ("", "auto", "000000"))
        parts["spacing"] += n * _number(find("spacing"), "val", 0.0) / 20
        letters += n
    out = {k: v / letters for k, v in parts.items()} if letters else parts | {"size": normal}
    own = p.find(f"{_W}pPr")
    find = (lambda tag: own.find(f"{_W}{tag}")) if own is not None else (lambda tag: None)
    side = find("jc").get(f"{_W}val") if find("jc") is not None else ""
    style = (find("pStyle").get(f"{_W}val") or "").lower() if find("pStyle") is not None else ""
    indent = _number(find("ind"), "left", 0.0) / 20
    return out | {"indent": indent, "before": _number(find("spacing"), "before", 0.0) / 20, "right": side in ("right", "end"), "centered": side == "center", "rule": find("pBdr") is not None or "heading" in style or "title" in style, "table": table, "box": box}


def _paragraphs(parent, table: bool = False, box: bool = False):
    """Paragraphs in the order of their text, with whether a table or a text box holds them."""
    for node in parent:
        if node.tag == f"{_W}p":
            yield node, table, box
            stack = list(node)
            while stack:
                x = stack.pop(0)
                if x.tag == f"{_W}txbxContent":
                    yield from _paragraphs(x, table, True)
                elif x.tag != _FALLBACK:
                    stack[:0] = list(x)
        elif node.tag in (f"{_W}tbl", f"{_W}tr", f"{_W}tc", f"{_W}sdt", f"{_W}sdtContent"):
            yield from _paragraphs(node, table or node.tag == f"{_W}tbl", box)


PAGE_WIDTH = 612.0


def docx_lines(data: bytes) -> list[tuple[str, list[float]]]:
    """(line, geometry) of a DOCX file: the numbers of operators.tagger.GEOMETRY that its formatting tells; a file has no places on a page."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        styles = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else None
    size = None if styles is None else next((s.find(f"{_W}rPr/{_W}sz") for s in styles.findall(f"{_W}style") if s.get(f"{_W}styleId") == "Normal"), None)
    normal = _number(size, "val", 22.0) / 2
    rows = [(line.strip(), _look(p, normal, t, b), "\t" in line) for p, t, b in _paragraphs(body if body is not None else ()) for line in _paragraph(p).splitlines() if line.strip()]
    sizes = sorted(f["size"] for _, f, _ in rows)
    usual = (sizes[(len(sizes) - 1) // 2] + sizes[len(sizes) // 2]) / 2 if sizes else normal
    clip = lambda v, low, high: max(low, min(high, v))
    out = []
    for i, (line, f, tab) in enumerate(rows):
        words = line.split()
        known = {
            "has_geometry": 1.0, "size_ratio": clip(f["size"] / usual, 0, 3) / 3, "is_largest": float(f["size"] >= 0.98 * sizes[-1]), "bold": f["bold"], "italic": f["italic"], "colored": f["colored"],
            "x0": clip(f["indent"] / PAGE_WIDTH, 0, 1), "right_aligned": float(f["right"] or tab), "centered": float(f["centered"]), "gap_above": clip(f["before"] / max(usual, 1), 0, 4) / 4,
            "letter_spacing": clip(f["spacing"], 0, 1), "single_letter_words": sum(len(w) == 1 for w in words) / max(len(words), 1), "rule_below": float(f["rule"]), "in_table": float(f["table"]),
            "in_box": float(f["box"] or f["table"]), "indent_change": clip((f["indent"] - rows[i - 1][1]["indent"]) / PAGE_WIDTH, -0.5, 0.5) if i else 0.0,
        }
        out.append((line, [known.get(name, 0.0) for name in GEOMETRY]))
    return out


def docx_geometry(content: Column | str) -> Column:
    """array of struct(line, geometry) of DOCX files in a binary column; null where a file can't be read."""

    @F.pandas_udf("array<struct<line:string,geometry:array<double>>>")
    def read(files: pd.Series) -> pd.Series:
        def one(data):
            try:
                return None if data is None else [{"line": t, "geometry": g} for t, g in docx_lines(bytes(data))]
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                return None

        return files.map(one)

    return read(content)


def docx_column(content: Column | str, layout_aware: bool = False) -> Column:
    """Text of DOCX files in a binary column; null where a file can't be read."""

    @F.pandas_udf("string")
    def read(files: pd.Series) -> pd.Series:
        def one(data):
            try:
                return None if data is None else docx_text(bytes(data), layout_aware)
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                return None

        return files.map(one)

    return read(content)


def read_documents(spark: SparkSession, path: str, layout_aware: bool = False) -> DataFrame:
    """path, suffix and text of the files under a folder; a suffix without a reader is an error, not an empty text."""
    from .html import plain_text

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"), "content")
    odd = [r["suffix"] for r in files.select("suffix").distinct().collect() if r["suffix"] not in SUPPORTED]
    if odd:
        raise UnsupportedFormat(f"no reader for: {', '.join(sorted(odd))}")
    # A scan for each kind of reader: a Python reader in a CASE would be given the files of the other kinds too.
    plain = F.col("content").cast("string")
    markup = ("html", "htm")
    kinds = ((F.col("suffix") == "docx", docx_column("content", layout_aware)), (F.col("suffix").isin(*markup), plain_text(plain)), (~F.col("suffix").isin("docx", *markup), plain))
    parts = [files.where(own).select("path", "suffix", text.alias("text")) for own, text in kinds]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def read_layout(spark: SparkSession, path: str, **parts: str) -> DataFrame:
    """Files of a tree template=/format=/layout=, reading only the folders asked for."""
    rows = spark.read.format("binaryFile").load(path)
    for name, value in parts.items():
        rows = rows.where(F.col(name) == value)
    return rows
