"""Whole-token terms: Java patterns for Spark, and the counting expression an RE2 engine needs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms up to this length are matched in their own case.
CASED = 2
_EDGE = r"\pL\pM\pN_+#&"


def _body(term: str, gap: str) -> str:
    words = term.split()
    if not words:
        raise ValueError("a term needs at least one visible character")
    return gap.join(re.escape(w) for w in words)


def term_pattern(term: str, cased: int = CASED) -> str:
    """A Java pattern of the term between token edges; spaces inside may be any white space."""
    flags = "(?U)" if len(term) <= cased else "(?iU)"
    return rf"{flags}(?<![\w+#&]){_body(term, chr(92) + 's+')}(?![\w+#&])"


def any_pattern(terms: list[str], cased: int = CASED) -> str:
    """One pattern for all terms, each with its own case rule."""
    return "|".join(f"(?:{term_pattern(t, cased)})" for t in terms)


def has_term(text: Column | str, term: str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return text.rlike(term_pattern(term))


def count_term(text: Column | str, term: str) -> Column:
    return F.regexp_count(text, F.lit(term_pattern(term)))


def replace_term(text: Column | str, term: str, other: str, cased: int = 3) -> Column:
    """Substitution has its own case limit: three characters."""
    return F.regexp_replace(text, term_pattern(term, cased), re.sub(r"([\\$])", r"\\\1", other))


def sql_count(text: str, term: str, cased: int = CASED) -> str:
    """The same count for an engine without lookaround: delimiters are doubled, so neighbours never share one."""
    body = "[[:space:]]+".join("".join(2 * re.escape(c) if re.match(r"[^\w+#&]", c) else re.escape(c) for c in w) for w in term.split())
    flags = "" if len(term) <= cased else "(?i)"
    pattern = f"{flags}(^|[^{_EDGE}]){body}($|[^{_EDGE}])".replace("'", "''")
    return f"len(regexp_extract_all(regexp_replace({text}, '([^{_EDGE}])', '\\1\\1', 'g'), '{pattern}'))"
