"""Secrets in texts: a trigram inverted index, candidates by Boolean queries, exact patterns.

1. From each rule's pattern its Boolean query of mandatory trigrams is derived (trigrams.py). The index holds a
   posting (trigram, text key) for each trigram of any query that a text has, in lower case.
2. A rule's candidates are the texts whose postings hold a whole set of its query: postings join the sets, are
   counted by text, and complete sets name the candidates.
3. Candidates are verified by the pattern. A rule without mandatory trigrams scans every text.

The key of a text is a 64-bit hash: two texts under one key share candidates, which verification sorts out, so
nothing is lost. Copies of a text share their postings. Candidates go to the texts by broadcast as long as they
are few (BROADCAST rows, counted), else by a join on the key, which moves the texts.

All of it is DataFrame operations. Nulls: a null text is empty, a null doc_id is returned as null; repeated rows
are all returned; spans of two rules that start at one place go by the order of the rules; a very long text is one
row, scanned once a rule; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stash, table
from .trigrams import query

BROADCAST = 100_000


@dataclass(frozen=True)
class Rule:
    """A pattern, and the least length of its match or of one of its groups; shorter matches are dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    ignore_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


# Base rules: fixed patterns.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
# Public formats of credentials.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE
SPAN = "array<struct<start:int,kind:int,end:int>>"


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): the numbers of the rules whose query the text of a key satisfies. docs has key and text."""
    sets = [(r, s, len(grams), g) for r, rule in enumerate(rules) for s, grams in enumerate(query(rule.pattern) or ()) for g in sorted(grams)]
    grams = sorted({g for *_, g in sets})
    every = F.array(*map(F.lit, grams))
    has = F.transform(F.array(F.lower("text")), lambda low: F.filter(every, lambda g: F.contains(low, g)))[0]
    postings = docs.select("key", F.explode(has).alias("gram")).distinct()
    wanted = docs.sparkSession.createDataFrame(sets, "rule int, part int, size int, gram string")  # as large as the rules
    whole = postings.join(F.broadcast(wanted), "gram").groupBy("key", "rule", "part").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    return whole.where("n = size").groupBy("key").agg(F.collect_set("rule").alias("rules"))


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """(start, kind, end) of the leftmost matches that don't overlap, in code points, short ones dropped."""
    pattern = F.lit(rule.java)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = matches if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.slice(F.split(text, rule.java, -1), 1, F.size(matches))
    each = F.arrays_zip(between.alias("gap"), matches.alias("hit"), judged.alias("judged"))
    empty = F.array().cast(SPAN)

    def add(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"))).cast(SPAN)
        return F.struct(end.alias("at"), F.when(F.length(x["judged"]) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(each, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row doc_id and spans, an array of (start, kind, end) by start and kind; kind is a number in rules."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    found = stash(candidates(rows, rules), "candidates")
    if found.count() <= BROADCAST:
        found = F.broadcast(found)
    rows = rows.join(found, "key", "left")
    empty = F.array().cast(SPAN)
    parts = []
    for i, rule in enumerate(rules):
        own = spans_of(F.col("text"), rule, i)
        if query(rule.pattern) is None:
            parts.append(F.when(F.col("text").rlike(rule.java), own).otherwise(empty))
        else:
            parts.append(F.when(F.array_contains("rules", i), own).otherwise(empty))
    return rows.select("doc_id", F.sort_array(F.concat(*parts)).alias("spans"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every text of documents."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    kinds = F.array(*(F.lit(r.kind) for r in RULES))

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(number):
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long").alias(f"n_{BASE[number].kind}")

    return found.select("doc_id", *map(count, range(len(BASE))), F.sha2(told(F.filter("spans", lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The same result without an index: every pattern over every text."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    cuts = ", ".join(
        f"regexp_extract_all(t, {quote(r.java)}, 0) AS m{i}, regexp_extract_all(t, {quote(r.java)}, {r.group}) AS g{i}, string_split_regex(t, {quote(r.java)}) AS p{i}" for i, r in enumerate(RULES)
    )
    lists = ", ".join(
        f"list_filter(list_transform(range(1, len(m{i}) + 1), lambda i: {{'s': list_sum(list_transform(p{i}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{i}[1:i - 1], lambda x: length(x))), 0), 'k': {i}, 'n': length(m{i}[i]), 'g': length(g{i}[i])}}), lambda x: x.g >= {r.least}) AS s{i}"
        for i, r in enumerate(RULES)
    )
    kinds = "[" + ", ".join(quote(r.kind) for r in RULES) + "]"
    all_ = "list_concat(" * (len(RULES) - 1) + "s0" + "".join(f", s{i})" for i in range(1, len(RULES)))
    told = f"array_to_string(list_transform({{}}, lambda x: {kinds}[x.k + 1] || ':' || x.s::BIGINT || ':' || (x.s + x.n)::BIGINT), ',')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, {cuts} FROM d),
l AS (SELECT doc_id, {lists} FROM c),
a AS (SELECT doc_id, list_sort({all_}) AS spans FROM l)
SELECT doc_id, {", ".join(f"len(list_filter(spans, lambda x: x.k = {i}))::BIGINT AS n_{r.kind}" for i, r in enumerate(BASE))},
  sha256({told.format(f"list_filter(spans, lambda x: x.k < {len(BASE)})")}) AS base_sha256, {told.format("spans")} AS spans FROM a"""


QUERIES = {"op6_secret_scan": op6_secret_scan}
ORACLES = {"op6_secret_scan": _sql()}
