"""Line, sentence, label and skill queries over documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.fields import EMAIL, PHONE
from ..functions.fields import HEADINGS as KNOWN
from ..functions.terms import sql_count
from ..operators import diagnose, lines
from ..operators import experiments as X
from ..operators.scoring import Keyword, Requirement, units
from .postings import TAXONOMY
from .screening import POSTING, _sql_score
from .tables import table
from .texts import _FULL, _LINES, _NORMAL

_WORDS = "list_filter(string_split_regex({}, '[\\s\\x0B]+'), lambda w: w <> '')"
#: Lines of the driver's documents that stand in for headings of sections.
HEADINGS = {"education": ("licensed under the apache license, version 2.0.", "released under the mit license."), "skills": ("of.", "and ornd.", "ietzte.")}
_SECTION = "CASE " + " ".join(f"WHEN {_NORMAL} IN ({', '.join(repr(h) for h in hs)}) THEN '{name}'" for name, hs in HEADINGS.items()) + " END"
_O = "OVER (PARTITION BY doc_id ORDER BY line_no"


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.unwrap("text")).alias("digest"))


def prose_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(text.sentences("text")).alias("n", "sentence"))


def likely_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(text.likely_headings("text"), "|").alias("headings"))


def document_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _docs(spark, sf_dir).select("doc_id", diagnose.risks("text").alias("r"))
    return got.select("doc_id", diagnose.level(F.col("r")).alias("level"), F.array_join(F.transform("r", lambda x: x["kind"]), "; ").alias("kinds"))


def close_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lenient tokens of each line, and whether the line before has all of them and few more."""
    rows = lines.neighbours(lines.exploded(_docs(spark, sf_dir)))
    return rows.select("doc_id", "line_no", F.size(text.lenient_tokens("line")).cast("long").alias("tokens"), text.close(F.col("line"), F.col("before")).alias("close"))


def bare_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without what stands in parentheses."""
    return lines.exploded(_docs(spark, sf_dir)).select("doc_id", "line_no", F.md5(text.clean_skill("line")).alias("digest"))


def joined_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.array_join(text.join_items(text.full_lines("text")), "|")).alias("digest"))


def joined_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.array_join(text.join_letters(text.words("text")), " ")).alias("digest"))


def shown_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.date_format("o_orderdate", "yyyy-MM")
    return table(spark, sf_dir, "orders").select("o_orderkey", *(text.show_date(iso, s).alias(s) for s in ("short", "numeric", "long", "season")))


def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 numbers of each line's look and place."""
    rows = lines.shape(lines.exploded(_docs(spark, sf_dir)))
    return rows.select("doc_id", "line_no", *(F.round(F.col("features")[i], 6).alias(f"f{i:02d}") for i in range(20)))


def _labelled(spark, sf_dir) -> DataFrame:
    return lines.rule_labels(lines.exploded(_docs(spark, sf_dir), trimmed=False), HEADINGS)


def rule_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("doc_id", "line_no", "label")


def labelled_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each label as a section, and the line labelled as the name."""
    got = lines.labelled_sections(_labelled(spark, sf_dir))
    return got.select("doc_id", F.md5("name").alias("name"), F.explode_outer("sections").alias("section", "body")).select("doc_id", "name", "section", F.md5("body").alias("digest"))


def carried_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lines are a block that takes the label of its first."""
    parts = _labelled(spark, sf_dir).select("doc_id", F.floor(F.col("line_no") / 3).alias("block"), F.col("line_no").alias("part_no"), "label")
    return lines.carried_labels(parts)


def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's label by the reference line, one of its document's first four, that has most of its tokens."""
    rows = lines.exploded(_docs(spark, sf_dir))
    names = F.array(*(F.lit(x) for x in ("name", "education", "skills", "other")))
    ref = rows.where("line_no < 4").select("doc_id", F.col("line_no").alias("ord"), names[F.col("line_no")].alias("label"), text.tokens("line").alias("tokens"))
    return lines.best_match(rows, ref).select("doc_id", "line_no", "label", F.round("containment", 6).alias("containment"))


def keyword_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword score where other spellings and narrower skills count as well."""
    return _docs(spark, sf_dir).select("doc_id", F.round(Keyword(TAXONOMY).score("text", SKILLS), 4).alias("score"))


SKILLS = [Requirement("the", "the"), Requirement("que", "que", "preferred"), Requirement("und", "und"), Requirement("of", "of", "preferred", curated=False)]


def bullet_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small edits of a conversation's turns as bullets, and the keyword score they give."""
    return _edited(spark, sf_dir).select("conv_id", "edit", F.md5("t").alias("digest"), F.round(Keyword().score("t", POSTING), 4).alias("score"))


def _edited(spark, sf_dir) -> DataFrame:
    """A row for each conversation and edit: one scan, the edits as an array. Turns begin with verbs by their numbers."""
    verbs = F.array(*(F.lit(f"{v} ") for v in VERBS))
    own = F.struct("turn", F.concat(verbs[F.pmod("turn", F.lit(len(VERBS))).cast("int")], "text").alias("text"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["text"]).alias("b"))
    each = F.array(*(F.struct(F.lit(e).alias("edit"), F.array_join(X.edited_bullets("b", e), "\n").alias("t")) for e in ("none", *X.EDITS)))
    return rows.select("conv_id", F.inline(each))


VERBS = ("Built", "led", "Fine-tuned", "Led")


def ranking_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a small edit of one conversation moves it in the ranking while the others stay."""
    scored = _edited(spark, sf_dir).select("conv_id", "edit", F.round(Keyword().score("t", POSTING), 4).alias("s"))
    wide = scored.groupBy("conv_id").agg(F.max(F.when(F.col("edit") == "none", F.col("s"))).alias("before"), F.collect_list(F.struct("edit", "s")).alias("e"))
    variants = wide.select("conv_id", "before", F.inline("e")).where("edit <> 'none'").select("conv_id", "edit", "before", F.col("s").alias("after"))
    return X.stability(wide.select("before"), variants)


QUERIES = {
    f.__name__: f
    for f in (wrapped_lines, prose_sentences, likely_headings, document_risks, close_lines, bare_names, joined_items, joined_letters, shown_dates, line_features, rule_labels, labelled_sections, carried_labels, source_labels, keyword_taxonomy, bullet_edits, ranking_stability)
}

_STRIP = "regexp_replace({}, '^[\\s\\x0B\\p{{Z}}]+|[\\s\\x0B\\p{{Z}}]+$', '', 'g')"
_ITEM = r"^([-•*·▪◦●■–]\s|\d+[.)]\s)"
_GOES_ON = r"(?i)(,|\b(and|or|a|an|the|of|in|to|for|with|by|from|as|on|at|least|than|between))$"
# A line goes on if it and the end of the line before say so: what was joined ends as the line before does.
_UNWRAP = f"""l AS (SELECT doc_id, line_no, line, {_STRIP.format("line")} AS s, rtrim(coalesce(lag(line) {_O}), ''), ' ') AS b FROM {_LINES}),
j AS (SELECT *, line_no > 0 AND s <> '' AND b <> '' AND NOT regexp_matches(s, '{_ITEM}') AND NOT regexp_matches(b, '[.:;!?]$') AND (regexp_matches(s, '^\\p{{Ll}}') OR regexp_matches(b, '{_GOES_ON}')) AS joins FROM l),
i AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) {_O}) AS k FROM j),
u AS (SELECT doc_id, k, CASE WHEN count(*) = 1 THEN min(line) ELSE string_agg(CASE WHEN joins THEN s ELSE rtrim(line, ' ') END, ' ' ORDER BY line_no) END AS line FROM i GROUP BY ALL),
whole AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS t FROM u GROUP BY doc_id)"""
_NONWORD = "[^\\pL\\pM\\pN_]*"
_SHAPED = f"""len({_WORDS.format("line")}) BETWEEN 1 AND 5 AND NOT regexp_matches(line, '[\\d.,;!?@|]') AND regexp_matches(line, '\\pL') AND (upper(line) = line OR
 len(list_filter({_WORDS.format("line")}, lambda w: NOT regexp_matches(w, '^{_NONWORD}(\\p{{Lu}}|(and|of|the|for|in|&)$)'))) = 0)"""
_HEADS = f"heads AS (SELECT doc_id, string_agg(line, '|' ORDER BY line_no) AS h, count(*) AS n FROM {_FULL} WHERE {_SHAPED} GROUP BY doc_id)"
_TOK = "regexp_extract_all(lower(line), '[a-z0-9+#&]+')"
_LEN = "regexp_extract_all(regexp_replace(lower({}), '\\([^)]*\\)', ' ', 'g'), '[a-z0-9+#&]+')"
_LOOKS = f"""({_NORMAL} IN ({", ".join(repr(h) for hs in KNOWN.values() for h in hs)}) OR
 (len({_WORDS.format("line")}) BETWEEN 1 AND 5 AND NOT regexp_matches(line, '[\\d.,;@|]') AND regexp_matches(line, '\\pL') AND (upper(line) = line OR ends_with(line, ':'))))"""
_N = "greatest(length(line), 1)"
_FEATURES = (
    "ln(1 + length(line))", f"ln(1 + len({_WORDS.format('line')}))", f"len(regexp_extract_all(line, '\\p{{Lu}}')) / {_N}::DOUBLE", f"len(regexp_extract_all(line, '[0-9]')) / {_N}::DOUBLE", f"len(regexp_extract_all(line, '[^\\pL\\pM\\pN_\\s\\x0B\\p{{Z}}]')) / {_N}::DOUBLE",
    f"regexp_matches(line, '{EMAIL}')", f"regexp_matches(line, '{PHONE}')", "regexp_matches(line, '(?i)https?://|www\\.|\\.com\\b')", "regexp_matches(line, '(?:19|20)\\d\\d')", "regexp_matches(line, '^[-•*·▪◦●■–]')",
    "ends_with(line, ':')", "ends_with(line, '.')", "contains(line, ',')", "contains(line, '|')", "upper(line) = line",
    f"len(list_filter({_WORDS.format('line')}, lambda w: NOT regexp_matches(w, '^{_NONWORD}\\p{{Lu}}'))) = 0", _LOOKS, "line_no / greatest(max(line_no) OVER (PARTITION BY doc_id), 1)::DOUBLE", "line_no = 0", "ln(1 + line_no)",
)
_LABELLED = f"""a AS (SELECT *, {_SECTION} AS s FROM {_LINES}), b AS (SELECT *, coalesce(last_value(s IGNORE NULLS) {_O} ROWS UNBOUNDED PRECEDING), 'header') AS section FROM a),
r AS (SELECT doc_id, line_no, line, CASE WHEN s IS NOT NULL THEN 'heading' WHEN section <> 'header' THEN section WHEN line_no = 0 THEN 'name' ELSE 'contact' END AS label FROM b)"""


def _taxonomy_sql() -> str:
    parts, total = [], 0.0
    for u in units(SKILLS):
        w = max(r.weight for r in u)
        total += w
        forms = [f for r in u for f in Keyword(TAXONOMY).forms(r)]
        parts.append(f"CASE WHEN {' OR '.join(f'{sql_count("text", f)} > 0' for f in forms)} THEN {w} ELSE 0.0 END")
    return f"round(cast(({' + '.join(parts)}) AS DOUBLE) / {total}, 4)"


_MAP = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in X.VERBS.items()) + "}"
_SWAP = f"list_transform(b, lambda x: coalesce({_MAP}[regexp_extract(x, '^\\S+')] || substr(x, length(regexp_extract(x, '^\\S+')) + 1), x))"
_EDITS = {"none": "b", "verb_swap": _SWAP, "reorder_bullets": "list_reverse(b)", "date_format": "b", "add_teamwork_bullet": f"list_append(b, '{X.EXTRA_BULLET}')", "all_edits": f"list_append(list_reverse({_SWAP}), '{X.EXTRA_BULLET}')"}
_EDITED = f"""c AS (SELECT conv_id, list(['{"', '".join(VERBS)}'][turn % {len(VERBS)} + 1] || ' ' || text ORDER BY turn, text) AS b FROM conversations GROUP BY conv_id),
e AS ({" UNION ALL ".join(f"SELECT conv_id, '{k}' AS edit, array_to_string({v}, chr(10)) AS text FROM c" for k, v in _EDITS.items())}), s AS (SELECT conv_id, edit, text, {_sql_score(POSTING)} AS s FROM e)"""
ORACLES = {
    "wrapped_lines": f"WITH {_UNWRAP} SELECT doc_id, md5(t) AS digest FROM whole",
    "prose_sentences": f"""WITH {_UNWRAP}, p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(t, '([a-z0-9)]{{3}}[.;!?])[\\s\\x0B]+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: regexp_replace(x, '^[ \\-•*\\t]+|[ \\-•*\\t]+$', '', 'g')), lambda x: x <> '') AS p FROM whole)
SELECT doc_id, n, sentence FROM (SELECT doc_id, unnest(range(0, len(p))) AS n, unnest(p) AS sentence FROM p)""",
    "likely_headings": f"WITH {_HEADS} SELECT doc_id, coalesce(h, '') AS headings FROM documents LEFT JOIN heads USING (doc_id)",
    "document_risks": f"""WITH {_HEADS}, d AS (SELECT doc_id, text, {_WORDS.format("text")} AS w FROM documents), f AS (SELECT doc_id, count(*) AS n FROM {_FULL} GROUP BY doc_id),
x AS (SELECT d.doc_id, len(w) AS n, coalesce(f.n, 0) AS l, coalesce(heads.n, 0) AS h, len(regexp_extract_all(text, '\\(cid:\\d+\\)')) AS g,
 len(list_filter(w, lambda x: length(x) >= 4 AND length(x) % 2 = 0 AND len(list_filter(range(0, length(x) // 2), lambda i: x[2 * i + 1] <> x[2 * i + 2])) = 0)) AS two FROM d LEFT JOIN f USING (doc_id) LEFT JOIN heads USING (doc_id)),
k AS (SELECT doc_id, list_filter([CASE WHEN n = 0 THEN 'no text' END, CASE WHEN n BETWEEN 1 AND 29 THEN 'little text' END, CASE WHEN g > 0 THEN 'unmapped glyphs' END, CASE WHEN two >= greatest(5.0, 0.2 * n) THEN 'doubled letters' END,
 CASE WHEN n > 200 AND l <= 3 THEN 'long lines' END, CASE WHEN n >= 30 AND h = 0 THEN 'no headings' END], lambda z: z IS NOT NULL) AS r FROM x)
SELECT doc_id, CASE WHEN list_has_any(r, ['no text', 'unmapped glyphs', 'doubled letters']) THEN 'bad' WHEN list_has_any(r, ['little text', 'no headings']) THEN 'warn' WHEN list_contains(r, 'long lines') THEN 'info' ELSE 'ok' END AS level, array_to_string(r, '; ') AS kinds FROM k""",
    "close_lines": f"""WITH a AS (SELECT doc_id, line_no, {_LEN.format("line")} AS g, {_LEN.format(f"coalesce(lag(line) {_O}), '')")} AS p FROM {_FULL})
SELECT doc_id, line_no, len(g) AS tokens, len(g) > 0 AND len(p) > 0 AND len(list_filter(g, lambda x: NOT list_contains(p, x))) = 0 AND len(p) - len(g) <= 3 AS close FROM a""",
    "bare_names": f"SELECT doc_id, line_no, md5({_STRIP.format("regexp_replace(line, '[\\s\\x0B]*\\([^)]*\\)', '', 'g')")}) AS digest FROM {_FULL}",
    "joined_items": f"""WITH j AS (SELECT *, line_no > 0 AND (regexp_matches(lag(line) {_O}), ',\\s*$') OR regexp_matches(line, '^\\p{{Ll}}')) AS joins FROM {_FULL}), i AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) {_O}) AS k FROM j),
u AS (SELECT doc_id, k, string_agg(line, ' ' ORDER BY line_no) AS t FROM i GROUP BY ALL), w AS (SELECT doc_id, string_agg(t, '|' ORDER BY k) AS t FROM u GROUP BY doc_id) SELECT doc_id, md5(coalesce(t, '')) AS digest FROM documents LEFT JOIN w USING (doc_id)""",
    "joined_letters": f"""WITH a AS (SELECT doc_id, unnest(w) AS w, unnest(range(0, len(w))) AS line_no FROM (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents)), b AS (SELECT *, regexp_matches(w, '^\\pL$') AS one FROM a),
j AS (SELECT *, one AND coalesce(lag(one) {_O}), false) AS joins FROM b), i AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) {_O}) AS k FROM j),
u AS (SELECT doc_id, k, string_agg(w, '' ORDER BY line_no) AS t FROM i GROUP BY ALL), w AS (SELECT doc_id, string_agg(t, ' ' ORDER BY k) AS t FROM u GROUP BY doc_id) SELECT doc_id, md5(coalesce(t, '')) AS digest FROM documents LEFT JOIN w USING (doc_id)""",
    "shown_dates": "SELECT o_orderkey, strftime(o_orderdate, '%b %Y') AS short, strftime(o_orderdate, '%m/%Y') AS numeric, strftime(o_orderdate, '%B %Y') AS long, CASE WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN 'Spring' WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 'Summer' WHEN month(o_orderdate) BETWEEN 9 AND 11 THEN 'Fall' ELSE 'Winter' END || ' ' || year(o_orderdate) AS season FROM orders",
    "line_features": f"SELECT doc_id, line_no, {', '.join(f'round(({x})::DOUBLE, 6) AS f{i:02d}' for i, x in enumerate(_FEATURES))} FROM {_FULL}",
    "rule_labels": f"WITH {_LABELLED} SELECT doc_id, line_no, label FROM r",
    "labelled_sections": f"""WITH {_LABELLED}, n AS (SELECT doc_id, md5(arg_min(line, line_no)) AS name FROM r WHERE label = 'name' GROUP BY doc_id), s AS (SELECT doc_id, label AS section, md5(string_agg(line, chr(10) ORDER BY line_no)) AS digest FROM r WHERE label NOT IN ('heading', 'name') GROUP BY ALL)
SELECT doc_id, name, section, digest FROM s FULL JOIN n USING (doc_id)""",
    "carried_labels": f"WITH {_LABELLED} SELECT doc_id, line_no // 3 AS block, arg_min(label, line_no) AS label FROM r GROUP BY ALL",
    "source_labels": f"""WITH t AS (SELECT doc_id, line_no, list_distinct({_TOK}) AS t FROM {_FULL}), ref AS (SELECT doc_id, line_no AS ord, ['name', 'education', 'skills', 'other'][line_no + 1] AS label, t AS r FROM t WHERE line_no < 4),
p AS (SELECT t.doc_id, t.line_no, ref.ord, ref.label, len(list_intersect(t, r)) AS same_, len(t) AS nt, len(r) AS nr FROM t JOIN ref USING (doc_id)), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY same_ / nt::DOUBLE DESC, same_ / (nt + nr - same_)::DOUBLE DESC, ord) AS i FROM p WHERE same_ > 0)
SELECT doc_id, line_no, label, round(same_ / nt::DOUBLE, 6) AS containment FROM b WHERE i = 1 AND same_ / nt::DOUBLE >= 0.5""",
    "keyword_taxonomy": f"SELECT doc_id, {_taxonomy_sql()} AS score FROM documents",
    "bullet_edits": f"WITH {_EDITED} SELECT conv_id, edit, md5(text) AS digest, s AS score FROM s",
    "ranking_stability": f"""WITH {_EDITED}, p AS (SELECT conv_id, s AS before FROM s WHERE edit = 'none'), v AS (SELECT conv_id, edit, before, s AS after FROM s JOIN p USING (conv_id) WHERE edit <> 'none'),
r AS (SELECT *, 1 + (SELECT count(*) FROM p o WHERE o.before > v.before + 1e-12 AND o.conv_id <> v.conv_id) AS rank_before, 1 + (SELECT count(*) FROM p o WHERE o.before > v.after + 1e-12 AND o.conv_id <> v.conv_id) AS rank_after FROM v)
SELECT conv_id, edit, before, after, rank_before, rank_after, abs(rank_after - rank_before) AS abs_rank_change, (rank_before <= 5) <> (rank_after <= 5) AS top_k_flip FROM r""",
}
