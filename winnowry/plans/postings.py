"""Postings, pages and layout queries, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, postings
from ..operators.alignment import align_labels
from ..operators.taxonomy import Skill, Taxonomy, skill_share
from ..sources import html
from .tables import dealt, table

#: Words of the driver's texts as skills, with other spellings and a broader one.
TAXONOMY = Taxonomy((Skill("the", ("this",), "a"), Skill("that", ("than",), "a", "the"), Skill("que", ("qui",), "b"), Skill("und", ("der", "die"), "b"), Skill("of", (), "c")))
_PROSE = """concat('Requirements:\\n- ', element_at(array('Bachelor''s', 'M.S.', 'Ph.D.'), cast(c_custkey % 3 + 1 AS int)), ' degree in ', element_at(array('Biology', 'Physics, or Chemistry', 'Art'), cast(c_custkey % 3 + 1 AS int)),
 CASE WHEN c_custkey % 2 = 0 THEN ' or a related field.' ELSE '.' END, '\\n- Minimum GPA of ', 2 + c_custkey % 2, '.', c_custkey % 10, '0 required.\\n- Graduating between June ', 2020 + c_custkey % 7, ' and December ', 2021 + c_custkey % 7,
 '.', CASE WHEN c_custkey % 4 = 0 THEN '\\n- We cannot sponsor visas.' ELSE '' END, CASE WHEN c_custkey % 5 = 0 THEN '\\nMust be authorized to work in the country.' ELSE '' END)"""


def prose_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings made of customer rows, and the rules read from their prose."""
    rows = dealt(spark.sql(f"SELECT c_custkey AS id, {_PROSE} AS text FROM {{c}}", c=table(spark, sf_dir, "customer")), "id")
    got = rows.select("id", postings.prose_rules("text").alias("r"))
    return got.select("id", "r.min_degree_level", F.array_join("r.degree_fields", "; ").alias("fields"), "r.fields_enforced", F.round("r.min_gpa", 2).alias("min_gpa"), "r.grad_window.low", "r.grad_window.high", "r.require_work_authorization", "r.no_sponsorship")


def requirement_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as postings: the skills they name, with levels and groups of alternatives."""
    text = F.concat(F.lit("Requirements\n"), F.regexp_replace("text", " and ", " or "), F.lit("\nthis or of\nNice to have\nque / und"))
    return postings.requirements(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("posting_id"), text.alias("text")), TAXONOMY)


def posting_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("A posting\nWhat you need:\n"), F.col("text"), F.lit("\nBonus points\n"), F.reverse("text"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(postings.posting_sections(text)).alias("section", "body"))
    return rows.select("item_id", "section", F.md5("body").alias("digest"))


def skills_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(TAXONOMY.found_in("text"), "; ").alias("skills"))


def skill_share_of_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(F.lit("the"), F.lit("that"), F.lit("of"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(skill_share(TAXONOMY.found_in("text"), wanted), 6).alias("share"))


def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.events("html")).alias("n", "e"))
    return rows.select("page_id", "n", "e.text", "e.section", "e.is_heading")


def heading_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.heading_texts("html")).alias("n", "heading"))


def aligned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a page's text, labelled by the place of their letters among the page's events."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), html.events("html").alias("e"))
    label = F.transform("e", lambda x: F.struct(x["text"].alias("text"), F.when(x["is_heading"], "heading").otherwise("other").alias("label")))
    return align_labels(p.select("doc_id", F.transform("e", lambda x: x["text"]).alias("lines"), label.alias("events")))


def body_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.body_size(table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")), "brand")


QUERIES = {f.__name__: f for f in (prose_rules, requirement_groups, posting_sections, skills_found, skill_share_of_item, html_sections, heading_events, aligned_labels, body_size)}


def _found() -> str:
    from ..functions.terms import sql_count

    return "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'{sql_count("text", f)} > 0' for f in s.forms)} THEN '{s.name}' END" for s in TAXONOMY.skills) + "], lambda x: x IS NOT NULL)"


ORACLES = {
    "prose_rules": """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'BS' WHEN 1 THEN 'MS' ELSE 'PHD' END AS min_degree_level, CASE c_custkey % 3 WHEN 0 THEN 'Biology' WHEN 1 THEN 'Physics; Chemistry' ELSE 'Art' END AS fields, c_custkey % 2 = 1 AS fields_enforced,
 round(2 + c_custkey % 2 + (c_custkey % 10) / 10.0::DOUBLE, 2) AS min_gpa, (2020 + c_custkey % 7) || '-06' AS low, (2021 + c_custkey % 7) || '-12' AS high, c_custkey % 5 = 0 AS require_work_authorization, c_custkey % 4 = 0 AS no_sponsorship FROM customer""",
    "posting_sections": """SELECT item_id, unnest(['intro', 'required', 'preferred']) AS section, unnest([md5('A posting'), md5(trim(text)), md5(trim(reverse(text)))]) AS digest FROM benchmark""",
    "skills_found": f"SELECT doc_id, array_to_string({_found()}, '; ') AS skills FROM documents",
    "skill_share_of_item": f"SELECT doc_id, round(len(list_filter({_found()}, lambda x: list_contains(['the', 'that', 'of'], x))) / 3.0::DOUBLE, 6) AS share FROM documents",
    "heading_events": """WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1) AS h FROM pages), b AS (SELECT page_id, unnest(h) AS x, unnest(range(0, len(h))) AS n FROM a)
SELECT page_id, n, trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS heading FROM b""",
    "body_size": "SELECT p_brand AS brand, quantile_cont(p_size, 0.5) AS body, max(p_size) AS largest FROM part GROUP BY ALL",
}
