"""Rejection rules with three outcomes: met, not met, and not known."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranks and display names of degree levels.
DEGREE_RANK = {"BA": 1, "BS": 1, "MS": 2, "PHD": 3}
DEGREE_NAME = {"BA": "Bachelor's", "BS": "Bachelor's", "MS": "Master's", "PHD": "Ph.D."}


@dataclass(frozen=True)
class Rules:
    """What a posting demands; None or False leaves a rule out."""

    grad_window: tuple[str, str] | None = None
    min_gpa: float | None = None
    min_degree_level: str | None = None
    degree_fields: tuple[str, ...] | None = None
    require_work_authorization: bool = False
    no_sponsorship: bool = False
    shown_fields: tuple[str, ...] = field(default=())  # named in the posting, not enforced


@dataclass(frozen=True)
class Person:
    """The columns that hold what is known about a candidate."""

    grad_date: Column
    gpa: Column
    degree_level: Column
    field_of_study: Column
    work_authorized: Column
    needs_sponsorship: Column

    @classmethod
    def of_columns(cls, *names: str) -> Person:
        return cls(*map(F.col, names or ("grad_date", "gpa", "degree_level", "field_of_study", "work_authorized", "needs_sponsorship")))


def rank(level: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in DEGREE_RANK.items() for x in kv)), level)


def field_matches(name: Column, accepted: tuple[str, ...]) -> Column:
    """One contains the other, whatever the case."""
    low = F.lower(name)
    return F.exists(F.array(*(F.lit(a.lower()) for a in accepted)), lambda a: F.contains(low, a) | F.contains(a, low))


def _two(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.2f", value))


def _checks(who: Person, rules: Rules):
    """(label, value, holds, reason) of the rules on what the document says, in the order of their reasons."""
    if rules.grad_window:
        low, high = rules.grad_window
        yield "graduation date", who.grad_date, who.grad_date.between(low, high), F.concat(F.lit("graduation date "), who.grad_date, F.lit(f" outside {low}..{high}"))
    if rules.min_gpa is not None:
        yield "GPA", who.gpa, who.gpa >= rules.min_gpa, F.concat(F.lit("GPA "), _two(who.gpa), F.lit(f" below {rules.min_gpa:.2f}"))
    if rules.min_degree_level:
        least = DEGREE_RANK[rules.min_degree_level]
        yield "degree", who.degree_level, rank(who.degree_level) >= least, F.concat(F.lit("degree "), who.degree_level, F.lit(f" below {rules.min_degree_level}"))
    if rules.degree_fields:
        yield "field of study", who.field_of_study, field_matches(who.field_of_study, rules.degree_fields), F.concat(F.lit("field of study '"), who.field_of_study, F.lit("' not in accepted list"))


def outcome(who: Person, rules: Rules, policy: str = "review") -> Column:
    """struct(status, reasons, missing). A failed rule decides; else what is missing does, by the policy: review, reject or pass."""
    if policy not in ("review", "reject", "pass"):
        raise ValueError(f"unknown policy {policy!r}")
    checks = list(_checks(who, rules))
    reasons = [F.when(value.isNotNull() & ~holds, reason) for _, value, holds, reason in checks]
    if rules.require_work_authorization:
        reasons.append(F.when(who.work_authorized.eqNullSafe(False), F.lit("not authorized to work")))
    if rules.no_sponsorship:
        reasons.append(F.when(F.coalesce(who.needs_sponsorship, F.lit(False)), F.lit("requires visa sponsorship")))
    none = F.array().cast("array<string>")
    failed = F.array_compact(F.array(*reasons)) if reasons else none
    missing = F.array_compact(F.array(*(F.when(value.isNull(), F.lit(label)) for label, value, _, _ in checks))) if checks else none
    lacks = F.size(missing) > 0
    status = F.when(F.size(failed) > 0, "REJECT")
    if policy == "review":
        status = status.when(lacks, "REVIEW")
    if policy == "reject":
        status = status.when(lacks, "REJECT")
        failed = F.when((F.size(failed) == 0) & lacks, F.transform(missing, lambda m: F.concat(F.lit("missing "), m))).otherwise(failed)
    return F.struct(status.otherwise("PASS").alias("status"), failed.alias("reasons"), missing.alias("missing"))


def rule_table(who: Person, rules: Rules) -> Column:
    """array of struct(rule, requirement, resume, status) for display; answers not given show as `ask`, unlike in outcome()."""

    def row(rule, requirement, resume, status):
        return F.struct(F.lit(rule).alias("rule"), F.lit(requirement).alias("requirement"), resume.cast("string").alias("resume"), status.alias("status"))

    def known(value, holds):
        return F.when(value.isNull(), "missing").when(holds, "pass").otherwise("fail")

    rows = []
    if rules.min_degree_level:
        names = F.create_map(*(F.lit(x) for kv in DEGREE_NAME.items() for x in kv))
        rows.append(row("Degree", f"{DEGREE_NAME[rules.min_degree_level]} or higher", F.element_at(names, who.degree_level), known(who.degree_level, rank(who.degree_level) >= DEGREE_RANK[rules.min_degree_level])))
    if rules.degree_fields:
        rows.append(row("Field of study", ", ".join(rules.degree_fields), who.field_of_study, known(who.field_of_study, field_matches(who.field_of_study, rules.degree_fields))))
    rows += [row("Field of study", f, who.field_of_study, F.lit("info")) for f in rules.shown_fields]
    if rules.min_gpa is not None:
        rows.append(row("GPA", f"{rules.min_gpa:.2f} or higher", _two(who.gpa), known(who.gpa, who.gpa >= rules.min_gpa)))
    if rules.grad_window:
        low, high = rules.grad_window
        rows.append(row("Graduation", f"by {high}" if low <= "1900-12" else f"{low} to {high}", who.grad_date, known(who.grad_date, who.grad_date.between(low, high))))
    if rules.require_work_authorization:
        rows.append(row("Work authorization", "Authorized to work", F.lit(None), F.when(who.work_authorized.isNull(), "ask").when(who.work_authorized, "pass").otherwise("fail")))
    if rules.no_sponsorship:
        rows.append(row("Visa sponsorship", "Not offered", F.lit(None), F.when(who.needs_sponsorship.isNull(), "ask").when(who.needs_sponsorship, "fail").otherwise("pass")))
    return F.array(*rows) if rows else F.array().cast("array<struct<rule:string,requirement:string,resume:string,status:string>>")
