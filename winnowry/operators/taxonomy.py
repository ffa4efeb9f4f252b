"""Skills with other spellings and broader skills: small, kept on the driver, used to build patterns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import any_pattern, term_pattern
from ..functions.text import STRINGS


@dataclass(frozen=True)
class Skill:
    name: str
    aliases: tuple[str, ...] = ()
    category: str = "other"
    broader: str | None = None

    @property
    def forms(self) -> tuple[str, ...]:
        return (self.name, *self.aliases)


@dataclass(frozen=True)
class Taxonomy:
    skills: tuple[Skill, ...] = field(default=())

    @classmethod
    def from_frame(cls, rows: DataFrame) -> Taxonomy:
        """From name, aliases, category, broader; order is that of `ord` where there is one."""
        rows = rows.orderBy("ord") if "ord" in rows.columns else rows
        return cls(tuple(Skill(r["name"], tuple(r["aliases"] or ()), r["category"], r["broader"]) for r in rows.collect()))

    def get(self, name: str | None) -> Skill | None:
        return next((s for s in self.skills if s.name == name), None)

    def canonical(self, term: str) -> str | None:
        """The skill a spelling belongs to; spellings of one or two characters keep their case."""
        same = lambda form: form == term if min(len(form), len(term)) <= 2 else form.lower() == term.lower()
        return next((s.name for s in self.skills if any(map(same, s.forms))), None)

    def expand(self, term: str) -> list[str]:
        skill = self.get(self.canonical(term))
        return list(dict.fromkeys([term, *(skill.forms if skill else ())]))

    def match_forms(self, name: str) -> list[str]:
        """Spellings of a skill, and of those that have it as their broader one."""
        own = self.get(name)
        return [*(own.forms if own else ()), *(f for s in self.skills if s.broader == name for f in s.forms)]

    def found_in(self, text: Column | str) -> Column:
        """Names of the skills that occur in a text, in the taxonomy's order."""
        text = F.col(text) if isinstance(text, str) else text
        if not self.skills:
            return F.array().cast(STRINGS)
        return F.array_compact(F.array(*(F.when(text.rlike(any_pattern(list(s.forms))), s.name) for s in self.skills)))

    def hits(self, line: Column) -> Column:
        """array of struct(start, end, name, surface) by place: of each skill the first form, in its order, that occurs."""

        def one(s: Skill) -> Column:
            out = None
            for form in s.forms:
                p = term_pattern(form)
                surface = F.regexp_substr(line, F.lit(p))
                at = F.regexp_instr(line, F.lit(p))
                got = F.struct(at.alias("start"), (at + F.length(surface)).alias("end"), F.lit(s.name).alias("name"), surface.alias("surface"))
                out = F.when(line.rlike(p), got) if out is None else out.when(line.rlike(p), got)
            return out

        return F.array_sort(F.array_compact(F.array(*map(one, self.skills))))

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(name, category, broader) and (name, form, ord)."""
        return (
            spark.createDataFrame([(s.name, s.category, s.broader) for s in self.skills], "name string, category string, broader string"),
            spark.createDataFrame([(s.name, f, i) for s in self.skills for i, f in enumerate(s.forms)], "name string, form string, ord int"),
        )


def skill_share(resume: Column, posting: Column) -> Column:
    """Share of a posting's skills that the resume has; nothing asked for is 0."""
    return F.when(F.size(F.array_distinct(posting)) > 0, F.size(F.array_intersect(posting, resume)) / F.size(F.array_distinct(posting))).otherwise(0.0)
