"""Verdicts on postings from their checked facts, by rules in a fixed order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_of

#: Scores from which a posting is worth applying to or considering, and the most that a blocked one gets.
APPLY, CONSIDER, BLOCKED = 65, 40, 20
#: Kinds of bars that nothing gets past; others only make a posting not worth it. Permission to work is not judged.
STRUCTURAL = ("nationality", "clearance")
IGNORED = ("work_auth",)


@dataclass(frozen=True)
class Limits:
    """What the reader of postings can meet; None leaves a rule out."""

    graduation_years: tuple[int, ...] | None = None
    student: bool | None = None
    levels: tuple[str, ...] | None = None
    max_years: int | None = None
    skip_fields: tuple[str, ...] = ()
    nationalities: tuple[str, ...] = ()
    #: Employers for which the rule on fields is left out.
    exempt: tuple[str, ...] = ()
    least_score: int = 55


def company_exempt(company: Column, exempt: tuple[str, ...]) -> Column:
    """Whether an exempt name stands in a company's as a run of whole words, case and accents aside. Names of other scripts count; one without a word exempts nothing."""
    from ..functions.resolvers import plain_words

    name = F.concat(F.lit(" "), F.array_join(plain_words(text_of(company)), " "), F.lit(" "))
    out = F.lit(False)
    for words in filter(None, (" ".join(_plain(e)) for e in exempt)):
        out = out | F.contains(name, F.lit(f" {words} "))
    return out


def _plain(text: str) -> list[str]:
    import re
    import unicodedata

    folded = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
    return re.findall(r"\w+", "".join(ch for ch in folded if not unicodedata.combining(ch)))


def overlaid(judged: DataFrame, capped: DataFrame, columns: list[str], key: str = "uid") -> DataFrame:
    """judged with the columns of capped rows in place of theirs."""
    new = capped.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    both = judged.join(new, F.col(key) == F.col("__key"), "left")
    return both.select(*[F.when(F.col("__key").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in judged.columns])


def _own(quote: Column, nationalities: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in nationalities:
        out = out | F.lower(text_of(quote)).rlike(f"(?U)(?<!\\w)\\Q{n.lower()}\\E(?!\\w)")
    return out


def verdict(df: DataFrame, limits: Limits) -> DataFrame:
    """df with verdict (blocked, skip, apply or consider), rule and score.

    df: fit_score, level, years_required, student_only, graduation_year, field
    and bars (array of kind and quote); a null fact fires no rule. The order:
    bars that nothing gets past, other bars, graduation year, students only
    (unless the year has judged that), level, years, field, and then the score.
    """
    bars = F.filter(F.coalesce(F.col("bars"), F.array().cast("array<struct<kind:string,quote:string>>")), lambda b: ~b["kind"].isin(*IGNORED) & ~((b["kind"] == "nationality") & _own(b["quote"], limits.nationalities)))
    hard = F.exists(bars, lambda b: b["kind"].isin(*STRUCTURAL))
    fires: list[tuple[str, Column]] = []
    year_judged = F.lit(False)
    if limits.graduation_years is not None:
        fires.append(("graduation_year", F.col("graduation_year").isNotNull() & ~F.col("graduation_year").isin(*limits.graduation_years)))
        year_judged = F.col("graduation_year").isNotNull()
    if limits.student is False:
        fires.append(("student_only", F.col("student_only") & ~year_judged))
    if limits.levels is not None:
        fires.append(("level", ~F.col("level").isin(*limits.levels)))
    if limits.max_years is not None:
        fires.append(("years", F.col("years_required") > limits.max_years))
    if limits.skip_fields:
        exempt = company_exempt(F.col("company"), limits.exempt) if limits.exempt else F.lit(False)
        fires.append(("field", F.col("field").isin(*limits.skip_fields) & ~exempt))
    rule = F.when(hard | (F.size(bars) > 0), F.lit("hard_bar"))
    for name, test in fires:
        rule = rule.when(F.coalesce(test, F.lit(False)), F.lit(name))
    df = df.withColumns({"__hard": F.coalesce(hard, F.lit(False)), "rule": rule})
    fit = F.coalesce(F.col("fit_score"), F.lit(0))
    score = F.when(F.col("__hard"), F.least(fit, F.lit(BLOCKED))).when(F.col("rule").isNotNull(), F.least(fit, F.lit(max(limits.least_score - 1, 0)))).otherwise(fit)
    kind = F.when(F.col("__hard"), "blocked").when(F.col("rule").isNotNull(), "skip").when(fit >= APPLY, "apply").when(fit >= CONSIDER, "consider").otherwise("skip")
    return df.withColumns({"verdict": kind, "score": score}).drop("__hard")


def recorded(df: DataFrame) -> DataFrame:
    """What a run may record as seen, with the reason: assessed postings only, so that one put off comes again."""
    reason = F.when(F.col("gate") == "reject", "below the gate").when(F.col("rule").isNotNull(), F.concat(F.lit("rule: "), F.col("rule"))).when(F.col("verdict").isNotNull(), F.col("verdict"))
    return df.filter(F.col("deferred").isNull()).withColumn("reason", reason).filter(F.col("reason").isNotNull())
