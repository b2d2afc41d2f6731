"""Postings' facts: the quote check, then corrections from the text in a fixed order, with a count of what each step changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract, resolvers, stated
from ..functions import phrases as P
from ..functions.text import fold, text_of

#: What changes() counts.
STEPS = ("quotes", "years_set", "years_cleared", "bars", "student", "level", "field")


def check(df: DataFrame, title: str = "title", body: str = "description") -> DataFrame:
    """df with facts cleared whose quote stands in neither the title nor the text, or doesn't support them; quotes_rejected: whether any was.

    Facts: level, years_required, student_only, graduation_year and field, each
    with its quote (level_quote and so on; years_quote, student_quote,
    graduation_quote), and bars (kind, quote); null columns may be missing.
    """
    texts = [fold(F.col(title)), fold(F.col(body))]

    def stands(quote: Column) -> Column:
        q = fold(quote)
        return (q != "") & (F.contains(texts[0], q) | F.contains(texts[1], q))

    named = {"level": "level_quote", "years_required": "years_quote", "student_only": "student_quote", "graduation_year": "graduation_quote", "field": "field_quote"}
    also = {"student_only": resolvers.student_supported, "graduation_year": resolvers.graduation_supported}
    made, rejected = {}, F.lit(False)
    for fact, quote in named.items():
        if fact not in df.columns or quote not in df.columns:
            continue
        ok = stands(F.col(quote))
        if fact in also:
            ok = ok & also[fact](F.col(fact), F.col(quote))
        made |= {fact: F.when(ok, F.col(fact)), quote: F.when(ok, F.col(quote)).otherwise("")}
        rejected = rejected | (~ok & (F.col(fact).isNotNull() | (text_of(F.col(quote)) != "")))
    bars = F.coalesce("bars", F.array().cast(resolvers.BARS))
    kept = F.filter(bars, lambda b: stands(b["quote"]) & resolvers.bar_supported(b["kind"], b["quote"]))
    return df.withColumns(made | {"bars": kept, "quotes_rejected": rejected | (F.size(kept) < F.size(bars))})


def resolved_row(title: Column, quote: Column, said: Column, rows, least_words: int = 2) -> tuple[Column, Column]:
    """A level or field and where it is from: what the title says; else the answer's, where its quote has two words; else what such a quote says."""
    in_title = extract.first_row(title, rows)
    enough = F.size(F.filter(F.split(F.trim(text_of(quote)), "\\s+"), lambda w: w != "")) >= least_words
    told = F.when(enough, F.coalesce(said, extract.first_row(quote, rows)))
    return F.coalesce(in_title, told), F.when(in_title.isNotNull(), "title").when(told.isNotNull(), "text").otherwise("none")


def finish(df: DataFrame, title: str = "title", body: str = "description") -> DataFrame:
    """df (checked facts: years_required, years_quote, bars, student_only, student_quote, level, level_quote, field, field_quote) with them corrected, level_source, and changed: what the steps did, in order."""
    t, b = F.col(title), F.col(body)
    none = F.lit(None).cast("string")
    column = lambda name, otherwise: F.col(name) if name in df.columns else otherwise
    df = df.withColumn("__read", stated.read(t, b, F.col("years_required"), F.col("years_quote")))
    read = F.col("__read")
    student = resolvers.resolve_student(F.col("student_only"), column("student_quote", none), read)
    # Of a title with an analytic word, "other" is no field.
    field_said = F.when((F.col("field") == "other") & extract.says(t, P.ANALYTIC_TITLE), none).otherwise(F.col("field"))
    field_quote = F.when((F.col("field") == "other") & extract.says(t, P.ANALYTIC_TITLE), F.lit("")).otherwise(F.col("field_quote"))
    level, source = resolved_row(t, F.col("level_quote"), F.col("level"), extract.LEVELS)
    field, field_source = resolved_row(t, field_quote, field_said, extract.FIELDS)
    bars = F.coalesce("bars", F.array().cast(resolvers.BARS))
    by_title = lambda is_from, quote: F.when(is_from == "title", F.left(t, F.lit(stated.QUOTE))).when(is_from == "text", quote).otherwise("")
    new = {
        "years_required": read["years"].cast("int"), "years_quote": read["years_quote"], "bars": resolvers.resolve_bars(bars, read), "student_only": student["value"], "student_quote": student["quote"],
        "level": level, "level_source": source, "level_quote": by_title(source, F.col("level_quote")), "field": field, "field_quote": by_title(field_source, field_quote),
    }
    was = {c: F.col(f"__was_{c}") for c in ("years_required", "bars", "student_only", "level", "field")}
    df = df.withColumns({f"__was_{c}": F.col(c) for c in was}).withColumns(new)
    kinds = lambda c: F.transform(F.coalesce(c, F.array().cast(resolvers.BARS)), lambda x: x["kind"])
    years = F.col("years_required")
    did = {
        "quotes": column("quotes_rejected", F.lit(False)), "years_set": years.isNotNull() & ~years.eqNullSafe(was["years_required"]), "years_cleared": years.isNull() & was["years_required"].isNotNull(),
        "bars": F.size(F.array_except(kinds(F.col("bars")), kinds(was["bars"]))) > 0, "student": ~F.col("student_only").eqNullSafe(was["student_only"]), "level": ~F.col("level").eqNullSafe(was["level"]), "field": ~F.col("field").eqNullSafe(was["field"]),
    }
    changed = F.array_compact(F.array(*[F.when(did[s], F.lit(s)) for s in STEPS]))
    return df.withColumn("changed", changed).drop("__read", *[f"__was_{c}" for c in was])


def changes(finished: DataFrame) -> DataFrame:
    """One row: postings, and how many each step changed; a posting counts once a step."""
    return finished.agg(F.count("*").alias("postings"), *[F.count_if(F.array_contains("changed", s)).alias(s) for s in STEPS])
