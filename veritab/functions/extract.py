"""Level and field of a posting by ordered tables of phrases: the first row with a hit decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import phrases as P
from .text import PLAIN, TYPOGRAPHIC, text_of

LEVELS, FIELDS = P.LEVELS, P.FIELDS


def says(c: Column, pattern: str) -> Column:
    """Whether a text matches a phrase, quotes and dashes plain, case aside."""
    return F.translate(text_of(c), TYPOGRAPHIC, PLAIN).rlike(f"(?i){pattern}")


def first_row(c: Column, rows) -> Column:
    """The name of the first row (name, pattern) that matches; null if none does."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in rows:
        out = out.when(says(c, pattern), F.lit(name))
    return out


def is_programme(title: Column) -> Column:
    """Whether a title names a programme that opens every year."""
    return says(title, P.PROGRAMME_TITLE)


def graduation_year(c: Column) -> Column:
    """The first year that a sentence names as one of graduating."""
    return F.nullif(F.regexp_extract(F.lower(text_of(c)), "\\bgraduat(?:e|es|ed|ing|ion)\\b[^.;!?]{0,40}?\\b(20[0-9]{2})\\b", 1), F.lit("")).cast("int")


def total_due(c: Column) -> Column:
    """The amount that a text calls its total due, and these words."""
    words = F.nullif(F.regexp_extract(text_of(c), f"(?i){P.TOTAL_DUE}", 0), F.lit(""))
    amount = F.replace(F.regexp_extract(text_of(c), f"(?i){P.TOTAL_DUE}", 1), F.lit(","), F.lit("")).try_cast("double")
    return F.struct(F.when(words.isNotNull(), amount).alias("value"), F.coalesce(words, F.lit("")).alias("quote"))


def total_not_subtotal(fact: Column, texts: list[Column]) -> Column:
    """A fact (value, quote) whose quote speaks of another amount, replaced by the total due of the first text that has one."""
    totals = [total_due(t) for t in texts]
    found = F.coalesce(*[F.when(t["value"].isNotNull(), t) for t in totals])
    other = fact["value"].isNotNull() & says(fact["quote"], P.NOT_THE_TOTAL)
    return F.when(other & found.isNotNull(), F.struct(found["value"].alias("value"), found["quote"].alias("quote"))).otherwise(fact)
