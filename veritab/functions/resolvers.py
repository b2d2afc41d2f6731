"""Facts that code finds in a text by itself, to fill or correct an answer's."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import phrases as P
from .extract import says
from .text import text_of

#: Bars that nothing gets past; they are never cut for room.
STRUCTURAL = ("nationality", "clearance")
BARS = "array<struct<kind:string,quote:string>>"


def resolve_student(stated: Column, quote: Column, read: Column) -> Column:
    """Whether only students may apply, and the words for it: what the text says of graduates takes back a yes; what it says of students makes one."""
    graduates, students = read["graduates"], read["students"]
    yes = F.coalesce(stated, F.lit(False))
    said = lambda v, q: F.struct(v.alias("value"), text_of(q).alias("quote"))
    return F.when(graduates.isNotNull() & yes, said(F.lit(False), graduates)).when(graduates.isNull() & ~yes & students.isNotNull(), said(F.lit(True), students)).otherwise(said(stated, quote))


def bars_stated(read: Column) -> Column:
    """At most one bar of each structural kind, with the words that state it."""
    return F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), read[k].alias("quote")) for k in STRUCTURAL]), lambda b: b["quote"].isNotNull())


def resolve_bars(stated: Column, read: Column, most: int = 5) -> Column:
    """The answer's bars and those of kinds that it doesn't name. Where there is no room for all, the answer's structural ones go before its others."""
    have = F.coalesce(stated, F.array().cast(BARS))
    kinds = F.transform(have, lambda b: b["kind"])
    found = F.filter(bars_stated(read), lambda b: ~F.array_contains(kinds, b["kind"]))
    hard = lambda b: b["kind"].isin(*STRUCTURAL)
    ordered = F.when(F.size(have) + F.size(found) > most, F.concat(F.filter(have, hard), F.filter(have, lambda b: ~hard(b)))).otherwise(have)
    return F.when(F.size(found) == 0, have).otherwise(F.concat(F.slice(ordered, F.lit(1), F.greatest(most - F.size(found), F.lit(0))), found))


def bar_supported(kind: Column, quote: Column) -> Column:
    """Whether a quote speaks of the kind of bar that it is given for; one of another kind must require something; a statement of equal opportunity never does."""
    spoken = F.when(kind == "other", says(quote, P.REQUIRES))
    for name, words in P.BAR_WORDS.items():
        spoken = spoken.when(kind == name, says(quote, words))
    return spoken.otherwise(F.lit(True)) & ~says(quote, P.EQUAL_OPPORTUNITY)


def year_in(year: Column, quote: Column) -> Column:
    """Whether a quote states a year as a whole number; one that isn't stated needs none."""
    return year.isNull() | F.array_contains(F.regexp_extract_all(text_of(quote), F.lit("(\\d+)"), F.lit(1)), year.cast("string"))


def graduation_supported(year: Column, quote: Column) -> Column:
    """Whether a quote states the year and speaks of graduating, not of a programme's name."""
    return year.isNull() | (year_in(year, quote) & says(quote, P.GRADUATION))


def student_supported(stated: Column, quote: Column) -> Column:
    """Whether a yes is about who may apply, and not about whom the role serves."""
    return ~(F.coalesce(stated, F.lit(False)) & says(quote, P.STUDENTS_SERVED))


@F.pandas_udf(T.ArrayType(T.StringType()))
def plain_words(texts: pd.Series) -> pd.Series:
    """Words without compatibility forms, case and accents; null has none."""
    import re
    import unicodedata

    def plain(t: str | None) -> list[str]:
        folded = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", t or "").casefold())
        return re.findall(r"\w+", "".join(ch for ch in folded if not unicodedata.combining(ch)))

    return texts.map(plain)
