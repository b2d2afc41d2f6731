"""What a posting says of itself: shapes that state a fact, and the words around them that take it back.

A Reading names the shapes, where a match's surroundings end, and which words in
which part of them refuse it. The first match that nothing refuses is the fact,
quoted as it stands. All readings of a posting are made in one Arrow batch
function; a text without any of the words that shapes need never reaches it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import phrases as P
from .text import PLAIN, TYPOGRAPHIC, text_of

#: The most characters of a quote; of a bar's whole sentence; and the most years that are taken for a requirement.
QUOTE, BAR_SENTENCE, MOST_YEARS = 200, 120, 14
_FOLD = str.maketrans(TYPOGRAPHIC, PLAIN)
#: What a text must hold for any reading to find something.
ANY = r"(?i)year|yrs|graduat|student|currently|returning to|national|citizen|passport|emirati|saudis|family\s+book|clear|vetting|uksv|nppv|\bedv\b|\bSC\b|\bDV\b"


def _re(pattern: str) -> re.Pattern[str]:
    return re.compile(pattern, re.IGNORECASE)


@dataclass(frozen=True)
class Reading:
    """shapes: patterns that state the fact. ends: where a unit (a sentence) ends. reach: characters of the unit looked at on either side. refuses: (part, pattern); a part is before, after, clause (before, since the last cut), rest (after, to the next cut), near (after, a little), unit or match."""

    shapes: tuple[re.Pattern[str], ...]
    refuses: tuple[tuple[str, re.Pattern[str]], ...]
    ends: re.Pattern[str]
    cuts: re.Pattern[str]
    reach: int
    near: int


def _reading(shapes, refuses, ends: str, cuts: str, reach: int, near: int) -> Reading:
    return Reading(tuple(map(_re, shapes)), tuple((part, _re(p)) for part, p in refuses), _re(ends), _re(cuts), reach, near)


_SENTENCE = r"[.!?;](?=\s|$)"
_ELIGIBLE = (("before", P.NEGATION), ("after", P.NEGATION), ("before", P.EXCLUDED_BEFORE))
_WAIVED = (
    ("clause", P.BAR_NEGATED_BEFORE), ("near", P.BAR_NEGATED_AFTER), ("clause", P.BAR_SOFT_BEFORE), ("near", P.BAR_SOFT_AFTER), ("rest", P.BAR_SOFT_IN_CLAUSE),
    ("before", P.BAR_HEDGED_BEFORE), ("near", P.BAR_HEDGED_AFTER),
)
READINGS = {
    "graduates": _reading((P.GRADUATES_ELIGIBLE,), _ELIGIBLE, _SENTENCE, P.CLAUSE_START, 60, 60),
    "students": _reading((P.STUDENTS_ONLY,), (*_ELIGIBLE, ("unit", P.OTHER_ROUTE)), _SENTENCE, P.CLAUSE_START, 60, 60),
    "nationality": _reading(P.NATIONALITY_STATED, (*_WAIVED, ("before", P.BAR_ALTERNATIVE), ("after", P.BAR_ALTERNATIVE), ("after", P.BAR_OR_ALTERNATIVE)), P.BAR_SENTENCE_END, P.BAR_CLAUSE_START, 120, 60),
    "clearance": _reading(P.CLEARANCE_STATED, (*_WAIVED, ("clause", P.CLEARANCE_DUTY), ("clause", P.CLEARANCE_HOLDERS), ("clause", P.CLEARANCE_PEERS), ("after", P.CLEARANCE_WORK_AFTER), ("after", P.QUESTION_AFTER)), P.BAR_SENTENCE_END, P.BAR_CLAUSE_START, 120, 60),
    # A count's clause may go back over sentences that end within it ("max. 2 years"), so its unit is the whole text.
    "years": _reading(P.YEARS_STATED, (("clause", P.YEARS_CAP), ("tight", P.YEARS_CAP_TIGHT), ("clause", P.YEARS_SOFT), ("after", P.YEARS_SOFT_AFTER), ("after", P.YEARS_CAP_AFTER), ("after", P.YEARS_COMPANY_AFTER), ("after", P.YEARS_WAIVED), ("clause", P.YEARS_WAIVED_BEFORE), ("after", P.YEARS_CAREER)), r"(?!)", P.CLAUSE_START, 240, 60),
}


#: Words of which one stands in every text that a reading's shapes match.
HINTS = {
    "graduates": ("graduat", "completed"), "students": ("penultimate", "currently", "first", "1st", "returning", "students"), "years": ("year", "yr", "experience"),
    "nationality": ("national", "citizen", "emirati", "saudi", "family", "passport"), "clearance": ("clear", "vetting", "uksv", "nppv", "edv", "sc", "dv"),
}


def hinted(name: str, low: str) -> bool:
    return any(w in low for w in HINTS[name])


def _last_end(pattern: re.Pattern[str], text: str) -> int:
    return max((m.end() for m in pattern.finditer(text)), default=0)


def standing(reading: Reading, text: str):
    """(match, parts, start and end of its unit) of each match in order that no words around it refuse."""
    ends = [m.end() for m in reading.ends.finditer(text)]
    for m in sorted((m for s in reading.shapes for m in s.finditer(text)), key=re.Match.start):
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        i = bisect_right(ends, begin)
        low = ends[i - 1] if i else 0
        high = next((e for e in ends[i:] if e >= m.end()), len(text))
        before = text[max(low, begin - reading.reach) : begin]
        after = text[m.end() : min(high, m.end() + max(reading.reach, 200 if reading.reach > 200 else 0))]
        tail = before if reading.reach > 200 else before[-60:]
        stop = reading.cuts.search(after)
        parts = {"before": before, "after": after, "clause": tail[_last_end(reading.cuts, tail) :], "rest": after[: stop.start()] if stop else after, "near": after[: reading.near], "unit": text[low:high].strip(), "match": m[0], "tight": before[-16:]}
        if not any(p.search(parts[part]) for part, p in reading.refuses):
            yield m, parts, low, high


def sentence_in(name: str, text: str) -> str | None:
    """The sentence that states a fact, or only its words where the sentence is long; null if none does."""
    for m, parts, _, _ in standing(READINGS[name], text.translate(_FOLD)):
        at = text.translate(_FOLD).find(parts["unit"])
        return text[at : at + len(parts["unit"])] if len(parts["unit"]) <= QUOTE else text[m.start() : m.end()]
    return None


def bar_in(kind: str, text: str) -> str | None:
    """The words that state a bar of a kind: its sentence if short, else from its shape on to the end of a word. Only those that name the kind."""
    folded = text.translate(_FOLD)
    for m, _, low, high in standing(READINGS[kind], folded):
        whole = folded[low:high]
        if kind == "clearance" and (re.search(r"(?i)\bbpss\b|\bbaseline\s+personnel\s+security\b", whole) and not re.search(r"\b(?:SC|DV|eDV|EDV|CTC)\b|(?i:developed\s+vetting|nppv|uksv|top\s+secret|ts/sci|counter[\s-]terroris[tm])", whole)):
            continue
        if kind == "clearance" and not re.search(r"(?i)(?:cleared|eligible)\s*$", m[0]) and re.match(r"(?i)\s*analysts?\b", folded[m.end() : high]):
            continue
        quote = text[low:high].strip(" \t\r\n•·")
        if len(quote) > BAR_SENTENCE:
            stop = min(high, m.start() + BAR_SENTENCE)
            if stop < high:
                stop = max((s.start() for s in re.compile(r"\s").finditer(folded, m.end(), stop + 1)), default=m.end())
            quote = text[m.start() : stop].rstrip(" \t\r\n•·")
        quote = quote[:QUOTE]
        if names_bar(kind, quote):
            return quote
    return None


def names_bar(kind: str, quote: str) -> bool:
    """Whether a bar's quote names its kind; one of another kind must require something; a statement of equal opportunity is no bar."""
    quote = quote.translate(_FOLD)
    if _re(P.EQUAL_OPPORTUNITY).search(quote):
        return False
    if kind == "other":
        return _re(P.REQUIRES).search(quote) is not None
    return kind not in P.BAR_WORDS or _re(P.BAR_WORDS[kind]).search(quote) is not None


def _under_wishes(text: str, at: int) -> bool:
    """Whether the line above is a heading of wishes: short, without a full stop, and with a colon or of three words."""
    lines = text[:at].split("\n")
    above = lines[-2].strip() if len(lines) > 1 and at - text.rfind("\n", 0, at) <= 240 else ""
    return 0 < len(above) <= 60 and "." not in above and (above.endswith(":") or len(above.split()) <= 3) and _re(P.YEARS_SOFT).search(above) is not None


def _of_others(clause: str) -> bool:
    """Whether the count is another's: someone is named just before, and nothing is asked of the reader after that."""
    near = clause[-70:]
    for m in _re(P.YEARS_OTHERS).finditer(near):
        of_reader = m[0].lower().startswith("who") and _re(P.YEARS_CANDIDATE).search(near[: m.start()])
        if not of_reader and not _re(P.YEARS_ASKED).search(near[m.end() :]):
            return True
    return False


def years_in(text: str) -> tuple[int, str] | None:
    """The least years of experience that a text asks for, and its words."""
    for m, parts, _, _ in standing(READINGS["years"], text):
        n, words = int(next(g for g in m.groups() if g)), m[0].strip()
        if not 0 < n <= MOST_YEARS or _under_wishes(text, m.start() + len(m[0]) - len(m[0].lstrip())):
            continue
        if not words.lower().startswith("you have") and (_of_others(parts["clause"]) or _re(P.YEARS_COMPANY).search(parts["clause"])):
            continue
        return n, words[:QUOTE]
    return None


def range_in(quote: str) -> tuple[int, int] | None:
    """Both ends of the first range of years, rounded down; none if the low one isn't smaller."""
    found = [m for p in P.YEARS_RANGES if (m := _re(p).search(quote))]
    if not found:
        return None
    m = min(found, key=lambda m: m.start(1))
    low, high = int(float(m[1])), int(float(m[2]))
    return (low, high) if low < high else None


def no_least(value: int, quote: str) -> bool:
    """Whether a quote makes a count a most, or an age."""
    m = re.search(rf"(?<![\d.]){value}(?![\d.])", quote)
    if m is None:
        return False
    before = quote[: m.start()]
    clause = before[_last_end(_re(P.CLAUSE_START), before) :]
    most = _re(P.YEARS_CAP).search(clause) and not _re(P.YEARS_FLOOR).search(clause)
    return bool(most or _re(P.YEARS_AGE_BEFORE).search(clause) or _re(P.YEARS_AGE_AFTER).match(quote[m.end() :]))


def settled_years(value: int | None, quote: str, title: str, body: str) -> tuple[int | None, str]:
    """Years required: the answer's, at the low end of its own range; where its quote makes it no least, or nothing is left, the title's, else the text's."""
    if value is not None and not no_least(value, quote):
        ends = range_in(quote)
        if ends is None or ends[1] != value:
            return value, quote
        if ends[0] > 0:
            return ends[0], quote
    return next((x for t in (title, body) if hinted("years", t.lower()) and (x := years_in(t))), (None, ""))


STATED = T.StructType(
    [T.StructField("years", T.LongType()), T.StructField("years_quote", T.StringType()), *[T.StructField(n, T.StringType()) for n in ("graduates", "students", "nationality", "clearance")]]
)


@F.pandas_udf(STATED)
def _read(title: pd.Series, body: pd.Series, value: pd.Series, quote: pd.Series) -> pd.DataFrame:
    rows = []
    for t, b, v, q in zip(title, body, value, quote, strict=True):
        t, b, q = t or "", b or "", q or ""
        years, words = settled_years(None if pd.isna(v) else int(v), q, t, b)
        texts = [(x, x.lower()) for x in (t, b) if x]
        found = [next((y for x, low in texts if hinted(n, low) and (y := read(n, x))), None) for n, read in (("graduates", sentence_in), ("students", sentence_in), ("nationality", bar_in), ("clearance", bar_in))]
        rows.append((years, words, *found))
    out = pd.DataFrame(rows, columns=STATED.names)
    return out.assign(years=out["years"].astype("Int64"))


def read(title: Column, body: Column, years: Column | None = None, quote: Column | None = None) -> Column:
    """What a posting states: years and their quote (an answer's, if given, settled by its quote), and the words that state that graduates may apply, that only students may, a bar of nationality, and one of clearance."""
    some = lambda c: F.when(text_of(c).rlike(ANY), text_of(c))
    nothing = F.lit(None)
    return _read(some(title), some(body), (nothing if years is None else years).cast("long"), (nothing if quote is None else quote).cast("string"))
