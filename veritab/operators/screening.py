"""Prefilters, keyword scores, gates and rankings of documents and postings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, fold, has_any, has_term, text_of


def prefilter_reason(texts: list[Column], exclude=(), require=()) -> Column:
    """Why a document is dropped before anything costly: the first excluded term in any text, or no required one; else null."""
    folded = [fold(t) for t in texts]
    reason = F.when(F.lit(False), F.lit(""))
    for term in exclude:
        reason = reason.when(_any([has_term(t, term) for t in folded]), F.lit(f"excluded by {term!r}"))
    if require:
        reason = reason.when(~_any([has_any(t, require) for t in folded]), F.lit("none of require_any found"))
    return reason


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


@dataclass(frozen=True)
class Profile:
    """Weights of wanted terms and of blockers, and terms that bar outright."""

    keywords: dict[str, int]
    blockers: dict[str, int] = field(default_factory=dict)
    title_only: frozenset[str] = frozenset()
    hard: tuple[str, ...] = ()
    agencies: tuple[str, ...] = ()
    agency_penalty: int = 0
    locations: tuple[str, ...] = ()
    location_penalty: int = 25
    excluded_locations: tuple[str, ...] = ()
    remote_ok: bool = True
    title_factor: int = 3


def run_of_words(text: Column, terms) -> Column:
    """Whether one of the terms is a run of whole words of a text, punctuation aside."""
    plain = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text_of(c)), "[^a-z0-9]+", " ")), F.lit(" "))
    tests = [F.contains(plain(text), plain(F.lit(t))) & (F.length(F.trim(plain(F.lit(t)))) > 0) for t in terms]
    return _any(tests) if tests else F.lit(False)


def location_ok(location: Column, remote: Column, p: Profile) -> Column:
    """Whether a posting's place fits: none is asked for, it can be done from anywhere, it states none, or it holds one that is asked for."""
    if not p.locations:
        return F.lit(True)
    place = F.lower(text_of(location))
    fits = (place == "") | _any([F.contains(place, F.lit(x.lower())) for x in p.locations])
    return fits | F.coalesce(remote, F.lit(False)) if p.remote_ok else fits


def keyword_score(df: DataFrame, p: Profile, title="title", body="description", company="company", location="location", remote="remote") -> DataFrame:
    """df with keyword_score, keyword_hits, keyword_penalties and blocker_hits.

    Keywords match as substrings, times title_factor in the title; blockers
    match as whole words. Missing columns count as empty.
    """
    has = lambda name: F.col(name) if name in df.columns else F.lit("")
    head = F.lower(text_of(has(title)))
    blob = F.lower(F.concat(text_of(has(title)), F.lit("\n"), text_of(has(body))))
    score, hits, costs = F.lit(0), [], []
    for term, weight in p.keywords.items():
        needle = F.lit(term.lower())
        inside, below = F.contains(head, needle), F.contains(blob, needle)
        score = score + F.when(inside, F.lit(weight * p.title_factor)).when(below, F.lit(weight)).otherwise(F.lit(0))
        hits.append(F.when(inside, F.lit(f"{term} (title)")).when(below, F.lit(term)))
    for term, weight in p.blockers.items():
        hit = has_term(head if term in p.title_only else blob, term)
        score = score - F.when(hit, F.lit(weight)).otherwise(F.lit(0))
        costs.append(F.when(hit, F.lit(term)))
    if p.agency_penalty:
        hit = run_of_words(has(company), p.agencies)
        score = score - F.when(hit, F.lit(p.agency_penalty)).otherwise(F.lit(0))
        costs.append(F.when(hit, F.lit("posted by an agency")))
    if p.locations:
        fits = location_ok(has(location), F.col(remote) if remote in df.columns else F.lit(False), p)
        score = score - F.when(fits, F.lit(0)).otherwise(F.lit(p.location_penalty))
        costs.append(F.when(~fits, F.lit("location mismatch")))
    bars = [F.when(has_term(blob, t), F.lit(t)) for t in p.hard] + [F.when(run_of_words(has(location), [t]), F.lit(f"location: {t}")) for t in p.excluded_locations]
    some = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull()) if xs else F.array().cast("array<string>")
    return df.withColumns({"keyword_score": score, "keyword_hits": some(hits), "keyword_penalties": some(costs), "blocker_hits": some(bars)})


def gate(score: Column, text: Column, least: int) -> Column:
    """candidate, thin (too low, and nothing to read) or reject."""
    return F.when(score >= least, "candidate").when(F.trim(text_of(text)) == "", "thin").otherwise("reject")


def in_first(df: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """df with `within`: whether the row's key is among the first `limit` by a total order. Only the top rows are sorted and joined."""
    top = df.orderBy(*order).limit(limit).select(F.col(key).alias("__top"))
    return df.join(F.broadcast(top) if limit <= 100_000 else top, F.col(key) == F.col("__top"), "left").withColumn("within", F.col("__top").isNotNull()).drop("__top")


def first_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; Spark filters each task's rows by rank before they are dealt."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def merge_near(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Postings without near-duplicates: of one company and city, equal sets of title words, and titles similar to threshold.

    df: uid, url, company, title, location, description. The posting with the
    longest text stays, then the smaller uid and url. Equal word sets are an
    equivalence, so they are part of the group's key; within a group the
    choice is greedy, over its distinct titles. Postings without a company
    stay.
    """
    import pandas as pd

    from ..functions.text import city_key, company_key, title_words

    keyed = df.withColumns({"__company": company_key(F.col("company")), "__city": city_key(F.col("location")), "__words": F.array_join(title_words(F.col("title")), " "), "__title": clean(F.col("title"))})
    alone = keyed.filter("__company = ''")
    order = [F.length(text_of(F.col("description"))).desc(), F.col("uid"), F.col("url")]
    # Equal cleaned titles always match: one of each is enough, so groups of copies never meet in Python.
    best = first_of_each(keyed.filter("__company <> ''"), ["__company", "__city", "__words", "__title"], order)
    best = best.withColumn("__length", F.length(text_of(F.col("description"))))

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        from difflib import SequenceMatcher

        rows = rows.assign(__less=-rows["__length"]).sort_values(["__less", "uid", "url"])
        kept: list[str] = []
        stays = []
        match = SequenceMatcher(None)
        for title in rows["__title"]:
            # What is known of the second text is kept; lengths and letters rule out most pairs before their blocks are looked for.
            match.set_seq2(title)
            new = True
            for k in kept:
                match.set_seq1(k)
                if match.real_quick_ratio() >= threshold and match.quick_ratio() >= threshold and match.ratio() >= threshold:
                    new = False
                    break
            stays.append(new)
            if new:
                kept.append(title)
        return rows.loc[stays, ["uid", "url"]]

    keys = ["__company", "__city", "__words"]
    # Most groups have one title, and so nothing to compare.
    best = best.withColumn("__titles", F.count("*").over(Window.partitionBy(*keys)))
    chosen = best.filter("__titles > 1").groupBy(*keys).applyInPandas(greedy, df.select("uid", "url").schema)
    chosen = chosen.unionByName(best.filter("__titles = 1").select("uid", "url"))
    return keyed.join(chosen.dropDuplicates(), ["uid", "url"], "left_semi").unionByName(alone).select(df.columns)
