"""Containment, paging, finished facts and keys, and the queries that have no SQL, against brute force."""

import json
import random
import unicodedata
from difflib import SequenceMatcher

import duckdb
from pyspark.sql import functions as F
from tests.conftest import SF

from veritab.functions import keys as H
from veritab.operators import finish, guard, screening
from veritab.plans.catalog import QUERIES
from veritab.sources import paging
from veritab.sources.structured import postings_in


def test_contained_against_all_pairs(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("ab") for _ in range(draw.randint(1, 3)))
    texts = [(i, " ".join(word() for _ in range(draw.randint(0, 30)))) for i in range(60)] + [(90, None), (91, "")]
    passages = [(i, " ".join(word() for _ in range(draw.randint(0, 9)))) for i in range(150)] + [(900, None), (901, "x" * 80), (902, texts[0][1])]
    texts.append((92, "y" + "x" * 90))
    t, p = spark.createDataFrame(texts, "t int, text string"), spark.createDataFrame(passages, "p int, passage string")
    got = sorted((r.t, r.p) for r in guard.contained(t, p).collect())
    assert got == sorted((i, j) for i, a in texts for j, b in passages if a and b and b in a) and len(got) > 500
    assert guard.contained(t.limit(0), p).count() == 0 and guard.contained(t, p.limit(0)).count() == 0


def test_paging(spark):
    pages = [("a", 1, ["1", "2"], 5), ("a", 2, ["3", "4"], 0), ("a", 3, ["5"], 0), ("b", 1, ["1", "2"], None), ("b", 2, ["1", "9"], None), ("b", 3, ["7", "8"], None), ("c", 1, ["1", "2"], 2), ("c", 2, ["3", "4"], 2), ("d", 1, [], None), ("e", 1, ["x", "y"], None)]
    got = {(r.query, r.page): (r.ends, r.read) for r in paging.page_verdicts(spark.createDataFrame(pages, "query string, page int, rows array<string>, total int"), 2).collect()}
    assert got == {("a", 1): (None, True), ("a", 2): (None, True), ("a", 3): ("short", True), ("b", 1): (None, True), ("b", 2): ("begins again", False), ("b", 3): (None, False), ("c", 1): ("count reached", True), ("c", 2): ("count reached", False), ("d", 1): ("empty", False), ("e", 1): (None, True)}
    listing = spark.createDataFrame([("p", 2, "late"), ("p", 1, "first"), ("", 3, "x"), (None, 4, "y"), ("q", 5, "z")], "path string, ordinal int, title string")
    one = paging.first_by_path(listing)
    assert sorted(r.title for r in one.collect()) == ["first", "x", "y", "z"]
    details = spark.createDataFrame([("p", "full"), ("q", "")], "path string, title string")
    assert sorted(r.title for r in paging.with_details(one, details, ["title"]).collect()) == ["full", "x", "y", "z"]
    entries = spark.createDataFrame([("u", "1"), ("v", None), ("w", "2")], "loc string, lastmod string")
    cache = spark.createDataFrame([("u", "1", "kept"), ("v", None, "kept"), ("w", "1", "old")], "url string, lastmod string, html string")
    assert {r.loc: (r.html, r.hit) for r in paging.kept_pages(entries, cache).collect()} == {"u": ("kept", True), "v": (None, False), "w": (None, False)}
    status = spark.createDataFrame([(200,), (404,), (500,), (None,)], "s int").select(paging.page_outcome(F.col("s"))).collect()
    assert [r[0] for r in status] == ["read", "lost", "failed", "failed"]
    jobs = spark.createDataFrame([("a:x", "2026-01-01"), ("a:x", "2025-01-01"), ("b:x", "2025-01-01"), ("a:x", None)], "source string, d string").withColumn("posted", F.col("d").cast("date"))
    assert [(r.source, r.d) for r in paging.drop_stale(jobs, F.lit("2026-01-10").cast("date"), 30, ("b",)).collect()] == [("a:x", "2026-01-01"), ("b:x", "2025-01-01"), ("a:x", None)]


def test_finish(spark):
    schema = "title string, description string, years_required int, years_quote string, bars array<struct<kind:string,quote:string>>, student_only boolean, level string, level_quote string, field string, field_quote string"
    rows = [
        ("Senior data analyst", "UK nationals only. 3-5 years", 5, "3-5 years", None, None, "mid", "", "sales", ""), ("Clerk", "We ask for 4 years of experience.", None, None, [], True, "mid", "a role for a graduate", None, None),
        ("Clerk", "", 2, "0-2 years", [], None, None, "team lead of six", None, None), ("Clerk", "", 3, "up to 3 years", [], None, None, None, "other", "two words"), ("Insights clerk", "", None, "", [], None, "mid", "mid", "other", "two words"),
    ]
    done = finish.finish(spark.createDataFrame(rows, schema)).cache()
    got = [(r.years_required, [b.kind for b in r.bars], r.student_only, r.level, r.level_source, r.field, r.changed) for r in done.collect()]
    assert got == [
        (3, ["nationality"], None, "senior", "title", "analytics_bi", ["years_set", "bars", "level", "field"]), (4, [], True, "mid", "text", None, ["years_set"]), (None, [], None, "lead_principal", "text", None, ["years_cleared", "level"]),
        (None, [], None, None, "none", "other", ["years_cleared"]), (None, [], None, None, "none", None, ["level", "field"]),
    ]
    assert finish.changes(done).first().asDict() == {"postings": 5, "quotes": 0, "years_set": 2, "years_cleared": 2, "bars": 1, "student": 0, "level": 3, "field": 2}


def test_check_facts(spark):
    schema = "title string, description string, level string, level_quote string, years_required int, years_quote string, student_only boolean, student_quote string, graduation_year int, graduation_quote string, field string, field_quote string, bars array<struct<kind:string,quote:string>>"
    text = "A “Senior” post. 3 years. Student services. Graduating in 2027. UK citizens only."
    rows = [
        ("Clerk", text, "senior", '"Senior" post', 3, "3 years", True, "Student services", 2027, "Graduating in 2027", "quant", "not here", [("nationality", "UK citizens only"), ("clearance", "UK citizens only"), ("other", "nowhere must")]),
        ("Clerk", text, None, "", 3, "Clerk A", None, None, 2027, "3 years", None, None, None),
    ]
    a, b = finish.check(spark.createDataFrame(rows, schema)).collect()
    assert (a.level, a.years_required, a.student_only, a.graduation_year, a.field, a.field_quote, [x.kind for x in a.bars], a.quotes_rejected) == ("senior", 3, None, 2027, None, "", ["nationality"], True)
    assert (b.level, b.years_required, b.graduation_year, b.bars, b.quotes_rejected) == (None, None, None, [], True)


def test_keys(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("", "a")], "x string, y string").select(H.content_hash("x", "y").alias("h"), H.one_sentence(F.lit("one  two three"), 9).alias("s"))
    a, b, c = df.collect()
    assert a.h == b.h != c.h and len(a.h) == 16 and a.s == "one two…"
    assert H.fingerprint(a=1, b=2) == H.fingerprint(b=2, a=1) != H.fingerprint(a=1, b=3)
    assert H.source_key("k", "s", "l") == "k:s:l" != H.source_key("k", "s", "l", pages=3)


def test_markup_postings(spark):
    micro = '<div itemscope itemtype="https://schema.org/JobPosting"><h1 itemprop="title">Clerk <b>II</b></h1><meta itemprop="datePosted" content="2026-02-03"><div itemprop="hiringOrganization" itemscope itemtype="http://schema.org/Organization"><span itemprop="name">Acme</span></div><div itemprop="jobLocation" itemscope><div itemprop="address" itemscope><span itemprop="addressLocality">Oslo</span></div></div><p itemprop="description">one<br>two</p></div>'
    rdfa = '<div vocab="http://schema.org/" typeof="JobPosting"><span property="title">Cook</span><span property="hiringOrganization" typeof="Organization"><i property="name">Beta</i></span><a property="url" href="http://x/1">go</a></div>'
    ld = json.dumps({"@type": "JobPosting", "title": "First"})
    pages = [("u1", micro), ("u2", rdfa), ("u3", micro + f'<script type="application/ld+json">{ld}</script>'), ("u4", "<p>none</p>"), ("u5", None), ("u6", '<div itemscope itemtype="http://schema.org/Person"><b itemprop="title">Dr</b></div>')]
    got = {r.url: (r.title, r.company, r.location, str(r.posted), r.description) for r in postings_in(spark.createDataFrame(pages, "url string, html string")).collect()}
    assert got == {"u1": ("Clerk II", "Acme", "Oslo", "2026-02-03", "one two"), "http://x/1": ("Cook", "Beta", "", "None", ""), "u3": ("First", "", "", "None", "")}


def test_fuzzy_lookup_against_all(spark):
    def key(x):
        x = "".join(c if c.isascii() and c.isalnum() else " " for c in x.lower().strip())
        return "".join(w for w in x.split() if w != "ltd")

    def ratio(a, b):
        r = SequenceMatcher(None, a, b).ratio()
        return min(r, 0.84) if min(len(a), len(b)) < 6 else r

    def score(asked, slug, name):
        a, s, n = key(asked), key(slug), key(name)
        if asked.lower() == slug.lower():
            return 1.0
        if asked.lower() == name.lower():
            return 0.99
        if a in (s, n):
            return 0.97
        return max(ratio(a, s), ratio(a, n), 0.85 if len(a) >= 4 and a in s else 0, 0.88 if len(a) >= 4 and a in n else 0)

    rows = [(f"s{k}", n) for k, n in duckdb.sql(f"select s_suppkey, s_name from '{SF}/supplier.parquet'").fetchall()]
    want = set()
    for asked in ("Supplier 12 Ltd", "supplier#0000007", "s3"):
        best = sorted(((-score(asked, s, n), s) for s, n in rows if score(asked, s, n) >= 0.55))[:8]
        want |= {(asked, s, round(-x, 9)) for x, s in best}
    assert {(r.asked, r.slug, round(r.score, 9)) for r in QUERIES["fuzzy_lookup"](spark, SF).collect()} == want


def test_plain_words_against_python(spark):
    import re

    want = {}
    for i, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall():
        x = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", t or "").casefold())
        w = re.findall(r"\w+", "".join(c for c in x if not unicodedata.combining(c)))
        want[i] = (len(w), len(set(w)))
    assert {r.doc_id: (r.n_words, r.n_distinct) for r in QUERIES["plain_words"](spark, SF).collect()} == want


def test_near_duplicates_against_greedy(spark):
    draw = random.Random(5)
    words = ["senior", "data", "analysts", "analyst", "clerk", "in", "oslo"]
    rows = [(f"{i:03d}", f"u{i}", draw.choice(["Acme Ltd", "acme", "Beta", ""]), " ".join(draw.sample(words, draw.randint(2, 4))), draw.choice(["Oslo, Norway", "Greater Oslo", "Rome"]), "x" * draw.randint(0, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "uid string, url string, company string, title string, location string, description string")

    def singular(t):
        return frozenset(w[:-1] if len(w) > 3 and w.endswith("s") else w for w in t.split())

    kept = []
    for r in sorted(rows, key=lambda r: (-len(r[5]), r[0], r[1])):
        company, city = r[2].lower().replace(" ltd", ""), "rome" if r[4] == "Rome" else "oslo"
        same = any(company and (company, city) == k[:2] and singular(r[3]) == singular(k[2]) and SequenceMatcher(None, k[2], r[3]).ratio() >= 0.9 for k in kept)
        if not same:
            kept.append((company, city, r[3], r[0]))
    assert sorted(r.uid for r in screening.merge_near(df).collect()) == sorted(k[3] for k in kept)
