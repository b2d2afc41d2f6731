"""Facts found by code, and postings in pages."""

import datetime as dt
import json

from pyspark.sql import functions as F

from veritab.functions import extract, stated
from veritab.functions import resolvers as R
from veritab.operators import postings
from veritab.sources.structured import postings_in


def values(spark, column, texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(column).collect()]


def readings(spark, texts, titles=None):
    rows = [(titles[i] if titles else "", t) for i, t in enumerate(texts)]
    return [r[0] for r in spark.createDataFrame(rows, "title string, body string").select(stated.read(F.col("title"), F.col("body"))).collect()]


def test_students_and_graduates(spark):
    texts = [
        "We grow. Open to current students only. Apply.", "This is not open to current students only.", "Currently pursuing a BSc. Recent graduates may apply.", None, "You are in your penultimate year.",
        "Currently pursuing or holding a degree.", "Recent graduates are not eligible.", "If you have already graduated with a degree, wait.", "Returning to full-time study in autumn",
    ]
    got = readings(spark, texts)
    assert [r.students for r in got] == ["Open to current students only.", None, "Currently pursuing a BSc.", None, "You are in your penultimate year.", None, None, None, "Returning to full-time study in autumn"]
    assert [r.graduates for r in got] == [None, None, "Recent graduates may apply.", None, None, None, None, None, None]
    df = spark.createDataFrame([(texts[0], None), (texts[2], True), (texts[2], None), (texts[5], True), ("x", None)], "body string, s boolean")
    student = R.resolve_student(F.col("s"), F.lit("q"), stated.read(F.lit(""), F.col("body")))
    assert [(r[0].value, r[0].quote) for r in df.select(student).collect()] == [(True, "Open to current students only."), (False, "Recent graduates may apply."), (None, "q"), (True, "q"), (None, "q")]
    long = "word " * 60 + "penultimate year"
    assert stated.sentence_in("students", long) == "penultimate year"


def test_bars(spark):
    hard = ["UK nationals only.", "Must be a British citizen.", "Candidates must hold active SC clearance.", "Saudi passport required", "You must be eligible to obtain DV", "Open to UAE and GCC nationals only", "Security clearance is required for this post.", "Nationality: Saudi", "Nous cherchons"]
    soft = [
        "No security clearance required", "UAE nationals are encouraged to apply", "SC clearance is desirable", "A UK national or have the right to work in the UK", "Process security clearance applications", "Security Vetting team", "Do you hold security clearance? (Yes/No)",
        "Our customers hold active SC clearance", "BPSS security clearance", "You may need to gain SC clearance depending on the role", "without regard to race or UK nationals only", "security clearance analyst", "Nationality: UAE / Any",
    ]
    got = readings(spark, hard + soft)
    kinds = [("n" if r.nationality else "") + ("c" if r.clearance else "") for r in got]
    assert kinds == ["n", "n", "c", "n", "c", "n", "c", "n", ""] + [""] * len(soft)
    assert got[0].nationality == "UK nationals only." and got[2].clearance == "Candidates must hold active SC clearance."
    run_on = "We are a large firm and " * 8 + "all staff must hold active SC clearance and " + "more words follow here " * 20
    quote = stated.bar_in("clearance", run_on)
    assert quote.startswith("hold active SC clearance") or quote.startswith("active SC clearance")
    assert len(quote) <= 120 and quote in run_on
    bars = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit("q").alias("quote")) for k in ("other", "work_auth", "other", "clearance", "other")])
    df = spark.createDataFrame([("UK nationals only.",)], "t string").select(R.resolve_bars(bars, stated.read(F.lit(""), F.col("t"))).alias("b"))
    assert [b.kind for b in df.first().b] == ["clearance", "other", "work_auth", "other", "nationality"]


def test_years_stated(spark):
    rows = {
        "You have 3-5 years of experience in audit.": (3, "You have 3-5 years of experience"), "Up to 2 years of experience. At least 4 years of experience needed.": (4, "At least 4 years of experience"), "5 years of experience preferred": None, "Our team has 10 years of experience": None,
        "Aged 18 years old": None, "0 years of experience": None, "20 years experience": None, "3 years of experience or a relevant degree": None, "Within the last 2 years as a clerk": None, "Must have 2+ yrs experience": (2, "2+ yrs experience"),
        "Experience (3+ years)": (3, "Experience (3+ years)"), "Seniority: 5+ years": (5, "Seniority: 5+ years"), "Years of experience: 3-5": (3, "Years of experience: 3-5"), "2 years and gives you hands-on experience": None, "2 year graduate programme, gaining experience": None,
        "Acme has 10 years of experience": None, "someone who has 5 years of experience": (5, "5 years of experience"), "mentored by an engineer with 8+ years of experience": None, "reports to the CFO and requires 5+ years of experience": (5, "5+ years of experience"),
        "Preferred qualifications:\n3+ years of experience": None, "3 years as an Associate leads to VP": None, "4+ years in a data role": (4, "4+ years in a data role"), "max. 2 years experience": None, "2 years of experience or less": None, "": None,
    }
    assert {t: stated.years_in(t) for t in rows} == rows
    assert [(r.years, r.years_quote or None) for r in readings(spark, list(rows))] == [x or (None, None) for x in rows.values()]
    assert [stated.range_in(q) for q in ("0-2 years", "a team of 2-5; 5 years", "Experience: Minimum 2-3", "7 - 5 years", "0.5-2 yrs", "")] == [(0, 2), None, (2, 3), None, (0, 2), None]
    assert [stated.no_least(n, q) for n, q in ((3, "up to 3 years"), (3, "not less than 3 years"), (27, "27 years old"), (27, "age limit of 27"), (3, "3 years"), (4, "3 years"))] == [True, False, True, True, False, False]
    body = "You will need 3+ years of experience."
    assert [stated.settled_years(v, q, "", body) for v, q in ((5, "3-5 years"), (2, "0-2 years"), (5, "5+ years overall, 2-3 years in Python"), (None, ""), (2, "up to 2 years"))] == [(3, "3-5 years"), (3, "3+ years of experience"), (5, "5+ years overall, 2-3 years in Python"), (3, "3+ years of experience"), (3, "3+ years of experience")]


def test_support(spark):
    rows = [("clearance", "SC required"), ("clearance", "sc required"), ("nationality", "all nationalities welcome regardless of origin"), ("nationality", "UK citizens"), ("other", "x"), ("other", "you must drive"), ("language", None)]
    df = spark.createDataFrame(rows, "k string, q string")
    assert [r[0] for r in df.select(R.bar_supported(F.col("k"), F.col("q"))).collect()] == [True, False, False, True, False, True, True]
    assert [stated.names_bar(k, q or "") for k, q in rows] == [True, False, False, True, False, True, True]
    df = spark.createDataFrame([(2027, "graduating 2027"), (2027, "in 12027, graduate"), (2027, "room 2027"), (2027, "2027 Graduate Programme"), (None, "")], "y int, q string")
    assert [r[0] for r in df.select(R.graduation_supported(F.col("y"), F.col("q"))).collect()] == [True, False, False, False, True]


def test_levels_fields_and_programmes(spark):
    titles = {"Senior Analyst Internship": "graduate_entry", "Jr Staff Engineer": "junior", "Senior Director of Data": "lead_principal", "Lead Generation Executive": None, "Lead Cloud Data Engineer": "lead_principal", "Tech Lead - Payments": "lead_principal", "Staff Accountant": None, "Mid-Senior clerk": "senior", "Mid-level clerk": "mid", "Internal Auditor": None}
    assert values(spark, extract.first_row(F.col("t"), extract.LEVELS), list(titles)) == list(titles.values())
    fields = {"ML Engineer, Data Platform": "ai_llm", "Software Engineer, Data Platform": "data_engineering", "Data Science Consultant": "data_science", "Quantitative Developer, Backend": "quant", "DevOps Consultant": "software", "Finance Project Analyst": "finance", "Marketing Analyst": None}
    assert values(spark, extract.first_row(F.col("t"), extract.FIELDS), list(fields)) == list(fields.values())
    programmes = {"Summer Internship": True, "Placement Officer": False, "Graduate Data Science Programme": True, "International Sales": False, "Off-cycle Analyst": True, "Trainee Accountant": False}
    assert values(spark, extract.is_programme(F.col("t")), list(programmes)) == list(programmes.values())


def test_total_due(spark):
    df = spark.createDataFrame([(90.0, "Subtotal 90", "Subtotal 90. Amount now due: £1,100.50"), (90.0, "Total 90", "Amount due £100"), (90.0, "VAT 90", "Amount due 30 days from"), (None, "", "Total due £5")], "v double, q string, t string")
    got = df.select(extract.total_not_subtotal(F.struct(F.col("v").alias("value"), F.col("q").alias("quote")), [F.lit(None).cast("string"), F.col("t")]).alias("f")).collect()
    assert [(r.f.value, r.f.quote) for r in got] == [(1100.5, "Amount now due: £1,100.50"), (90.0, "Total 90"), (90.0, "VAT 90"), (None, "")]


def test_plain_words(spark):
    assert values(spark, R.plain_words(F.col("t")), ["Société ﬁne ＡB", None]) == [["societe", "fine", "ab"], []]
    assert values(spark, extract.graduation_year(F.col("t")), ["Graduating in summer 2027.", "Founded 2019. We hire graduates", None]) == [2027, None, None]


def test_verdict_order(spark):
    limits = postings.Limits(levels=("junior",), max_years=2, nationalities=("French",))
    rows = [(90, "senior", 5, "clearance", "q"), (90, "junior", 1, "nationality", "French citizens only"), (90, "senior", 1, "work_auth", "q"), (90, None, 3, "language", "q"), (50, None, None, "work_auth", ""), (10, None, None, "work_auth", "")]
    df = spark.createDataFrame(rows, "fit_score int, level string, years_required int, k string, q string").withColumn("bars", F.array(F.struct(F.col("k").alias("kind"), F.col("q").alias("quote"))))
    got = [(r.verdict, r.rule, r.score) for r in postings.verdict(df, limits).collect()]
    assert got == [("blocked", "hard_bar", 20), ("apply", None, 90), ("skip", "level", 54), ("skip", "hard_bar", 54), ("consider", None, 50), ("skip", None, 10)]


def test_places_and_dates_of_markup(spark):
    node = lambda place, day: json.dumps({"@type": "JobPosting", "title": "Clerk", "jobLocation": place, "datePosted": day})
    rows = [({"address": {"streetAddress": "SA"}}, "Wed Aug 05 00:00:00 UTC 2026"), ({"address": {"addressLocality": "Oslo", "addressCountry": "NO"}}, "2026-08-05"), ({"name": "Head office"}, "soon")]
    df = spark.createDataFrame([(f"u{i}", f'<script type="application/ld+json">{node(*x)}</script>') for i, x in enumerate(rows)], "url string, html string")
    got = {r.url: (r.location, r.posted) for r in postings_in(df).collect()}
    assert got == {"u0": ("Saudi Arabia", dt.date(2026, 8, 5)), "u1": ("Oslo, NO", dt.date(2026, 8, 5)), "u2": ("Head office", None)}


def test_json_ld(spark):
    node = {"@graph": [{"@type": "Thing"}, {"@type": ["http://schema.org/JobPosting"], "title": " Clerk ", "hiringOrganization": {"name": "Acme"}, "jobLocation": [{"address": {"addressLocality": "Oslo", "addressCountry": {"name": "NO"}}}], "description": "&lt;p&gt;one&lt;br&gt;two", "datePosted": "2026-02-03T00:00"}]}
    page = lambda x: f'<html><script type="application/ld+json">{x}</script></html>'
    df = spark.createDataFrame([("u1", page(json.dumps(node))), ("u2", page("{broken")), ("u3", "<p>none</p>"), ("u4", None)], "url string, html string")
    got = postings_in(df).collect()
    assert [(r.url, r.title, r.company, r.location, r.description, r.posted) for r in got] == [("u1", "Clerk", "Acme", "Oslo, NO", "one two", dt.date(2026, 2, 3))]
