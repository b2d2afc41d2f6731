"""Registered queries of stated facts, model calls, sources and state between runs, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import extract, prompts, resolvers, stated
from ..functions import text as X
from ..operators import evaluation, finish, grading, judging, ranking, usage
from ..operators.rules import FactType, Rule, RuleSet
from ..sources import directory, fetching, paging, readers
from ..streaming import state
from .queries import _HALF, query, table

# Facts that postings state. Each order stands for a posting whose text is one of a list of real wordings.

YEARS = (
    ("You have 3-5 years of experience in audit.", 3), ("Up to 2 years of experience.", None), ("5 years of experience preferred.", None), ("Our team has 10 years of experience.", None), ("Years of experience: 3-5.", 3),
    ("Must have 2+ yrs experience.", 2), ("3 years of experience or a relevant degree.", None), ("Acme has 10 years of experience.", None), ("Reports to the CFO and requires 5+ years of experience.", 5), ("Seniority: 7+ years.", 7), ("20 years experience.", None),
    ("2 year graduate programme, gaining experience.", None), ("Experience (4+ years) is key.", 4),
)
ELIGIBLE = (
    ("Open to current students only.", True), ("Currently pursuing a BSc. Recent graduates may apply.", False), ("You are in your penultimate year.", True), ("Currently pursuing or holding a degree.", None), ("We like cats.", None),
    ("Recent graduates are not eligible.", None), ("Returning to full-time study in autumn.", True),
)
BARRED = (
    ("UK nationals only.", "nationality"), ("SC clearance is desirable.", None), ("Candidates must hold active SC clearance.", "clearance"), ("No security clearance required.", None), ("Must be a British citizen.", "nationality"),
    ("UAE nationals are encouraged to apply.", None), ("Process security clearance applications.", None), ("Security clearance is required for this post.", "clearance"), ("A UK national or have the right to work in the UK.", None),
)


def _nth(pairs, i: int, n):
    """The i-th part of the pair that a number picks."""
    return F.get(F.array(*[F.lit(p[i]) for p in pairs]), F.pmod(n, F.lit(len(pairs))).cast("int"))


def _case_sql(pairs, key: str) -> str:
    said = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"
    return f"CASE {key} % {len(pairs)} " + " ".join(f"WHEN {i} THEN {said(v)}" for i, (_, v) in enumerate(pairs)) + " END"


@query(f"SELECT o_orderkey, CAST({_case_sql(YEARS, 'o_orderkey')} AS BIGINT) AS years, CAST({_case_sql(ELIGIBLE, 'o_orderkey')} AS BOOLEAN) AS student_only, {_case_sql(BARRED, 'o_orderkey')} AS bar FROM orders")
def stated_facts(spark, sf_dir):
    """Years, eligibility and bars of postings, by what they say; an answer that said students only is taken back or kept."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    df = o.select("o_orderkey", F.concat_ws("\n", *[_nth(p, 0, n) for p in (YEARS, ELIGIBLE, BARRED)]).alias("body"), F.when(_nth(ELIGIBLE, 1, n) == F.lit(False), F.lit(True)).alias("said"))
    df = df.withColumn("read", stated.read(F.lit(""), F.col("body")))
    student = resolvers.resolve_student(F.col("said"), F.lit(""), F.col("read"))
    return df.select("o_orderkey", F.col("read.years").alias("years"), student["value"].alias("student_only"), F.get(resolvers.bars_stated(F.col("read")), F.lit(0))["kind"].alias("bar"))


TITLES = (("Senior Analyst Internship", "graduate_entry"), ("Jr Staff Engineer", "junior"), ("Senior Director of Data", "lead_principal"), ("Lead Generation Executive", None), ("Lead Cloud Data Engineer", "lead_principal"), ("Staff Accountant", None), ("Mid-level clerk", "mid"), ("Sr clerk", "senior"))
WORK = (("ML Engineer, Data Platform", "ai_llm"), ("Software Engineer, Data Platform", "data_engineering"), ("Data Science Consultant", "data_science"), ("Quantitative Developer, Backend", "quant"), ("DevOps Consultant", "software"), ("Marketing Analyst", None), ("Finance Project Analyst", "finance"), ("Product Manager", "product"), ("BI Developer", "analytics_bi"))
PROGRAMMES = (("Summer Internship", True), ("Placement Officer", False), ("Graduate Data Science Programme", True), ("International Sales", False), ("Off-cycle Analyst", True))


@query(f"SELECT o_orderkey, {_case_sql(TITLES, 'o_orderkey')} AS level, {_case_sql(WORK, 'o_orderkey')} AS field, {_case_sql(PROGRAMMES, 'o_orderkey')} AS programme FROM orders")
def level_and_field(spark, sf_dir):
    """Levels, fields and yearly programmes by the library's own tables of phrases."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select("o_orderkey", extract.first_row(_nth(TITLES, 0, n), extract.LEVELS).alias("level"), extract.first_row(_nth(WORK, 0, n), extract.FIELDS).alias("field"), extract.is_programme(_nth(PROGRAMMES, 0, n)).alias("programme"))


QUOTED = (("up to 4 years of experience", None), ("3-4 years", 3), ("0-4 years", None), ("4 years", 4), ("5+ years overall, 2-3 years in Python, 4", 4), ("Experience: Minimum 2-4", 2), ("not less than 4 years", 4), ("4 years old", None))


@query(f"SELECT o_orderkey, CAST({_case_sql(QUOTED, 'o_orderkey')} AS INTEGER) AS years_required, o_orderkey % 3 = 0 AS changed_field FROM orders")
def finished_facts(spark, sf_dir):
    """An answer of 4 years settled by its own quote, and an answer of `other` in a title that is analytic."""
    o, n, nothing = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.lit(None).cast("string")
    facts = o.select(
        "o_orderkey", F.when(n % 3 == 0, "Insights clerk").otherwise("Clerk").alias("title"), F.lit("").alias("description"), F.lit(4).alias("years_required"), _nth(QUOTED, 0, n).alias("years_quote"), F.lit(None).cast(resolvers.BARS).alias("bars"),
        F.lit(None).cast("boolean").alias("student_only"), nothing.alias("level"), nothing.alias("level_quote"), F.lit("other").alias("field"), F.lit("two words").alias("field_quote"),
    )
    return finish.finish(facts).select("o_orderkey", "years_required", F.array_contains("changed", "field").alias("changed_field"))


@query("""SELECT count(*) AS postings, CAST(0 AS BIGINT) AS quotes, CAST(0 AS BIGINT) AS years_set, count(*) FILTER (o_orderkey % 2 = 0) AS years_cleared, count(*) FILTER (o_orderkey % 5 = 0) AS bars, count(*) FILTER (o_orderkey % 3 = 0) AS student, count(*) AS level, CAST(0 AS BIGINT) AS field FROM orders""")
def finish_counts(spark, sf_dir):
    """What each step of the corrections changed."""
    o, n, nothing = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.lit(None).cast("string")
    text = F.concat(F.when(n % 5 == 0, "UK nationals only. ").otherwise(""), F.when(n % 3 == 0, "Open to current students only.").otherwise("None."))
    facts = o.select("o_orderkey", F.lit("Trainee").alias("title"), text.alias("description"), F.when(n % 2 == 0, 2).alias("years_required"), F.when(n % 2 == 0, "0-2 years").alias("years_quote"), F.lit(None).cast(resolvers.BARS).alias("bars"), F.lit(None).cast("boolean").alias("student_only"), nothing.alias("level"), nothing.alias("level_quote"), nothing.alias("field"), nothing.alias("field_quote"))
    return finish.changes(finish.finish(facts))


BAR_QUOTES = (("nationality", "UK citizens", True), ("nationality", "national origin counts for nothing", False), ("clearance", "MSc required", False), ("clearance", "SC required", True), ("other", "you must drive", True), ("other", "Benefits include a car", False), ("clearance", "cleared regardless of age", False), ("language", "x", True))


@query(f"""SELECT o_orderkey, {_case_sql([(q, ok) for _, q, ok in BAR_QUOTES], 'o_orderkey')} AND o_orderkey % 7 <> 0 AS kept, o_orderkey % 4 IN (0, 1) AND o_orderkey % 7 <> 0 AS year_kept, o_orderkey % 7 = 0 OR NOT {_case_sql([(q, ok) for _, q, ok in BAR_QUOTES], 'o_orderkey')} OR o_orderkey % 4 IN (2, 3) AS quotes_rejected FROM orders""")
def checked_facts(spark, sf_dir):
    """The quote check of postings' facts: bars must name their kind, years of graduation must be ones; of each seventh posting the text says nothing of it."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    kinds, quotes = [(k, q) for k, q, _ in BAR_QUOTES], [(q, ok) for _, q, ok in BAR_QUOTES]
    years = (("graduating in 2027", 1), ("Class of 2027", 1), ("2027 Graduate Programme", 0), ("room 2027", 0))
    body = F.when(n % 7 != 0, F.concat_ws(". ", _nth(quotes, 0, n), _nth(years, 0, n))).otherwise("")
    bars = F.array(F.struct(_nth(kinds, 0, n).alias("kind"), _nth(quotes, 0, n).alias("quote")))
    done = finish.check(o.select("o_orderkey", F.lit("Clerk").alias("title"), body.alias("description"), F.lit(2027).alias("graduation_year"), _nth(years, 0, n).alias("graduation_quote"), bars.alias("bars")))
    return done.select("o_orderkey", (F.size("bars") > 0).alias("kept"), F.col("graduation_year").isNotNull().alias("year_kept"), "quotes_rejected")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice, 2) ELSE 1.0 END AS amount FROM orders")
def total_not_subtotal(spark, sf_dir):
    """An amount read from a subtotal gives way to the item's total due."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = F.concat(F.lit("Subtotal 1. Amount now due: £"), F.format_number("o_totalprice", 2))
    fact = F.struct(F.lit(1.0).alias("value"), F.when(n % 2 == 0, "Subtotal 1").otherwise("one 1").alias("quote"))
    return o.select("o_orderkey", extract.total_not_subtotal(fact, [text])["value"].alias("amount"))


# Text.


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(o_orderdate AS DATE) END AS posted, CASE o_orderkey % 4 WHEN 0 THEN 'Saudi Arabia' WHEN 1 THEN 'Norway' WHEN 2 THEN 'XX' ELSE 'Oslo' END AS place, lower('Clerk' || chr(10) || o_orderpriority) AS blob, o_orderstatus <> 'P' AS identified,
  CASE WHEN o_orderkey % 2 = 0 THEN 'GET /x?key=<redacted>&n=' || o_orderkey ELSE 'GET /' || o_orderkey END AS line FROM orders""")
def posting_texts(spark, sf_dir):
    """Dates in two forms, countries of bare codes, the text that substring tests read, identity, and log lines without secrets."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    java = F.date_format("o_orderdate", "EEE MMM dd HH:mm:ss 'UTC' yyyy")
    raw = F.when(n % 3 == 0, java).when(n % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).otherwise("soon")
    code = _nth((("SA", 0), ("no", 0), ("XX", 0), ("Oslo", 0)), 0, n)
    line = F.when(n % 2 == 0, F.concat(F.lit("GET /x?key=s3cr%2Ft-token&n="), n.cast("string"))).otherwise(F.concat(F.lit("GET /"), n.cast("string")))
    return o.select("o_orderkey", X.java_date(raw).alias("posted"), X.country_name(code).alias("place"), X.blob(F.lit("Clerk"), F.col("o_orderpriority")).alias("blob"), X.identified(F.lit("Clerk"), F.when(F.col("o_orderstatus") != "P", "u")).alias("identified"), X.redacted(line, ["s3cr/t-token", "short"]).alias("line"))


SIGNED = (("-12.5 and 1,200", (-12.5, 1200.0)), ("€ 2.5m", (2.5, 2500000.0)), ("- £40k", (-40.0, -40000.0)), ("12 500 units", (12500.0, 12.0, 500.0)), ("2-5 staff", (2.0, 5.0)), ("1.2 million", (1.2, 1200000.0)), ("no number", ()))


@query(f"SELECT o_orderkey, CAST(CASE o_orderkey % {len(SIGNED)} " + " ".join(f"WHEN {i} THEN {sum(v)!r}" for i, (_, v) in enumerate(SIGNED)) + f" END AS DOUBLE) AS total, CASE o_orderkey % {len(SIGNED)} " + " ".join(f"WHEN {i} THEN {len(v)}" for i, (_, v) in enumerate(SIGNED)) + " END AS n FROM orders")
def numbers_with_signs(spark, sf_dir):
    """Numbers as texts write them: signs, groups, decimals and scale words."""
    o = table(spark, sf_dir, "orders").withColumn("l", X.numbers_in(_nth(SIGNED, 0, F.col("o_orderkey"))))
    return o.select("o_orderkey", F.aggregate("l", F.lit(0.0), lambda a, b: a + b).alias("total"), F.size("l").alias("n"))


@query("""SELECT o_orderkey, o_orderkey % 5 <> 1 AND NOT (o_orderkey % 5 = 2 AND round(o_totalprice, 2) <> round(o_totalprice)) AS kept FROM orders""")
def number_in_quote_check(spark, sf_dir):
    """A value against quotes that state it: grouped, of another sign, rounded off, in thousands, and plain."""
    o, n, v = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.round("o_totalprice", 2)
    plain = F.format_string("%.2f", v)
    quote = F.when(n % 5 == 0, F.concat(F.lit("due £"), F.format_number(v, 2))).when(n % 5 == 1, F.concat(F.lit("minus -"), plain)).when(n % 5 == 2, F.format_string("about %d", F.round(v).cast("long"))).when(n % 5 == 3, F.concat(F.format_string("%.5f", v / 1000), F.lit("k"))).otherwise(F.concat(plain, F.lit(" in all")))
    return o.select("o_orderkey", X.number_in(v, quote).alias("kept"))


@query("""SELECT o_orderkey, o_orderkey % 3 = 2 OR (o_orderkey % 3 = 0) AS agrees FROM orders""")
def year_in_quote(spark, sf_dir):
    """A date against quotes with its year, with the next year beside a longer number, and without one."""
    o, n, day = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    year = F.year(day)
    quote = F.when(n % 3 == 0, F.concat(F.lit("due 3 May "), year.cast("string"))).when(n % 3 == 1, F.concat(F.lit("by "), (year + 1).cast("string"), F.lit(", ref 1"), year.cast("string"))).otherwise("due in May")
    return o.select("o_orderkey", X.year_agrees(day, quote).alias("agrees"))


# Model calls.


def _answer(system: str, asked: list[str]) -> list:
    """A backend without a model: it repeats what it is asked, and fails for some."""
    out: list = []
    for p in asked:
        n = int(p.rsplit(" ", 1)[1])
        out.append(None if n % 11 == 0 else ValueError("down") if n % 7 == 0 else "[1]" if n % 5 == 0 else f'{{"n": {n}}}')
    return out


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 4 = 0 AS cached, CASE WHEN o_orderkey % 4 = 0 THEN 'answered' WHEN r > 6000 OR o_orderkey % 11 = 0 THEN 'deferred' WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN 'error' ELSE 'answered' END AS state,
  CASE WHEN o_orderkey % 4 = 0 THEN 'kept' WHEN r > 6000 OR o_orderkey % 11 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN NULL ELSE '{"n": ' || o_orderkey || '}' END AS raw
  FROM (SELECT *, sum(CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END) OVER (ORDER BY o_orderkey) AS r FROM orders)""")
def judged_with_cache(spark, sf_dir):
    """Kept answers cost no call; of the rest the first 6000 are asked, and what fails is an error of its row."""
    o = table(spark, sf_dir, "orders")
    asked = o.select(F.col("o_orderkey").cast("string").alias("id"), "o_orderkey", F.concat(F.lit("k"), "o_orderkey").alias("answer_key"), prompts.posting_prompt(F.lit("t"), F.lit("c"), F.lit("l"), F.concat(F.lit("order "), "o_orderkey"), 50).alias("prompt"))
    cache = o.filter("o_orderkey % 4 = 0").select(F.concat(F.lit("k"), "o_orderkey").alias("answer_key"), F.lit("kept").alias("raw"))
    return judging.judge(asked, cache, _answer, "", 6000, [F.col("o_orderkey")]).select("id", "cached", "state", "raw")


def _improve(row: dict) -> dict:
    if row["c_custkey"] % 3 == 0:
        raise ValueError("no answer")
    return {"reason": f"good: {row['reason']}"}


@query("""SELECT c_custkey, CASE WHEN r <= 200 AND c_custkey % 3 <> 0 THEN 'good: ' || c_mktsegment ELSE c_mktsegment END AS reason FROM (SELECT *, CASE WHEN c_acctbal > 0 THEN row_number() OVER (PARTITION BY c_acctbal > 0 ORDER BY c_custkey) END AS r FROM customer)""")
def enriched_reasons(spark, sf_dir):
    """The first 200 eligible rows are enriched; one whose enricher fails keeps its reason."""
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "reason")
    return judging.enrich(c, _improve, F.col("c_acctbal") > 0, "reason", 200, [F.col("c_custkey")], "c_custkey").select("c_custkey", "reason")


_BATCH_STATE = "CASE WHEN o_orderkey % 9 = 0 THEN 'error' WHEN o_orderkey % 4 = 1 THEN 'deferred' WHEN o_orderkey % 4 = 2 THEN 'error' WHEN o_orderkey % 5 = 0 THEN 'error' ELSE 'answered' END"


def _batched(spark, sf_dir):
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    sent = o.select(n.cast("string").alias("request"), "o_orderkey")
    kind = _nth((("succeeded", 0), ("expired", 0), ("errored", 0), ("succeeded", 0)), 0, n)
    results = o.filter("o_orderkey % 9 <> 0").select(n.cast("string").alias("request"), kind.alias("type"), F.when(n % 5 == 0, "max_tokens").otherwise("end_turn").alias("stop"), F.lit('{"a": 1}').alias("text"), F.when(n % 4 == 2, "overloaded").alias("detail"), (n % 100).alias("input_tokens"))
    stray = results.limit(0).unionByName(spark.createDataFrame([("stray", "succeeded", "end_turn", "{}", None, 1)], results.schema))
    return sent, results.unionByName(stray)


@query(f"SELECT o_orderkey, {_BATCH_STATE} AS state FROM orders")
def batch_correlation(spark, sf_dir):
    """Results of a batch by request: answered, failed, cut short, expired, or missing."""
    sent, results = _batched(spark, sf_dir)
    return usage.batch_answers(sent, results).select("o_orderkey", "state")


@query(f"SELECT count(*) FILTER (s = 'answered') AS answered, count(*) FILTER (s = 'error') AS failed, CAST(sum(o_orderkey % 100) AS BIGINT) AS input_tokens, CAST(0 AS BIGINT) AS cache_read, CAST(0 AS BIGINT) AS cache_write, CAST(sum(o_orderkey % 7) AS BIGINT) AS output_tokens FROM (SELECT *, {_BATCH_STATE} AS s FROM orders)")
def batch_token_sums(spark, sf_dir):
    sent, results = _batched(spark, sf_dir)
    n, none = F.col("o_orderkey"), F.lit(None).cast("long")
    return usage.token_sums(usage.batch_answers(sent, results).withColumns({"input_tokens": n % 100, "cache_read": none, "cache_write": none, "output_tokens": n % 7}))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'breaker' WHEN event_id % 100 >= 90 THEN 'ceiling' WHEN value >= 90 THEN 'time' END AS stop,
  CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'scoring did not run: no key' WHEN event_type = 'error' THEN 'scoring stopped after failures in a row' WHEN event_id % 10 * 100 > (10 + event_id % 10) * 20 AND event_type <> 'signup' THEN 'scoring failed for ' || event_id % 10 || ' of ' || (10 + event_id % 10)
  WHEN event_type = 'signup' AND event_id % 10 > 0 THEN 'scoring failed for ' || event_id % 10 || ' of ' || event_id % 10 ELSE '' END AS failure FROM events""")
def stop_reasons(spark, sf_dir):
    """Why no further call may start, and why a run's scoring failed as a whole."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    bare = F.col("event_type") == "signup"
    scored = F.when(bare, 0).otherwise(15)
    failure = usage.run_failure(scored, F.when(bare, 0).otherwise(5), (n % 10).cast("int"), F.col("event_type") == "error", F.when(n % 2 == 0, "no key").otherwise(""))
    return e.select("event_id", usage.stop_reason(F.col("event_type") == "error", n % 100, 90, F.col("value") * 60, 90).alias("stop"), failure.alias("failure"))


@query("""SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 500 < 1200 // 8 THEN 'cut' WHEN event_id % 500 + 100 >= 0.97 * CASE WHEN event_id % 2 = 0 THEN 400 ELSE 600 END THEN 'full' END AS why, CASE WHEN event_id % 2 = 0 THEN 400 END AS own_window,
  CASE WHEN event_id % 5 = 0 THEN 1.0 WHEN event_id % 5 = 1 THEN 30.0 WHEN event_id % 5 = 2 THEN 2.0 END AS wait FROM events""")
def prompt_windows(spark, sf_dir):
    """Prompts that a model cut, the window that it says it has, and waits before another try."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    info = F.create_map(F.lit("general.architecture"), F.lit("x"), F.when(n % 2 == 0, "x.context_length").otherwise("x.length"), F.lit("400"))
    own = usage.model_window(info)
    why = usage.prompt_cut(F.when(n % 13 != 0, n % 500), F.lit(100), F.lit(1200), F.lit(600), own)
    status = _nth(((503, 0), (429, 0), (500, 0), (404, 0), (503, 0)), 0, n)
    wait = usage.retry_after(status, F.when(n % 5 == 2, 2).when(n % 5 == 4, 3).otherwise(1), F.when(n % 5 == 1, "90"))
    return e.select("event_id", why.alias("why"), own.cast("int").alias("own_window"), wait.alias("wait"))


# Sources.


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 5.0 WHEN 1 THEN 2.5 WHEN 2 THEN 30.0 ELSE 0.0 END AS delay, CASE WHEN n_nationkey % 6 = 5 THEN 'FAIL' WHEN n_nationkey % 6 = 4 THEN 'EMPTY' WHEN n_nationkey % 6 = 3 THEN 'UNKNOWN' WHEN n_nationkey % 6 = 2 THEN 'UNKNOWN' ELSE 'OK' END AS probe,
  n_nationkey % 3 <> 0 AS ages, CASE WHEN n_nationkey % 3 = 1 THEN 'm' || n_nationkey END AS since FROM nation""")
def sources_by_kind(spark, sf_dir):
    """What robots.txt asks of the reader, what a look at a site says, and attributes and marks by kind of source."""
    t, n = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    robots = _nth((("User-agent: *\nCrawl-delay: 9\n\nUser-agent: Reader # us\nUser-agent: other\nCrawl-delay: 5", 0), ("user-agent: *\ncrawl-delay: 2.5\nDisallow: /x", 0), ("User-agent: *\nCrawl-delay: 600", 0), ("User-agent: other\nCrawl-delay: 7", 0)), 0, n)
    k = n % 6
    probe = fetching.probe_structured(F.when(k == 5, "404"), F.when(k == 4, 0).otherwise(9), F.when(k == 3, 0).otherwise(2), k != 2)
    # Of the three kinds the first's dates are taken not to tell age here, the second is read from a mark on.
    kinds = F.when(n % 3 == 1, "structured").otherwise("reed")
    df = t.select("n_nationkey", fetching.crawl_delay(robots, "reader").alias("wait"), probe.alias("probe"), kinds.alias("kind"), n.cast("string").alias("source_key"))
    marks = t.select(n.cast("string").alias("source_key"), F.concat(F.lit("m"), n).alias("since"))
    df = fetching.with_marks(fetching.with_kind(df), marks)
    return df.select("n_nationkey", F.col("wait").alias("delay"), "probe", (F.col("ages") & (n % 3 != 0)).alias("ages"), "since")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS raw_id, 'Clerk ' || s_suppkey AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'Oslo, NATION_' || s_nationkey ELSE 'Rome' END AS location, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE '' END AS company, DATE '2026-02-03' AS posted, s_suppkey % 5 = 0 AS remote FROM supplier""")
def search_payloads(spark, sf_dir):
    """Postings of a search service whose place is structured, or a plain list."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    place = F.struct(F.lit("Oslo").alias("city"), F.concat(F.lit("NATION_"), "s_nationkey").alias("countryName"))
    row = F.struct(k.cast("string").alias("id"), F.concat(F.lit("Clerk "), k).alias("title"), F.lit("http://x/1").alias("url"), F.when(k % 2 == 0, place).alias("location"), F.array(F.lit("Rome")).alias("locations"), F.struct(F.when(k % 3 == 0, F.col("s_name")).alias("title")).alias("company"), F.when(k % 5 == 0, "remote").alias("workplace"), F.lit("2026-02-03T10:00").alias("created"))
    payloads = s.select(F.to_json(F.struct(F.array(row).alias("jobs"))).alias("payload"))
    return readers.postings(payloads, "workable_search").select("raw_id", "title", "location", "company", "posted", "remote")


def _source(spark, entry, mark):
    """A source of the queries: postings from suppliers of a nation; it fails for one slug and leaves itself out for another."""
    if entry.slug == "down":
        raise OSError("no route")
    if entry.slug == "keyless":
        raise fetching.Skipped("no key")
    s = spark.read.parquet(f"{entry.options['dir']}/supplier.parquet").filter(F.col("s_nationkey") == int(entry.slug))
    text = lambda c: F.lit(c).cast("string")
    return s.select(text("q").alias("source"), F.col("s_name").alias("company"), F.col("s_name").alias("title"), text("").alias("location"), F.col("s_name").alias("url"), text("").alias("description"), F.lit(None).cast("date").alias("posted"), F.lit(False).alias("remote"), F.col("s_suppkey").cast("string").alias("raw_id"))


fetching.SOURCES["suppliers"] = _source


@query("""SELECT 'suppliers:' || n || ':' AS source_key, (SELECT count(*) FROM supplier WHERE s_nationkey = n) AS n, CASE WHEN (SELECT count(*) FROM supplier WHERE s_nationkey = n) = 0 THEN 'EMPTY' ELSE 'OK' END AS status FROM (VALUES (1), (2), (3), (99)) v(n) UNION ALL VALUES ('suppliers:down:', 0, 'FAIL'), ('suppliers:keyless:', 0, 'FAIL')""")
def fetched_sources(spark, sf_dir):
    """Every enabled source is read; one that fails, or has nothing, gives a report."""
    config = [{"kind": "suppliers", "slug": x, "dir": sf_dir} for x in (1, 2, 3, 99, "down", "keyless")] + [{"kind": "suppliers", "slug": "off", "enabled": False}]
    reports, rows = fetching.fetch_all(spark, config)
    return paging.source_reports(reports.select("source_key", "error", F.lit(False).alias("skipped")), rows).select("source_key", "n", "status")


# State.


@query(f"""SELECT user_id AS uid, CAST(max(floor(date_diff('second', l, TIMESTAMP '2024-03-01') / 86400)) AS INTEGER) AS days_away FROM (SELECT user_id, max(ts) AS l FROM events WHERE ts < {_HALF} GROUP BY 1) JOIN (SELECT DISTINCT user_id FROM events WHERE ts >= {_HALF} AND event_type = 'signup') USING (user_id) WHERE l < TIMESTAMP '2024-03-01' - INTERVAL 47 DAY GROUP BY 1""")
def programmes_away(spark, sf_dir):
    """Yearly programmes that were off the board for longer than a gap."""
    e, cut = table(spark, sf_dir, "events"), F.lit("2024-01-16").cast("timestamp")
    seen = e.filter(F.col("ts") < cut).groupBy(F.col("user_id").alias("uid")).agg(F.max("ts").alias("last_seen"))
    scanned = e.filter(F.col("ts") >= cut).select(F.col("user_id").alias("uid"), F.when(F.col("event_type") == "signup", "Summer Internship").otherwise("Internal Auditor").alias("title"))
    return state.days_off(scanned, seen, F.lit("2024-03-01").cast("timestamp"), 47)


@query("""SELECT 'labels' AS "table", count(*) FILTER (toxic = 1) AS removed FROM labels UNION ALL SELECT 'documents', count(*) FILTER (n_chars < 500) FROM documents""")
def prune_counts(spark, sf_dir):
    """Rows that a trim removed, by table."""
    tables = {n: table(spark, sf_dir, n) for n in ("labels", "documents")}
    return state.prune_report(tables, {"labels": tables["labels"].filter("toxic = 0"), "documents": tables["documents"].filter("n_chars >= 500")})


@query("""SELECT c_custkey AS url, 'saved' AS state, CASE WHEN c_custkey % 3 = 0 THEN 'own' WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS company, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS title FROM customer""")
def marked_pages(spark, sf_dir):
    """Marks with the names of the pages kept for them."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    marks = c.select(k.alias("url"), F.lit("saved").alias("state"), F.when(k % 3 == 0, "own").otherwise("").alias("company"), F.lit(None).cast("string").alias("title"))
    pages = c.filter(k % 2 == 0).select(k.alias("url"), F.col("c_mktsegment").alias("company"), F.col("c_name").alias("title"))
    return state.with_known_names(marks, pages.unionByName(pages))


@query("SELECT user_id, CAST(ts AS DATE) AS ran, CAST(arg_max(event_id, event_id) AS BIGINT) AS n FROM events GROUP BY ALL")
def source_history(spark, sf_dir):
    """A history of counts by source and day; a day recorded again replaces its row."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("ran"), F.col("event_id").alias("n"))
    day = e.groupBy("user_id", "ran").agg(F.min("n").alias("first"), F.max("n").alias("last"))
    return state.appended(day.select("user_id", "ran", F.col("first").alias("n")), day.select("user_id", "ran", F.col("last").alias("n")), ["user_id", "ran"])


@query("""SELECT o_orderkey, o_orderstatus = 'F' OR o_totalprice > 100000 AS kept, CASE WHEN o_totalprice > 100000 THEN 2 WHEN o_orderstatus = 'F' THEN 1 END AS layout FROM orders""")
def migrated_rows(spark, sf_dir):
    """Rows brought from layout 0 to the newest, step by step."""
    steps = [lambda df: df.withColumn("layout", F.when(F.col("o_orderstatus") == "F", 1)), lambda df: df.withColumn("layout", F.when(F.col("o_totalprice") > 100000, 2).otherwise(F.col("layout")))]
    done = state.migrated(table(spark, sf_dir, "orders"), 0, steps)
    return done.select("o_orderkey", F.col("layout").isNotNull().alias("kept"), "layout")


@query(f"SELECT user_id AS uid, max(CAST(ts AS DATE)) AS last_seen, count(*) FILTER (ts >= {_HALF}) > 0 AS again FROM events GROUP BY 1")
def recorded_scan(spark, sf_dir):
    """A dry run's end: what would be seen, without a table or a report being written."""
    e, cut = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date")), F.lit("2024-01-16").cast("timestamp")
    by = lambda rows: rows.groupBy(F.col("user_id").alias("uid")).agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"))

    class Held(state.Table):
        def read(self):
            return by(e.filter(F.col("ts") < cut)).withColumn("again", F.lit(False))

    scan = by(e.filter(F.col("ts") >= cut)).withColumns({"again": F.lit(True), "reopened": F.lit(False)})
    seen = state.record_scan(Held(spark, "", ""), scan, scan, "", dry=True)["seen"]
    return seen.select("uid", "last_seen", "again")


# Boards and hidden rows.


@query("SELECT 'greenhouse' AS kind, count(*) AS n FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'lever', count(*) FROM supplier WHERE s_suppkey % 2 = 1")
def board_kinds(spark, sf_dir):
    """Boards of a directory by kind."""
    s = table(spark, sf_dir, "supplier")
    named = F.when(F.col("s_suppkey") % 2 == 0, "greenhouse.json").otherwise("lever.json")
    files = s.groupBy(named.alias("file")).agg(F.to_json(F.collect_list("s_name")).alias("payload"))
    return directory.index(files).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'hard_bar' WHEN o_orderstatus = 'F' THEN 'terms' WHEN o_orderkey % 100 < 50 AND o_orderkey % 100 + 20 >= 50 AND o_orderstatus = 'P' THEN 'blockers' WHEN o_orderkey % 100 < 50 AND o_orderkey % 100 >= 45 THEN 'gate' END AS hidden FROM orders")
def hidden_labels(spark, sf_dir):
    """The one group that a row which isn't shown is listed under."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    hits = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    verdict = F.when(F.col("o_orderpriority") == "5-LOW", "blocked").otherwise("apply")
    return o.select("o_orderkey", ranking.hidden_as(F.lit(None).cast("string"), verdict, hits, n % 100, F.when(F.col("o_orderstatus") == "P", 20).otherwise(0), 50, 5).alias("hidden"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate IS NULL OR o_orderdate >= DATE '1998-01-01' - 365 OR o_orderpriority = '5-LOW'")
def stale_filter(spark, sf_dir):
    """Postings that are fresh, or of a kind of source whose dates tell no age."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("posted"), F.when(F.col("o_orderpriority") == "5-LOW", "undated:x").otherwise("board:x").alias("source"))
    return paging.drop_stale(o, F.lit(dt.date(1998, 1, 1)), 365, ("undated",)).select("o_orderkey")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS id, '## flag' || chr(10) || l_returnflag || chr(10) || chr(10) || '## mode' || chr(10) || coalesce(CASE WHEN l_linenumber = 1 THEN NULL ELSE 'm' || l_linenumber END, '') AS prompt, CAST(l_linenumber AS VARCHAR) AS line FROM lineitem")
def multi_field_items(spark, sf_dir):
    """Items of several fields in order, and the prompt that they make."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"), F.when(F.col("l_linenumber") > 1, F.concat(F.lit("m"), "l_linenumber")).alias("mode"))
    made = readers.items(li, "l_orderkey", ["flag", "mode"], ["l_linenumber"])
    return made.select("id", F.array_join(F.transform("fields", lambda f: F.concat(F.lit("## "), f["name"], F.lit("\n"), f["text"])), "\n\n").alias("prompt"), F.col("meta")["l_linenumber"].alias("line"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 25 ELSE 0 END + CASE WHEN s_suppkey = 7 THEN 40 ELSE 0 END AS cost FROM supplier")
def agency_and_location(spark, sf_dir):
    """What a score loses for an agency's posting and for a place that doesn't fit."""
    from ..operators import screening

    profile = screening.Profile({}, agencies=("Supplier 000000007",), agency_penalty=40, locations=("oslo",), location_penalty=25)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("Clerk").alias("title"), F.lit("").alias("description"), F.col("s_name").alias("company"), F.when(F.col("s_suppkey") % 2 == 0, "Rome").otherwise("Greater Oslo").alias("location"), F.lit(False).alias("remote"))
    return screening.keyword_score(s, profile).select("s_suppkey", (-F.col("keyword_score")).alias("cost"))


@query("""SELECT p_partkey, lower(replace(p_brand, '#', ' ')) AS company, 'oslo' AS city, list_aggregate(list_sort(list_distinct(list_transform(string_split(p_name || ' gears', ' '), lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END))), 'string_agg', ' ') AS words FROM part""")
def dedup_keys(spark, sf_dir):
    """Keys of near-duplicates: companies without legal forms, cities, words of titles."""
    p = table(spark, sf_dir, "part")
    form = _nth(tuple((f" {f} | makers", 0) for f in ("Ltd.", "Corp", "Incorporated", "Co.", "Corporation", "GmbH", "")), 0, F.col("p_partkey"))
    return p.select("p_partkey", X.company_key(F.concat("p_brand", form)).alias("company"), X.city_key(F.lit("UK, Greater Oslo Area, Norway")).alias("city"), F.array_join(X.title_words(F.concat("p_name", F.lit(" gears"))), " ").alias("words"))


# Runs with limits, and graded cases.

_SPECS = {"n": {"type": "integer"}}
_RULES = RuleSet({"n": FactType("facts.n.value", "integer", quote="facts.n.quote")}, [Rule("even", {"n": {"in": list(range(0, 10, 2))}}, "yes")], "no")


@query("""WITH c AS (SELECT o_orderkey, o_orderkey >= 40 AND o_orderkey < 43 AS f FROM orders WHERE o_orderkey < 60)
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey >= 43 THEN 'deferred' WHEN o_orderkey >= 40 THEN 'error' ELSE 'decided' END AS status, CASE WHEN o_orderkey >= 60 THEN 'call ceiling' WHEN o_orderkey >= 43 THEN 'breaker' WHEN o_orderkey >= 40 THEN 'down' END AS reason FROM orders""")
def run_with_breaker(spark, sf_dir):
    """A run of 60 calls that three failures in a row stop."""
    from ..operators import runs

    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    items = o.select(n.cast("string").alias("id"), n.alias("ordinal"), F.concat(F.lit("n is "), n % 10).alias("body"))
    failed = n.between(40, 42)
    raw = F.to_json(F.struct(F.struct((n % 10).alias("value"), F.concat(F.lit("n is "), n % 10).alias("quote")).alias("n")))
    answers = o.select(n.cast("string").alias("id"), F.lit(1).alias("line"), F.when(~failed, raw).alias("raw"), F.when(failed, "down").alias("error"))
    return runs.run(items, answers, _SPECS, _RULES, dt.date(2026, 1, 1), ["body"], max_calls=60, breaker_after=3).select("id", "status", "reason")


@query("""SELECT count(*) FILTER ((doc_id % 3 = 0) <> (quality = 1)) AS n FROM labels""")
def unexpected_states(spark, sf_dir):
    """Cases whose state is not what their mark says."""
    t = table(spark, sf_dir, "labels")
    states = t.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "fail").otherwise("pass").alias("state"))
    cases = t.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "known").otherwise("").alias("open_defect"))
    return grading.unexpected(states, cases).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'pass' WHEN quality = 0 AND toxic = 0 THEN 'fail' ELSE 'flaky' END AS state FROM labels""")
def states_of_attempts(spark, sf_dir):
    """Each case's state over two attempts."""
    t = table(spark, sf_dir, "labels")
    one = t.select("doc_id", F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("outcome"))
    two = t.select("doc_id", F.when((F.col("quality") == 1) != (F.col("toxic") == 1), "pass").otherwise("fail").alias("outcome"))
    return evaluation.case_states(one.unionByName(two), "doc_id").select("doc_id", "state")


# Small parts of reports and postings.


@query("""SELECT o_orderkey, o_orderkey % 4 IN (1, 2, 3) AS remote, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS modified, 'Blocked: says "' || CASE WHEN length(o_orderpriority) <= 8 THEN o_orderpriority ELSE rtrim(left(o_orderpriority, 7)) || '…' END || '"' AS reason, ['b', 'a'] AS terms FROM orders""")
def posting_parts(spark, sf_dir):
    """Places that mean anywhere, dates of sitemaps, reasons that end in a cut quote, and terms in their first order."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    place = _nth((("Oslo", 0), ("Remote, UK", 0), ("Work from home", 0), ("Anywhere", 0)), 0, n)
    raw = F.when(n % 3 == 0, F.date_format("o_orderdate", " yyyy-MM-dd'T'HH:mm")).when(n % 3 == 1, F.lit("soon"))
    return o.select("o_orderkey", X.is_remote(place, F.lit("Clerk")).alias("remote"), X.lastmod_date(raw).alias("modified"), X.quote_reason(F.lit("Blocked: says "), F.col("o_orderpriority"), 24).alias("reason"), X.in_order(F.array(F.lit("b"), F.lit("a"), F.lit("b"), F.lit("c")), 2).alias("terms"))


@query("""SELECT s_suppkey, s_suppkey % 4 <> 3 AS fits, s_suppkey = 7 AS exempt FROM supplier""")
def place_and_employer(spark, sf_dir):
    """Whether a place fits, and whether an employer is exempt from a rule."""
    from ..operators import postings, screening

    profile = screening.Profile({}, locations=("oslo",))
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    place = _nth((("Greater OSLO", 0), (None, 0), ("Rome", 0), ("Rome", 0)), 0, k)
    return s.select("s_suppkey", screening.location_ok(place, k % 4 == 2, profile).alias("fits"), postings.company_exempt(F.concat(F.lit("Ünited "), "s_name"), ("united Supplier#000000007", "***")).alias("exempt"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'digest_cap' ELSE c_mktsegment END AS deferred FROM customer""")
def overlaid_rows(spark, sf_dir):
    from ..operators import postings

    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("deferred"))
    return postings.overlaid(c, c.filter("c_custkey % 4 = 0").withColumn("deferred", F.lit("digest_cap")), ["deferred"], "c_custkey")


@query("""SELECT place FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS place, sum(length(c_mktsegment)) OVER (ORDER BY c_custkey) AS t FROM customer WHERE c_custkey < 500) WHERE t <= 1000""")
def fitted_rows(spark, sf_dir):
    """The rows of a report that fit its room."""
    c = table(spark, sf_dir, "customer").filter("c_custkey < 500")
    return ranking.fitted(c.select((F.col("c_custkey") + 1).alias("place"), F.length("c_mktsegment").alias("bytes")), 1000).select("place")


@query("""SELECT o_orderpriority AS priority, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1""")
def most_common(spark, sf_dir):
    return ranking.most_common(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "priority"), "priority", "o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (1, 2, 3, 4) THEN 1 ELSE 0 END AS n FROM orders""")
def harness_grades(spark, sf_dir):
    """Finished facts against the expectations of a harness: equal, at most, one of, a rule, and not a rule."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    k, none = n % 6, F.lit(None).cast("string")
    expect = F.struct(F.when(k == 1, "4").when(k == 0, "5").alias("value"), F.when(k == 2, "4").when(k == 5, "5").alias("value_max"), F.when(k == 3, F.array(F.lit("x"))).alias("value_in"), none.alias("rule"), F.when(k == 4, "level").alias("rule_not"))
    return o.select("o_orderkey", F.size(grading.harness_misses(F.lit("5"), F.array(F.lit("y")), F.lit("level"), expect)).alias("n"))


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'Nothing new was found.' WHEN 1 THEN 'Nothing could be judged.' WHEN 2 THEN '9 judged, none to read.' WHEN 3 THEN '4 of 9 to read, 2 put off.' ELSE '4 of 9 to read.' END AS note FROM nation""")
def run_notes(spark, sf_dir):
    t, k = table(spark, sf_dir, "nation"), F.col("n_nationkey") % 5
    judged = F.when(k == 0, 0).otherwise(9)
    return t.select("n_nationkey", ranking.run_note(judged, F.when(k >= 3, 4).otherwise(0), F.when(k == 3, 2).otherwise(0), F.when(k == 1, 9).otherwise(0)).alias("note"))


def _service(method, url, params, body, headers):
    """A board without a network: three pages of 20 rows, 45 in all; one query's second page fails, another's paging isn't honoured."""
    import json

    from ..sources.connectors import HttpError

    if params["what"] == "down" or (params["what"] == "half" and not url.endswith("/1")):
        raise HttpError(url, 404, "status 404")
    page = 1 if params["what"] == "stuck" else int(url.rsplit("/", 1)[1])
    rows = [{"id": f"{params['what']}{i}", "title": f"Clerk {i}", "redirect_url": "http://x", "location": {"display_name": "Oslo"}} for i in range(45)][(page - 1) * 20 : page * 20]
    return json.dumps({"results": rows, "count": 45})


@query("""SELECT 5 AS pages, 4 AS queries, 1 AS failed, 'down: failed: 404; half: page 2 failed, 20 read: 404; stuck: a page repeated rows, 20 read' AS notes""")
def paged_queries(spark, sf_dir):
    """Queries of a search service, page by page; what fails or repeats is noted, and the rest is kept."""
    from ..sources import connectors

    api = dict(connectors.APIS)
    try:
        connectors.APIS["adzuna"] = connectors.Api(api["adzuna"].url, {"what": "{query}"}, rows="results", count="count", size=20)
        pages = connectors.payloads(spark, fetching.Entry("adzuna", "gb", options={"queries": ["all", "half", "stuck", "down"], "pages": 9}), _service)
    finally:
        connectors.APIS.update(api)
    return connectors.page_reports(pages).select(F.col("pages").cast("int"), F.col("queries").cast("int"), F.col("failed").cast("int"), "notes")


# Live evaluation, generated cases, answers by place.


def _reads_length(system: str, asked: list[str]) -> list:
    """A backend without a model: it reads a number off each text, wrongly for some, and doesn't answer others."""
    out: list = []
    for p in asked:
        n = int(p.rsplit(" ", 1)[1])
        out.append(None if n % 5 == 0 else {"n": {"value": n + (n % 3 == 0), "quote": f"is {n + (n % 3 == 0)}"}})
    return out


_LIVE = RuleSet({"n": FactType("facts.n.value", "integer", quote="facts.n.quote")}, [Rule("large", {"n": {"gt": 500}}, "big")], "small")


class _Project:
    specs, rules, texts, resolvers, dangerous = _SPECS, _LIVE, ["text"], (), frozenset({("big", "small")})


@query("""SELECT doc_id, CAST(a AS INTEGER) AS attempt, CASE WHEN doc_id % 5 = 0 THEN 'inconclusive' WHEN doc_id > 500 AND doc_id % 3 = 0 THEN 'fail' ELSE 'pass' END AS result FROM labels, (VALUES (1), (2)) v(a) WHERE doc_id % 7 <> 0""")
def live_attempts(spark, sf_dir):
    """Cases asked twice of a backend; a misread number loses its quote, and with it the outcome."""
    t = table(spark, sf_dir, "labels").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("n is "), "doc_id").alias("text"), (F.col("doc_id") % 7 == 0).alias("offline_only"), F.lit(None).cast("date").alias("as_of"))
    expect = F.struct(F.create_map().cast("map<string,map<string,string>>").alias("facts"), F.when(F.col("doc_id") > 500, "big").otherwise("small").alias("outcome"))
    graded = grading.live(t.withColumn("expect", expect), _Project, _reads_length, "", 2, dt.date(2026, 1, 1))
    return graded.select("doc_id", "attempt", "result")


@query("""SELECT outcome, count(*) AS n FROM (SELECT *, CASE WHEN amount IS NULL THEN 'review' WHEN amount > 1000 AND status = 'O' THEN 'hold' ELSE 'pay' END AS outcome FROM (VALUES (1), (500), (2000), (NULL)) a(amount), (VALUES ('O'), ('F')) b(status), (VALUES (1), (2), (3)) c(copy)) GROUP BY 1""")
def generated_cases(spark, sf_dir):
    """All combinations of stated facts with the rules' own outcomes."""
    rules = RuleSet({"amount": FactType("amount", "number"), "status": FactType("status", "enum")}, [Rule("none", {"amount": {"stated": False}}, "review"), Rule("large", {"amount": {"gt": 1000}, "status": {"is": "O"}}, "hold")], "pay")
    made = grading.generated(spark, {"amount": [1, 500, 2000, None], "status": ["O", "F"], "copy": [1, 2, 3]}, rules, dt.date(2026, 1, 1), most=100)
    return made.groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderkey * 2 AS answer FROM orders")
def answers_by_place(spark, sf_dir):
    """Answers that go by the places of their requests."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return usage.by_place(o.withColumn("place", F.col("o_orderkey")), o.select(F.col("o_orderkey").alias("place"), (F.col("o_orderkey") * 2).alias("answer"))).select("o_orderkey", "answer")
