"""Registered queries of payloads, readers and sinks, kept pages, counters and saved attempts, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import keys, resolvers
from ..functions import text as X
from ..operators import grading, runs, screening
from ..operators.rules import FactType, Rule, RuleSet, decide
from ..sources import paging, readers
from ..streaming import state
from . import project as P
from .queries import ORACLES, query, table


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or a local one where all of Spark is one process."""
    import tempfile
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(top or 'file://' + tempfile.mkdtemp(prefix='veritab-')).rstrip('/')}/{uuid.uuid4().hex}"


# Payloads of boards.


@query("""SELECT kind, CAST(s_suppkey AS VARCHAR) AS raw_id, 'Clerk ' || s_suppkey AS title, CASE kind WHEN 'smartrecruiters' THEN 'Oslo, NO' WHEN 'workable' THEN 'Oslo, NO' WHEN 'workday' THEN 'Oslo' ELSE 'Oslo' END AS location, CASE WHEN kind IN ('adzuna', 'reed', 'jooble') THEN s_name ELSE 'label' END AS company,
  CASE WHEN kind = 'workday' THEN NULL ELSE DATE '2026-02-03' END AS posted, kind IN ('smartrecruiters', 'ashby', 'workable') AS remote FROM supplier, (VALUES ('smartrecruiters'), ('lever'), ('ashby'), ('workable'), ('workday'), ('adzuna'), ('reed'), ('jooble')) v(kind)""")
def payloads_of_boards(spark, sf_dir):
    """The same posting as eight boards and services write it."""
    s = table(spark, sf_dir, "supplier")
    n, title, url, day = F.col("s_suppkey").cast("string"), F.concat(F.lit("Clerk "), "s_suppkey"), F.lit("http://x/1"), F.lit("2026-02-03T08:00:00Z")
    epoch = F.lit(1770105600000)
    one = lambda **k: F.struct(*[v.alias(name) for name, v in k.items()])
    oslo = F.lit("Oslo")
    rows = {
        "smartrecruiters": ("content", one(id=n, name=title, ref=url, location=one(city=oslo, country=F.lit("NO"), remote=F.lit(True)), releasedDate=day)),
        "lever": (None, one(id=n, text=title, hostedUrl=url, categories=one(location=oslo), createdAt=epoch)), "ashby": ("jobs", one(id=n, title=title, jobUrl=url, location=oslo, publishedAt=day, isRemote=F.lit(True))),
        "workable": ("jobs", one(shortcode=n, title=title, url=url, city=oslo, country=F.lit("NO"), published_on=day, telecommuting=F.lit(True))), "workday": ("jobPostings", one(externalPath=n, title=title, locationsText=oslo)),
        "adzuna": ("results", one(id=n, title=title, redirect_url=url, location=one(display_name=oslo), company=one(display_name=F.col("s_name")), created=day)),
        "reed": ("results", one(jobId=n, jobTitle=title, jobUrl=url, locationName=oslo, employerName=F.col("s_name"), date=F.lit("03/02/2026"))), "jooble": ("jobs", one(id=n, title=title, link=url, location=oslo, company=F.col("s_name"), updated=day)),
    }
    parts = []
    for kind, (at, row) in rows.items():
        payloads = s.select(F.to_json(F.array(row) if at is None else F.struct(F.array(row).alias(at))).alias("payload"))
        parts.append(readers.postings(payloads, kind, F.lit("label")).select(F.col("source").alias("kind"), "raw_id", "title", "location", "company", "posted", "remote"))
    return runs.union_sources(parts)


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'read ' || s_suppkey || ' of 100' END AS shortfall, CASE WHEN s_suppkey % 5 = 0 THEN 'FAIL' WHEN s_suppkey % 5 = 1 THEN 'SKIPPED' WHEN s_suppkey % 5 = 2 THEN 'EMPTY' ELSE 'OK' END AS probe FROM supplier WHERE s_suppkey < 100""")
def shortfalls(spark, sf_dir):
    """What a read fell short of, and what a look at a source says."""
    s, n = table(spark, sf_dir, "supplier").filter("s_suppkey < 100"), F.col("s_suppkey")
    return s.select("s_suppkey", paging.shortfall(n, F.when(n % 3 == 0, 100).otherwise(0)).alias("shortfall"), readers.probe(F.when(n % 5 == 0, "down"), n % 5 == 1, F.when(n % 5 == 2, 0).otherwise(1)).alias("probe"))


@query("""SELECT l_orderkey, l_linenumber, l_shipdate IS NOT NULL AND l_partkey % 2 = 0 AND l_partkey % 3 <> 0 AS hit, CASE WHEN l_shipdate IS NOT NULL AND l_partkey % 2 = 0 AND l_partkey % 3 <> 0 THEN 'p' || l_partkey END AS html FROM lineitem""")
def kept_pages(spark, sf_dir):
    """Pages kept from before are used where they are as they were last modified."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("loc"), F.lit(1).alias("lastmod"))
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    cache = part.filter(k % 2 == 0).select(k.alias("url"), F.when(k % 3 == 0, 2).otherwise(1).alias("lastmod"), F.concat(F.lit("p"), k).alias("html"))
    return paging.kept_pages(rows, cache).select("l_orderkey", "l_linenumber", "hit", "html")


# Readers and sinks.


@query("""SELECT kind, CAST(c_custkey AS VARCHAR) AS id, c_mktsegment || ', "' || c_nationkey || '"' AS body FROM customer, (VALUES ('csv'), ('jsonl')) v(kind)""")
def items_from_files(spark, sf_dir):
    """Items written as JSON lines and as CSV, read by the library's readers with their ids checked."""
    at = folder(spark)
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.col("c_mktsegment"), F.lit(', "'), F.col("c_nationkey"), F.lit('"')).alias("body"))
    items.write.json(f"{at}/jsonl")
    items.write.option("header", True).option("escape", '"').csv(f"{at}/csv")
    parts = [P.read_items(spark, P.parse({"name": "p", "items": {kind: f"{at}/{kind}", "fields": ["body"]}, "facts": {"n": {"type": "number"}}, "default_outcome": "x"})).select(F.lit(kind).alias("kind"), "id", "body") for kind in ("csv", "jsonl")]
    return parts[0].unionByName(parts[1])


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, '{"n":' || o_orderkey || '}' AS raw FROM orders""")
def answers_from_files(spark, sf_dir):
    """Recorded answers written as they arrive and read again; the last of an item stands."""
    at, o = folder(spark), table(spark, sf_dir, "orders")
    state.record_answers(o.select(F.col("o_orderkey").cast("string").alias("id"), F.to_json(F.struct(F.col("o_orderkey").alias("n"))).alias("raw")), at)
    return runs.last_answers(readers.read_answers(spark, at))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status FROM orders""")
def written_results(spark, sf_dir):
    """Results as JSON lines in the items' order."""
    at, o = folder(spark), table(spark, sf_dir, "orders")
    readers.write_results(o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderstatus").alias("status")), at)
    return spark.read.schema("id string, status string").json(at)


@query("""SELECT user_id AS uid, CAST(max(event_id) AS BIGINT) AS last FROM events GROUP BY 1""")
def state_table(spark, sf_dir):
    """A keyed table through three commits: its first rows, rows put in by key, and its end read back."""
    kept = state.Table(spark, folder(spark), "uid long, last long")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("uid"), F.col("event_id").alias("last"))
    low = e.groupBy("uid").agg(F.min("last").alias("last"))
    kept.commit(low.filter("uid % 2 = 0"), expected=0)
    kept.put(low, ["uid"])
    state.finish_run(kept, state.merge(kept.read(), e.groupBy("uid").agg(F.max("last").alias("last")), ["uid"]), low, folder(spark))
    return kept.read()


# State.


@query("""SELECT c_custkey AS uid, c_custkey % 4 >= 2 AS unread FROM customer""")
def thin_rows(spark, sf_dir):
    """Rows without a text are shown as they are once they were held often enough; keys that were dealt with are forgotten."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    counters = c.select(k.alias("uid"), (k % 4).alias("times"))
    counters = state.forget(counters, c.filter("c_custkey % 4 = 1").select(k.alias("uid")))
    return state.held_thin(c.select(k.alias("uid")), counters).select("uid", "unread")


@query("""SELECT c_custkey AS url, CASE c_custkey % 3 WHEN 0 THEN 'saved' ELSE 'applied' END AS state FROM customer WHERE c_custkey % 3 < 2 AND c_custkey <> 6""")
def shortlisted(spark, sf_dir):
    """Marks of the shortlist, without one that was taken back."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    marks = c.select(k.cast("string").alias("uid"), k.alias("url"), F.when(k % 3 == 0, "saved").when(k % 3 == 1, "applied").otherwise("dismissed").alias("state"), k.alias("updated"))
    return state.shortlist(state.unsee(marks, "6")).select("url", "state")


@query("""SELECT made FROM (SELECT DISTINCT CAST(ts AS DATE) AS made FROM events) WHERE made NOT IN (SELECT DISTINCT CAST(ts AS DATE) FROM events ORDER BY 1 DESC LIMIT 7)""")
def rotated_backups(spark, sf_dir):
    """Daily copies that go when the newest seven stay."""
    return state.rotate(table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("made")).distinct(), 7)


# Rules, texts, keys.


@query("""SELECT o_orderkey, CASE WHEN contains(lower(o_orderpriority), 'high') THEN 'fast' WHEN o_orderstatus IN ('F') THEN 'done' ELSE 'queue' END AS outcome FROM orders""")
def rule_contains(spark, sf_dir):
    rules = RuleSet({"priority": FactType("o_orderpriority", "text"), "status": FactType("o_orderstatus", "enum")}, [Rule("high", {"priority": {"contains": "HIGH"}}, "fast"), Rule("final", {"status": {"in": ["F"]}}, "done")], "queue")
    return decide(table(spark, sf_dir, "orders"), rules, dt.date(1998, 1, 1)).select("o_orderkey", "outcome")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS seconds, CAST(o_orderdate AS DATE) AS millis, NULL::DATE AS none, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g')) AS clean, 'two words' AS squeezed FROM orders""")
def dates_and_titles(spark, sf_dir):
    """Dates in ISO form and as epochs, and titles without punctuation or runs of spaces."""
    o = table(spark, sf_dir, "orders")
    seconds = F.unix_timestamp("o_orderdate")
    return o.select(
        "o_orderkey", X.iso_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("iso"), X.iso_date(seconds).alias("seconds"), X.iso_date(seconds * 1000).alias("millis"), X.iso_date(F.col("o_orderpriority")).alias("none"),
        X.clean(F.col("o_orderpriority")).alias("clean"), X.squeeze(F.lit(" two\t words\n")).alias("squeezed"),
    )


@query("""SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, CAST(len(list_distinct(w)) AS INTEGER) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(strip_accents(replace(lower(text), 'ß', 'ss')), '[\\p{L}\\p{N}_]+') AS w FROM documents)""")
def plain_words(spark, sf_dir):
    """Words without case, accents and compatibility forms."""
    words = table(spark, sf_dir, "documents").select("doc_id", resolvers.plain_words(X.text_of(F.col("text"))).alias("w"))
    return words.select("doc_id", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"))


@query("""SELECT 'lever:a:x' AS plain, 2 AS n, true AS told_apart""")
def source_keys(spark, sf_dir):
    """Keys of sources with and without options that shape what is read."""
    made = [keys.source_key("lever", "a", "x"), keys.source_key("lever", "a", "x", pages=2), keys.source_key("lever", "a", "x", pages=2)]
    return spark.createDataFrame([(made[0], len(set(made)), made[1] == made[2] != made[0])], "plain string, n int, told_apart boolean")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS uid FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey // 3 ORDER BY p_size DESC, CAST(p_partkey AS VARCHAR)) AS r FROM part) WHERE r = 1""")
def near_dup_equal_titles(spark, sf_dir):
    """Postings of one company and city whose titles differ in case, plural and punctuation only; the longest text stays. Other titles are far apart."""
    p = table(spark, sf_dir, "part")
    third = F.floor(F.col("p_partkey") / 3).cast("string")
    title = F.concat_ws(" ", F.left(F.md5(third), F.lit(12)), F.left(F.md5(F.concat(F.lit("x"), third)), F.lit(12)))
    spelt = F.when(F.col("p_partkey") % 3 == 1, F.upper(title)).when(F.col("p_partkey") % 3 == 2, F.regexp_replace(title, " ", " - ")).otherwise(title)
    jobs = p.select(F.col("p_partkey").cast("string").alias("uid"), F.concat(F.lit("u"), F.col("p_partkey")).alias("url"), F.when(F.col("p_partkey") % 2 == 0, "Acme Ltd").otherwise("ACME Inc.").alias("company"), spelt.alias("title"), F.lit("London, UK").alias("location"), F.repeat(F.lit("x"), F.col("p_size")).alias("description"))
    return screening.merge_near(jobs).select("uid")


# Saved attempts and offline cases.

_KEEP = P.parse({"name": "keep", "items": {"jsonl": "x", "fields": ["text"]}, "facts": {"n": {"type": "integer"}}, "rules": [{"name": "long", "when": {"n": {"ge": 1000}}, "then": "keep"}], "default_outcome": "drop", "dangerous": [{"expected": "drop", "got": "keep"}]})


def _cases(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.col("n_chars").cast("string")
    answer = F.to_json(F.struct(F.struct(F.col("n_chars").alias("value"), F.concat(F.lit("n "), n).alias("quote")).alias("n")))
    expect = F.struct(F.create_map(F.lit("n"), F.create_map(F.lit("ge"), F.lit("100"))).alias("facts"), F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("outcome"))
    return d.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("n "), n).alias("text"), expect.alias("expect"), F.when(F.col("doc_id") % 9 != 0, answer).alias("model_facts"), F.lit(None).cast("date").alias("as_of"), F.array("lang").alias("tags"), (F.col("doc_id") % 2 == 0).alias("heldout"), (F.col("doc_id") % 4 == 0).alias("__gone"))


_RESULT = "CASE WHEN doc_id % 9 = 0 THEN 'inconclusive' WHEN (n_chars >= 1000) = (quality = 1) AND n_chars >= 100 THEN 'pass' ELSE 'fail' END"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, {_RESULT} AS result, doc_id % 9 <> 0 AND n_chars >= 1000 AND quality = 0 AS dangerous FROM documents JOIN labels USING (doc_id)")
def offline_cases(spark, sf_dir):
    """Cases graded on the answers that they carry."""
    graded = grading.offline(_cases(spark, sf_dir), _KEEP, dt.date(2026, 1, 1))
    return graded.select("id", "result", (F.col("dangerous") & (F.col("result") != "inconclusive")).alias("dangerous"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, {_RESULT} AS state, CAST(2 AS BIGINT) AS attempts, doc_id % 2 = 0 AS heldout FROM documents JOIN labels USING (doc_id) WHERE doc_id % 4 <> 0")
def regraded_attempts(spark, sf_dir):
    """Saved attempts graded by the cases as they are now; attempts of cases that are gone drop out."""
    cases = _cases(spark, sf_dir)
    attempts = cases.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"), F.col("model_facts").alias("raw"))
    graded = grading.regrade(attempts, cases.filter("not __gone"), _KEEP, dt.date(2026, 1, 1))
    return grading.report(graded).select("id", "state", "attempts", "heldout")


@query("""SELECT 'drop, keep' AS outcomes, 'n: needs a number' AS wrong, count(*) AS checked FROM labels""")
def checked_project(spark, sf_dir):
    """A project's outcomes, what is wrong with a rule of another, and cases that name only what the project knows."""
    d = table(spark, sf_dir, "labels")
    cases = d.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("x:"), "doc_id").alias("source"), F.struct(F.lit(None).cast("map<string,map<string,string>>").alias("facts"), F.lit("keep").alias("outcome")).alias("expect"))
    n = grading.check_cases(cases, _KEEP.specs, _KEEP.rules.outcomes).count()
    wrong = f"n: {P.argument_problem(_KEEP.specs['n'], 'gt', 'x')}"
    return spark.createDataFrame([(", ".join(sorted(_KEEP.rules.outcomes)), wrong, n)], "outcomes string, wrong string, checked long")


@query("SELECT page_id, left(text, 12000) AS body FROM (" + ORACLES["html_to_text"] + ")")
def page_bodies(spark, sf_dir):
    """The text of pages whose markup gives none, up to its most."""
    return table(spark, sf_dir, "pages").select("page_id", X.body_text(F.col("html")).alias("body"))


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '192.0.2.' || n_nationkey WHEN 1 THEN '10.0.0.1' END AS address FROM nation""")
def interface_addresses(spark, sf_dir):
    """The first address of an interface's listing; one with a number above 255 is none."""
    n = F.col("n_nationkey")
    listing = F.when(n % 3 == 0, F.concat(F.lit("eth0: up\n  inet6 fe80::1\n  inet 192.0.2."), n, F.lit(" netmask 255.255.255.0"))).when(n % 3 == 1, F.lit("inet 300.1.1.1\ninet addr:10.0.0.1\ninet 10.0.0.2")).otherwise(F.lit("lo: down"))
    return table(spark, sf_dir, "nation").select("n_nationkey", X.interface_address(listing).alias("address"))
