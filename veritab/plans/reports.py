"""Queries of ranking, grading, keyed state and sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import keys, resolvers
from ..functions import text as X
from ..operators import finish, grading, ranking
from ..sources import directory, paging
from ..sources.structured import postings_in
from ..streaming import state
from . import project as P
from .queries import query, table

# Ranking.

_BLOCKED = "(c_mktsegment = 'MACHINERY')"


def _customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    hits = F.when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("machinery"))).otherwise(F.array().cast("array<string>"))
    rule = F.when(F.col("c_nationkey") == 3, "field").when(F.col("c_acctbal") < -500, "years")
    return ranking.keyed(c.select(F.col("c_custkey").cast("string").alias("uid"), F.col("c_custkey").alias("ordinal"), F.floor(F.col("c_acctbal") / 100).cast("int").alias("score"), F.lit("apply").alias("verdict"), rule.alias("rule"), hits.alias("blocker_hits"), F.when(F.col("c_nationkey") == 7, "llm_ceiling").alias("deferred"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("company"), F.col("c_name").alias("url")))


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS uid, CASE WHEN r <= 25 THEN CAST(r AS INTEGER) END AS place, CASE WHEN c_nationkey = 7 THEN 'llm_ceiling' WHEN r > 25 THEN 'digest_cap' END AS deferred
  FROM (SELECT *, row_number() OVER (ORDER BY {_BLOCKED}, floor(c_acctbal / 100) DESC, c_custkey, CAST(c_custkey AS VARCHAR)) AS r FROM customer WHERE floor(c_acctbal / 100) >= 20)""")
def rank_top_k_overflow(spark, sf_dir):
    return ranking.shown(_customers(spark, sf_dir), 20, 25, show_blocked=True).select("uid", "place", "deferred")


@query(f"""SELECT count(*) AS judged, count(*) FILTER (d) AS deferred, count(*) FILTER (NOT d AND c) AS caught, count(*) FILTER (NOT d AND NOT c AND s < 20) AS below, count(*) FILTER (NOT d AND NOT c AND s >= 20) AS reportable
  FROM (SELECT c_nationkey = 7 AS d, {_BLOCKED} OR c_nationkey = 3 OR c_acctbal < -500 AS c, floor(c_acctbal / 100) AS s FROM customer)""")
def outcome_counts(spark, sf_dir):
    return ranking.outcome_counts(_customers(spark, sf_dir), 20)


_HIDDEN = f"(SELECT *, CASE WHEN c_nationkey = 3 THEN 'field' WHEN c_acctbal < -500 THEN 'years' WHEN {_BLOCKED} THEN 'terms' WHEN s < 20 AND s + 30 >= 20 AND c_mktsegment = 'BUILDING' THEN 'blockers' WHEN s < 20 AND s >= 15 THEN 'gate' END AS \"group\" FROM (SELECT *, CAST(floor(c_acctbal / 100) AS INTEGER) AS s FROM customer))"


def _hidden(spark, sf_dir):
    c = _customers(spark, sf_dir).withColumn("penalties", F.when(F.col("company") == "BUILDING", F.array(F.lit("building"), F.lit("agency"))).otherwise(F.array().cast("array<string>")))
    penalty = ranking.charged(F.col("penalties"), {"building": 30})
    # Nothing is charged where a posting has no penalty: the score is then what it would be.
    group = ranking.hidden_as(F.col("rule"), F.col("verdict"), F.col("blocker_hits"), F.col("score"), penalty, 20, 5)
    c = c.withColumn("group", group).filter(F.col("group").isNotNull())
    return c.withColumn("reason", ranking.hidden_reason(F.col("group"), F.col("rule"), F.col("blocker_hits"), F.col("penalties"), F.col("score"), 20))


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS uid, "group", CASE "group" WHEN 'terms' THEN 'blocked by "machinery"' WHEN 'blockers' THEN 'pushed under the gate by "building"' WHEN 'gate' THEN 'scored ' || s || ', gate 20' ELSE "group" END AS reason FROM {_HIDDEN} WHERE "group" IS NOT NULL""")
def hidden_groups(spark, sf_dir):
    return _hidden(spark, sf_dir).select("uid", "group", "reason")


@query(f"""SELECT uid, "group", in_group, CAST(group_rank AS INTEGER) AS group_rank FROM (SELECT CAST(c_custkey AS VARCHAR) AS uid, "group", count(*) OVER (PARTITION BY "group") AS in_group, CASE "group" WHEN 'field' THEN 1 WHEN 'terms' THEN 2 ELSE 3 END AS group_rank,
  row_number() OVER (ORDER BY s DESC, lower(c_mktsegment), lower(c_name), c_name) AS r FROM {_HIDDEN} WHERE "group" IS NOT NULL) WHERE r <= 60""")
def hidden_list_cap(spark, sf_dir):
    return ranking.hidden_list(_hidden(spark, sf_dir), 60, ["field", "terms"]).select("uid", "group", "in_group", "group_rank")


@query("""WITH t AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place, length(p_name) * 10 AS b FROM part), f AS (SELECT *, min(CASE WHEN c <= 2000 THEN 1 ELSE 0 END) OVER (ORDER BY place) AS ok FROM (SELECT *, sum(b) OVER (ORDER BY place) AS c FROM t WHERE place <= 40))
  SELECT p_partkey, CASE WHEN ok = 1 THEN 'full' WHEN sum(CASE WHEN ok = 1 THEN b ELSE 20 END) OVER (ORDER BY place) <= 2000 THEN 'line' ELSE 'left out' END AS form FROM f""")
def report_budget(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("uid"), "p_partkey", F.col("p_partkey").alias("ordinal"), F.col("p_retailprice").alias("score"), F.lit(False).alias("is_blocked"), F.lit(None).cast("string").alias("deferred"), (F.length("p_name") * 10).alias("full_bytes"), F.lit(20).alias("line_bytes"))
    return ranking.within_budget(ranking.shown(parts, 0, 40).filter("place is not null"), 2000).select("p_partkey", "form")


# Grading: expectations are data.

GRADED = P.parse(
    {
        "name": "texts", "items": {"jsonl": "items.jsonl", "fields": ["text"]}, "default_outcome": "keep", "dangerous": [{"expected": "drop", "got": "keep"}],
        "facts": {"chars": {"type": "integer"}, "lang": {"type": "enum", "values": ["en", "de", "fr", "es"]}},
        "rules": [{"name": "short", "when": {"chars": {"lt": 900}}, "then": "drop"}],
    }
)
_EXPECTED = "CASE WHEN quality = 1 THEN 'keep' ELSE 'drop' END"
_GOT = "CASE WHEN n_chars < 900 THEN 'drop' ELSE 'keep' END"
_LANG = "lang IN ('en', 'de', 'fr', 'es')"


@query(f"""SELECT doc_id, CASE WHEN NOT {_LANG} THEN 'inconclusive' WHEN {_EXPECTED} = {_GOT} AND NOT miss THEN 'pass' ELSE 'fail' END AS result, miss AS chars_missed, {_EXPECTED} = 'drop' AND {_GOT} = 'keep' AS dangerous
  FROM (SELECT *, CASE source WHEN 'web' THEN n_chars <= 100 ELSE n_chars <> 600 AND n_chars <> 700 END AS miss FROM documents JOIN labels USING (doc_id))""")
def eval_graded_cases(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.col("n_chars").cast("string")
    wanted = F.when(F.col("source") == "web", F.create_map(F.lit("gt"), F.lit("100"))).otherwise(F.create_map(F.lit("in"), F.lit("[600, 700]")))
    expect = F.struct(F.create_map(F.lit("chars"), wanted).alias("facts"), F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("outcome"))
    raw = F.to_json(F.struct(F.struct(F.col("n_chars").alias("value"), F.concat(F.lit("has "), n, F.lit(" characters")).alias("quote")).alias("chars"), F.struct(F.col("lang").alias("value"), F.lit("has").alias("quote")).alias("lang")))
    cases = both.select("doc_id", F.concat(F.lit("A text that has "), n, F.lit(" characters.")).alias("text"), expect.alias("expect"), F.lit(None).cast("date").alias("as_of"), raw.alias("raw"))
    graded = grading.grade(cases, GRADED, dt.date(2026, 1, 1))
    return graded.select("doc_id", "result", F.array_contains("fact_misses", "chars").alias("chars_missed"), "dangerous")


# State.


@query("""WITH e AS (SELECT *, CASE WHEN event_type = 'click' THEN '' ELSE event_type END AS label, ts >= TIMESTAMP '2024-01-16' AS fresh FROM events), o AS (SELECT user_id, arg_max(event_id, event_id) AS updated, arg_max(label, event_id) AS company FROM e WHERE NOT fresh GROUP BY 1), n AS (SELECT user_id, max(event_id) AS updated, arg_max(label, event_id) AS company FROM e WHERE fresh GROUP BY 1)
  SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(n.updated, o.updated) AS updated, CASE WHEN n.user_id IS NOT NULL AND (n.company <> '' OR o.user_id IS NULL) THEN CASE WHEN n.company <> '' THEN n.company END ELSE o.company END AS company FROM o FULL JOIN n ON o.user_id = n.user_id""")
def merge_marks(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("updated"), F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")).alias("company"), "ts")
    cut = F.lit("2024-01-16").cast("timestamp")
    old = e.filter(F.col("ts") < cut).groupBy("user_id").agg(F.max("updated").alias("updated"), F.max_by("company", "updated").alias("company"))
    return state.merge(old, e.filter(F.col("ts") >= cut).drop("ts"), ["user_id"], ("company",), "updated")


@query("""SELECT CAST(user_id AS VARCHAR) AS source_key, CASE WHEN ok THEN last ELSE 1 END AS since FROM (SELECT user_id, max(event_id) AS last, arg_max(event_type IN ('view', 'click'), event_id) AS ok FROM events GROUP BY 1)""")
def source_marks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    key = F.col("user_id").cast("string").alias("source_key")
    marks = e.select(key).distinct().select("source_key", F.lit(1).cast("long").alias("since"), F.lit("x").alias("shape"))
    reads = e.select(key, F.col("event_id").alias("started"), F.lit("x").alias("shape"), (F.col("event_type") != "error").alias("whole"), (F.col("event_type") == "purchase").cast("int").alias("unreachable"), (F.col("event_type") == "signup").cast("int").alias("deferred"), F.lit(False).alias("failed"))
    return state.next_marks(marks, reads).select("source_key", "since")


# Sources.


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate > TIMESTAMP '1997-01-01' AND p_name <> '' THEN p_name ELSE '' || l_partkey END AS title FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND l_shipdate > TIMESTAMP '1997-01-01'""")
def listing_details(spark, sf_dir):
    late = F.col("l_shipdate") > F.lit("1997-01-01").cast("timestamp")
    listing = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(late, F.col("l_partkey").cast("string")).alias("path"), F.col("l_partkey").cast("string").alias("title"))
    details = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_name").alias("title"))
    return paging.with_details(listing, details, ["title"]).select("l_orderkey", "l_linenumber", "title")


@query("""SELECT page_id, url AS loc, CASE WHEN page_id >= 20 THEN DATE '2024-01-01' + CAST(page_id AS INTEGER) END AS lastmod FROM pages WHERE regexp_matches(url, '[02468]') AND NOT contains(url, 'about') AND (page_id < 20 OR DATE '2024-01-01' + CAST(page_id AS INTEGER) >= DATE '2024-01-31')""")
def sitemap_selection(spark, sf_dir):
    mod = F.when(F.col("page_id") >= 20, F.concat(F.lit("<lastmod>"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("page_id").cast("int")).cast("string"), F.lit("T00:00:00Z</lastmod>"))).otherwise("")
    maps = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("<urlset><url><loc> "), "url", F.lit("</loc>"), mod, F.lit("</url></urlset>")).alias("xml"))
    return paging.selected(paging.entries_of(maps, 10_000), "[02468]", "about", F.lit("2024-01-31").cast("date"))


@query("""SELECT "query", page, CASE WHEN n < 5 THEN 'short' WHEN page * 5 >= total THEN 'count reached' END AS ends FROM (SELECT o_custkey AS "query", page, count(*) AS n, any_value(t) AS total FROM (SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 5 + 1 AS page, count(*) OVER (PARTITION BY o_custkey) AS t FROM orders) GROUP BY 1, 2)""")
def page_ends(spark, sf_dir):
    from pyspark.sql import Window

    per = Window.partitionBy("o_custkey")
    # Pages as a service would give them: five of a customer's orders each.
    dealt = table(spark, sf_dir, "orders").withColumn("page", F.floor((F.row_number().over(per.orderBy("o_orderkey")) - 1) / 5) + 1).withColumn("t", F.count("*").over(per))
    pages = dealt.groupBy(F.col("o_custkey").alias("query"), "page").agg(F.sort_array(F.collect_list(F.col("o_orderkey").cast("string"))).alias("rows"), F.max("t").alias("total"))
    return paging.page_verdicts(pages, 5).select("query", "page", "ends")


@query("SELECT 'greenhouse' AS kind, p_brand || '-' || p_partkey AS slug, p_name AS name FROM part")
def board_directory(spark, sf_dir):
    entry = F.struct(F.concat_ws("-", "p_brand", "p_partkey").alias("token"), F.col("p_name").alias("company"))
    files = table(spark, sf_dir, "part").groupBy(F.col("p_size"), F.col("p_brand"), F.col("p_type")).agg(F.to_json(F.struct(F.collect_list(entry).alias("boards"))).alias("payload"))
    return directory.index(files.select(F.concat(F.lit("/d/greenhouse-"), "p_size", F.lit("-"), "p_brand", F.lit("-"), "p_type", F.lit(".json")).alias("file"), "payload")).select("kind", "slug", "name")


@query("""SELECT 'https://jobs.example/' || p_partkey AS url, p_name AS title, p_brand AS company, DATE '2026-01-01' + p_size AS posted FROM part""")
def markup_postings(spark, sf_dir):
    text = lambda name, c: F.concat(F.lit(f'<span itemprop="{name}">'), c, F.lit("</span>"))
    html = F.concat(F.lit('<div itemscope itemtype="https://schema.org/JobPosting">'), text("title", F.col("p_name")), F.lit('<div itemprop="hiringOrganization" itemscope>'), text("name", F.col("p_brand")), F.lit("</div>"), text("datePosted", F.date_add(F.lit("2026-01-01").cast("date"), F.col("p_size")).cast("string")), F.lit("</div>"))
    pages = table(spark, sf_dir, "part").select(F.concat(F.lit("https://jobs.example/"), "p_partkey").alias("url"), html.alias("html"))
    return postings_in(pages).select("url", "title", "company", "posted")


@query()
def fuzzy_lookup(spark, sf_dir):
    entries = table(spark, sf_dir, "supplier").select(F.lit("lever").alias("kind"), F.concat(F.lit("s"), "s_suppkey").alias("slug"), F.col("s_name").alias("name"))
    return directory.search(entries, ["Supplier 12 Ltd", "supplier#0000007", "s3"])


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'FAIL' WHEN n_regionkey = 1 THEN 'SKIPPED' WHEN n = 0 THEN 'EMPTY' ELSE 'OK' END AS status, CASE WHEN s_acctbal < 0 THEN 0 ELSE n END AS n FROM (SELECT s_suppkey, any_value(s_acctbal) AS s_acctbal, any_value(n_regionkey) AS n_regionkey, count(l_suppkey) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) ON l_suppkey = s_suppkey GROUP BY 1)")
def source_reports(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    sources = s.select("s_suppkey", F.col("s_suppkey").alias("source_key"), F.when(F.col("s_acctbal") < 0, "down").alias("error"), (F.col("n_regionkey") == 1).alias("skipped"))
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("source_key"))
    return paging.source_reports(sources, rows).select("s_suppkey", "status", "n")


# Facts and keys.



@query("""SELECT doc_id, left(sha256(CAST(to_json([['source', source], ['lang', lang]]) AS VARCHAR)), 16) || ':f:replay:m' AS key FROM documents""")
def answer_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", keys.answer_key(keys.content_hash("source", "lang"), "f", "replay", "m").alias("key"))


@query("""SELECT doc_id, CASE WHEN length(t) <= 220 THEN t ELSE rtrim(regexp_replace(left(t, 219), ' [^ ]*$', '')) || '…' END AS sentence FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)""")
def one_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", keys.one_sentence(F.col("text")).alias("sentence"))
