"""Queries of the library by name, and the SQL they are held against."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract
from ..functions import text as X
from ..operators import alarms, evaluation, guard, postings, runs, screening
from ..operators.rules import FactType, Rule, RuleSet, decide, histogram
from ..sources import readers
from ..streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = dt.date(1998, 1, 1)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rules.

ORDER_FACTS = {
    "amount": FactType("amount", "number"),
    "status": FactType("o_orderstatus", "enum"),
    "priority": FactType("o_orderpriority", "text"),
    "date": FactType("day", "date"),
}
ORDER_RULES = RuleSet(
    ORDER_FACTS,
    [
        Rule("unknown amount", {"amount": {"stated": False}}, "review"),
        Rule("large and open", {"amount": {"gt": 300000}, "status": {"is": "O"}}, "hold"),
        Rule("soon", {"date": {"within_days": 30}}, "rush"),
        Rule("urgent", {"priority": {"matches": "urgent|high"}, "amount": {"ge": 100000}}, "rush"),
        Rule("old", {"date": {"before_days": -700}, "status": {"ne": "P"}}, "archive"),
        Rule("cheap", {"amount": {"le": 20000}, "status": {"in": ["F", "P"]}}, "approve"),
    ],
    "queue",
)
_ORDER_CASE = """
    CASE WHEN amount IS NULL THEN {0}
         WHEN amount > 300000 AND o_orderstatus = 'O' THEN {1}
         WHEN day BETWEEN DATE '1998-01-01' AND DATE '1998-01-31' THEN {2}
         WHEN regexp_matches(lower(o_orderpriority), 'urgent|high') AND amount >= 100000 THEN {3}
         WHEN day < DATE '1998-01-01' - 700 AND o_orderstatus <> 'P' THEN {4}
         WHEN amount <= 20000 AND o_orderstatus IN ('F', 'P') THEN {5}
         ELSE {6} END"""
_ORDERS_SQL = "(SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS amount, CAST(o_orderdate AS DATE) AS day FROM orders)"
_OUTCOME = _ORDER_CASE.format("'review'", "'hold'", "'rush'", "'rush'", "'archive'", "'approve'", "'queue'")
_RULE = _ORDER_CASE.format("'unknown amount'", "'large and open'", "'soon'", "'urgent'", "'old'", "'cheap'", "NULL")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumns({"amount": F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")), "day": F.col("o_orderdate").cast("date")})


@query(f"SELECT o_orderkey, {_OUTCOME} AS outcome, {_RULE} AS rule FROM {_ORDERS_SQL}")
def rule_first_match_orders(spark, sf_dir):
    return decide(_orders(spark, sf_dir), ORDER_RULES, AS_OF).select("o_orderkey", "outcome", "rule")


@query(f"SELECT outcome, coalesce(rule, '(default: queue)') AS rule, count(*) AS n FROM (SELECT {_OUTCOME} AS outcome, {_RULE} AS rule FROM {_ORDERS_SQL}) GROUP BY 1, 2")
def rule_histogram(spark, sf_dir):
    return histogram(decide(_orders(spark, sf_dir), ORDER_RULES, AS_OF), "queue")


@query(f"""SELECT o_orderkey, coalesce(amount <> 5, false) AS ne, coalesce(amount > 5, false) AS gt, amount IS NULL AS unstated, amount IS NOT NULL AS stated FROM {_ORDERS_SQL}""")
def rule_null_semantics(spark, sf_dir):
    from ..operators.rules import condition

    fact, day = FactType("amount", "number"), F.lit(AS_OF)
    tests = {"ne": {"ne": 5}, "gt": {"gt": 5}, "unstated": {"stated": False}, "stated": {"stated": True}}
    return _orders(spark, sf_dir).select("o_orderkey", *[condition(fact, t, day).alias(n) for n, t in tests.items()])


@query("""SELECT l_orderkey, bool_or(l_quantity > 45) AS some_large, bool_or(l_quantity = 10) AS has_ten, count(*) > 0 AS stated FROM lineitem GROUP BY 1""")
def rule_list_any(spark, sf_dir):
    from ..operators.rules import condition

    fact, day = FactType("quantities", "number", many=True), F.lit(AS_OF)
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("quantities"))
    tests = {"some_large": {"gt": 45}, "has_ten": {"contains": 10.0}, "stated": {"stated": True}}
    return lists.select("l_orderkey", *[condition(fact, t, day).alias(n) for n, t in tests.items()])


# Text and screening.

_FOLD = "lower(trim(regexp_replace(translate(text, '‘’“”–—−' || chr(160) || chr(8239), '''''\"\"---  '), '\\s+', ' ', 'g')))"


@query(f"SELECT doc_id, {_FOLD} AS folded FROM documents")
def normalise_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.fold(F.col("text")).alias("folded"))


def _word_sql(term: str, text: str = "lower(text)") -> str:
    return f"regexp_matches({text}, '(^|[^\\p{{L}}\\p{{N}}_]){term}($|[^\\p{{L}}\\p{{N}}_])')"


@query(f"""SELECT doc_id, CASE WHEN {_word_sql('trash')} THEN 'excluded by ''trash''' WHEN {_word_sql('stupid')} THEN 'excluded by ''stupid''' WHEN NOT ({_word_sql('the')} OR {_word_sql('der')} OR {_word_sql('que')}) THEN 'none of require_any found' END AS reason FROM documents""")
def prefilter_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", screening.prefilter_reason([F.col("text")], ["trash", "stupid"], ["the", "der", "que"]).alias("reason"))


PROFILE = screening.Profile({"the": 5, "tion": 3, "ung": 4, "license": 10}, {"trash": 20, "stupid": 15, "de": 2}, title_only=frozenset({"de"}), hard=("password",))


@query(f"""SELECT doc_id, CAST(CASE WHEN contains(lower(source), 'the') THEN 15 WHEN contains(lower(text), 'the') THEN 5 ELSE 0 END
  + CASE WHEN contains(lower(text), 'tion') THEN 3 ELSE 0 END + CASE WHEN contains(lower(text), 'ung') THEN 4 ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN 10 ELSE 0 END
  - CASE WHEN {_word_sql('trash')} THEN 20 ELSE 0 END - CASE WHEN {_word_sql('stupid')} THEN 15 ELSE 0 END AS INTEGER) AS keyword_score,
  CAST({_word_sql('password')} AS INTEGER) AS n_blockers FROM documents""")
def keyword_score(spark, sf_dir):
    scored = screening.keyword_score(table(spark, sf_dir, "documents"), PROFILE, title="source", body="text", location="lang")
    return scored.select("doc_id", "keyword_score", F.size("blocker_hits").alias("n_blockers"))



@query("SELECT s_suppkey, left(sha256(lower(s_name || '|' || n_name)), 16) AS uid, left(sha256(lower(s_name)), 8) AS short FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def uid_hash(spark, sf_dir):
    both = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return both.select("s_suppkey", X.short_hash(F.col("s_name"), F.col("n_name")).alias("uid"), X.short_hash(F.col("s_name"), length=8).alias("short"))


@query("SELECT doc_id, left(sha256(lower(source || '|' || text)), 16) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.short_hash(F.col("source"), F.col("text")).alias("content_hash"))


@query("SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY lang, lower(split_part(text, '. ', 1)) ORDER BY length(text) DESC, doc_id) AS r FROM documents) WHERE r = 1")
def dedup_exact_longest(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").withColumn("head", F.lower(F.split_part("text", F.lit(". "), F.lit(1))))
    return screening.first_of_each(keyed, ["lang", "head"], [F.length("text").desc(), F.col("doc_id")]).select("doc_id", "text")


@query()
def near_dup_bucketed(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    jobs = p.select(F.col("p_partkey").cast("string").alias("uid"), F.concat(F.lit("u"), F.col("p_partkey")).alias("url"), F.col("p_brand").alias("company"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.lit("London, UK").alias("location"), F.repeat(F.lit("x"), F.col("p_size")).alias("description"))
    return screening.merge_near(jobs).select("uid", "company", "title")



@query("SELECT doc_id, CASE WHEN n_chars >= 2000 THEN 'candidate' WHEN trim(text) = '' THEN 'thin' ELSE 'reject' END AS gate FROM documents")
def gate_three_way(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", screening.gate(F.col("n_chars"), F.col("text"), 2000).alias("gate"))


@query("SELECT o_orderkey, r <= 100 AS within FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)")
def call_ceiling(spark, sf_dir):
    return screening.in_first(table(spark, sf_dir, "orders"), "o_orderkey", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 100).select("o_orderkey", "within")




# Quotes and answers.


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(" + _FOLD.replace("text", "d.text") + ", " + _FOLD.replace("text", "b.text") + ")")
def quote_containment(spark, sf_dir):
    passages = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return guard.contained(table(spark, sf_dir, "documents").select("doc_id", "text"), passages).select("doc_id", "item_id")


@query("""SELECT doc_id, CAST(len(l) AS INTEGER) AS n, list_sum(l) AS total FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: CAST(x AS DOUBLE)) AS l FROM (SELECT doc_id, regexp_replace(text, '[^0-9]+', ' x ', 'g') AS text FROM documents))""")
def numbers_in_text(spark, sf_dir):
    plain = F.regexp_replace("text", "[^0-9]+", " x ")
    df = table(spark, sf_dir, "documents").select("doc_id", X.numbers_in(plain).alias("l"))
    return df.select("doc_id", F.size("l").alias("n"), F.when(F.size("l") > 0, F.aggregate("l", F.lit(0.0), lambda a, b: a + b)).alias("total"))



SPECS = {"amount": {"type": "number"}, "status": {"type": "enum", "values": ["O", "F"]}}
ANSWER_RULES = RuleSet({"amount": FactType("facts.amount.value", "number", quote="facts.amount.quote"), "status": FactType("facts.status.value", "enum", quote="facts.status.quote")}, [Rule("big", {"amount": {"gt": 250000}}, "hold"), Rule("open", {"status": {"is": "O"}}, "wait")], "pay")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderpriority = '5-LOW' THEN 'filtered' WHEN r > 9000 THEN 'deferred' WHEN o_orderpriority = '1-URGENT' OR o_orderstatus = 'P' THEN 'error' ELSE 'decided' END AS status,
  CASE WHEN o_orderpriority = '5-LOW' OR r > 9000 OR o_orderpriority = '1-URGENT' OR o_orderstatus = 'P' THEN NULL WHEN o_totalprice > 250000 AND o_orderkey % 7 <> 0 THEN 'hold' WHEN o_orderstatus = 'O' THEN 'wait' ELSE 'pay' END AS outcome
  FROM (SELECT *, sum(CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 1 END) OVER (ORDER BY o_orderkey) AS r FROM orders)""")
def replay_run(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    items = o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("ordinal"), F.concat(F.lit("total "), F.format_number("o_totalprice", 2), F.lit(" status "), F.col("o_orderstatus")).alias("body"), F.regexp_replace("o_orderpriority", "[^A-Z]", " ").alias("priority"))
    fact = lambda v, q: F.struct(v.alias("value"), q.alias("quote"))
    wrong = F.when(F.col("o_orderkey") % 7 == 0, "total 1").otherwise(F.concat(F.lit("total "), F.format_number("o_totalprice", 2)))
    raw = F.to_json(F.struct(fact(F.col("o_totalprice"), wrong).alias("amount"), fact(F.col("o_orderstatus"), F.concat(F.lit("status "), F.col("o_orderstatus"))).alias("status")))
    answers = o.filter("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("id"), F.lit(1).alias("line"), raw.alias("raw"))
    done = runs.run(items, answers, SPECS, ANSWER_RULES, AS_OF, ["body", "priority"], exclude=["low"], max_calls=9000)
    return done.select("id", "status", "outcome")


@query("""SELECT count(*) AS items, count(*) FILTER (quality = 1) AS decided, count(*) FILTER (quality = 0 AND toxic = 0) AS filtered, count(*) FILTER (quality IS NULL) AS deferred, count(*) FILTER (quality = 0 AND toxic = 1) AS error FROM documents LEFT JOIN labels USING (doc_id)""")
def stats_line(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "deferred").when(F.col("quality") == 1, "decided").when(F.col("toxic") == 1, "error").otherwise("filtered")
    return runs.stats(df.withColumn("status", status))


@query("SELECT doc_id, quality IS NOT NULL AND doc_id >= 100 AS hit FROM documents LEFT JOIN labels USING (doc_id)")
def cache_hit_split(spark, sf_dir):
    cache = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("raw"), F.col("doc_id").alias("written"))
    return state.cache_split(table(spark, sf_dir, "documents").select("doc_id"), cache, "doc_id", since=F.lit(100)).select("doc_id", "hit")


@query("""WITH e AS (SELECT event_id, event_type = 'error' AS f FROM events), s AS (SELECT event_id, f AND lag(f) OVER (ORDER BY event_id) AND lag(f, 2) OVER (ORDER BY event_id) AS t FROM e) SELECT min(event_id) AS trip FROM s WHERE t""")
def circuit_breaker(spark, sf_dir):
    return runs.breaker(table(spark, sf_dir, "events"), "event_id", F.col("event_type") == "error", 3)



# State.

_HALF = "TIMESTAMP '2024-01-16'"


def _halves(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    cut = F.lit("2024-01-16").cast("date")
    return e.filter(F.col("day") < cut), e.filter(F.col("day") >= cut)


_UID = "user_id || ':' || event_type || ':' || CAST(floor(value) AS INTEGER)"


@query(f"SELECT event_id FROM events WHERE ts >= {_HALF} AND {_UID} NOT IN (SELECT {_UID} FROM events WHERE ts < {_HALF})")
def seen_anti(spark, sf_dir):
    uid = F.concat_ws(":", "user_id", "event_type", F.floor("value").cast("int"))
    old, scan = (half.withColumn("uid", uid) for half in _halves(spark, sf_dir))
    return state.unseen(scan, old.groupBy("uid").agg(F.max("day").alias("last_seen"))).select("event_id")


@query(f"""WITH s AS (SELECT user_id, max(CAST(ts AS DATE)) AS l FROM events WHERE ts < {_HALF} AND value > 97 GROUP BY 1) SELECT event_id, CAST(date_diff('day', l, DATE '2024-01-20') AS INTEGER) AS days_away FROM events LEFT JOIN s USING (user_id) WHERE ts >= {_HALF} AND (l IS NULL OR (date_diff('day', l, DATE '2024-01-20') > 5 AND event_type = 'signup'))""")
def seen_reopen(spark, sf_dir):
    old, scan = _halves(spark, sf_dir)
    seen = old.filter("value > 97").groupBy("user_id").agg(F.max("day").alias("last_seen"))
    return state.unseen(scan, seen, "user_id", 5, F.lit("2024-01-20").cast("date"), F.col("event_type") == "signup").select("event_id", "days_away")


@query(f"SELECT event_id FROM events e WHERE ts >= {_HALF} AND NOT EXISTS (SELECT 1 FROM events d WHERE d.ts < {_HALF} AND d.event_type = 'error' AND d.user_id = e.user_id AND d.value > 50)")
def dismissed_anti(spark, sf_dir):
    old, scan = _halves(spark, sf_dir)
    marks = old.filter("event_type = 'error' and value > 50").select(F.col("user_id").alias("url"), F.lit("dismissed").alias("state"))
    return state.undismissed(scan.withColumn("url", F.col("user_id")), marks).select("event_id")


@query(f"""WITH a AS (SELECT user_id, min(CAST(ts AS DATE)) f, max(CAST(ts AS DATE)) l FROM events WHERE ts < {_HALF} AND event_type <> 'view' GROUP BY 1), b AS (SELECT user_id, max(CAST(ts AS DATE)) d, bool_or(event_type = 'signup' AND value > 90) AS r FROM events WHERE ts >= {_HALF} AND event_type <> 'click' GROUP BY 1)
  SELECT coalesce(a.user_id, b.user_id) AS uid, CASE WHEN a.user_id IS NOT NULL AND NOT coalesce(r, false) THEN f ELSE d END AS first_seen, coalesce(d, l) AS last_seen FROM a FULL JOIN b ON a.user_id = b.user_id""")
def merge_seen_upsert(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    seen = old.filter("event_type <> 'view'").groupBy(F.col("user_id").alias("uid")).agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"))
    got = new.filter("event_type <> 'click'").groupBy(F.col("user_id").alias("uid")).agg(F.max("day").alias("first_seen"), F.max("day").alias("last_seen"), F.bool_or((F.col("event_type") == "signup") & (F.col("value") > 90)).alias("reopened"))
    return state.upsert_seen(seen, got)


@query("SELECT user_id AS uid, CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS times FROM events WHERE event_type = 'error' GROUP BY 1")
def deferred_counter(spark, sf_dir):
    held = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("user_id").alias("uid"), F.col("ts").cast("date").cast("string").alias("day"))
    counters = spark.createDataFrame([], "uid long, times long")
    for half in ("day < '2024-01-16'", "day >= '2024-01-16'"):
        counters = state.bump(counters, held.filter(half), run="day")
    return counters


@query(f"SELECT event_id FROM events WHERE NOT (ts < {_HALF} AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 96) AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 98))")
def retention_prune(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("url", F.col("event_id"))
    who = lambda kind, least: table(spark, sf_dir, "events").filter((F.col("event_type") == kind) & (F.col("value") > least)).select("user_id").distinct()
    keep = [e.join(who(*x), "user_id", "left_semi").select("url") for x in (("purchase", 96), ("signup", 98))]
    return state.prune(e, F.lit("2024-01-16").cast("timestamp"), "ts", *keep).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1998-01-01' - 1 OR o_orderdate IS NULL")
def incremental_window(spark, sf_dir):
    return state.window_since(table(spark, sf_dir, "orders"), F.lit(AS_OF), "o_orderdate").select("o_orderkey")


# Alarms.

_DAILY = "(SELECT key, day, CAST(CASE WHEN day(day) = 20 THEN 0 WHEN day(day) = 25 AND key IN ('view', 'click') THEN c // 10 ELSE c END AS INTEGER) AS n FROM (SELECT event_type AS key, CAST(ts AS DATE) AS day, count(*) FILTER (value > 40) AS c FROM events GROUP BY 1, 2))"


def _daily(spark, sf_dir):
    day = F.dayofmonth("day")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("ts").cast("date").alias("day"), "value")
    by = e.groupBy("key", "day").agg(F.count_if(F.col("value") > 40).alias("c"))
    n = F.when(day == 20, 0).when((day == 25) & F.col("key").isin("view", "click"), F.floor(F.col("c") / 10)).otherwise(F.col("c"))
    return by.select("key", "day", n.cast("int").alias("n"))


@query(f"SELECT key, day, n, CAST(coalesce(max(n) OVER w, 0) AS INTEGER) AS high, n = 0 AND coalesce(max(n) OVER w, 0) > 0 AS quiet FROM {_DAILY} WINDOW w AS (PARTITION BY key ORDER BY day RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)")
def source_quiet_alarm(spark, sf_dir):
    return alarms.source_alarms(_daily(spark, sf_dir)).select("key", "day", "n", "high", "quiet")


@query(f"SELECT key, day, n, CAST(count(n) FILTER (n > 0) OVER w AS INTEGER) AS runs, coalesce(count(n) FILTER (n > 0) OVER w >= 3 AND median(n) FILTER (n > 0) OVER w >= 10 AND n > 0 AND n * 100 < median(n) FILTER (n > 0) OVER w * 30, false) AS shrunk FROM {_DAILY} WINDOW w AS (PARTITION BY key ORDER BY day RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)")
def source_shrunk_alarm(spark, sf_dir):
    return alarms.source_alarms(_daily(spark, sf_dir)).select("key", "day", "n", "runs", "shrunk")


@query("""WITH d AS (SELECT user_id % 5 AS key, CAST(ts AS DATE) AS day, count(*) AS postings, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 95) AS spikes FROM events GROUP BY 1, 2),
  l AS (SELECT key, day, postings, 'errors' AS rate, errors AS affected FROM d UNION ALL SELECT key, day, postings, 'spikes', spikes FROM d),
  w AS (SELECT *, count(*) OVER w AS runs, median(affected / postings) OVER w AS m FROM l WINDOW w AS (PARTITION BY key, rate ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
  SELECT key, day, rate, affected FROM w WHERE postings >= 5 AND runs >= 3 AND affected > 2 * m * postings AND (m > 0 OR affected >= 5)""")
def model_health_alarm(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    daily = e.groupBy((F.col("user_id") % 5).alias("key"), F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("postings"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 95).alias("spikes"))
    return alarms.rate_alarms(daily, ["errors", "spikes"]).select("key", "day", "rate", "affected")


# Evaluation.

_ATTEMPTS = "(SELECT user_id AS c, CASE WHEN event_type = 'error' THEN 'fail' WHEN event_type = 'signup' THEN 'inconclusive' ELSE 'pass' END AS o FROM events)"
_STATES = f"(SELECT c, CASE WHEN bool_or(o = 'pass') AND bool_or(o = 'fail') THEN 'flaky' WHEN bool_or(o = 'fail') THEN 'fail' WHEN bool_or(o = 'inconclusive') THEN 'inconclusive' ELSE 'pass' END AS state, count(*) AS attempts FROM {_ATTEMPTS} GROUP BY c)"


def _attempts(spark, sf_dir):
    outcome = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "signup", "inconclusive").otherwise("pass")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("case"), outcome.alias("outcome"))


@query(f'SELECT c AS "case", state, attempts FROM {_STATES}')
def eval_case_state(spark, sf_dir):
    return evaluation.case_states(_attempts(spark, sf_dir))


@query(f"SELECT passed, conclusive, cases_passed, cases, passed / conclusive AS pass_at_1, cases_passed / cases AS pass_hat_k FROM (SELECT count(*) FILTER (o = 'pass') AS passed, count(*) FILTER (o <> 'inconclusive') AS conclusive FROM {_ATTEMPTS}), (SELECT count(*) FILTER (state = 'pass') AS cases_passed, count(*) FILTER (state <> 'inconclusive') AS cases FROM {_STATES})")
def eval_pass_at_k(spark, sf_dir):
    return evaluation.rates(_attempts(spark, sf_dir))


@query("""WITH s AS (SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS k FROM events GROUP BY 1) SELECT event_type, round((k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 9) AS low, round((k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 9) AS high FROM s""")
def eval_wilson(spark, sf_dir):
    by = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("k"))
    low, high = evaluation.wilson(F.col("k"), F.col("n"))
    return by.select("event_type", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


_SIDE = "(SELECT doc_id, CASE {0} WHEN 1 THEN 'pass' ELSE 'fail' END AS state FROM labels)"


@query(f"""SELECT coalesce(a.doc_id, b.doc_id) AS "case", CASE WHEN a.state IS NULL THEN 'only after' WHEN b.state IS NULL THEN 'only before' WHEN a.state = b.state THEN 'same' WHEN b.state = 'pass' THEN 'fixed' ELSE 'broke' END AS move FROM {_SIDE.format('quality')} a FULL JOIN {_SIDE.format('toxic')} b ON a.doc_id = b.doc_id""")
def eval_compare_moves(spark, sf_dir):
    side = lambda c: table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case"), F.when(F.col(c) == 1, "pass").otherwise("fail").alias("state"))
    return evaluation.moves(side("quality"), side("toxic")).select("case", "move")


@query("SELECT tag, state, count(*) AS n FROM (SELECT unnest([lang, source]) AS tag, CASE WHEN n_chars > 1000 THEN 'pass' ELSE 'fail' END AS state FROM documents) GROUP BY 1, 2")
def eval_tag_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.array("lang", "source").alias("tags"), F.when(F.col("n_chars") > 1000, "pass").otherwise("fail").alias("state"))
    return evaluation.by_tag(d)


# Sources and sets.


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style|noscript)\\b[^>]*>.*?</(script|style|noscript)\\s*>', ' ', 'gis'), '<(br|p|li|div|tr)\\b[^>]*>', chr(10), 'gi'), '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages""")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.html_text(F.col("html")).alias("text"))


@query("SELECT 'greenhouse' AS source, o_orderpriority AS title, 'https://jobs.example/' || o_orderkey AS url, CAST(o_orderdate AS DATE) AS posted, CAST(o_orderkey AS VARCHAR) AS raw_id FROM orders")
def board_payloads(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    job = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("https://jobs.example/"), F.col("o_orderkey")).alias("absolute_url"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("first_published"))
    # A payload for each customer's orders of a day: none grows with the table.
    payloads = o.groupBy("o_custkey", "o_orderdate").agg(F.to_json(F.struct(F.collect_list(job).alias("jobs"))).alias("payload"))
    return readers.postings(payloads, "greenhouse").select("source", "title", "url", "posted", "raw_id")


@query("SELECT DISTINCT 'documents' AS side, doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT 'both', doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels)")
def set_except_intersect(spark, sf_dir):
    d, b = table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return d.subtract(b).select(F.lit("documents").alias("side"), "doc_id").unionByName(d.intersect(b).select(F.lit("both").alias("side"), "doc_id"))


_LIMITS = postings.Limits(levels=("O", "F"), max_years=30, skip_fields=("5-LOW",), student=False, graduation_years=(1, 2, 3))
_FIT = "CAST(floor(o_totalprice / 5000) AS INTEGER)"
_FIRED = "CASE WHEN o_orderkey % 13 = 0 THEN 'hard_bar' WHEN o_orderkey % 17 = 0 AND o_orderkey % 4 = 0 THEN 'graduation_year' WHEN o_orderkey % 19 = 0 AND o_orderkey % 17 <> 0 THEN 'student_only' WHEN o_orderstatus = 'P' THEN 'level' WHEN o_custkey % 40 > 30 THEN 'years' WHEN o_orderpriority = '5-LOW' THEN 'field' END"


@query(f"""SELECT o_orderkey, rule, CASE WHEN bar = 'clearance' THEN 'blocked' WHEN rule IS NOT NULL THEN 'skip' WHEN fit >= 65 THEN 'apply' WHEN fit >= 40 THEN 'consider' ELSE 'skip' END AS verdict, CASE WHEN bar = 'clearance' THEN least(fit, 20) WHEN rule IS NOT NULL THEN least(fit, 54) ELSE fit END AS score
  FROM (SELECT o_orderkey, {_FIT} AS fit, {_FIRED} AS rule, CASE WHEN o_orderkey % 26 = 0 THEN 'clearance' END AS bar FROM orders)""")
def posting_verdicts(spark, sf_dir):
    key = F.col("o_orderkey")
    kind = F.when(key % 26 == 0, "clearance").when(key % 13 == 0, "language").otherwise("work_auth")
    facts = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.floor(F.col("o_totalprice") / 5000).cast("int").alias("fit_score"), F.col("o_orderstatus").alias("level"), (F.col("o_custkey") % 40).alias("years_required"),
        (key % 19 == 0).alias("student_only"), F.when(key % 17 == 0, key % 4 + F.when(key % 4 == 0, 9).otherwise(0)).alias("graduation_year"), F.col("o_orderpriority").alias("field"), F.array(F.struct(kind.alias("kind"), F.lit("q").alias("quote"))).alias("bars"),
    )
    return postings.verdict(facts, _LIMITS).select("o_orderkey", "rule", "verdict", "score")


FLAGSHIP = RuleSet(
    {"chars": FactType("n_chars", "integer"), "lang": FactType("lang", "enum"), "quality": FactType("quality", "integer"), "amount": FactType("amount", "number")},
    [Rule("low quality", {"quality": {"eq": 0}}, "drop"), Rule("short", {"chars": {"lt": 200}}, "drop"), Rule("large amount", {"amount": {"gt": 1000000}}, "review"), Rule("unlabelled", {"quality": {"stated": False}, "lang": {"ne": "en"}}, "review")],
    "keep",
)


@query("""SELECT outcome, rule, count(*) AS n FROM (SELECT CASE WHEN quality = 0 THEN 'drop' WHEN n_chars < 200 THEN 'drop' WHEN quality IS NULL AND lang <> 'en' THEN 'review' ELSE 'keep' END AS outcome,
  CASE WHEN quality = 0 THEN 'low quality' WHEN n_chars < 200 THEN 'short' WHEN quality IS NULL AND lang <> 'en' THEN 'unlabelled' ELSE '(default: keep)' END AS rule FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1, 2""")
def flagship(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    amount = F.array_max(X.numbers_in(F.regexp_extract("text", "total due [£$€]?([0-9][0-9,.]*)", 1)))
    return histogram(decide(docs.withColumn("amount", amount), FLAGSHIP, AS_OF), FLAGSHIP.default)
