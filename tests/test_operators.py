"""Operators on small rows of their own."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from veritab.functions import extract
from veritab.functions import text as X
from veritab.functions.similarity import matching_ratio
from veritab.operators import alarms, evaluation, guard, runs, screening
from veritab.operators.rules import FactType, Rule, RuleSet, condition, decide
from veritab.sources import readers
from veritab.streaming import state

DAY = dt.date(2026, 11, 7)


def value(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize(
    ("kind", "stated", "tests", "holds"),
    [
        ("number", 5.0, {"gt": 4}, True), ("number", 5.0, {"gt": 4, "lt": 5}, False), ("number", None, {"ne": 5}, False), ("number", None, {"stated": False}, True), ("number", None, {"stated": True}, False),
        ("number", 5.0, {"in": [4, 5]}, True), ("text", "Grey Cat", {"contains": "CAT"}, True), ("text", "Grey", {"matches": "^gr[ae]y$"}, True), ("text", None, {"matches": "."}, False),
        ("date", DAY, {"within_days": 0}, True), ("date", DAY + dt.timedelta(14), {"within_days": 14}, True), ("date", DAY + dt.timedelta(15), {"within_days": 14}, False), ("date", DAY - dt.timedelta(1), {"within_days": 3}, False),
        ("date", DAY - dt.timedelta(1), {"before_days": 0}, True), ("date", DAY, {"is": "2026-11-07"}, True), ("bool", False, {"is": False}, True), ("bool", None, {"is": False}, False),
    ],
)
def test_conditions(spark, kind, stated, tests, holds):
    types = {"number": "double", "text": "string", "date": "date", "bool": "boolean"}
    df = spark.createDataFrame([(stated,)], f"v {types[kind]}")
    assert df.select(condition(FactType("v", kind), tests, F.lit(DAY))).first()[0] is holds


@pytest.mark.parametrize(("stated", "tests", "holds"), [(["a", "b"], {"contains": "b"}, True), (["a"], {"contains": "A"}, False), (["ISO 27001"], {"matches": "27001"}, True), ([], {"matches": "."}, False), ([], {"stated": False}, True), (None, {"stated": False}, True)])
def test_list_conditions(spark, stated, tests, holds):
    df = spark.createDataFrame([(stated,)], "v array<string>")
    assert df.select(condition(FactType("v", "text", many=True), tests, F.lit(DAY))).first()[0] is holds


def test_first_rule_wins_and_bad_rules_are_refused(spark):
    facts = {"a": FactType("a", "number", quote="q")}
    rules = RuleSet(facts, [Rule("one", {"a": {"gt": 1}}, "x"), Rule("two", {"a": {"gt": 0}}, "y")], "z")
    got = decide(spark.createDataFrame([(2.0, "two"), (1.0, "one"), (None, "")], "a double, q string"), rules, DAY).collect()
    assert [(r.outcome, r.rule) for r in got] == [("x", "one"), ("y", "two"), ("z", None)]
    assert got[0].quotes == {"a": ["two"]} and got[2].quotes is None
    for when in ({"b": {"gt": 1}}, {"a": {"matches": "x"}}, {"a": {"in": 3}}):
        with pytest.raises(ValueError):
            RuleSet(facts, [Rule("r", when, "x")], "z")


def test_numbers(spark):
    texts = ["£12,500.00 due", "12 500", "40k", "-£3", "0-2 years", "1.2 million", "5 minutes", ""]
    got = value(spark, X.numbers_in(F.col("t")), [(t,) for t in texts], "t string")
    assert got == [[12500.0], [12500.0, 12.0, 500.0], [40.0, 40000.0], [-3.0], [0.0, 2.0], [1.2, 1200000.0], [5.0], []]


def test_keys(spark):
    row = spark.createDataFrame([("Acme, Ltd. | We hire", "UK, Greater Leeds Area", "Data Engineers (Remote)")], "c string, l string, t string")
    got = row.select(X.company_key(F.col("c")), X.city_key(F.col("l")), X.title_words(F.col("t"))).first()
    assert tuple(got) == ("acme", "leeds", ["data", "engineer", "remote"])


def test_whole_words(spark):
    texts = [("c++ and c",), ("cafés",), ("the caf is",), (None,)]
    assert value(spark, screening.has_term(X.fold(F.col("t")), "caf"), texts, "t string") == [False, False, True, False]
    assert value(spark, screening.has_term(X.fold(F.col("t")), "c++"), texts, "t string") == [True, False, False, False]


def test_dates_and_sentences(spark):
    assert value(spark, X.iso_date(F.col("t")), [("2026-11-07T10:00:00Z",), ("1762500000",), ("1762500000000",), ("soon",), (None,)], "t string") == [dt.date(2026, 11, 7), dt.date(2025, 11, 7), dt.date(2025, 11, 7), None, None]
    cut = value(spark, X.cut_sentence(F.col("t")), [("word " * 60,)], "t string")[0]
    assert len(cut) <= 220 and cut.endswith("word…")


def test_ratio(spark):
    assert value(spark, matching_ratio(F.col("a"), F.col("b")), [("abcd", "bcde"), (None, "x")], "a string, b string") == [0.75, 0.0]


def test_quotes(spark):
    specs = {"n": {"type": "number"}, "s": {"type": "enum", "values": ["a", "b"]}, "l": {"type": "list", "of": "text"}}
    made = lambda n, q, s="a", entries=(): json.dumps({"n": {"value": n, "quote": q}, "s": {"value": s, "quote": "a"}, "l": [{"value": x, "quote": x} for x in entries]})
    rows = [(1, made(12500, "total 12,500", entries=["total", "gone"])), (2, made(500, "total 12,500")), (3, made(1, "x", s="c")), (4, '{"n": {"value": "many", "quote": "a"}}'), (5, None)]
    df = spark.createDataFrame(rows, "id int, raw string").withColumns({"a": F.lit("A TOTAL 12,500 a"), "b": F.lit("b")})
    got = {r.id: r for r in guard.check_quotes(guard.parse_answers(df, specs), specs, ["a", "b"]).collect()}
    assert got[1].facts.n.value == 12500 and [x.value for x in got[1].facts.l] == ["total"]
    assert got[2].facts.n.value is None and got[2].facts.n.quote == ""
    assert [got[i].invalid for i in (1, 3, 4, 5)] == [False, True, True, False]


def test_breaker(spark):
    calls = spark.createDataFrame([(i, f) for i, f in enumerate([1, 1, 0, 1, 1, 1, 1])], "o int, f int")
    assert runs.breaker(calls, "o", F.col("f") == 1, 3).first().trip == 5
    assert runs.breaker(calls.limit(0), "o", F.col("f") == 1, 3).first().trip is None


def test_near_duplicates(spark):
    rows = [("1", "u1", "Acme Ltd", "Data Engineers", "London, UK", "long text"), ("2", "u2", "ACME", "Data engineer", "Greater London", "text"), ("3", "u3", "Acme", "Senior Data Engineer", "London", "x"), ("4", "u4", "", "Data Engineer", "London", "x"), ("5", "u5", "", "Data Engineer", "London", "x"), ("6", "u6", "Acme", "Data Engineer", "Leeds", "x")]
    df = spark.createDataFrame(rows, "uid string, url string, company string, title string, location string, description string")
    assert sorted(r.uid for r in screening.merge_near(df).collect()) == ["1", "3", "4", "5", "6"]


def test_state(spark, tmp_path):
    seen = state.Table(spark, str(tmp_path / "seen"), "uid string, last_seen date")
    assert seen.version() == 0 and seen.read().count() == 0
    seen.commit(spark.createDataFrame([("a", DAY - dt.timedelta(200)), ("b", DAY)], seen.schema))
    seen.commit(seen.read().unionByName(spark.createDataFrame([("c", DAY)], seen.schema)))
    scan = spark.createDataFrame([("a", "graduate programme"), ("b", "x"), ("d", "y")], "uid string, title string")
    got = state.unseen(scan, seen.read(), "uid", 120, F.lit(DAY), F.contains("title", F.lit("programme"))).collect()
    assert {(r.uid, r.days_away) for r in got} == {("a", 200), ("d", None)}
    assert seen.version() == 2


def test_stream_emits_each_key_once(spark, tmp_path):
    import shutil

    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "check"
    log = state.Log(spark, str(tmp_path / "keys"), "uid string, last_seen date")

    def run():
        state.emit_once(spark.readStream.schema("uid string").parquet(source), "uid", out, str(check), log, DAY).start().awaitTermination(120)

    for batch in ([("a",), ("b",), ("a",)], [("b",), ("c",)]):
        spark.createDataFrame(batch, "uid string").coalesce(1).write.mode("append").parquet(source)
        run()
    assert sorted(r.uid for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    # The last batch again, as after a crash between the log and Spark's own commit.
    for f in (check / "commits").glob("*1"):
        f.unlink()
    for f in (check / "commits").glob(".1*"):
        f.unlink()
    run()
    assert sorted(r.uid for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    # All batches from the beginning.
    shutil.rmtree(check)
    run()
    assert sorted({r.uid for r in spark.read.parquet(out).collect()}) == ["a", "b", "c"]
    assert sorted(r.uid for r in log.read().collect()).count("a") == 1


def test_alarms(spark):
    rows = [("s", DAY + dt.timedelta(i), n) for i, n in enumerate([20, 20, 20, 6, 5, 0])]
    got = alarms.source_alarms(spark.createDataFrame(rows, "key string, day date, n int")).orderBy("day").collect()
    assert [r.shrunk for r in got] == [False, False, False, False, True, False]
    assert [r.quiet for r in got] == [False] * 5 + [True]


def test_wilson_and_moves(spark):
    low, high = evaluation.wilson(F.col("k"), F.col("n"))
    got = spark.createDataFrame([(32, 32), (0, 0)], "k int, n int").select(low, high).collect()
    assert [round(x, 3) for x in got[0]] == [0.893, 1.0] and tuple(got[1]) == (0.0, 0.0)
    before = spark.createDataFrame([("a", "fail"), ("b", "pass"), ("c", "flaky"), ("d", "pass")], "case string, state string")
    after = spark.createDataFrame([("a", "pass"), ("b", "fail"), ("c", "pass"), ("e", "pass")], "case string, state string")
    assert {r.case: r.move for r in evaluation.moves(before, after).collect()} == {"a": "fixed", "b": "broke", "c": "noise", "d": "only before", "e": "only after"}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,body\n1,x\n".encode())
    assert readers.read_csv(spark, str(tmp_path / "a.csv")).first().asDict() == {"id": "1", "body": "x"}
    (tmp_path / "d").mkdir()
    (tmp_path / "d/one.txt").write_text("hello")
    (tmp_path / "d/two.md").write_text("there")
    (tmp_path / "d/no.bin").write_text("x")
    assert sorted(map(tuple, readers.read_folder(spark, str(tmp_path / "d")).collect())) == [("one", "hello"), ("two", "there")]
    (tmp_path / "r.jsonl").write_text('{"id": "1", "raw": {"v": 1}}\n\n{"id": "1", "raw": {"v": 2}}\n')
    answers = runs.last_answers(readers.read_answers(spark, str(tmp_path / "r.jsonl"))).collect()
    assert [(r.id, json.loads(r.raw)) for r in answers] == [("1", {"v": 2})]
    with pytest.raises(ValueError):
        readers.unique_ids(spark.createDataFrame([("a",), ("a",)], "id string"))
    made = readers.items(spark.createDataFrame([(1, None, "s")], "k int, body string, src string"), "k", ["body"], ["src"]).first()
    assert made.id == "1" and made.fields[0].text == "" and made.meta == {"src": "s"}


def test_boards(spark):
    payload = json.dumps({"content": [{"id": 7, "name": "Clerk", "ref": "u", "location": {"city": "Oslo", "country": "no", "remote": True}, "releasedDate": "2026-01-02T00:00:00Z"}, {"id": 8, "name": ""}]})
    got = readers.postings(spark.createDataFrame([(payload,)], "payload string"), "smartrecruiters", F.lit("Co")).collect()
    assert [(r.company, r.title, r.location, r.posted, r.remote, r.raw_id) for r in got] == [("Co", "Clerk", "Oslo, no", dt.date(2026, 1, 2), True, "7")]
    xml = "<urlset><url><loc> u1 </loc><lastmod>2026-01-02T03:04</lastmod></url><url><loc>u2</loc></url>"
    assert [tuple(x) for x in value(spark, readers.sitemap(F.col("x")), [(xml,)], "x string")[0]] == [("u1", dt.date(2026, 1, 2)), ("u2", None)]
