"""A project file end to end: items, recorded answers, decisions, graded cases."""

import datetime as dt
import json
import textwrap

import pytest

from veritab.__main__ import main
from veritab.operators import grading
from veritab.plans import project as P
from veritab.sources import readers

YAML = """
name: refunds
items: {jsonl: items.jsonl, id: id, fields: [subject, body]}
prefilter: {require_any: [refund], exclude_any: [spam]}
facts:
  amount: {type: number}
  reason: {type: enum, values: [late, broken]}
  due: {type: date}
  tags: {type: list, of: text}
rules:
  - {name: big, when: {amount: {gt: 100}}, then: review}
  - {name: late, when: {reason: {is: late}, due: {before_days: 0}}, then: pay}
default_outcome: wait
dangerous: [{expected: review, got: pay}]
resolvers: ["fixes:halve"]
model: {max_calls: 4}
"""
FIXES = """
from pyspark.sql import functions as F

def halve(df):
    return df
"""
AS_OF = dt.date(2026, 5, 1)


def fact(value, quote):
    return {"value": value, "quote": quote}


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "project.yaml").write_text(YAML)
    (tmp_path / "fixes.py").write_text(FIXES)
    items = [("a", "Refund", "pay 120.00 now"), ("b", "Refund", "it came late, due 2 April 2026"), ("c", "Hello", "nothing"), ("d", "refund", "no answer"), ("e", "refund", "bad answer"), ("f", "refund", "beyond the ceiling")]
    (tmp_path / "items.jsonl").write_text("".join(json.dumps({"id": i, "subject": s, "body": b}) + "\n" for i, s, b in items))
    answers = [("a", {"amount": fact(7, "7")}), ("a", {"amount": fact(120, "pay 120.00")}), ("b", {"reason": fact("late", "came late"), "due": fact("2026-04-02", "due 2 April 2026")}), ("e", {"reason": fact("lost", "bad")})]
    (tmp_path / "answers.jsonl").write_text("".join(json.dumps({"id": i, "raw": r}) + "\n" for i, r in answers))
    return tmp_path


def test_run(spark, folder):
    project = P.load(str(folder / "project.yaml"))
    done = P.run_project(project, P.read_items(spark, project), readers.read_answers(spark, str(folder / "answers.jsonl")), AS_OF).cache()
    got = {r.id: (r.status, r.outcome, r.rule) for r in done.collect()}
    assert got == {"a": ("decided", "review", "big"), "b": ("decided", "pay", "late"), "c": ("filtered", None, None), "d": ("error", None, None), "e": ("error", None, None), "f": ("deferred", None, None)}
    text = P.summary(project, done)
    assert "6 items: 2 decided, 1 filtered, 1 deferred, 2 errors." in text and "| late | 1 |" in text and "| error | no recorded answer | 1 | d |" in text


@pytest.mark.parametrize(
    "old,new,says",
    [("gt: 100", "gt: ten", "number"), ("is: late", "is: lost", "none of its values"), ("{type: date}", "{type: day}", "no type"), ("got: pay", "got: lose", "no outcome"), ("jsonl: items.jsonl, id", "id", "one reader"), ("name: refunds", "title: refunds", "unknown title"), ("before_days: 0", "before_days: -1", "whole days"), ("fixes:halve", "fixes:none", "no such function")],
)
def test_wrong_projects(folder, old, new, says):
    path = folder / "project.yaml"
    path.write_text(YAML.replace(old, new))
    with pytest.raises(P.ProjectError, match=says):
        P.load(str(path))
    assert main(["check", str(path)]) == 2


CASES = """
# a comment
{"id": "big", "text": "t", "fields": {"subject": "refund", "body": "pay 120"}, "expect": {"facts": {"amount": {"gt": 100, "in": [1, 120]}}, "outcome": "review"}, "model_facts": {"amount": {"value": 120, "quote": "pay 120"}}, "tags": ["x", "y"]}
{"id": "unquoted", "text": "pay 12", "expect": {"facts": {"amount": {"stated": true}}}, "model_facts": {"amount": {"value": 120, "quote": "pay 12"}}, "tags": ["x"]}
{"id": "danger", "text": "came late by 2 April 2026", "expect": {"outcome": "review"}, "as_of": "2027-01-01", "model_facts": {"reason": {"value": "late", "quote": "late"}, "due": {"value": "2026-04-02", "quote": "2 April 2026"}}}
{"id": "list", "text": "red and Blue", "expect": {"facts": {"tags": {"contains": "red", "matches": "^BL"}, "amount": {"stated": false}}}, "model_facts": {"tags": [{"value": "red", "quote": "red"}, {"value": "blue", "quote": "blue"}, {"value": "green", "quote": "green"}]}}
{"id": "none", "text": "x", "expect": {"outcome": "wait"}}
"""


def test_cases(spark, folder):
    project = P.load(str(folder / "project.yaml"))
    (folder / "cases.jsonl").write_text(CASES)
    cases = grading.check_cases(grading.read_cases(spark, str(folder / "cases.jsonl"), project.texts), project.specs, project.rules.outcomes)
    graded = grading.offline(cases, project, AS_OF).cache()
    got = {r.id: (r.result, r.fact_misses, r.outcome_miss, r.dangerous) for r in graded.collect()}
    assert got == {"big": ("pass", [], None, False), "unquoted": ("fail", ["amount"], None, False), "danger": ("fail", [], "pay", True), "list": ("pass", [], None, False), "none": ("inconclusive", [], None, False)}
    states = grading.report(graded).cache()
    assert {r.id: r.state for r in states.collect()} == {"big": "pass", "unquoted": "fail", "danger": "fail", "list": "pass", "none": "inconclusive"}
    text = grading.report_markdown("refunds", states)
    assert "Dangerous: danger" in text and "| x | 1 | 1 | 0 | 0 |" in text
    attempts = cases.selectExpr("id", "1 attempt", "model_facts raw").unionByName(cases.filter("id = 'big'").selectExpr("id", "2 attempt", "'{}' raw"))
    again = {r.id: (r.state, r.facts_changed) for r in grading.report(grading.regrade(attempts, cases, project, AS_OF)).collect()}
    assert again["big"] == ("flaky", True) and again["list"] == ("pass", False)


@pytest.mark.parametrize("line,says", [('{"text": "x", "expect": {"outcome": "pay"}}', "needs an id"), ('{"id": "n", "text": "x", "expect": {"outcome": "lose"}}', "unknown outcome"), ('{"id": "n", "text": "x"}', "nothing to grade"), ('{"id": "n", "text": "x", "expect": {"facts": {"amount": {"matches": "x"}}}}', "unknown fact or operator"), ('{"id": "big", "text": "x", "expect": {"outcome": "pay"}}', "stands at")])
def test_wrong_cases(spark, folder, line, says):
    project = P.load(str(folder / "project.yaml"))
    (folder / "cases.jsonl").write_text(textwrap.dedent(CASES) + line + "\n")
    with pytest.raises(ValueError, match=says):
        grading.check_cases(grading.read_cases(spark, str(folder / "cases.jsonl"), project.texts), project.specs, project.rules.outcomes)


def test_commands(spark, folder, capsys):
    p = str(folder / "project.yaml")
    assert main(["check", p]) == 0
    assert main(["run", p, "--as-of", "2026-05-01", "--answers", str(folder / "answers.jsonl"), "--out", str(folder / "out")]) == 1
    (folder / "cases.jsonl").write_text(CASES)
    assert main(["eval", p, "--as-of", "2026-05-01", "--cases", str(folder / "cases.jsonl")]) == 1
    assert "# refunds" in capsys.readouterr().out
