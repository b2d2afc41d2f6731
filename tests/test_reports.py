"""Ranking, hidden rows, reports, keyed state, and the directory of boards."""

import json

from pyspark.sql import functions as F

from veritab.operators import ranking as K
from veritab.sources import directory as D
from veritab.streaming import state

JUDGED = "uid string, ordinal int, title string, company string, url string, score int, verdict string, rule string, blocker_hits array<string>, deferred string"


def judged(spark):
    rows = [("a", 1, "A", "x", "http://a", 90, "apply", None, [], None), ("b", 2, "B*", "x", "javascript:b", 80, "apply", None, [], None), ("c", 3, "C", "y", "http://c", 80, "apply", None, [], "llm_ceiling"), ("d", 4, "D", "y", "http://d", 95, "blocked", "hard_bar", [], None), ("e", 5, "E", "z", "http://e", 10, "skip", None, ["no visa"], None), ("f", 6, "F", "z", "http://f", 10, "skip", None, None, None)]
    return K.keyed(spark.createDataFrame(rows, JUDGED))


def test_shown(spark):
    got = {r.uid: (r.place, r.deferred) for r in K.shown(judged(spark), 50, 1).collect()}
    assert got == {"a": (1, None), "b": (None, "digest_cap"), "c": (None, "llm_ceiling")}
    blocked = K.shown(judged(spark), 50, 9, show_blocked=True).orderBy("place").collect()
    assert [r.uid for r in blocked] == ["a", "b", "c", "d"]
    assert K.shown(judged(spark).limit(0), 50, 1).count() == 0
    assert K.outcome_counts(judged(spark), 50).first().asDict() == {"judged": 6, "deferred": 1, "caught": 2, "below": 1, "reportable": 2}


def test_hidden(spark):
    rows = [("rule", "r", "skip", ["t"], 9, ["x"], "why"), ("block", None, "blocked", [], 9, [], "why"), ("term", None, "skip", ["t", "t"], 9, [], ""), ("pushed", None, None, None, 9, ["x", "agency"], ""), ("near", None, None, None, 9, [], ""), ("far", None, None, None, 1, [], "")]
    df = spark.createDataFrame(rows, "id string, rule string, verdict string, hits array<string>, score int, penalties array<string>, reason string")
    group = K.hidden_as(F.col("rule"), F.col("verdict"), F.col("hits"), F.col("score"), K.charged(F.col("penalties"), {"x": 5}), 12, 4)
    df = df.withColumn("group", group).withColumn("why", K.hidden_reason(F.col("group"), F.col("reason"), F.col("hits"), F.col("penalties"), F.col("score"), 12))
    assert {r.id: (r.group, r.why) for r in df.collect()} == {"rule": ("r", "why"), "block": ("hard_bar", "why"), "term": ("terms", 'blocked by "t"'), "pushed": ("blockers", 'pushed under the gate by "x"'), "near": ("gate", "scored 9, gate 12"), "far": (None, "")}


def test_digest(spark):
    hidden = judged(spark).filter("uid in ('d', 'e')").select(F.when(F.col("uid") == "d", "hard_bar").otherwise("terms").alias("group"), F.lit("why").alias("reason"), "score", "company", "title", "url")
    listed = K.hidden_list(hidden, 1, ["terms", "hard_bar"])
    text = K.digest("Today", K.shown(judged(spark), 50, 2), listed, ["one | source"])
    assert "- one \\| source" in text and "1. [A](http://a), x (90, apply)" in text and "2. B\\*, x" in text and "[D](http://d), y: why" in text and "[E]" not in text
    cards = spark.createDataFrame([(1, 50, 5), (2, 50, 5), (3, 10, 5), (4, 1, 60)], "place int, full_bytes int, line_bytes int")
    assert [r.form for r in K.within_budget(cards, 60).orderBy("place").collect()] == ["full", "line", "line", "left out"]


def test_directory(spark):
    files = [("/x/greenhouse_a.json", json.dumps(["acme", {"slug": "beta", "name": "Beta Ltd"}, {"name": "no slug"}])), ("/x/lever.json", json.dumps({"data": {"octoenergy": "Octopus Energy", "zed": {"company": "Zed"}}})), ("/x/workday.json", json.dumps(["ten|wd3|Site", "ten|wd5|Other", "a|b"])), ("/x/greenhouse_b.json", json.dumps([{"token": "acme", "name": "Acme"}])), ("/x/other.json", "[]"), ("/x/ashby.json", "{broken")]
    entries = D.index(spark.createDataFrame(files, "file string, payload string")).cache()
    got = sorted((r.kind, r.slug, r.name, r.site, r.host) for r in entries.collect())
    assert got == [("greenhouse", "acme", "Acme", "", ""), ("greenhouse", "beta", "Beta Ltd", "", ""), ("lever", "octoenergy", "Octopus Energy", "", ""), ("lever", "zed", "Zed", "", ""), ("workday", "a|b", "", "", ""), ("workday", "ten", "", "Other", "wd5"), ("workday", "ten", "", "Site", "wd3")]
    hits = {(r.asked, r.slug): round(r.score, 2) for r in D.search(entries, ["Octopus Energy", "BETA", "Beta Limited", "zedd", "the"]).collect()}
    assert hits == {("Octopus Energy", "octoenergy"): 0.99, ("BETA", "beta"): 1.0, ("Beta Limited", "beta"): 0.97, ("zedd", "zed"): 0.84}


def test_merge_and_marks(spark):
    schema = "url string, state string, company string, title string, updated int"
    old = spark.createDataFrame([("u1", "saved", "Acme", "Clerk", 1), ("u2", "applied", "B", "T", 1), (None, "saved", "", "", 1)], schema)
    new = spark.createDataFrame([("u1", "dismissed", "", None, 3), ("u1", "saved", "Other", "X", 2), ("u3", "saved", None, "", 2), (None, "applied", "N", "", 2)], schema)
    posts = spark.createDataFrame([("u3", "Co", "Job")], "url string, company string, title string")
    got = {r.url: (r.state, r.company, r.title, r.updated) for r in state.mark(old, new, posts).collect()}
    assert got == {"u1": ("dismissed", "Acme", "Clerk", 3), "u2": ("applied", "B", "T", 1), "u3": ("saved", "Co", "Job", 2), None: ("applied", "N", "", 2)}
    assert [r.url for r in state.shortlist(state.mark(old, new, posts)).collect()] == [None, "u3", "u2"]
    seen = spark.createDataFrame([("x", "u1"), ("y", None), ("z", "u2")], "uid string, url string")
    assert [r.uid for r in state.unsee(state.unsee(seen, "u1"), "z").collect()] == ["y"]


def test_counters_marks_backups(spark):
    held = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 2)], "uid string, run int")
    counters = state.bump(spark.createDataFrame([("b", 4)], "uid string, times long"), held, run="run")
    assert {r.uid: r.times for r in counters.collect()} == {"a": 2, "b": 5}
    assert [r.uid for r in state.forget(counters, held.filter("uid = 'a'")).collect()] == ["b"]
    thin = spark.createDataFrame([("a",), ("b",), ("c",)], "uid string")
    assert {r.uid: r.unread for r in state.held_thin(thin, counters, after=4).collect()} == {"a": False, "b": True, "c": False}
    marks = spark.createDataFrame([("s", 1, "x"), ("t", 1, "x"), ("u", 1, "x"), ("v", 1, "x")], "source_key string, since int, shape string")
    reads = spark.createDataFrame([("s", 5, "x", True, 0, 0, False), ("t", 5, "x", True, 1, 0, False), ("u", 5, "y", False, 0, 0, False), ("w", 5, "y", True, None, None, None)], "source_key string, started int, shape string, whole boolean, unreachable int, deferred int, failed boolean")
    assert {r.source_key: (r.since, r.shape) for r in state.next_marks(marks, reads).collect()} == {"s": (5, "x"), "t": (1, "x"), "v": (1, "x"), "w": (5, "y")}
    assert [r.made for r in state.rotate(spark.range(1, 6).withColumnRenamed("id", "made"), 2).orderBy("made").collect()] == [1, 2, 3]
