"""Commands end to end, in one session."""

import json

from pyspark.sql import functions as F

from veritab.__main__ import main
from veritab.sources import fetching

JOBS = [("Acme", "Data Clerk", "Oslo", "http://x/1"), ("Beta", "Cook", "Rome", "http://x/2"), ("Acme", "Data Lead", "Oslo", "http://x/3")]


def board(spark, entry, mark):
    if entry.slug == "down":
        raise OSError("no route")
    df = spark.createDataFrame(JOBS, "company string, title string, location string, url string")
    return df.select(F.lit("fake:x").alias("source"), "company", "title", "location", "url", F.lit("text").alias("description"), F.lit(None).cast("date").alias("posted"), F.lit(False).alias("remote"), F.col("url").alias("raw_id"))


def test_scan_marks_and_state(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setitem(fetching.SOURCES, "fake", board)
    config, store, out = tmp_path / "scan.yaml", str(tmp_path / "state"), tmp_path / "out"
    config.write_text("sources:\n- {kind: fake, slug: x}\n- {kind: fake, slug: down}\nprofile: {keywords: {data: 10}, least_score: 5}\noutput: {most: 1}\n")
    assert main(["scan", str(config), store, "--out", str(out), "--dry"]) == 0 and not out.exists()
    assert main(["scan", str(config), store, "--out", str(out)]) == 0
    assert "fake:down:: OSError: no route" in capsys.readouterr().out and "1 to read" in (out / "report.md").read_text()
    assert "Data" in (out / "report.html").read_text()
    # What was capped comes again; what was shown or too low doesn't.
    assert main(["scan", str(config), store, "--out", str(out)]) == 0
    assert "1 to read" in (out / "report.md").read_text()
    assert main(["scan", str(config), store, "--out", str(out)]) == 0
    assert "0 to read" in (out / "report.md").read_text()
    capsys.readouterr()
    assert main(["stats", store]) == 0 and "seen\t3" in capsys.readouterr().out
    assert main(["mark", store, "http://x/9", "applied", "--title", "T"]) == 0 and main(["show", store, "--marks"]) == 0
    assert "http://x/9\tapplied" in capsys.readouterr().out
    assert main(["show", store]) == 0
    uid = capsys.readouterr().out.split("\t")[0]
    assert main(["unsee", store, uid]) == 0 and main(["stats", store]) == 0 and "seen\t2" in capsys.readouterr().out
    assert main(["prune", store, "--days", "1"]) == 0 and "0 removed" in capsys.readouterr().out
    assert main(["backup", store, str(tmp_path / "copies"), "--keep", "2"]) == 0
    assert main(["sources", str(config)]) == 1 and "FAIL" in capsys.readouterr().out
    (tmp_path / "state" / "LOCK").write_text("")
    assert main(["unsee", store, uid]) == 4
    config.write_text("sources: 5")
    assert main(["scan", str(config), store, "--out", str(out)]) == 2


def test_projects_from_init_to_compare(spark, tmp_path, capsys):
    folder = tmp_path / "p"
    assert main(["init", str(folder)]) == 0 and main(["init", str(folder)]) == 2
    project = str(folder / "project.yaml")
    assert main(["check", project]) == 0 and "outcomes pay, review" in capsys.readouterr().out
    case = {"id": "a", "text": "Total due: 1200", "expect": {"outcome": "review"}, "model_facts": {"total": {"value": 1200, "quote": "due: 1200"}}}
    cases, saved = folder / "cases.yaml", [str(folder / "one"), str(folder / "two")]
    cases.write_text(json.dumps([case]))
    assert main(["eval", project, "--cases", str(cases), "--save", saved[0]]) == 0
    cases.write_text(json.dumps([case | {"model_facts": {"total": {"value": 5, "quote": "due: 1200"}}}]))
    assert main(["eval", project, "--cases", str(cases), "--save", saved[1]]) == 1
    capsys.readouterr()
    assert main(["compare", *saved]) == 1 and "| broke | 1 | a |" in capsys.readouterr().out
    assert main(["regrade", project, saved[0], "--cases", str(cases)]) == 0
    assert main(["backends"]) == 0 and "chat" in capsys.readouterr().out
    boards = tmp_path / "boards"
    boards.mkdir()
    (boards / "lever.json").write_text('["acme", "beta"]')
    assert main(["slugs", str(boards), "Acme"]) == 0 and "acme" in capsys.readouterr().out
