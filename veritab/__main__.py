"""Commands over a project file, and over a scan's configuration and state.

Exit codes: 0 fine; 1 some item or case failed, or every source did; 2 the
project or configuration is wrong; 3 a model's scoring failed as a whole;
4 another run holds the state.
"""

from __future__ import annotations

import argparse
import datetime as dt
import os
import sys

TEMPLATE = """name: example
items: {jsonl: items.jsonl, id: id, fields: [text]}
facts:
  total: {type: number, describe: the amount that is due}
rules:
- {name: large, when: {total: {gt: 1000}}, then: review}
default_outcome: pay
"""
SEEN = "uid string, first_seen date, last_seen date"
MARKS = "url string, state string, company string, title string"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="veritab")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *positional: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        for x in positional:
            p.add_argument(x)
        return p

    command("init", "write an example project", "folder")
    for name, text in (("check", "check a project"), ("run", "decide its items from recorded answers"), ("eval", "grade its cases")):
        p = command(name, text, "project")
        p.add_argument("--as-of", type=dt.date.fromisoformat, default=dt.date.today())
        if name == "run":
            p.add_argument("--answers", required=True, help="recorded answers: JSON lines of id and raw")
            p.add_argument("--out", required=True, help="folder for the results")
        if name == "eval":
            p.add_argument("--cases", required=True, nargs="+", help="JSON lines or YAML")
            p.add_argument("--heldout", nargs="*", default=[])
            p.add_argument("--save", help="folder for the run: attempts, what it was, its report")
    p = command("regrade", "grade saved attempts by the cases as they are now", "project", "saved")
    p.add_argument("--cases", required=True, nargs="+")
    p.add_argument("--as-of", type=dt.date.fromisoformat, default=dt.date.today())
    command("compare", "how cases moved between two saved runs", "before", "after")
    p = command("scan", "read all sources, drop what is known, and report", "config", "state")
    p.add_argument("--out", required=True, help="folder for the report's rows and its Markdown and HTML")
    p.add_argument("--dry", action="store_true", help="write nothing")
    command("sources", "look at each source", "config")
    p = command("show", "what the state holds", "state")
    p.add_argument("--marks", action="store_true")
    command("stats", "rows of each table of the state", "state")
    p = command("mark", "note what became of a posting", "state", "url", "mark")
    p.add_argument("--company", default="")
    p.add_argument("--title", default="")
    command("unsee", "let a posting come again", "state", "uid")
    p = command("prune", "drop what was last seen long ago", "state")
    p.add_argument("--days", type=int, required=True)
    p = command("backup", "copy the state", "state", "folder")
    p.add_argument("--keep", type=int, default=7)
    command("slugs", "search a directory of boards", "directory", "name")
    p = command("backends", "known backends, and whether one answers")
    p.add_argument("--url")
    p.add_argument("--model", default="")
    return top


def session(name: str):
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName(f"veritab {name}").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from .streaming.state import Locked

    try:
        return COMMANDS[a.command](a)
    except Locked as e:
        print(e, file=sys.stderr)
        return 4
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2


def init(a) -> int:
    path = os.path.join(a.folder, "project.yaml")
    if os.path.exists(path):
        raise ValueError(f"{path} is there already")
    os.makedirs(a.folder, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(TEMPLATE)
    with open(os.path.join(a.folder, "items.jsonl"), "w", encoding="utf-8") as f:
        f.write('{"id": "1", "text": "Total due: 1200"}\n')
    print(path)
    return 0


def check(a) -> int:
    from .plans import project as P

    project = P.load(a.project)
    print(f"{project.name}: {len(project.specs)} facts, {len(project.rules.rules)} rules, outcomes {', '.join(sorted(project.rules.outcomes))}")
    return 0


def run(a) -> int:
    from .plans import project as P
    from .sources import readers

    project, spark = P.load(a.project), session("run")
    P.run_project(project, P.read_items(spark, project), readers.read_answers(spark, a.answers), a.as_of).write.mode("overwrite").parquet(a.out)
    results = spark.read.parquet(a.out)
    print(P.summary(project, results))
    return 1 if results.filter("status = 'error'").head(1) else 0


def evaluate(a) -> int:
    from .operators import grading
    from .plans import project as P

    project, spark = P.load(a.project), session("eval")
    cases = grading.check_cases(grading.load_cases(spark, a.cases, project.texts, a.heldout), project.specs, project.rules.outcomes)
    graded = grading.offline(cases, project, a.as_of).persist()
    states = grading.report(graded)
    page = grading.report_markdown(project.name, states)
    if a.save:
        grading.save_run(spark, a.save, graded.selectExpr("id", "0 AS attempt", "model_facts AS raw", "result"), {"project": project.name, "as_of": a.as_of}, page)
    print(page)
    return 1 if grading.unexpected(states, cases).head(1) else 0


def regrade(a) -> int:
    from .operators import grading
    from .plans import project as P

    project, spark = P.load(a.project), session("regrade")
    cases = grading.load_cases(spark, a.cases, project.texts)
    states = grading.report(grading.regrade(spark.read.schema("id string, attempt int, raw string").json(f"{a.saved}/attempts"), cases, project, a.as_of))
    print(grading.report_markdown(project.name, states))
    return 1 if grading.unexpected(states, cases).head(1) else 0


def compare(a) -> int:
    from .operators import evaluation, grading

    spark = session("compare")
    runs = [evaluation.case_states(spark.read.schema("id string, attempt int, result string").json(f"{x}/attempts"), "id", "result") for x in (a.before, a.after)]
    moves = evaluation.moves(*runs, case="id").withColumnRenamed("id", "case").persist()
    print(grading.compare_markdown(moves))
    return 1 if moves.filter("move = 'broke'").head(1) else 0


def scan(a) -> int:
    from pyspark.sql import functions as F

    from .functions.text import short_hash
    from .operators import digest, ranking, screening
    from .sources import connectors, fetching, paging  # noqa: F401
    from .streaming import state

    config, spark = fetching.load_config(a.config), session("scan")
    profile, output = config.get("profile") or {}, config.get("output") or {}
    reports, jobs = fetching.fetch_all(spark, [{"kind": e.kind, "slug": e.slug, "label": e.label, **e.options} for e in config["sources"]])
    status = paging.source_reports(reports.select("source_key", "error", "skipped"), jobs).orderBy("source_key").collect()
    jobs = screening.merge_near(jobs.withColumn("uid", short_hash(F.col("company"), F.col("title"), F.col("location"))).dropDuplicates(["uid", "url"]))
    seen = state.Table(spark, f"{a.state}/seen", SEEN)
    marks = state.Table(spark, f"{a.state}/marks", MARKS)
    fresh = state.undismissed(state.unseen(jobs, seen.read()), marks.read())
    scored = screening.keyword_score(fresh, screening.Profile(profile.get("keywords") or {}, profile.get("blockers") or {}, locations=tuple(profile.get("locations") or ())))
    judged = ranking.keyed(scored.select("uid", "url", "title", "company", F.xxhash64("uid").alias("ordinal"), F.col("keyword_score").alias("score"), F.lit("consider").alias("verdict"), "blocker_hits", F.lit(None).cast("string").alias("deferred"), F.lit("").alias("reason"))).persist()
    placed = ranking.shown(judged, int(profile.get("least_score", 0)), int(output.get("most", 50))).persist()
    none = judged.limit(0).select(F.lit("").alias("group"), F.lit(0).alias("in_group"), "title", "url", "company", "reason")
    alarms = [f"{r.source_key}: {r.error or r.status}" for r in status if r.status != "OK"]
    if not a.dry:
        os.makedirs(a.out, exist_ok=True)
        for name, page in (("report.md", ranking.digest("Scan", placed, none, alarms)), ("report.html", digest.html("Scan", placed, none, alarms))):
            with open(os.path.join(a.out, name), "w", encoding="utf-8") as f:
                f.write(page)
        today = F.current_date()
        recorded = judged.join(placed.filter("deferred is not null").select("uid"), "uid", "left_anti").select("uid", today.alias("first_seen"), today.alias("last_seen"), F.lit(False).alias("reopened")).dropDuplicates(["uid"])
        with state.run_lock(spark, a.state):
            state.record_scan(seen, placed, recorded, f"{a.out}/rows")
    print(judged.agg(ranking.run_note(F.count("*"), F.lit(placed.filter("place is not null").count()), F.lit(placed.filter("deferred is not null").count()), F.lit(0))).first()[0])
    print("\n".join(alarms))
    return 1 if status and all(r.status == "FAIL" for r in status) else 0


def sources(a) -> int:
    from .sources import connectors, fetching, paging  # noqa: F401

    config, spark = fetching.load_config(a.config), session("sources")
    reports, jobs = fetching.fetch_all(spark, [{"kind": e.kind, "slug": e.slug, "label": e.label, **e.options} for e in config["sources"]])
    rows = paging.source_reports(reports.select("source_key", "error", "skipped"), jobs).orderBy("source_key").collect()
    print("\n".join(f"{r.status}\t{r.source_key}\t{r.n}\t{r.error or ''}" for r in rows))
    return 1 if any(r.status == "FAIL" for r in rows) else 0


def _tables(a):
    from .streaming import state

    spark = session(a.command)
    return state.Table(spark, f"{a.state}/seen", SEEN), state.Table(spark, f"{a.state}/marks", MARKS)


def show(a) -> int:
    from pyspark.sql import functions as F

    seen, marks = _tables(a)
    for r in (marks.read().orderBy("url") if a.marks else seen.read().orderBy(F.desc("last_seen"), "uid")).limit(200).collect():
        print("\t".join(str(x) for x in r))
    return 0


def stats(a) -> int:
    for table in _tables(a):
        print(f"{table.path.rsplit('/', 1)[1]}\t{table.read().count()}\tversion {table.version()}")
    return 0


def mark(a) -> int:
    from .streaming import state

    _, marks = _tables(a)
    with state.run_lock(marks.spark, a.state):
        marks.put(marks.spark.createDataFrame([(a.url, a.mark, a.company, a.title)], MARKS), ["url"])
    return 0


def unsee(a) -> int:
    from .streaming import state

    seen, _ = _tables(a)
    with state.run_lock(seen.spark, a.state):
        seen.commit(seen.read().filter(f"uid <> '{a.uid.replace(chr(39), '')}'"))
    return 0


def prune(a) -> int:
    from pyspark.sql import functions as F

    from .streaming import state

    seen, _ = _tables(a)
    with state.run_lock(seen.spark, a.state):
        before = seen.read()
        kept = before.filter(F.col("last_seen") >= F.date_sub(F.current_date(), a.days))
        print(f"seen: {state.prune_report({'seen': before}, {'seen': kept}).first().removed} removed")
        seen.commit(kept)
    return 0


def backup(a) -> int:
    from .streaming import state

    for table in _tables(a):
        print(", ".join(state.backup(table, f"{a.folder}/{table.path.rsplit('/', 1)[1]}", dt.date.today(), a.keep)))
    return 0


def slugs(a) -> int:
    from .sources import directory

    spark = session("slugs")
    for r in directory.search(directory.read_directory(spark, a.directory), [a.name]).collect():
        print("\t".join(str(x) for x in r))
    return 0


def backends(a) -> int:
    from .operators import judging

    print(", ".join(sorted(judging.BACKENDS)))
    why = judging.status(judging.chat_backend(a.url, a.model)) if a.url else ""
    print(why or ("answers" if a.url else ""))
    return 3 if why else 0


COMMANDS = {f.__name__: f for f in (init, check, run, regrade, compare, scan, sources, show, stats, mark, unsee, prune, backup, slugs, backends)} | {"eval": evaluate}

if __name__ == "__main__":
    sys.exit(main())
