"""Grading: expectations are data, one set for each case, so they are compared as columns and not compiled case by case."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .guard import check_quotes, parse_answers
from .rules import decide

CASE = "id string, text string, fields map<string,string>, tags array<string>, expect struct<facts: map<string, map<string, string>>, outcome: string>, model_facts string, as_of date, offline_only boolean, note string, open_defect string"


def read_cases(spark: SparkSession, path: str, texts: list[str], heldout: bool = False) -> DataFrame:
    """Cases of JSON lines (# begins a comment): id, texts, tags, expect, model_facts, as_of, heldout, source (file:line). `text` stands for the first field. A line that is no JSON is an error that names it."""
    lines = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    lines = lines.filter((F.trim("line") != "") & ~F.startswith(F.ltrim("line"), F.lit("#"))).withColumn("source", F.concat_ws(":", "file", F.col("at") + 1))
    return _cases(lines, texts, heldout)


def _cases(lines: DataFrame, texts: list[str], heldout: bool) -> DataFrame:
    df = lines.withColumn("c", F.from_json("line", CASE)).select("source", "c.*")
    text = lambda i, t: F.coalesce(F.col("fields")[t], F.col("text") if i == 0 else F.lit(""), F.lit(""))
    return df.select("id", *[text(i, t).alias(t) for i, t in enumerate(texts)], F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "expect", "model_facts", "as_of", F.coalesce("open_defect", F.lit("")).alias("open_defect"), F.coalesce("offline_only", F.lit(False)).alias("offline_only"), F.lit(heldout).alias("heldout"), "source")


def read_yaml_cases(spark: SparkSession, path: str, texts: list[str], heldout: bool = False) -> DataFrame:
    """read_cases() of a YAML file: a list of cases, or a mapping with one under `cases`; source names the line on which a case begins. Graded cases are written by hand, so a file of them is read on the driver."""
    import json

    import yaml

    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        data, node = yaml.safe_load(text) or [], yaml.compose(text)
    except yaml.YAMLError as e:
        raise ValueError(f"{path}: {e}") from e
    if isinstance(data, dict):
        data, node = data.get("cases") or [], next((v for k, v in node.value if k.value == "cases"), None)
    lines = [n.start_mark.line + 1 for n in node.value] if data else []
    rows = []
    for at, case in zip(lines, data, strict=True):
        if not isinstance(case, dict) or "id" not in case:
            raise ValueError(f"{path}:{at}: a case needs an id")
        if extra := sorted(set(case) - {"id", "text", "fields", "tags", "expect", "model_facts", "as_of", "offline_only", "note", "open_defect"}):
            raise ValueError(f"{path}:{at}: unknown {', '.join(extra)}")
        rows.append((f"{path}:{at}", json.dumps(case, default=str, ensure_ascii=False)))
    return _cases(spark.createDataFrame(rows, "source string, line string"), texts, heldout)


def load_cases(spark: SparkSession, paths: list[str], texts: list[str], heldout: list[str] = ()) -> DataFrame:
    """Cases of all files, by their endings YAML or JSON lines; those of the second list are held out."""
    read = lambda p, held: (read_yaml_cases if p.endswith((".yaml", ".yml")) else read_cases)(spark, p, texts, held)
    return reduce(DataFrame.unionByName, [*[read(p, False) for p in paths], *[read(p, True) for p in heldout]])


def check_cases(cases: DataFrame, specs: dict[str, dict], outcomes: frozenset[str]) -> DataFrame:
    """cases; one without an id, an expectation or a known fact, operator or outcome, or an id that stands twice, is an error that names its lines. Two aggregations; at most one row comes back from each."""
    from ..plans.project import scalar
    from .rules import ALLOWED

    facts = F.coalesce(F.col("expect.facts"), F.create_map().cast("map<string, map<string, string>>"))
    known = F.map_from_arrays(F.array(*[F.lit(n) for n in specs]), F.array(*[F.array(*[F.lit(o) for o in sorted(ALLOWED[scalar(s)] | ({"contains"} if s["type"] == "list" else set()))]) for s in specs.values()]))
    wrong = F.exists(F.map_entries(facts), lambda e: ~F.map_contains_key(known, e["key"]) | (F.size(F.array_except(F.map_keys(e["value"]), F.coalesce(F.try_element_at(known, e["key"]), F.array().cast("array<string>")))) > 0))
    outcome = F.col("expect.outcome")
    problem = (
        F.when(F.col("id").isNull(), "a case needs an id").when(wrong, "unknown fact or operator").when(outcome.isNotNull() & ~outcome.isin(*sorted(outcomes)), F.concat(F.lit("unknown outcome "), outcome))
        .when((F.size(facts) == 0) & outcome.isNull(), "nothing to grade")
    )
    bad = cases.select("source", problem.alias("p")).filter("p is not null").orderBy("source").head(1)
    if bad:
        raise ValueError(f"{bad[0].source}: {bad[0].p}")
    twice = cases.groupBy("id").agg(F.count("*").alias("n"), F.min("source").alias("a"), F.max("source").alias("b")).filter("n > 1").head(1)
    if twice:
        raise ValueError(f"case {twice[0].id} stands at {twice[0].a} and {twice[0].b}")
    return cases


def _as(arg: Column, kind: str) -> Column:
    return {"number": lambda: arg.try_cast("double"), "integer": lambda: arg.try_cast("double"), "bool": lambda: arg.try_cast("boolean"), "date": lambda: arg.try_cast("date")}.get(kind, lambda: arg)()


def _meets(value: Column, op: str, arg: Column, kind: str, as_of: Column) -> Column:
    one = _as(arg, kind)
    if op == "in":
        return F.exists(F.from_json(arg, "array<string>"), lambda a: _as(a, kind) == value)
    if op == "contains":
        return F.contains(F.lower(value.cast("string")), F.lower(arg))
    if op == "matches":
        return F.rlike(value.cast("string"), F.concat(F.lit("(?iu)"), arg))
    if op in ("within_days", "before_days"):
        until = F.date_add(as_of, arg.try_cast("int"))
        return value.between(as_of, until) if op == "within_days" else value < until
    return {"is": lambda: value == one, "eq": lambda: value == one, "ne": lambda: value != one, "lt": lambda: value < one, "le": lambda: value <= one, "gt": lambda: value > one, "ge": lambda: value >= one}[op]()


def _entry(op: str, arg: Column, kind: str, as_of: Column):
    return lambda x: F.coalesce(_meets(x, op, arg, kind, as_of), F.lit(False))


def misses(specs: dict[str, dict], as_of: Column, expect: str = "expect") -> Column:
    """Names of the facts that miss what a case expects of them. One expression for each pair of a fact and an operator that it takes, whatever the number of cases."""
    from ..plans.project import scalar
    from .rules import ALLOWED

    out = []
    for name, spec in specs.items():
        kind, many = scalar(spec), spec["type"] == "list"
        value, tests = F.col(f"facts.{name}.value"), F.col(f"{expect}.facts")[name]
        holds = []
        for op in sorted(ALLOWED[kind] | ({"contains"} if many else set())):
            arg = tests[op]
            if op == "stated":
                ok = (F.coalesce(F.size(value), F.lit(0)) > 0 if many else value.isNotNull()) == arg.try_cast("boolean")
            elif many and op == "contains":
                ok = F.array_contains(value, _as(arg, kind))
            elif many:
                ok = F.exists(value, _entry(op, arg, kind, as_of))
            else:
                ok = _meets(value, op, arg, kind, as_of)
            holds.append(arg.isNull() | F.coalesce(ok, F.lit(False)))
        out.append(F.when(~reduce(lambda a, b: a & b, holds), F.lit(name)))
    return F.array_compact(F.array(*out))


def grade(df: DataFrame, project, as_of: dt.date, raw: str = "raw") -> DataFrame:
    """df (texts, expect, as_of and a raw answer) graded: facts, outcome and rule by the same steps as a run; fact_misses, outcome_miss, dangerous, result.

    An answer that is missing or malformed is inconclusive; it neither passes nor fails.
    """
    when = F.coalesce(F.col("as_of"), F.lit(as_of))
    done = check_quotes(parse_answers(df, project.specs, raw), project.specs, project.texts)
    for resolve in project.resolvers:
        done = check_quotes(resolve(done), project.specs, project.texts)
    done = decide(done, project.rules, when)
    expected = F.col("expect.outcome")
    missed = F.coalesce(expected != F.col("outcome"), F.lit(False))
    pairs = [F.struct(F.lit(e), F.lit(g)) for e, g in sorted(project.dangerous)]
    dangerous = missed & (F.struct(expected, F.col("outcome")).isin(*pairs) if pairs else F.lit(False))
    done = done.withColumns({"fact_misses": misses(project.specs, when), "outcome_miss": F.when(missed, F.col("outcome")), "dangerous": dangerous})
    bad = F.col(raw).isNull() | F.coalesce(F.col("invalid"), F.lit(True))
    return done.withColumn("result", F.when(bad, "inconclusive").when(F.col("outcome_miss").isNull() & (F.size("fact_misses") == 0), "pass").otherwise("fail"))


def offline(cases: DataFrame, project, as_of: dt.date) -> DataFrame:
    """Cases graded on the answers that they carry."""
    return grade(cases, project, as_of, "model_facts")


def live(cases: DataFrame, project, backend, system: str, repeats: int, as_of: dt.date) -> DataFrame:
    """Cases graded on a backend's own answers, each asked `repeats` times: id, attempt, state, why and what grade() adds. A case that wasn't answered, or not by a JSON object, is inconclusive. Cases marked offline_only are left out."""
    from .guard import item_texts
    from .judging import ask

    asked = cases.filter(~F.col("offline_only")).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    asked = asked.withColumns({"__ask": F.concat_ws("#", "attempt", "id"), "__prompt": item_texts(*project.texts)})
    said = ask(asked, backend, system, "__prompt", "__ask").withColumnRenamed("__ask", "__said")
    return grade(asked.join(said, F.col("__ask") == F.col("__said"), "left").drop("__ask", "__said", "__prompt"), project, as_of)


def generated(spark: SparkSession, facts: dict[str, list], rules, as_of: dt.date, most: int = 3, seed: int = 1) -> DataFrame:
    """Cases whose answers are the rules' own: every combination of the facts' stated values, decided, and at most `most` of each rule, drawn by a hash.

    facts: for each, values or nulls of one type. id, the facts, outcome and
    rule. The combinations are the product of stated lists, made as a product
    of numbers, so no table is joined with another.
    """
    import math

    sizes = [len(v) for v in facts.values()]
    df, place = spark.range(math.prod(sizes)), F.col("id")
    for name, values in facts.items():
        df = df.withColumn(name, F.get(F.array(*map(F.lit, values)), F.pmod(place, F.lit(len(values))).cast("int")))
        place = F.floor(place / len(values))
    done = decide(df, rules, as_of)
    rank = F.row_number().over(Window.partitionBy("rule", "outcome").orderBy(F.xxhash64(F.lit(seed), "id"), "id"))
    return done.withColumn("__rank", rank).filter(F.col("__rank") <= most).select("id", *facts, "outcome", "rule")


def regrade(attempts: DataFrame, cases: DataFrame, project, as_of: dt.date) -> DataFrame:
    """Saved attempts (id, attempt, raw) graded by the cases as they are now; attempts of cases that are gone drop out."""
    return grade(attempts.select("id", "attempt", "raw").join(cases, "id"), project, as_of)


def report(graded: DataFrame, case: str = "id") -> DataFrame:
    """One row a case: state, attempts, dangerous, and whether its conclusive raw answers differ."""
    has = lambda x: F.bool_or(F.col("result") == x)
    state = F.when(has("pass") & has("fail"), "flaky").when(has("fail"), "fail").when(has("inconclusive") | ~has("pass"), "inconclusive").otherwise("pass")
    told = F.when(F.col("result") != "inconclusive", F.sha2(F.to_json("facts"), 256))
    return graded.groupBy(case).agg(state.alias("state"), F.count("*").alias("attempts"), F.bool_or("dangerous").alias("dangerous"), (F.count_distinct(told) > 1).alias("facts_changed"), F.first("tags").alias("tags"), F.first("heldout").alias("heldout"))


def report_markdown(name: str, cases: DataFrame) -> str:
    """Counts by state for visible and held-out cases and for each tag; dangerous misses first. Held-out cases are counted, never listed."""
    out = [f"# {name}", ""]
    danger = cases.filter("dangerous and not heldout").select("id").orderBy("id").collect()
    if danger:
        out += ["Dangerous: " + ", ".join(r.id for r in danger), ""]
    states = ("pass", "fail", "flaky", "inconclusive")
    counts = [F.count_if(F.col("state") == s).alias(s) for s in states]
    for title, rows in (("Split", cases.groupBy(F.when(F.col("heldout"), "held out").otherwise("visible").alias("k"))), ("Tag", cases.select(F.explode("tags").alias("k"), "state").groupBy("k"))):
        out += [f"| {title} | {' | '.join(states)} |", "|---" * (len(states) + 1) + "|"]
        out += [f"| {r.k} | {' | '.join(str(r[s]) for s in states)} |" for r in rows.agg(*counts).orderBy("k").collect()] + [""]
    return "\n".join(out).rstrip() + "\n"


def headline(model: str, repeats: int, pass_at_1: float) -> list[str]:
    """The figures of a run that a text about it should quote."""
    return [f"`{model}`, {repeats} runs", f"pass@1 {pass_at_1:.0%}"]


def not_quoted(text: str, figures: list[str]) -> list[str]:
    """The figures that a text doesn't quote."""
    return [f for f in figures if f not in text]


def unexpected(states: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases whose state breaks a build, and why: one that could not be graded, a failure without an open defect, or a pass with one."""
    both = states.join(cases.select("id", "open_defect"), "id")
    marked, state = F.col("open_defect") != "", F.col("state")
    why = F.when(state == "inconclusive", "inconclusive").when(marked & (state == "pass"), "passes: remove its open_defect").when(~marked & state.isin("fail", "flaky"), state)
    return both.withColumn("why", why).filter("why is not null")


def harness_misses(value: Column, values: Column, rule: Column, expect: Column) -> Column:
    """Why a finished fact (value, or values of a list) and a rule miss what a case of a harness expects: expect has value, value_max, value_in, rule and rule_not; null ones are not expected."""
    number = lambda c: c.try_cast("double")
    wrong = {
        "value": expect["value"].isNotNull() & ~value.eqNullSafe(expect["value"]), "value_max": expect["value_max"].isNotNull() & F.coalesce(number(value) > number(expect["value_max"]), F.lit(False)),
        "value_in": expect["value_in"].isNotNull() & ~F.arrays_overlap(F.coalesce(values, F.array().cast("array<string>")), expect["value_in"]),
        "rule": expect["rule"].isNotNull() & ~rule.eqNullSafe(expect["rule"]), "rule_not": expect["rule_not"].isNotNull() & rule.eqNullSafe(expect["rule_not"]),
    }
    return F.array_compact(F.array(*[F.when(w, F.lit(n)) for n, w in wrong.items()]))


def save_run(spark: SparkSession, path: str, attempts: DataFrame, meta: dict, page: str) -> None:
    """A graded run: its attempts as JSON lines, what it was, and its report."""
    import json

    attempts.write.mode("overwrite").json(f"{path}/attempts")
    spark.createDataFrame([(json.dumps(meta, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/run")
    spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")


def compare_markdown(moves: DataFrame) -> str:
    """How cases moved between two runs: counts, and the cases that broke or were fixed."""
    rows = moves.groupBy("move").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("move").isin("broke", "fixed"), F.col("case").cast("string")))).alias("ids")).orderBy("move").collect()
    return "\n".join(["| Move | Cases | Which |", "|---|---|---|", *[f"| {r['move']} | {r.n} | {', '.join(r.ids)} |" for r in rows]]) + "\n"


def case_params(spark: SparkSession, project, path: str) -> list:
    """A project's cases as parameters of a test, each with its state by its own answer; a case with an open defect is expected to fail. Cases without an answer are left out."""
    import pytest

    cases = load_cases(spark, [path], project.texts).filter("model_facts is not null")
    rows = offline(cases, project, dt.date.today()).select("id", "result", "fact_misses", "outcome_miss", "open_defect").orderBy("id").collect()
    return [pytest.param(r, id=r.id, marks=[pytest.mark.xfail(strict=True, reason=r.open_defect)] if r.open_defect else []) for r in rows]


def assert_case(row) -> None:
    assert row.result == "pass", f"{row.id}: {', '.join(row.fact_misses)} {row.outcome_miss or ''}"
