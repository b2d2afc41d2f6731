"""A project: one YAML file that names items, facts, rules and dangerous mistakes, checked whole before any row is read."""

from __future__ import annotations

import datetime as dt
import importlib.util
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs
from ..operators.judging import plugin
from ..operators.rules import ALLOWED, FactType, Rule, RuleSet, histogram
from ..sources import readers
from ..sources.fetching import read_stdin

SCALARS = ("number", "integer", "text", "bool", "date", "enum")
READERS = ("jsonl", "csv", "folder", "stdin", "plugin")
#: Readers by name, for items that no built-in reader reads: functions of a session and the items' part of the file.
PLUGINS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {}
_KEYS = {"name", "items", "prefilter", "facts", "rules", "default_outcome", "model", "cache", "resolvers", "dangerous"}


class ProjectError(ValueError):
    """The file is wrong; the message says where."""


def _only(given: Any, allowed: set[str], where: str) -> dict:
    if not isinstance(given, dict):
        raise ProjectError(f"{where}: needs a mapping")
    if extra := sorted(set(map(str, given)) - allowed):
        raise ProjectError(f"{where}: unknown {', '.join(extra)}")
    return given


def scalar(spec: dict) -> str:
    """The type of one value of a fact: its own, or its entries'."""
    return spec["of"] if spec["type"] == "list" else spec["type"]


def _spec(name: str, spec: Any) -> dict:
    spec = _only(spec, {"type", "describe", "values", "of"}, f"fact {name}")
    kind = spec.get("type")
    if kind not in (*SCALARS, "list"):
        raise ProjectError(f"fact {name}: no type {kind!r}")
    if (kind == "list") != ("of" in spec) or spec.get("of", "text") not in SCALARS:
        raise ProjectError(f"fact {name}: `of` names what a list holds, and only that")
    if (scalar(spec) == "enum") != bool(spec.get("values")):
        raise ProjectError(f"fact {name}: an enum, and nothing else, needs values")
    return spec


def argument_problem(spec: dict, op: str, arg: Any) -> str | None:
    """What is wrong with an operator or its argument for a fact; None if nothing is."""
    kind = scalar(spec)
    if op not in ALLOWED[kind] | ({"contains"} if spec["type"] == "list" else set()):
        return f"{op} does not apply to {kind}"
    if op == "stated":
        return None if isinstance(arg, bool) else "stated takes true or false"
    if op in ("within_days", "before_days"):
        return None if isinstance(arg, int) and not isinstance(arg, bool) and arg >= 0 else f"{op} takes whole days, 0 or more"
    if op == "in":
        if not isinstance(arg, list) or not arg:
            return "in takes a list"
        return next((p for a in arg if (p := _value_problem(spec, kind, a))), None)
    if op == "matches":
        try:
            re.compile(arg)
        except (re.error, TypeError) as e:
            return f"no pattern: {e}"
        return None
    return _value_problem(spec, kind, arg)


def _value_problem(spec: dict, kind: str, arg: Any) -> str | None:
    if kind in ("number", "integer"):
        return None if isinstance(arg, (int, float)) and not isinstance(arg, bool) else "needs a number"
    if kind == "bool":
        return None if isinstance(arg, bool) else "needs true or false"
    if kind == "date":
        try:
            arg if isinstance(arg, dt.date) else dt.date.fromisoformat(arg)
        except (TypeError, ValueError):
            return "needs a date"
        return None
    if not isinstance(arg, str):
        return "needs text"
    return f"{arg!r} is none of its values" if kind == "enum" and arg not in spec["values"] else None


@dataclass(frozen=True)
class Project:
    name: str
    items: dict
    specs: dict[str, dict]
    rules: RuleSet
    prefilter: dict = field(default_factory=dict)
    model: dict = field(default_factory=dict)
    resolvers: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    dangerous: frozenset[tuple[str, str]] = frozenset()
    base: str = ""

    @property
    def texts(self) -> list[str]:
        return self.items["fields"]


def fact_types(specs: dict[str, dict]) -> dict[str, FactType]:
    """Where the facts of an answer stand. A list's values are one array."""
    return {n: FactType(f"facts.{n}.value", scalar(s), s["type"] == "list", f"facts.{n}.quote") for n, s in specs.items()}


def resolver(name: str, base: str) -> Callable[[DataFrame], DataFrame]:
    """`module:function`: a function of a DataFrame with facts, from a file beside the project or an installed module. Files get names of their own, so two projects' modules never meet."""
    module, _, function = name.partition(":")
    path = os.path.join(base, f"{module}.py")
    if os.path.exists(path):
        spec = importlib.util.spec_from_file_location(f"project_{abs(hash(path))}_{module}", path)
        loaded = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(loaded)
    else:
        try:
            loaded = importlib.import_module(module)
        except ImportError as e:
            raise ProjectError(f"resolver {name}: {e}") from e
    if not callable(getattr(loaded, function, None)):
        raise ProjectError(f"resolver {name}: no such function")
    return getattr(loaded, function)


def parse(data: Any, base: str = "") -> Project:
    data = _only(data, _KEYS, "project")
    if missing := sorted({"name", "items", "facts", "default_outcome"} - set(data)):
        raise ProjectError(f"project: no {', '.join(missing)}")
    items = _only(data["items"], {*READERS, "id", "fields", "meta"}, "items")
    if sum(r in items for r in READERS) != 1 or not items.get("fields"):
        raise ProjectError("items: needs exactly one reader, and a field at least")
    specs = {n: _spec(n, s) for n, s in data["facts"].items()}
    found = []
    for r in data.get("rules") or []:
        r = _only(r, {"name", "when", "then"}, "rule")
        if not r.get("when"):
            raise ProjectError(f"rule {r.get('name')}: `when` is empty")
        for fact, tests in r["when"].items():
            if fact not in specs or not isinstance(tests, dict) or not tests:
                raise ProjectError(f"rule {r.get('name')}: no fact {fact} or no condition on it")
            for op, arg in tests.items():
                if problem := argument_problem(specs[fact], op, arg):
                    raise ProjectError(f"rule {r['name']}, {fact}: {problem}")
        found.append(Rule(r["name"], r["when"], r["then"]))
    rules = RuleSet(fact_types(specs), found, data["default_outcome"])
    dangerous = frozenset((d["expected"], d["got"]) for d in data.get("dangerous") or [])
    for outcome in {o for pair in dangerous for o in pair} - rules.outcomes:
        raise ProjectError(f"dangerous: {outcome} is no outcome")
    prefilter = _only(data.get("prefilter") or {}, {"require_any", "exclude_any"}, "prefilter")
    return Project(data["name"], items, specs, rules, prefilter, data.get("model") or {}, tuple(resolver(r, base) for r in data.get("resolvers") or []), dangerous, base)


def load(path: str) -> Project:
    import yaml

    with open(path, encoding="utf-8") as f:
        try:
            return parse(yaml.safe_load(f), os.path.dirname(os.path.abspath(path)))
        except yaml.YAMLError as e:
            raise ProjectError(f"{path}: {e}") from e


def _at(project: Project, path: str) -> str:
    return path if "://" in path or os.path.isabs(path) else os.path.join(project.base, path)


def read_items(spark: SparkSession, project: Project) -> DataFrame:
    """id, ordinal and texts of the project's items. An id that stands twice is an error."""
    i = project.items
    kind = next(r for r in READERS if r in i)
    key, texts = i.get("id", "id"), i["fields"]
    if kind == "jsonl":
        df = readers.read_jsonl(spark, _at(project, i[kind]), ", ".join(f"`{c}` string" for c in dict.fromkeys([key, *texts, *i.get("meta", [])])))
    elif kind == "csv":
        df = readers.read_csv(spark, _at(project, i[kind]))
    elif kind == "folder":
        df = readers.read_folder(spark, _at(project, i[kind]), texts[0])
    elif kind == "stdin":
        df = read_stdin(spark, key, texts, i.get("meta", []))
    else:
        try:
            df = plugin("reader", i[kind], PLUGINS)(spark, i)
        except ValueError as e:
            raise ProjectError(f"items: {e}") from e
    named = df.select(F.col(key).cast("string").alias("id"), F.monotonically_increasing_id().alias("ordinal"), *[F.coalesce(F.col(t).cast("string"), F.lit("")).alias(t) for t in texts], *[F.col(m) for m in i.get("meta", [])])
    return readers.unique_ids(named)


def run_project(project: Project, items: DataFrame, answers: DataFrame, as_of: dt.date) -> DataFrame:
    """Every item with one status, outcome and rule; answers: id, line, raw."""
    p = project.prefilter
    return runs.run(items, answers, project.specs, project.rules, as_of, project.texts, p.get("exclude_any") or (), p.get("require_any") or (), project.model.get("max_calls", 100), project.resolvers, project.model.get("breaker", 0), 60 * project.model.get("max_minutes", 0))


def summary(project: Project, results: DataFrame) -> str:
    """A report in Markdown: counts by status, outcome and rule. The tables have a row for each rule; problems are counted by reason."""
    n = runs.stats(results).first()
    out = [f"# {project.name}", "", f"{n['items']} items: {n.decided} decided, {n.filtered} filtered, {n.deferred} deferred, {n.error} errors.", ""]
    decided = histogram(results.filter("status = 'decided'"), project.rules.default)
    for title, column in (("Outcome", "outcome"), ("Rule", "rule")):
        rows = decided.groupBy(column).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), column).collect()
        out += [f"| {title} | Items |", "|---|---|", *[f"| {r[0]} | {r[1]} |" for r in rows], ""]
    problems = results.filter("status in ('error', 'deferred')").groupBy("status", "reason").agg(F.count("*").alias("n"), F.min("id").alias("first")).orderBy("status", "reason").collect()
    if problems:
        out += ["| Status | Why | Items | First |", "|---|---|---|---|", *[f"| {r.status} | {r.reason} | {r.n} | {r['first']} |" for r in problems], ""]
    return "\n".join(out).rstrip() + "\n"
