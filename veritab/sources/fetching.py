"""Reading all sources of a scan: one that fails gives a report and no rows, and fails nothing else."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text_of
from ..operators.judging import plugin
from .readers import JOB


class Skipped(Exception):
    """A source that leaves itself out, and says why (no key, nothing configured)."""


@dataclass(frozen=True)
class Entry:
    """A source of the configuration."""

    kind: str
    slug: str
    label: str = ""
    enabled: bool = True
    options: dict[str, Any] = field(default_factory=dict)

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.slug}:{self.label}"


@dataclass(frozen=True)
class Kind:
    """What is known of a kind of source: whether its dates tell a posting's age, whether it is read from a mark on, the options it takes, and the wait between its requests."""

    ages: bool = True
    incremental: bool = False
    whole: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    delay: float = 0.0


KINDS = {
    "structured": Kind(incremental=True, whole=("max_pages", "max_age_days"), flags=("render", "follow_index")), "workable_search": Kind(whole=("pages",), delay=2.0),
    "adzuna": Kind(whole=("pages", "per_page")), "reed": Kind(whole=("pages", "per_page")), "jooble": Kind(whole=("pages",)), "workday": Kind(whole=("pages",)),
}
#: Readers of sources by kind: functions of a session, an entry and its mark that return postings.
SOURCES: dict[str, Callable[[SparkSession, Entry, str | None], DataFrame]] = {}


def entries(config: list[dict]) -> list[Entry]:
    """The enabled sources of a configuration; an entry of wrong options is an error before anything is read."""
    made = [Entry(str(c["kind"]), str(c["slug"]), str(c.get("label", "")), c.get("enabled", True), {k: v for k, v in c.items() if k not in ("kind", "slug", "label", "enabled")}) for c in config]
    for e in made:
        if problem := option_problem(e):
            raise ValueError(f"{e.key}: {problem}")
    return [e for e in made if e.enabled]


def option_problem(e: Entry) -> str | None:
    """What is wrong with a source's options: one that is to be a whole number, 1 or more, or true or false, and isn't."""
    kind = KINDS.get(e.kind, Kind())
    for name in kind.whole:
        value = e.options.get(name, 1)
        if isinstance(value, bool) or not isinstance(value, int) or value < 1:
            return f"{name} needs a whole number, 1 or more, not {value!r}"
    return next((f"{name} needs true or false, not {e.options[name]!r}" for name in kind.flags if not isinstance(e.options.get(name, False), bool)), None)


def fetch_one(spark: SparkSession, e: Entry, mark: str | None = None) -> tuple[dict, DataFrame | None]:
    """A source's report and its postings, which are read here and now: a source that can't be read is a report."""
    report = {"source_key": e.key, "kind": e.kind, "error": None, "skipped": False, "note": "", "n": 0}
    try:
        rows = plugin("source", e.kind, SOURCES)(spark, e, mark if KINDS.get(e.kind, Kind()).incremental else None)
        rows = rows.select([F.col(c.split(" ")[0]) for c in JOB.split(", ")]).withColumn("source_key", F.lit(e.key)).persist()
        return report | {"n": rows.count()}, rows
    except Skipped as x:
        return report | {"error": str(x), "skipped": True}, None
    except Exception as x:
        return report | {"error": f"{type(x).__name__}: {str(x).splitlines()[0] if str(x) else ''}"}, None


def fetch_all(spark: SparkSession, config: list[dict], marks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Reports, one row a source, and the postings of all sources that could be read. Sources number in the tens; their postings stay distributed."""
    from concurrent.futures import ThreadPoolExecutor

    chosen = entries(config)
    since = {r.source_key: r.since for r in marks.select("source_key", "since").collect()} if marks is not None else {}
    with ThreadPoolExecutor(max(1, min(8, len(chosen)))) as pool:
        found = list(pool.map(lambda e: fetch_one(spark, e, since.get(e.key)), chosen))
    reports = spark.createDataFrame([r for r, _ in found], "source_key string, kind string, error string, skipped boolean, note string, n long")
    parts = [rows for _, rows in found if rows is not None]
    return reports, reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{JOB}, source_key string")


def with_kind(rows: DataFrame, kind: str = "kind") -> DataFrame:
    """rows with ages, incremental and delay of their kind of source; unknown kinds have the defaults."""
    attributes = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.struct(F.lit(v.ages).alias("ages"), F.lit(v.incremental).alias("incremental"), F.lit(v.delay).alias("delay")))])
    found, none = F.try_element_at(attributes, F.col(kind)), Kind()
    return rows.withColumns({"ages": F.coalesce(found["ages"], F.lit(none.ages)), "incremental": F.coalesce(found["incremental"], F.lit(none.incremental)), "delay": F.coalesce(found["delay"], F.lit(none.delay))})


def with_marks(sources: DataFrame, marks: DataFrame) -> DataFrame:
    """sources (source_key, incremental) with since: the mark that its last whole read left, for those that are read from a mark on."""
    held = marks.select(F.col("source_key").alias("__key"), F.col("since").alias("__since"))
    return sources.join(held, F.col("source_key") == F.col("__key"), "left").withColumn("since", F.when(F.col("incremental"), F.col("__since"))).drop("__key", "__since")


def crawl_delay(robots: Column, agent: str, cap: float = 30.0) -> Column:
    """The seconds between requests that a site's robots.txt asks of an agent, or of all; at most cap, 0 if it asks none."""
    lines = F.transform(F.split(text_of(robots), "\\r?\\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    field = lambda x: F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1))))
    value = lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", ""))
    zero = F.struct(F.array().cast("array<string>").alias("of"), F.lit(False).alias("closed"), F.lit(None).cast("double").alias("own"), F.lit(None).cast("double").alias("all"))

    def step(acc: Column, x: Column) -> Column:
        is_agent, is_delay = field(x) == "user-agent", field(x) == "crawl-delay"
        of = F.when(is_agent & acc["closed"], F.array(F.lower(value(x)))).when(is_agent, F.concat(acc["of"], F.array(F.lower(value(x))))).otherwise(acc["of"])
        delay = F.when(is_delay, value(x).try_cast("double"))
        own, every = F.array_contains(of, agent.lower()), F.array_contains(of, "*")
        return F.struct(of.alias("of"), F.when(is_agent, F.lit(False)).when(x == "", acc["closed"]).otherwise(F.lit(True)).alias("closed"), F.when(own, F.coalesce(delay, acc["own"])).otherwise(acc["own"]).alias("own"), F.when(every, F.coalesce(delay, acc["all"])).otherwise(acc["all"]).alias("all"))

    found = F.aggregate(lines, zero, step)
    return F.least(F.greatest(F.coalesce(found["own"], found["all"], F.lit(0.0)), F.lit(0.0)), F.lit(cap))


def probe_structured(error: Column, listed: Column, matching: Column, marked: Column) -> Column:
    """What a look at a site's sitemap and one sample page says; UNKNOWN where nothing listed matches or the sample holds no posting."""
    return F.when(error.isNotNull(), "FAIL").when(listed == 0, "EMPTY").when((matching == 0) | ~F.coalesce(marked, F.lit(False)), "UNKNOWN").otherwise("OK")


def read_stdin(spark: SparkSession, key: str, fields: list[str], meta: list[str] = (), stream=None) -> DataFrame:
    """Items of JSON lines on standard input, which only the driver has. A line that is no JSON is an error that names it."""
    import json

    rows = []
    for n, line in enumerate(stream or sys.stdin, 1):
        if line.strip():
            try:
                row = json.loads(line)
            except ValueError as e:
                raise ValueError(f"standard input, line {n}: {e}") from e
            rows.append(tuple(None if row.get(c) is None else str(row[c]) for c in (key, *fields, *meta)))
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in (key, *fields, *meta)))


def load_config(path: str) -> dict[str, Any]:
    """A scan's YAML: sources (checked), and profile, output and model parts as they stand; a file named in it is found beside it, and must exist."""
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    if not isinstance(data, dict) or not isinstance(data.get("sources", []), list):
        raise ValueError(f"{path}: needs a mapping with a list of sources")
    if extra := sorted(set(data) - {"sources", "profile", "output", "model", "http", "rules"}):
        raise ValueError(f"{path}: unknown {', '.join(extra)}")
    model = data.get("model") or {}
    if name := model.get("examples_file"):
        beside = os.path.join(os.path.dirname(os.path.abspath(path)), name)
        if not os.path.exists(beside):
            raise ValueError(f"{path}: no file {beside}")
        data["model"] = model | {"examples_file": beside}
    return data | {"sources": entries(data.get("sources", []))}
