"""A run over items: each ends with exactly one status."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .guard import check_quotes, parse_answers
from .rules import RuleSet, decide
from .screening import in_first, prefilter_reason


def last_answers(answers: DataFrame, key: str = "id", line: str = "line") -> DataFrame:
    """One raw answer an item: the last line wins."""
    return answers.groupBy(key).agg(F.max_by("raw", line).alias("raw"))


def breaker(calls: DataFrame, ordinal: str, failed: Column, streak: int) -> DataFrame:
    """One row: the ordinal at which `streak` calls in a row had failed, or null.

    ordinal counts calls without gaps. Each failure stands in the windows of
    `streak` ordinals around it; a window that is full of failures trips. So
    no task needs the calls in order.
    """
    ends = calls.filter(failed).select(F.explode(F.sequence(F.col(ordinal), F.col(ordinal) + streak - 1)).alias("end"))
    return ends.groupBy("end").agg(F.count("*").alias("n")).filter(F.col("n") >= streak).agg(F.min("end").alias("trip"))


def run(items: DataFrame, answers: DataFrame, specs: dict[str, dict], rules: RuleSet, as_of: dt.date, texts: list[str], exclude=(), require=(), max_calls: int = 100, resolvers=(), breaker_after: int = 0, max_seconds: float = 0) -> DataFrame:
    """Decides every item from recorded answers.

    items: id, ordinal (total order) and texts; answers: id, line, raw (JSON),
    and perhaps error (the call failed) and started (seconds since the first
    call). Adds status (filtered, deferred, error or decided), outcome, rule,
    quotes, reason, facts. An item without an answer, with a failed call or with
    an invalid answer is an error. Items are deferred after breaker_after failed
    calls in a row, beyond max_calls, and where the call began at max_seconds or
    later; the reason is the first of these. 0: no such limit. resolvers:
    functions of a DataFrame with facts, checked again after; one that sets
    resolver_error makes its item an error.
    """
    df = items.withColumn("reason", prefilter_reason([F.col(t) for t in texts], exclude, require))
    calls = in_first(df.filter("reason is null").select("id", "ordinal"), "id", [F.col("ordinal")], max_calls).filter("within").select(F.col("id").alias("__called"), "ordinal")
    extra = [c for c in ("error", "started") if c in answers.columns]
    last = answers.groupBy("id").agg(F.max_by(F.struct("raw", *extra), "line").alias("__a"))
    calls = calls.join(last, F.col("__called") == F.col("id"), "left").drop("id")
    stopped = F.lit(None).cast("string")
    if "started" in extra and max_seconds:
        stopped = F.when(F.col("__a.started") >= max_seconds, "time limit")
    if "error" in extra and breaker_after:
        # The calls are at most max_calls, so they may be numbered.
        calls = calls.withColumn("__n", F.row_number().over(Window.orderBy("ordinal")))
        trip = breaker(calls, "__n", F.col("__a.error").isNotNull(), breaker_after)
        calls = calls.withColumn("__trip", trip.scalar())
        stopped = F.when(F.col("__n") > F.col("__trip"), "breaker").otherwise(stopped)
    calls = calls.select("__called", stopped.alias("__stopped"), F.when(stopped.isNull(), F.col("__a.raw")).alias("raw"), (F.when(stopped.isNull(), F.col("__a.error")) if "error" in extra else F.lit(None).cast("string")).alias("__failed"))
    df = df.join(calls, F.col("id") == F.col("__called"), "left")
    df = check_quotes(parse_answers(df, specs), specs, texts)
    for resolve in resolvers:
        df = check_quotes(resolve(df), specs, texts)
    df = decide(df, rules, as_of)
    broke = F.col("resolver_error") if "resolver_error" in df.columns else F.lit(None).cast("string")
    put_off = F.col("__called").isNull() | F.col("__stopped").isNotNull()
    status = F.when(F.col("reason").isNotNull(), "filtered").when(put_off, "deferred").when(F.col("raw").isNull() | F.col("invalid") | broke.isNotNull(), "error").otherwise("decided")
    df = df.withColumn("status", status)
    deferred, error = F.col("status") == "deferred", F.col("status") == "error"
    reason = F.when(deferred, F.coalesce("__stopped", F.lit("call ceiling"))).when(error & F.col("__failed").isNotNull(), F.col("__failed")).when(error & F.col("raw").isNull(), "no recorded answer").when(error & broke.isNotNull(), broke).when(error, "invalid answer").otherwise(F.col("reason"))
    done = F.col("status") == "decided"
    df = df.withColumns({"reason": reason} | {c: F.when(done, F.col(c)) for c in ("outcome", "rule", "quotes", "facts")})
    return df.drop("__called", "__stopped", "__failed", "raw", "invalid", "resolver_error")


def each_item(function: Callable[[dict, dict], dict], texts: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A resolver from a function of one item's texts and facts that returns facts. What it raises is that item's resolver_error and costs no other."""
    import json

    def resolve(df: DataFrame) -> DataFrame:
        kind = df.schema["facts"].dataType

        def run_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                out = []
                for row in rows.itertuples(index=False):
                    try:
                        out.append((row[0], json.dumps(function(dict(zip(texts, row[2:], strict=True)), json.loads(row[1]))), None))
                    except Exception as e:
                        out.append((row[0], None, f"{type(e).__name__} after the answer: {e}"))
                yield pd.DataFrame(out, columns=["__id", "__facts", "__error"])

        sent = df.filter("facts is not null and raw is not null").select("id", F.to_json("facts", {"ignoreNullFields": "false"}), *[F.col(t).cast("string") for t in texts])
        made = sent.mapInPandas(run_batches, "__id string, __facts string, __error string")
        both = df.join(made, F.col("id").cast("string") == F.col("__id"), "left")
        before = F.col("resolver_error") if "resolver_error" in df.columns else F.lit(None).cast("string")
        return both.withColumns({"facts": F.when(F.col("__facts").isNotNull(), F.from_json("__facts", kind)).otherwise(F.col("facts")), "resolver_error": F.coalesce(before, F.col("__error"))}).drop("__id", "__facts", "__error")

    return resolve


def stats(results: DataFrame) -> DataFrame:
    """One row: items by status."""
    return results.agg(F.count("*").alias("items"), *[F.count_if(F.col("status") == s).alias(s) for s in ("decided", "filtered", "deferred", "error")])


def union_sources(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
