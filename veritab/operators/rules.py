"""Ordered rules over stated facts, compiled to one expression."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import java_pattern

#: Which operators a fact of each type takes.
_COMMON = {"is", "eq", "ne", "in", "stated"}
_ORDERED = {"lt", "le", "gt", "ge"}
ALLOWED = {
    "number": _COMMON | _ORDERED,
    "integer": _COMMON | _ORDERED,
    "date": _COMMON | _ORDERED | {"within_days", "before_days"},
    "text": _COMMON | {"contains", "matches"},
    "enum": _COMMON,
    "bool": {"is", "eq", "ne", "stated"},
}


@dataclass(frozen=True)
class Rule:
    name: str
    when: dict[str, dict[str, Any]]
    then: str


@dataclass(frozen=True)
class FactType:
    """A fact's column, its type, and whether it is a list of such values."""

    column: str
    type: str
    many: bool = False
    quote: str | None = None


@dataclass(frozen=True)
class RuleSet:
    """Facts by name, rules in order, and the outcome where none fires. Wrong operators, facts and arguments are errors here, not when rows run."""

    facts: dict[str, FactType]
    rules: list[Rule]
    default: str
    outcomes: frozenset[str] = field(init=False, default=frozenset())

    def __post_init__(self) -> None:
        object.__setattr__(self, "outcomes", frozenset({self.default, *(r.then for r in self.rules)}))
        for rule in self.rules:
            for name, condition in rule.when.items():
                if name not in self.facts:
                    raise ValueError(f"rule {rule.name}: no fact {name}")
                for op, arg in condition.items():
                    self._check(rule.name, name, op, arg)

    def _check(self, rule: str, name: str, op: str, arg: Any) -> None:
        fact = self.facts[name]
        allowed = ALLOWED[fact.type] | ({"contains"} if fact.many else set())
        if op not in allowed:
            raise ValueError(f"rule {rule}: {op} does not apply to {name}, of type {fact.type}")
        if op == "matches":
            try:
                re.compile(arg)
            except re.error as e:
                raise ValueError(f"rule {rule}: {arg!r} is no pattern ({e})") from e
        if op in ("within_days", "before_days") and not isinstance(arg, int):
            raise ValueError(f"rule {rule}: {op} takes whole days")
        if op == "in" and not isinstance(arg, (list, tuple)):
            raise ValueError(f"rule {rule}: in takes a list")


def _literal(arg: Any, kind: str) -> Column:
    if kind == "date":
        return F.lit(arg if isinstance(arg, dt.date) else dt.date.fromisoformat(arg))
    return F.lit(arg)


def _test(value: Column, op: str, arg: Any, kind: str, as_of: Column) -> Column:
    if op in ("is", "eq"):
        return value == _literal(arg, kind)
    if op == "ne":
        return value != _literal(arg, kind)
    if op in _ORDERED:
        other = _literal(arg, kind)
        return {"lt": value < other, "le": value <= other, "gt": value > other, "ge": value >= other}[op]
    if op == "in":
        return value.isin(*[_literal(a, kind) for a in arg])
    if op == "contains":
        return F.contains(F.lower(value.cast("string")), F.lit(str(arg).lower()))
    if op == "matches":
        return value.cast("string").rlike(java_pattern(arg))
    if op == "within_days":
        return value.between(as_of, F.date_add(as_of, arg))
    return value < F.date_add(as_of, arg)


def condition(fact: FactType, tests: dict[str, Any], as_of: Column) -> Column:
    """Whether a fact meets all tests. What is unstated meets nothing but `stated: false`, so null never reaches a rule; a list meets a test if an entry does."""
    value = F.col(fact.column)
    out = []
    for op, arg in tests.items():
        if op == "stated":
            stated = (F.size(F.coalesce(value, F.array())) > 0) if fact.many else value.isNotNull()
            out.append(stated if arg else ~stated)
        elif fact.many and op == "contains":
            out.append(F.coalesce(F.array_contains(value, _literal(arg, fact.type)), F.lit(False)))
        elif fact.many:
            out.append(F.coalesce(F.exists(value, _entry(op, arg, fact.type, as_of)), F.lit(False)))
        else:
            out.append(F.coalesce(_test(value, op, arg, fact.type, as_of), F.lit(False)))
    return reduce(lambda a, b: a & b, out, F.lit(True))


def _entry(op: str, arg: Any, kind: str, as_of: Column):
    return lambda x: F.coalesce(_test(x, op, arg, kind, as_of), F.lit(False))


def decide(df: DataFrame, rules: RuleSet, as_of: Column | dt.date) -> DataFrame:
    """df with outcome, rule (null for the default) and quotes of the facts that the rule read."""
    as_of = F.lit(as_of) if isinstance(as_of, dt.date) else as_of
    fired = None
    for i, rule in enumerate(rules.rules):
        holds = reduce(lambda a, b: a & b, [condition(rules.facts[n], c, as_of) for n, c in rule.when.items()], F.lit(True))
        fired = F.when(holds, F.lit(i)) if fired is None else fired.when(holds, F.lit(i))
    df = df.withColumn("__fired", fired if fired is not None else F.lit(None).cast("int"))
    at = F.col("__fired")
    name, then, quotes = F.lit(None).cast("string"), F.lit(rules.default), F.lit(None).cast("map<string,array<string>>")
    for i, rule in enumerate(rules.rules):
        name = F.when(at == i, F.lit(rule.name)).otherwise(name)
        then = F.when(at == i, F.lit(rule.then)).otherwise(then)
        read = [(n, rules.facts[n].quote, rules.facts[n].many) for n in rule.when if rules.facts[n].quote]
        if read:
            made = F.create_map(*[x for n, q, many in read for x in (F.lit(n), F.col(q) if many else F.array(F.col(q).cast("string")))])
            quotes = F.when(at == i, made).otherwise(quotes)
    return df.withColumns({"outcome": then, "rule": name, "quotes": quotes}).drop("__fired")


def histogram(decided: DataFrame, default: str) -> DataFrame:
    """Outcomes and rules by frequency."""
    label = F.coalesce(F.col("rule"), F.lit(f"(default: {default})"))
    return decided.groupBy("outcome", label.alias("rule")).agg(F.count("*").alias("n"))
