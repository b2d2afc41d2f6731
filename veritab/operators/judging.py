"""Calls of a model or an enricher over rows: whatever they raise costs one row, never the run.

A backend is a function of the instructions and a list of prompts that returns,
for each prompt, an answer (text of JSON), an exception, or None if it was not
answered in time. It is called on the executors, a batch of rows at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from importlib.metadata import entry_points
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .screening import in_first

Backend = Callable[[str, list[str]], list[Any]]
#: Backends and enrichers by name; more come from installed packages.
BACKENDS: dict[str, Callable[..., Backend]] = {}
ENRICHERS: dict[str, Callable[[dict], dict]] = {}
GROUPS = {"backend": "veritab.backends", "enricher": "veritab.enrichers", "reader": "veritab.readers", "source": "veritab.sources"}


def plugin(kind: str, name: str, known: dict) -> Any:
    """What is registered under a name: here, or as an entry point of an installed package."""
    if name in known:
        return known[name]
    found = list(entry_points(group=GROUPS[kind], name=name))
    if not found:
        raise ValueError(f"no {kind} {name!r}; known: {', '.join(sorted(known)) or 'none'}")
    return found[0].load()


def chat_backend(url: str, model: str, key: str = "", timeout: float = 60.0, tries: int = 2) -> Backend:
    """A backend that speaks the chat-completions form over HTTP, one POST a prompt and one more if it fails."""

    def call(system: str, prompts: list[str]) -> list[Any]:
        import urllib.request

        def one(prompt: str) -> Any:
            body = {"model": model, "temperature": 0, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}], "response_format": {"type": "json_object"}}
            head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
            for left in range(tries - 1, -1, -1):
                try:
                    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=timeout) as r:
                        return json.load(r)["choices"][0]["message"]["content"]
                except Exception as e:
                    if not left:
                        return e
            return None

        return [one(p) for p in prompts]

    return call


BACKENDS["chat"] = chat_backend


def status(backend: Backend, system: str = "Answer {}.") -> str:
    """"" if a backend answers at all, else why not; asked once before a run."""
    try:
        (answer,) = backend(system, ["{}"])
    except Exception as e:
        return f"{type(e).__name__}: {e}"
    return f"{type(answer).__name__}: {answer}" if isinstance(answer, Exception) else "" if answer else "no answer"


def ask(df: DataFrame, backend: Backend, system: str, prompt: str = "prompt", key: str = "id", size: int = 64) -> DataFrame:
    """key, state (answered, error, deferred), why, raw: the backend's answer to each row's prompt.

    Rows reach the backend in batches of at most `size`. A batch that fails is an
    error of its rows only; so is an answer that is no JSON object.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), size):
                rows = whole.iloc[at : at + size]
                try:
                    answers = list(backend(system, rows[prompt].tolist()))
                    if len(answers) != len(rows):
                        raise ValueError(f"{len(answers)} answers to {len(rows)} prompts")
                except Exception as e:
                    answers = [e] * len(rows)
                yield pd.DataFrame([(k, *settled(a)) for k, a in zip(rows[key], answers, strict=True)], columns=[key, "state", "why", "raw"])

    return df.select(F.col(key).cast("string").alias(key), prompt).mapInPandas(run, f"`{key}` string, state string, why string, raw string")


def settled(answer: Any) -> tuple[str, str | None, str | None]:
    """state, why and raw of one answer."""
    if answer is None:
        return "deferred", "not answered within the time limit", None
    if isinstance(answer, Exception):
        return "error", f"{type(answer).__name__}: {answer}", None
    try:
        text = answer if isinstance(answer, str) else json.dumps(answer)
        if not isinstance(json.loads(text), dict):
            return "error", "the answer is no JSON object", None
    except (TypeError, ValueError) as e:
        return "error", f"the answer is no JSON: {e}", None
    return "answered", None, text


def cache_usable(identity: Column | None, known: bool) -> bool:
    """Answers may be kept only under the name of weights that are known: an unnamed model's would be served for another's."""
    return identity is not None and known


def judge(candidates: DataFrame, cache: DataFrame | None, backend: Backend, system: str, max_calls: int, order: list[Column], key: str = "id", answer_key: str = "answer_key") -> DataFrame:
    """Candidates (id, answer_key, prompt) with state, why, raw and cached.

    Kept answers come first and cost no call; of the rest the first max_calls by
    order are asked, the others deferred.
    """
    df = candidates
    if cache is not None:
        kept = cache.select(F.col(answer_key).alias("__key"), F.col("raw").alias("__kept"))
        df = df.join(kept, F.col(answer_key) == F.col("__key"), "left").drop("__key")
    else:
        df = df.withColumn("__kept", F.lit(None).cast("string"))
    asked = in_first(df.filter("__kept is null"), key, order, max_calls)
    said = ask(asked.filter("within"), backend, system, key=key).withColumnRenamed(key, "__id")
    df = df.join(said, F.col(key).cast("string") == F.col("__id"), "left").drop("__id")
    cached = F.col("__kept").isNotNull()
    state = F.when(cached, "answered").when(F.col("state").isNull(), "deferred").otherwise(F.col("state"))
    why = F.when(cached, F.lit(None)).when(F.col("state").isNull(), F.lit("call ceiling")).otherwise(F.col("why"))
    return df.withColumns({"why": why, "raw": F.coalesce("__kept", "raw"), "cached": cached, "state": state}).drop("__kept")


def enrich(df: DataFrame, enricher: Callable[[dict], dict], eligible: Column, column: str, max_calls: int, order: list[Column], key: str = "uid") -> DataFrame:
    """df with a text column rewritten by an enricher for the first max_calls eligible rows; one that fails or gives nothing keeps the row as it is."""
    chosen = in_first(df.filter(eligible), key, order, max_calls).filter("within").drop("within")
    names = chosen.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for row in rows.to_dict("records"):
                try:
                    new = enricher(dict(row)).get(column)
                except Exception:
                    new = None
                out.append((row[key], new if isinstance(new, str) else row[column]))
            yield pd.DataFrame(out, columns=[key, column])

    made = chosen.select(*names).mapInPandas(run, chosen.select(key, column).schema).select(F.col(key).alias("__key"), F.col(column).alias("__new"))
    return df.join(made, F.col(key) == F.col("__key"), "left").withColumn(column, F.coalesce("__new", column)).drop("__key", "__new")
