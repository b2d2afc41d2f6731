"""Answers of a model by request, what they cost, and when a run stops or counts as failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that a token holds at most; the share of a window from which it counts as full; the share of failed calls, in percent, from which a run has failed.
CHARS_A_TOKEN, FULL, FAILED = 8, 0.97, 20
TOKENS = ("input_tokens", "cache_read", "cache_write", "output_tokens")


def batch_answers(sent: DataFrame, results: DataFrame, key: str = "request") -> DataFrame:
    """Each request sent with what became of it: state (answered, error or deferred), why, raw.

    results: request, type (succeeded, errored, canceled, expired), stop, text,
    detail. A request that was cancelled or expired is deferred; one that failed,
    was cut short, gave nothing or no JSON object, or has no result, is an
    error. Results of no request are left out; of several the first by type
    stands.
    """
    one = results.groupBy(F.col(key).alias("__key")).agg(F.min(F.struct("type", "stop", "text", "detail")).alias("r"))
    df = sent.join(one, F.col(key) == F.col("__key"), "left")
    kind, text = F.col("r.type"), F.coalesce("r.text", F.lit(""))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(text)), F.lit("OBJECT")), F.lit(False))
    why = (
        F.when(F.col("__key").isNull(), "no result").when(kind.isin("canceled", "expired"), "not answered within the time limit").when(kind != "succeeded", F.concat_ws(": ", F.concat(F.lit("request "), kind), F.nullif("r.detail", F.lit(""))))
        .when((F.coalesce("r.stop", F.lit("")) != "end_turn") | (text == ""), F.concat(F.lit("no facts in the answer: "), F.coalesce("r.stop", F.lit("none")))).when(~is_object, "the answer is no JSON object")
    )
    state = F.when(kind.isin("canceled", "expired"), "deferred").when(why.isNotNull(), "error").otherwise("answered")
    return df.withColumns({"why": why, "state": state, "raw": F.when(state == "answered", text)}).drop("__key", "r")


def by_place(sent: DataFrame, answers: DataFrame, place: str = "place") -> DataFrame:
    """Requests and answers that go by their places; a number of answers other than that of requests is an error."""
    n, m = sent.count(), answers.count()
    if n != m:
        raise ValueError(f"{n} requests, {m} answers")
    return sent.join(answers, place)


def token_sums(answers: DataFrame) -> DataFrame:
    """One row: answered, failed, and tokens by kind; a count that is missing is 0."""
    return answers.agg(F.count_if(F.col("state") == "answered").alias("answered"), F.count_if(F.col("state") == "error").alias("failed"), *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TOKENS])


def stop_reason(tripped: Column, calls: Column, most: int, seconds: Column, minutes: float) -> Column:
    """Why no call may start: the breaker, then the ceiling of calls, then the time; null while one may. minutes 0: no limit."""
    late = (seconds >= minutes * 60) if minutes else F.lit(False)
    return F.when(F.coalesce(tripped, F.lit(False)), "breaker").when(calls >= most, "ceiling").when(F.coalesce(late, F.lit(False)), "time")


def run_failure(scored: Column, cached: Column, errors: Column, breaker: Column, unusable: Column) -> Column:
    """Why a run's scoring failed as a whole; "" if it didn't. Answers kept from before asked nothing, so they don't count as attempts."""
    attempted = scored - cached + errors
    return (
        F.when((F.coalesce(unusable, F.lit("")) != "") & (scored == 0), F.concat(F.lit("scoring did not run: "), unusable)).when(F.coalesce(breaker, F.lit(False)), "scoring stopped after failures in a row")
        .when((attempted > 0) & (errors * 100 > attempted * FAILED), F.format_string("scoring failed for %d of %d", errors, attempted)).otherwise("")
    )


def prompt_cut(prompt_tokens: Column, output_tokens: Column, prompt_chars: Column, window: Column, own_window: Column | None = None) -> Column:
    """Why an answer was made without its whole prompt: fewer tokens were read than the prompt holds at least, or prompt and answer filled the window (the model's own, if that is smaller). Null if neither, or if nothing was counted."""
    room = window if own_window is None else F.least(window, own_window)
    told = prompt_tokens.isNotNull() & output_tokens.isNotNull()
    return F.when(told & (prompt_tokens < F.floor(prompt_chars / CHARS_A_TOKEN)), "cut").when(told & (prompt_tokens + output_tokens >= FULL * room), "full")


def model_window(info: Column) -> Column:
    """The context length in a model's description (a map of text): its architecture's own, else the first key's that names one."""
    named = F.try_element_at(info, F.concat(F.try_element_at(info, F.lit("general.architecture")), F.lit(".context_length"))).try_cast("long")
    keys = F.array_sort(F.filter(F.map_keys(info), lambda k: F.endswith(k, F.lit(".context_length")) & F.try_element_at(info, k).try_cast("long").isNotNull()))
    return F.coalesce(named, F.try_element_at(info, F.get(keys, F.lit(0))).try_cast("long"))


#: Statuses that are worth another try.
AGAIN = (408, 425, 429, 500, 502, 503, 504)


def retry_after(status: Column, attempt: Column, told: Column, most: int = 3, base: float = 1.0, cap: float = 30.0) -> Column:
    """The longest wait in seconds before a request is made again; null if it isn't. What the server told goes before a doubling wait; either ends at cap. A caller draws its wait below that."""
    wait = F.least(F.coalesce(told.try_cast("double"), base * F.pow(F.lit(2.0), attempt - 1)), F.lit(cap))
    return F.when((status.isNull() | status.isin(*AGAIN) | (status >= 500)) & (attempt < most), F.greatest(wait, F.lit(0.0)))
