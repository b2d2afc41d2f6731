"""What a run shows, what it hides and why, and the report of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_of

#: Penalties that are no words of the text.
SYNTHETIC = ("agency", "location")
#: Rows of a table of a report that are read to the driver at most.
MOST_ROWS = 2_000


def keyed(df: DataFrame) -> DataFrame:
    """df (verdict, score, blocker_hits) with is_blocked: a verdict or a blocking term says so."""
    return df.withColumn("is_blocked", (F.coalesce(F.col("verdict") == "blocked", F.lit(False))) | (F.size(F.coalesce("blocker_hits", F.array())) > 0))


def shown(judged: DataFrame, least_score: int, most: int, show_blocked: bool = False) -> DataFrame:
    """The reportable rows with place (1 the best) among the first `most`, and deferred.

    judged: uid, ordinal, score, is_blocked, deferred. Unblocked rows come
    first, then by score, ties in the order of ordinal. Rows past the cap have
    no place and are deferred as digest_cap, unless something else already
    deferred them. Only the `most` rows shown are ranked.
    """
    keep = judged.filter(F.col("score") >= least_score)
    if not show_blocked:
        keep = keep.filter(~F.col("is_blocked"))
    order = [F.col("is_blocked"), F.desc("score"), F.col("ordinal"), F.col("uid")]
    top = keep.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order))).select(F.col("uid").alias("__uid"), "place")
    cut = keep.join(top, F.col("uid") == F.col("__uid"), "left").drop("__uid")
    return cut.withColumn("deferred", F.when(F.col("place").isNull(), F.coalesce("deferred", F.lit("digest_cap"))).otherwise(F.col("deferred")))


def hidden_as(rule: Column, verdict: Column, blocker_hits: Column, score: Column, penalty: Column, gate: int, margin: int) -> Column:
    """The one group that a row not shown is listed under: the rule that fired, a block of the model's own, a blocking term, weighted terms that pushed it under the gate, or a score close to the gate. Null: none of these hid it."""
    under = (score < gate) & (score + penalty >= gate)
    return (
        F.when(rule.isNotNull(), rule).when(F.coalesce(verdict == "blocked", F.lit(False)), "hard_bar").when(F.size(F.coalesce(blocker_hits, F.array())) > 0, "terms")
        .when(F.coalesce(under, F.lit(False)), "blockers").when((score < gate) & (score >= gate - margin), "gate")
    )


def hidden_reason(group: Column, reason: Column, blocker_hits: Column, penalties: Column, score: Column, gate: int) -> Column:
    quoted = lambda terms: F.array_join(F.transform(F.array_distinct(terms), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", ")
    costly = F.filter(penalties, lambda t: ~t.isin(*SYNTHETIC))
    return F.when(group == "terms", F.concat(F.lit("blocked by "), quoted(blocker_hits))).when(group == "blockers", F.concat(F.lit("pushed under the gate by "), quoted(costly))).when(group == "gate", F.format_string("scored %d, gate %d", score, F.lit(gate))).otherwise(text_of(reason))


def charged(penalties: Column, weights: dict[str, int]) -> Column:
    """The sum of the weights of charged penalties; unknown ones weigh nothing."""
    if not weights:
        return F.lit(0)
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.aggregate(penalties, F.lit(0), lambda a, t: a + F.coalesce(table[t], F.lit(0)))


def hidden_list(hidden: DataFrame, most: int | None, groups: list[str]) -> DataFrame:
    """Hidden rows (group, reason, score, company, title, url) in the order of groups, and within one by company and title; in_group and in_all count all rows before the cut to the `most` best by score."""
    counts = hidden.groupBy("group").agg(F.count("*").alias("in_group"))
    # A row for each group that was named, and one for others: as many as the groups.
    kept = hidden if most is None else hidden.orderBy(F.desc("score"), F.lower("company"), F.lower("title"), "url").limit(most)
    at = F.coalesce(F.array_position(F.array(*[F.lit(g) for g in groups]), F.col("group")), F.lit(0))
    return kept.join(counts, "group").withColumn("group_rank", F.when(at > 0, at).otherwise(len(groups) + 1)).orderBy("group_rank", "group", F.lower("company"), F.lower("title"), "url")


def within_budget(cards: DataFrame, room: int, place: str = "place", full: str = "full_bytes", line: str = "line_bytes") -> DataFrame:
    """A report's cards (a bounded table, the places shown) with form: full while the cards fit the room, a line from the first that doesn't, left out where lines don't fit either.

    Once one card is cut short, so are all after it. One window over the report, not over the input.
    """
    so_far = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    df = cards.withColumn("__full", F.sum(full).over(so_far)).withColumn("__ok", F.min((F.col("__full") <= room).cast("int")).over(so_far) == 1)
    df = df.withColumn("__spent", F.sum(F.when(F.col("__ok"), F.col(full)).otherwise(F.col(line))).over(so_far))
    return df.withColumn("form", F.when(F.col("__ok"), "full").when(F.col("__spent") <= room, "line").otherwise("left out")).drop("__full", "__ok", "__spent")


def fitted(rows: DataFrame, room: int, size: str = "bytes", place: str = "place") -> DataFrame:
    """The first rows, in order, whose sizes fit the room together. One window over a report's rows, not over the input."""
    so_far = F.sum(size).over(Window.orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__so_far", so_far).filter(F.col("__so_far") <= room).drop("__so_far")


def most_common(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Each value with how often it stands, the most frequent first, ties in the order of their first rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(ordinal).alias("first")).orderBy(F.desc("n"), "first")


def run_note(judged: Column, shown: Column, deferred: Column, failed: Column) -> Column:
    """One sentence on how a run went."""
    return (
        F.when(judged == 0, "Nothing new was found.").when(failed == judged, "Nothing could be judged.").when(shown == 0, F.format_string("%d judged, none to read.", judged))
        .otherwise(F.concat(F.format_string("%d of %d to read", shown, judged), F.when(deferred > 0, F.format_string(", %d put off", deferred)).otherwise(""), F.lit(".")))
    )


def outcome_counts(judged: DataFrame, least_score: int) -> DataFrame:
    """One row: how many were shown, put off by reason, caught by a rule, or too low with nothing else to say so; the counts are disjoint."""
    caught = F.col("rule").isNotNull() | F.col("is_blocked")
    low = F.col("score") < least_score
    put_off = F.col("deferred").isNotNull()
    return judged.agg(
        F.count("*").alias("judged"), F.count_if(put_off).alias("deferred"), F.count_if(~put_off & caught).alias("caught"), F.count_if(~put_off & ~caught & low).alias("below"), F.count_if(~put_off & ~caught & ~low).alias("reportable"),
    )


def _plain(text: str | None) -> str:
    return "".join("\\" + c if c in "\\`*_[]<>|" else c for c in " ".join((text or "").split()))


def _link(title: str, url: str) -> str:
    return f"[{_plain(title)}]({url})" if url.lower().startswith(("http://", "https://")) and not set(url) & set(" ()<>") else _plain(title)


def digest(name: str, shown_rows: DataFrame, hidden: DataFrame, alarms: list[str] = (), shortlist: DataFrame | None = None) -> str:
    """The report in Markdown: alarms first, then what is shown, what is hidden, and the shortlist. Each table given is bounded by its own cap (shown and hidden_list), and by MOST_ROWS; text from postings is escaped and only http links are links."""
    out = [f"# {name}", ""]
    out += [f"- {_plain(a)}" for a in alarms] + [""] * bool(alarms)
    rows = shown_rows.filter("place is not null").orderBy("place").limit(MOST_ROWS).collect()
    out += [f"## {len(rows)} to read", ""]
    out += [f"{r.place}. {_link(r.title, r.url)}, {_plain(r.company)} ({r.score}, {r.verdict})" for r in rows] + [""]
    hid = hidden.limit(MOST_ROWS).collect()
    if hid:
        out += ["## Hidden by your rules", ""]
        for group in dict.fromkeys(r.group for r in hid):
            of = [r for r in hid if r.group == group]
            out += [f"**{_plain(group)}** ({of[0].in_group})", "", *[f"- {_link(r.title, r.url)}, {_plain(r.company)}: {_plain(r.reason)}" for r in of], ""]
    if shortlist is not None and (saved := shortlist.limit(MOST_ROWS).collect()):
        out += ["## Shortlist", "", *[f"- {_link(r.title, r.url)}, {_plain(r.company)}: {r.state}" for r in saved], ""]
    return "\n".join(out).rstrip() + "\n"
