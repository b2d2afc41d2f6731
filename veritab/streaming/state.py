"""State between runs: keyed tables as versioned Parquet snapshots, and a stream that emits each key once.

Parquet has no MERGE, so an update writes a new version: the rows that the
update doesn't touch, and the updated ones. The pointer to the current version
is written last, after a run's output is safe.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Table:
    """A keyed table in a folder: v1, v2, ... and CURRENT, a one-row table that names one of them."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def version(self) -> int:
        """0 before the first commit. The highest entry counts: a commit appends."""
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema("version int").parquet(f"{self.path}/CURRENT").agg(F.max("version")).first()[0] or 0
        except AnalysisException:
            return 0

    def read(self) -> DataFrame:
        at = self.version()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{at}") if at else self.spark.createDataFrame([], self.schema)

    def commit(self, rows: DataFrame, expected: int | None = None) -> int:
        """Writes the next version. expected: the version that rows were made from; if another run has written since, this one is refused."""
        at = self.version() + 1
        if expected is not None and expected != at - 1:
            raise Locked(f"{self.path} is at version {at - 1}, not {expected}")
        rows.write.mode("overwrite").parquet(f"{self.path}/v{at}")
        self.spark.range(1).select(F.lit(at).alias("version")).coalesce(1).write.mode("append").parquet(f"{self.path}/CURRENT")
        return at


    def put(self, rows: DataFrame, keys: list[str]) -> int:
        """Commits the table with rows put in by key."""
        at = self.version()
        return self.commit(merge(self.read(), rows.select(*self.read().columns), keys), expected=at)


def record_answers(answers: DataFrame, path: str) -> None:
    """Appends answers (id, raw), kept ones included, as JSON lines, so a run that stops half way keeps what it paid for."""
    answers.select("id", "raw").write.mode("append").json(path)


def backup(table: Table, folder: str, day: dt.date, keep: int) -> list[str]:
    """Copies a table's current version to a folder of the day, and deletes all copies but the newest `keep`; the names of those left. The copy is read back and counted before any is deleted."""
    spark, rows = table.spark, table.read()
    to = f"{folder.rstrip('/')}/{day.isoformat()}"
    rows.write.mode("overwrite").parquet(to)
    if spark.read.schema(table.schema).parquet(to).count() != rows.count():
        raise OSError(f"{to}: the copy is not whole")
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in files.listStatus(at))
    for name in names[: -max(keep, 1)]:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)
    return names[-max(keep, 1) :]


def unseen(scanned: DataFrame, seen: DataFrame, key: str = "uid", reopen_days: int | None = None, now: Column | None = None, reopens: Column | None = None) -> DataFrame:
    """Rows whose key was never seen; with reopen_days also those for which reopens holds and that were away longer. Adds days_away."""
    old = seen.select(F.col(key).alias("__key"), F.col("last_seen").alias("__last"))
    df = scanned.join(old, F.col(key) == F.col("__key"), "left")
    away = F.datediff(now, "__last") if now is not None else F.lit(None).cast("int")
    keep = F.col("__key").isNull()
    if reopen_days is not None:
        keep = keep | F.coalesce((away > reopen_days) & (reopens if reopens is not None else F.lit(True)), F.lit(False))
    return df.filter(keep).withColumn("days_away", away).drop("__key", "__last")


def undismissed(df: DataFrame, marks: DataFrame, on: str = "url") -> DataFrame:
    return df.join(marks.filter("state = 'dismissed'").select(on), on, "left_anti")


def upsert_seen(seen: DataFrame, recorded: DataFrame, key: str = "uid") -> DataFrame:
    """seen with recorded rows merged: first_seen stays unless the row was reopened (reopened is true), last_seen and the rest are the new ones."""
    columns = [c for c in seen.columns if c != key]
    a, b = seen.alias("a"), recorded.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    new, old = F.col(f"b.{key}").isNotNull(), F.col(f"a.{key}").isNotNull()
    pick = {c: F.when(new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) for c in columns}
    pick["first_seen"] = F.when(old & ~F.coalesce(F.col("b.reopened"), F.lit(False)), F.col("a.first_seen")).otherwise(F.col("b.first_seen"))
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[pick[c].alias(c) for c in columns])


def bump(counters: DataFrame, held: DataFrame, key: str = "uid", run: str | None = None) -> DataFrame:
    """A count more for each held key, once a run however often it is held. held is one run, or several with a column that tells them apart."""
    more = held.groupBy(key).agg((F.count_distinct(run) if run else F.lit(1).cast("long")).alias("__more"))
    return counters.join(more, key, "full_outer").select(key, (F.coalesce("times", F.lit(0)) + F.coalesce("__more", F.lit(0))).cast("long").alias("times"))


def forget(counters: DataFrame, done: DataFrame, key: str = "uid") -> DataFrame:
    """counters without the keys that a run has dealt with."""
    return counters.join(done.select(key).distinct(), key, "left_anti")


def held_thin(thin: DataFrame, counters: DataFrame, key: str = "uid", after: int = 3) -> DataFrame:
    """thin (rows without a text to read) with unread: true for the run in which a row has been held often enough to be shown as it is; until then it waits."""
    times = counters.select(F.col(key).alias("__key"), F.col("times").alias("__times"))
    return thin.join(times, F.col(key) == F.col("__key"), "left").withColumn("unread", F.coalesce("__times", F.lit(0)) + 1 >= after).drop("__key", "__times")


def merge(target: DataFrame, source: DataFrame, keys: list[str], keep_if_blank: tuple[str, ...] = (), newest: str | None = None) -> DataFrame:
    """target with source's rows put in by key. A column of keep_if_blank that is null or "" in source keeps its old value. Of source rows with one key the newest stands; target has each key once.

    Keys are compared null-safe, so a null key is one key. Columns of target only.
    """
    rest = [c for c in target.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in ([newest] if newest else []) + rest])
    last = source.groupBy(*keys).agg(F.max(F.struct(order.alias("o"), *rest)).alias("__new")).select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__new")
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    both = target.withColumn("__old", F.lit(True)).join(last, on, "full_outer")
    new = F.col("__new").isNotNull()

    def value(c: str):
        fresh = F.col(f"__new.{c}")
        return F.when(new & ~(F.coalesce(fresh.cast("string"), F.lit("")) == "") if c in keep_if_blank else new, fresh).otherwise(F.col(c)).alias(c)

    picked = {k: F.when(F.col("__old").isNotNull(), F.col(k)).otherwise(F.col(f"__k_{k}")).alias(k) for k in keys}
    return both.select(*[picked[c] if c in picked else value(c) for c in target.columns])


def mark(marks: DataFrame, new: DataFrame, postings: DataFrame | None = None, key: str = "url") -> DataFrame:
    """The user's marks (url, state, company, title, updated) with new ones: the newest state stands, and a blank label never wipes one out. postings (url, company, title) lends labels to marks that have none."""
    if postings is not None:
        known = postings.groupBy(F.col(key).alias("__key")).agg(F.max("company").alias("__company"), F.max("title").alias("__title"))
        new = new.join(known, F.col(key) == F.col("__key"), "left")
        new = new.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}")) for c in ("company", "title")}).drop("__key", "__company", "__title")
    return merge(marks, new, [key], ("company", "title"), "updated")


def shortlist(marks: DataFrame, states: tuple[str, ...] = ("saved", "applied")) -> DataFrame:
    return marks.filter(F.col("state").isin(*states)).orderBy(F.desc("updated"), "url")


def unsee(seen: DataFrame, key: str) -> DataFrame:
    """seen without the rows that a uid or a url names."""
    return seen.filter(~(F.coalesce(F.col("uid") == key, F.lit(False)) | F.coalesce(F.col("url") == key, F.lit(False))))


def next_marks(marks: DataFrame, reads: DataFrame) -> DataFrame:
    """Where each source is read from next. reads: source_key, started, shape, whole, unreachable, deferred, failed.

    A mark moves to a read's start only if the read was whole, lost no page and
    put nothing off; otherwise it stays. A mark of another shape of options
    doesn't count: its source is read from the beginning, so it has no mark
    until a whole read.
    """
    ok = F.coalesce(F.col("whole"), F.lit(False)) & (F.coalesce("unreachable", F.lit(0)) == 0) & (F.coalesce("deferred", F.lit(0)) == 0) & ~F.coalesce(F.col("failed"), F.lit(False))
    last = reads.groupBy("source_key").agg(F.max(F.struct("started", ok.alias("ok"), "shape")).alias("r"))
    old = marks.select("source_key", F.col("since").alias("__since"), F.col("shape").alias("__shape"))
    both = old.join(last, "source_key", "full_outer")
    stays = F.col("r").isNull() | (F.col("__shape") == F.col("r.shape"))
    return both.select("source_key", F.when(F.col("r.ok"), F.col("r.started")).when(stays, F.col("__since")).alias("since"), F.coalesce("r.shape", "__shape").alias("shape")).filter("since is not null")


def rotate(backups: DataFrame, keep: int, at: str = "made") -> DataFrame:
    """Backups to remove: all but the newest, of which the one made last is always one. A listing of a store's own copies, one row a day."""
    newest = backups.orderBy(F.desc(at)).limit(max(keep, 1)).select(at)
    return backups.join(newest, at, "left_anti")


def finish_run(table: Table, rows: DataFrame, output: DataFrame, path: str) -> int:
    """Writes a run's output, and its state only after that; a crash between the two reports rows again and loses none."""
    output.write.mode("overwrite").parquet(path)
    return table.commit(rows)


def cache_split(items: DataFrame, cache: DataFrame, key: str = "key", since: Column | None = None) -> DataFrame:
    """items with raw and hit: an answer that is recent enough."""
    fresh = cache if since is None else cache.filter(F.col("written") >= since)
    return items.join(fresh.select(key, "raw"), key, "left").withColumn("hit", F.col("raw").isNotNull())


def prune(rows: DataFrame, cutoff: Column, stamp: str, *protected: DataFrame, key: str = "url") -> DataFrame:
    """rows without those older than the cutoff, unless one of the protected tables names them. Anti-joins: a null key protects nothing."""
    old = rows.filter(F.col(stamp) < cutoff)
    for p in protected:
        old = old.join(p.select(key).distinct(), key, "left_anti")
    return rows.join(old.select(key).distinct(), key, "left_anti")


def window_since(rows: DataFrame, mark: Column, modified: str = "lastmod", slack_days: int = 1) -> DataFrame:
    """Rows modified since a mark, less a day's slack; undated ones always."""
    return rows.filter(F.col(modified).isNull() | (F.col(modified) >= F.date_sub(mark, slack_days)))


class Log:
    """Keys in a folder, a part for each batch that brought them: written once, never rewritten."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def read(self, before: int | None = None) -> DataFrame:
        """All rows, or those of earlier batches."""
        from pyspark.errors import AnalysisException

        try:
            rows = self.spark.read.schema(f"{self.schema}, batch long").parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)
        return (rows if before is None else rows.filter(F.col("batch") < before)).drop("batch")

    def put(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


def emit_once(stream: DataFrame, key: str, output: str, checkpoint: str, log: Log, now: dt.date):
    """A streaming query that writes each key's first row to output, and then its key to the log.

    A batch is held against the keys of earlier batches only, and replaces its
    own output and keys. So one that is run again, wherever the first run
    stopped, gives the same rows: none is repeated and none is lost.
    """

    def batch(df: DataFrame, number: int) -> None:
        fresh = unseen(df.dropDuplicates([key]), log.read(before=number), key)
        path = f"{output.rstrip('/')}/batch={number}"
        fresh.drop("days_away").write.mode("overwrite").parquet(path)
        log.put(df.sparkSession.read.parquet(path).select(F.col(key), F.lit(now).alias("last_seen")), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def days_off(scanned: DataFrame, seen: DataFrame, now: Column, gap_days: int, title: str = "title", key: str = "uid") -> DataFrame:
    """uid and days_away of seen postings of yearly programmes that no scan has listed for more than gap_days; one a key. A last_seen that is no time brings nothing back."""
    from ..functions.extract import is_programme

    then = F.col("__last").try_cast("timestamp")
    old = seen.select(F.col(key).alias("__key"), F.col("last_seen").cast("string").alias("__last"))
    both = scanned.filter(is_programme(F.col(title))).join(old, F.col(key) == F.col("__key")).filter(then < now - F.make_dt_interval(F.lit(gap_days)))
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)
    return both.groupBy(key).agg(F.max(F.floor(seconds / 86400)).cast("int").alias("days_away"))


def appended(history: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """A history with a run's rows; a row of the same keys is replaced, so a run that is recorded twice counts once."""
    return merge(history, rows, keys)


def kept_days(retention: int, cache_days: int) -> int:
    """Days that an answer is kept: never fewer than it may be used; 0 keeps all."""
    return 0 if 0 in (retention, cache_days) else max(retention, cache_days)


def prune_report(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Rows removed from each table, one row a table."""
    count = lambda tables, n: [t.agg(F.count("*").alias(n)).withColumn("table", F.lit(k)) for k, t in tables.items()]
    unite = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(unite(parts[1:]))
    return unite(count(before, "had")).join(unite(count(after, "has")), "table").select("table", (F.col("had") - F.col("has")).alias("removed"))


def with_known_names(marks: DataFrame, pages: DataFrame) -> DataFrame:
    """marks (url, state, company, title) with the company and title of the page kept for a url where the mark gives none."""
    known = pages.groupBy(F.col("url").alias("__url")).agg(*[F.max(F.nullif(F.col(c), F.lit(""))).alias(f"__{c}") for c in ("company", "title")])
    both = marks.join(known, F.col("url") == F.col("__url"), "left")
    return both.select("url", "state", *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}"), F.lit("")).alias(c) for c in ("company", "title")])


class Locked(RuntimeError):
    """Another run writes to the same state."""


class TooNew(RuntimeError):
    """The state was written by a later version of the library."""


def run_lock(spark: SparkSession, path: str):
    """A context in which this run alone writes to a folder of state: a file that can be created only once, on any file system that Spark writes to."""
    from contextlib import contextmanager

    @contextmanager
    def held():
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/LOCK")
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(at.getParent())
        if not files.createNewFile(at):
            raise Locked(f"{path} is in use; delete {at} if its run is gone")
        try:
            yield
        finally:
            files.delete(at, False)

    return held()


def migrated(rows: DataFrame, version: int, steps: list) -> DataFrame:
    """Rows of an older layout brought to the newest, step by step; steps[i] takes layout i to i + 1. A layout that is newer than all steps is refused."""
    if version > len(steps):
        raise TooNew(f"layout {version}; this library knows layouts up to {len(steps)}")
    for step in steps[version:]:
        rows = step(rows)
    return rows


def record_scan(table: Table, shown: DataFrame, recorded: DataFrame, output: str, counters: DataFrame | None = None, dry: bool = False) -> dict[str, DataFrame]:
    """Ends a scan: its output first, then what it has seen, merged; a dry run writes neither. Returns the tables as they are after it, or would be: seen, and counters without the keys that were dealt with."""
    seen = upsert_seen(table.read(), recorded)
    if not dry:
        finish_run(table, seen, shown, output)
        seen = table.read()
    return {"seen": seen} | ({"counters": forget(counters, recorded)} if counters is not None else {})
