"""What connectors do with pages once they are rows: listings with details, selection by sitemap, pages kept from before, and reports of each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_verdicts(pages: DataFrame, size: int) -> DataFrame:
    """pages (query, page from 1, rows array<string>, total) with read (whether a reader would have taken the page) and ends (why it is the last): short, empty, count reached, or begins again (its first row opened an earlier page of the query).

    A query's first end decides, so it is found by an aggregation and no page waits for another.
    """
    first = F.sha2(F.get("rows", F.lit(0)), 256)
    n = F.coalesce(F.size("rows"), F.lit(0))
    df = pages.withColumns({"__first": first, "__n": n})
    opened = df.filter("__first is not null").groupBy(F.col("query").alias("__q"), F.col("__first").alias("__f")).agg(F.min("page").alias("__opened"))
    df = df.join(opened, (F.col("query") == F.col("__q")) & (F.col("__first") == F.col("__f")), "left")
    again = F.coalesce(F.col("page") > F.col("__opened"), F.lit(False))
    # Only the first page's total is trusted; later ones may say 0.
    total = pages.filter("page = 1").groupBy(F.col("query").alias("__t")).agg(F.max("total").alias("__total"))
    df = df.join(total, F.col("query") == F.col("__t"), "left")
    ends = F.when(F.col("__n") == 0, "empty").when(again, "begins again").when(F.col("__n") < size, "short").when((F.col("__total") > 0) & (F.col("page") * size >= F.col("__total")), "count reached")
    df = df.withColumn("ends", ends).drop("__q", "__f", "__opened", "__t", "__total", "__first", "__n")
    last = df.filter("ends is not null").groupBy(F.col("query").alias("__q")).agg(F.min("page").alias("__last"))
    return df.join(last, F.col("query") == F.col("__q"), "left").withColumn("read", F.coalesce(F.col("page") <= F.col("__last"), F.lit(True)) & ~F.coalesce("ends", F.lit("")).isin("empty", "begins again")).drop("__q", "__last")


def first_by_path(listing: DataFrame, path: str = "path", order: str = "ordinal") -> DataFrame:
    """One row a path over all search texts, the first listed; rows without a path are never one another's copies."""
    named = listing.filter(F.col(path).isNotNull() & (F.col(path) != ""))
    rest = listing.filter(F.col(path).isNull() | (F.col(path) == ""))
    one = named.groupBy(path).agg(F.min_by(F.struct(*listing.columns), order).alias("__row")).select("__row.*")
    return one.unionByName(rest)


def with_details(listing: DataFrame, details: DataFrame, columns: list[str], path: str = "path") -> DataFrame:
    """listing with each column taken from its detail where that has one; a posting whose detail failed keeps its listing row."""
    found = details.groupBy(F.col(path).alias("__path")).agg(*[F.max(F.nullif(F.col(c), F.lit(""))).alias(f"__{c}") for c in columns])
    both = listing.join(found, F.col(path) == F.col("__path"), "left")
    return both.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in listing.columns])


def shortfall(read: Column, total: Column) -> Column:
    return F.when(read < total, F.format_string("read %d of %d", read, total))


def selected(entries: DataFrame, include: str | None = None, exclude: str | None = None, newest_after: Column | None = None) -> DataFrame:
    """Sitemap entries (loc, lastmod) worth reading. Undated ones always are, as far as age goes."""
    keep = F.lit(True)
    if include:
        keep = keep & F.col("loc").rlike(include)
    if exclude:
        keep = keep & ~F.col("loc").rlike(exclude)
    if newest_after is not None:
        keep = keep & (F.col("lastmod").isNull() | (F.col("lastmod") >= newest_after))
    return entries.filter(keep)


def entries_of(sitemaps: DataFrame, most: int, xml: str = "xml") -> DataFrame:
    """loc and lastmod of sitemaps; one with more than `most` entries is an error before any is read."""
    from .readers import sitemap

    over = sitemaps.filter(F.regexp_count(xml, F.lit("<loc>")) > most).select(F.regexp_count(xml, F.lit("<loc>"))).head(1)
    if over:
        raise ValueError(f"a sitemap of {over[0][0]} entries; at most {most} are read")
    rest = [c for c in sitemaps.columns if c != xml]
    return sitemaps.select(*rest, F.inline(sitemap(F.col(xml))))


def kept_pages(entries: DataFrame, cache: DataFrame) -> DataFrame:
    """entries (loc, lastmod) with html from a cache (url, lastmod, html), and hit: the cache holds the page as it was last modified. An undated entry never is a hit."""
    held = cache.select(F.col("url").alias("__url"), F.col("lastmod").alias("__mod"), "html")
    return entries.join(held, (F.col("loc") == F.col("__url")) & (F.col("lastmod") == F.col("__mod")), "left").withColumn("hit", F.col("__url").isNotNull()).drop("__url", "__mod")


def page_outcome(status: Column) -> Column:
    """lost pages are gone for good; a failed one holds its source's mark back, so that it is read again."""
    return F.when(status.isNull(), "failed").when(status == 200, "read").when(status.isin(404, 410), "lost").otherwise("failed")


def source_reports(sources: DataFrame, rows: DataFrame, key: str = "source_key") -> DataFrame:
    """One row a source (source_key, error, skipped), whatever it gave: n, and what a look at it says. A failed source has no rows and fails nothing else."""
    from .readers import probe

    counts = rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("n"))
    df = sources.join(counts, F.col(key) == F.col("__key"), "left").drop("__key").withColumn("n", F.when(F.col("error").isNotNull(), 0).otherwise(F.coalesce("n", F.lit(0))))
    return df.withColumn("status", probe(F.col("error"), F.coalesce(F.col("skipped"), F.lit(False)), F.col("n")))


def drop_stale(jobs: DataFrame, as_of: Column, max_age_days: int, undated_kinds: tuple[str, ...] = ()) -> DataFrame:
    """jobs that are fresh, undated, or of a kind of source whose dates say nothing of freshness. source is kind:label."""
    kind = F.split_part("source", F.lit(":"), F.lit(1))
    keep = F.col("posted").isNull() | (F.col("posted") >= F.date_sub(as_of, max_age_days))
    return jobs.filter(keep | kind.isin(*undated_kinds) if undated_kinds else keep)
