"""Connectors of boards and search services: requests page by page, through a transport that tests replace.

A connector makes requests and reads payloads; what a payload's rows mean is in
readers.BOARDS. Queries of a service are independent, so they are rows of a
DataFrame and read on the executors, one after another within a task.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fetching, readers
from .fetching import Entry, Skipped

#: A transport takes method, url, parameters, body and headers, and returns text; what it raises has a `status` if the server answered.
Transport = Callable[[str, str, dict, Any, dict], str]
#: Statuses that are worth another try.
AGAIN = (408, 425, 429)
PAYLOADS = "query string, page int, payload string, note string, total long"


class HttpError(Exception):
    def __init__(self, url: str, status: int | None, detail: str, wait: float | None = None) -> None:
        super().__init__(f"{url}: {detail}")
        self.status, self.wait = status, wait


def http(method: str, url: str, params: dict, body: Any, headers: dict, timeout: float = 30.0) -> str:
    """The transport of production."""
    import urllib.error
    import urllib.parse
    import urllib.request

    full = f"{url}?{urllib.parse.urlencode(params)}" if params else url
    data = None if body is None else json.dumps(body).encode()
    head = headers | ({"Content-Type": "application/json"} if body is not None else {})
    try:
        with urllib.request.urlopen(urllib.request.Request(full, data, head, method=method), timeout=timeout) as r:
            return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        told = e.headers.get("Retry-After", "")
        raise HttpError(url, e.code, f"status {e.code}", float(told) if told.isdigit() else None) from e
    except (OSError, ValueError) as e:
        raise HttpError(url, None, str(e)) from e


def patient(send: Transport, tries: int = 3, base: float = 1.0, cap: float = 30.0, sleep: Callable[[float], None] = time.sleep, draw: Callable[[], float] | None = None) -> Transport:
    """A transport that asks again after a lost connection, a server's error or a plea to wait: as long as the server says, else a drawn share of a doubling wait, at most cap. Other refusals are final."""
    import random

    draw = draw or random.random

    def call(method: str, url: str, params: dict, body: Any, headers: dict) -> str:
        for turn in range(tries):
            try:
                return send(method, url, params, body, headers)
            except Exception as e:
                status, told = getattr(e, "status", None), getattr(e, "wait", None)
                if turn == tries - 1 or not (status is None or status >= 500 or status in AGAIN):
                    raise
                sleep(min(told if told is not None else base * 2**turn * draw(), cap))
        raise AssertionError

    return call


@dataclass(frozen=True)
class Api:
    """How a service is asked. url, params, body and headers may hold {slug}, {query}, {place}, {page}, {skip}, {size}, {cursor} and options; where the payload keeps its rows, its count and its next token; rows of a full page (0: the service has one page)."""

    url: str
    params: dict = field(default_factory=dict)
    body: dict | None = None
    headers: dict = field(default_factory=dict)
    rows: str = "jobs"
    count: str = ""
    size: int = 0
    token: str = ""
    needs: tuple[str, ...] = ()
    other_urls: tuple[str, ...] = ()


# The public interfaces of boards and search services.
APIS = {
    "smartrecruiters": Api("https://api.smartrecruiters.com/v1/companies/{slug}/postings", {"limit": "{size}", "offset": "{skip}"}, rows="content", count="totalFound", size=100),
    "greenhouse": Api("https://boards-api.greenhouse.io/v1/boards/{slug}/jobs", {"content": "true"}),
    "lever": Api("https://api.lever.co/v0/postings/{slug}", {"mode": "json"}, rows="", other_urls=("https://api.eu.lever.co/v0/postings/{slug}",)),
    "ashby": Api("https://api.ashbyhq.com/posting-api/job-board/{slug}"),
    "workable": Api("https://apply.workable.com/api/v1/widget/accounts/{slug}", {"details": "true"}),
    "workday": Api("https://{slug}.{host}.myworkdayjobs.com/wday/cxs/{slug}/{site}/jobs", body={"searchText": "{query}", "limit": "{size}", "offset": "{skip}", "appliedFacets": "{facets}"}, rows="jobPostings", count="total", size=20, needs=("host", "site")),
    "adzuna": Api("https://api.adzuna.com/v1/api/jobs/{slug}/search/{page}", {"app_id": "{app_id}", "app_key": "{app_key}", "what": "{query}", "results_per_page": "{size}"}, rows="results", count="count", size=50, needs=("app_id", "app_key")),
    "reed": Api("https://www.reed.co.uk/api/1.0/search", {"keywords": "{query}", "locationName": "{place}", "resultsToTake": "{size}", "resultsToSkip": "{skip}"}, headers={"Authorization": "Basic {basic}"}, rows="results", count="totalResults", size=100, needs=("key",)),
    "jooble": Api("https://jooble.org/api/{key}", body={"keywords": "{query}", "location": "{place}", "page": "{page}"}, count="totalCount", size=20, needs=("key",)),
    "workable_search": Api("https://jobs.workable.com/api/v1/jobs", {"query": "{query}", "location": "{place}", "pageToken": "{cursor}"}, count="totalSize", token="nextPageToken"),
}


def _filled(value: Any, names: dict) -> Any:
    """A request's part with its names filled in; parameters that come out empty are left out."""
    if isinstance(value, dict):
        made = {k: _filled(v, names) for k, v in value.items()}
        return {k: v for k, v in made.items() if v not in ("", None)}
    if isinstance(value, str) and value.startswith("{") and value.endswith("}") and value.count("{") == 1:
        return names.get(value[1:-1], "")
    return value.format_map(names) if isinstance(value, str) else value


def read_query(api: Api, send: Transport, names: dict, most: int) -> Iterator[dict]:
    """The pages of one query: page, payload, total (the first page's), and on the last one a note if the read was cut.

    A read ends with a short or empty page, the stated count, the last token, or
    most pages. A page that opens with a row that opened an earlier one, or a
    token that was sent before, means that paging isn't honoured: it is
    dropped, and the note says so. A first page that fails fails the query; a
    later one ends it with a note.
    """
    seen, sent, read, total, cursor, url = set(), set(), 0, None, "", api.url
    for page in range(1, most + 1):
        at = names | {"page": page, "skip": (page - 1) * api.size, "size": api.size, "cursor": cursor}
        try:
            try:
                payload = send("POST" if api.body else "GET", _filled(url, at), _filled(api.params, at), _filled(api.body, at) if api.body else None, _filled(api.headers, at))
            except Exception as e:
                if getattr(e, "status", None) != 404 or page > 1 or not api.other_urls:
                    raise
                url = api.other_urls[0]
                payload = send("GET", _filled(url, at), _filled(api.params, at), None, _filled(api.headers, at))
            data = json.loads(payload)
        except Exception as e:
            if page == 1:
                raise
            yield {"page": page, "payload": None, "total": total, "note": f"page {page} failed, {read} read: {getattr(e, 'status', None) or 'no answer'}"}
            return
        rows = (data.get(api.rows) if api.rows and isinstance(data, dict) else data) or []
        if total is None and isinstance(data, dict) and isinstance(count := data.get(api.count), int):
            total = max(count, 0)
        first = json.dumps(rows[0], sort_keys=True) if rows else None
        if first is not None and first in seen:
            yield {"page": page, "payload": None, "total": total, "note": f"a page repeated rows, {read} read"}
            return
        seen.add(first)
        read += len(rows)
        cursor = str(data.get(api.token) or "") if api.token and isinstance(data, dict) else ""
        last = not rows or (api.size and len(rows) < api.size) or (total is not None and read >= total) or (not api.size and not cursor)
        stuck = not last and cursor and cursor in sent
        cut = page == most and not last
        note = f"the same page token came back, {read} read" if stuck else f"stopped after {most} pages, {read}{f' of {total}' if total is not None else ''} read" if cut else ""
        yield {"page": page, "payload": payload, "total": total, "note": note}
        if last or stuck:
            return
        sent.add(cursor)


def payloads(spark: SparkSession, e: Entry, send: Transport | None = None) -> DataFrame:
    """query, page, payload, note and total of all pages of a source's queries. A query that fails is a row without payload; the source fails only if all do. Missing keys skip the source."""
    import base64

    api = APIS[e.kind]
    if missing := [n for n in api.needs if not e.options.get(n)]:
        raise Skipped(f"no {', '.join(missing)}")
    queries = [str(q) for q in e.options.get("queries") or [""]]
    names = {"slug": e.slug, "place": str(e.options.get("where", "")), "facets": e.options.get("facets") or {}} | {n: e.options[n] for n in api.needs}
    if "key" in api.needs:
        names["basic"] = base64.b64encode(f"{e.options['key']}:".encode()).decode()
    most, wait = int(e.options.get("pages", 50)), float(e.options.get("delay", fetching.KINDS.get(e.kind, fetching.Kind()).delay))
    call = send or patient(http)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for query in rows["query"]:
                out = []

                def paced(*request, asked=[False]):  # noqa: B006
                    if wait and asked[0]:
                        time.sleep(wait)
                    asked[0] = True
                    return call(*request)

                try:
                    for x in read_query(api, paced, names | {"query": query}, most):
                        out.append((query, x["page"], x["payload"], x["note"], x["total"]))
                except Exception as problem:
                    out.append((query, 0, None, f"failed: {getattr(problem, 'status', None) or type(problem).__name__}", None))
                yield pd.DataFrame(out, columns=["query", "page", "payload", "note", "total"]).astype({"total": "Int64"})

    made = spark.createDataFrame([(q,) for q in dict.fromkeys(queries)], "query string").repartition(len(set(queries)), "query").mapInPandas(run, PAYLOADS).persist()
    if made.filter("payload is not null").isEmpty():
        why = made.select("note").first()
        raise HttpError(e.kind, None, f"every query failed: {why.note if why else 'none'}")
    return made


def source(kind: str, send: Transport | None = None) -> Callable[[SparkSession, Entry, str | None], DataFrame]:
    """A reader for fetching.SOURCES: a service's postings, each once by its id where several queries found it. Rows without a title or url are left out."""

    def read(spark: SparkSession, e: Entry, mark: str | None) -> DataFrame:
        pages = payloads(spark, e, send).filter("payload is not null").select("payload")
        found = readers.postings(pages, kind, F.lit(e.label or e.slug)).withColumn("source", F.lit(f"{kind}:{e.slug}"))
        named = found.filter("raw_id <> ''").dropDuplicates(["raw_id"])
        return named.unionByName(found.filter("raw_id = ''"))

    return read


for _kind in APIS:
    fetching.SOURCES[_kind] = source(_kind)


def page_reports(pages: DataFrame) -> DataFrame:
    """One row: pages read, queries, those that failed, the count that a single query states, and all notes."""
    return pages.agg(
        F.count("payload").alias("pages"), F.count_distinct("query").alias("queries"), F.count_distinct(F.when(F.startswith("note", F.lit("failed")), F.col("query"))).alias("failed"),
        F.when(F.count_distinct("query") == 1, F.max("total")).alias("total"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("note") != "", F.concat_ws(": ", F.nullif("query", F.lit("")), "note")))), "; ").alias("notes"),
    )


#: Entries of a sitemap, and pages of a site read at once, at most; the name that robots.txt is asked for.
MOST_ENTRIES, MOST_PAGES, AGENT = 50_000, 200, "veritab"


def site_pages(spark: SparkSession, e: Entry, mark: str | None = None, send: Transport | None = None, cache: DataFrame | None = None) -> tuple[DataFrame, str]:
    """Pages of a site by its sitemap (loc, lastmod, html, outcome), and a note if more were listed than are read.

    Options: sitemap, include and exclude (patterns of addresses), max_pages.
    Only pages modified since the mark, less a day, are read; the newest come
    first. A page that the cache holds as it was last modified costs no request;
    the others are read one after another, as far apart as the site's robots.txt
    asks. outcome: kept, read, lost (gone for good) or failed, which holds the
    mark back.
    """
    from urllib.parse import urlsplit

    from ..streaming.state import window_since
    from . import paging

    call = send or patient(http)
    if not (sitemap := e.options.get("sitemap")):
        raise Skipped("no sitemap")
    most, parts = int(e.options.get("max_pages", MOST_PAGES)), urlsplit(sitemap)
    try:
        robots = call("GET", f"{parts.scheme}://{parts.netloc}/robots.txt", {}, None, {})
    except Exception:
        robots = ""
    wait = max(float(e.options.get("delay", 0)), spark.range(1).select(fetching.crawl_delay(F.lit(robots), AGENT)).first()[0])
    xml = spark.createDataFrame([(call("GET", sitemap, {}, None, {}),)], "xml string")
    listed = paging.selected(paging.entries_of(xml, MOST_ENTRIES), e.options.get("include"), e.options.get("exclude"))
    if mark:
        listed = window_since(listed, F.lit(mark).cast("date"))
    total = listed.count()
    top = listed.orderBy(F.col("lastmod").desc_nulls_last(), "loc").limit(most)
    held = paging.kept_pages(top, cache) if cache is not None else top.withColumns({"html": F.lit(None).cast("string"), "hit": F.lit(False)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        began = False
        for rows in batches:
            out = []
            for loc in rows["loc"]:
                if began and wait:
                    time.sleep(wait)
                began = True
                try:
                    out.append((loc, 200, call("GET", loc, {}, None, {})))
                except Exception as problem:
                    out.append((loc, getattr(problem, "status", None), None))
            yield pd.DataFrame(out, columns=["__loc", "status", "__html"]).astype({"status": "Int64"})

    # One task: a site is asked one thing at a time.
    read = held.filter("not hit").select("loc").coalesce(1).mapInPandas(run, "__loc string, status int, __html string").persist()
    pages = held.join(read, F.col("loc") == F.col("__loc"), "left")
    pages = pages.select("loc", "lastmod", F.coalesce("html", "__html").alias("html"), F.when(F.col("hit"), "kept").otherwise(paging.page_outcome(F.col("status"))).alias("outcome"))
    return pages, f"read {most} of {total} pages" if total > most else ""


def site(send: Transport | None = None, cache: DataFrame | None = None) -> Callable[[SparkSession, Entry, str | None], DataFrame]:
    """A reader for fetching.SOURCES: the postings that a site's pages hold in their markup."""

    def read(spark: SparkSession, e: Entry, mark: str | None) -> DataFrame:
        from ..functions.text import is_remote
        from .structured import postings_in

        pages, _ = site_pages(spark, e, mark, send, cache)
        found = postings_in(pages.filter("html is not null").select(F.col("loc").alias("url"), "html"))
        remote = is_remote(F.col("location"), F.col("title"))
        return found.select(F.lit(e.key).alias("source"), F.when(F.col("company") == "", F.lit(e.label or e.slug)).otherwise(F.col("company")).alias("company"), "title", "location", "url", "description", "posted", remote.alias("remote"), F.col("url").alias("raw_id"))

    return read


fetching.SOURCES["structured"] = site()
