"""Postings that pages carry as JSON-LD, microdata or RDFa."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import COUNTRIES, html_text, iso_date, java_date, squeeze

_FOUND = "url string, title string, company string, location string, description string, posted string, raw_id string"


def _nodes(value) -> Iterator[dict]:
    """All objects of a document, outermost first."""
    if isinstance(value, list):
        for x in value:
            yield from _nodes(x)
    elif isinstance(value, dict):
        yield value
        for x in value.values():
            yield from _nodes(x)


def _name(value) -> str:
    """The text of a value that may be bare, a list, or an object with a name."""
    if isinstance(value, list):
        return next((n for x in value if (n := _name(x))), "")
    if isinstance(value, dict):
        return _name(value.get("name") or value.get("value") or value.get("@value"))
    return "" if value is None else str(value)


def _place(value) -> str:
    if isinstance(value, list):
        return next((p for x in value if (p := _place(x))), "")
    if not isinstance(value, dict):
        return _name(value)
    address = value.get("address", value)
    address = address[0] if isinstance(address, list) and address else address
    if not isinstance(address, dict):
        return _name(address)
    parts = [_name(address.get(k)) for k in ("addressLocality", "addressRegion", "addressCountry")]
    return ", ".join(p for p in parts if p) or _country(_name(address.get("streetAddress")) or _name(value))


def _country(name: str) -> str:
    """The country of a bare two-letter code; anything else as it is."""
    return COUNTRIES.get(name.upper(), name) if len(name) == 2 else name


def _is_posting(node: dict) -> bool:
    kinds = node.get("@type")
    return any(str(k).replace("#", "/").rsplit("/", 1)[-1] == "JobPosting" for k in (kinds if isinstance(kinds, list) else [kinds]))


#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Attributes in which an element may state its value, in order.
STATED = ("content", "datetime", "href", "src")


def marked_items(html: str, scope: str, prop: str) -> list[dict]:
    """All items that elements' attributes mark, outermost first, as JSON-LD would have them: microdata (scope itemtype, prop itemprop) or RDFa (typeof, property).

    An element with a property and a scope of its own is an object; one without is text: what it states in an attribute, else what it holds.
    """
    from html.parser import HTMLParser

    class Items(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.open: list[tuple[str, dict | None, tuple[dict, str, list[str]] | None]] = []
            self.found: list[dict] = []

        def owner(self) -> dict | None:
            return next((item for _, item, _ in reversed(self.open) if item is not None), None)

        def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
            has = dict(attrs)
            if tag in ("br", "p", "li", "div", "tr"):
                self.handle_data("\n")
            owner, name = self.owner(), (has.get(prop) or "").split()
            item = text = None
            if scope in has or "itemscope" in has and prop == "itemprop":
                item = {"@type": (has.get(scope) or "").split()}
                self.found.append(item)
            for n in name if owner is not None else ():
                n = n.replace("#", "/").rsplit("/", 1)[-1].rsplit(":", 1)[-1]
                stated = next((has[k] for k in STATED if has.get(k)), None)
                if item is not None:
                    owner.setdefault(n, []).append(item)
                elif stated is not None:
                    owner.setdefault(n, []).append(stated)
                else:
                    text = (owner, n, [])
            if tag not in VOID:
                self.open.append((tag, item, text))

        def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                self.handle_endtag(tag)

        def handle_endtag(self, tag: str) -> None:
            if not any(t == tag for t, _, _ in self.open):
                return
            while self.open:
                t, _, text = self.open.pop()
                if text is not None:
                    text[0].setdefault(text[1], []).append("".join(text[2]))
                if t == tag:
                    break

        def handle_data(self, data: str) -> None:
            for _, _, text in self.open:
                if text is not None:
                    text[2].append(data)

    parser = Items()
    parser.feed(html)
    parser.close()
    while parser.open:
        parser.handle_endtag(parser.open[-1][0])
    return parser.found


def _json_ld(html: str) -> Iterator[dict]:
    import json
    import re

    for text in re.findall(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script\s*>", html, re.S | re.I):
        try:
            yield from _nodes(json.loads(text, strict=False))
        except ValueError:
            continue


def postings_in(pages: DataFrame) -> DataFrame:
    """The first JobPosting of each page (url, html) that has one: in JSON-LD, else in microdata, else in RDFa. Pages without give no row, and what is broken is passed over.

    Pages that never name the type don't reach Python: a substring test stands before.
    """

    def first(html: str) -> dict | None:
        for items in (_json_ld(html), marked_items(html, "itemtype", "itemprop"), marked_items(html, "typeof", "property")):
            node = next((n for n in items if _is_posting(n)), None)
            if node:
                return node
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, html in zip(batch["url"], batch["html"], strict=True):
                if node := first(html):
                    rows.append((_name(node.get("url")) or url, _name(node.get("title")), _name(node.get("hiringOrganization")), _place(node.get("jobLocation")), _name(node.get("description")), _name(node.get("datePosted")), _name(node.get("identifier"))))
            yield pd.DataFrame(rows, columns=["url", "title", "company", "location", "description", "posted", "raw_id"])

    found = pages.filter(F.contains("html", F.lit("JobPosting"))).select("url", "html").mapInPandas(run, _FOUND)
    # Markup may be escaped once: decoding comes before the tags go.
    text = html_text(F.replace(F.replace("description", F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")))
    return found.withColumns({"title": squeeze(F.col("title")), "company": squeeze(F.col("company")), "location": squeeze(F.col("location")), "description": text, "posted": F.coalesce(iso_date(F.col("posted")), java_date(F.col("posted")))}).filter("title <> '' and url <> ''")
