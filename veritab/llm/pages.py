"""Main text of web pages by inferred wrappers.

Pages of a host come from one template. A page is read as a stream of tokens:
opening and closing tags of block elements, and texts between them. Streams are
aligned page by page, level by level, into a wrapper, a regular expression
without unions: tokens that repeat near each other fold into a repeated group,
tokens that some pages lack become optional groups, and texts that differ
become slots. The wrapper decides: what the pages share is template and goes;
elements whose label says boilerplate go unless they hold most of what varies;
the element that holds what varies is the article, and a page's main text is
what stands in its slots.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._packed import written

#: Expected pages of a host in a group that is aligned together.
GROUP_PAGES = 256
#: A table of hosts up to so many rows may be broadcast; a larger one is shuffled.
BROADCAST_HOSTS = 100_000
#: Elements nested deeper are taken as empty, and what they hold as their parent's.
DEEPEST = 200
#: Pages that must share a text of the article before it counts as template: two may quote the same.
SHARED = 3
#: How near tokens of one label must stand to fold into a repeated group.
NEAR = 4

# Elements without end tags, those that stand in a line, those whose content is no markup, and those that are never main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img svg".split())
RAW = frozenset("script style noscript template textarea iframe noframes xmp".split())
NEVER = frozenset("nav footer aside form head title button select dialog menu option datalist audio video canvas object".split())
MAIN = frozenset("article main".split())
#: Class, id and role words of boilerplate; and those that are boilerplate only where the wrapper bears it out.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer masthead comment comments reply replies respond disqus share sharing related recommended newsletter subscribe "
    "subscription signup login popup modal pagination pager complementary contentinfo".split()
)
WEAK = frozenset("alert side foot header social overlay widget toolbar skip hidden search".split())
#: Elements whose id is mostly made of their text, and what stands in a head.
_SLUGGED = frozenset("h1 h2 h3 h4 h5 h6 p li td th dt dd".split())
_IN_HEAD = frozenset("title meta link base".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"([^\s\"'=/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_RAW_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in (*RAW, "svg")}
_NUMBER = re.compile(r"[0-9]+")
#: An opening tag that ends an open one of these.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SCOPES = frozenset("article section div main body html table ul ol dl td th".split())


def tags(html: str):
    """(start, end, closes, name, attributes) of each tag, in order; what is no text has an empty name. Each character is looked at a bounded number of times, however broken the page."""
    at, n, svg = 0, len(html), True
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = n if end < 0 else end + 3
            yield at, end, False, "", ""
        elif m := _TAG.match(html, at):
            end, name = m.end(), m[2].lower()
            if not m[1] and (name in RAW or name == "svg" and svg and not m[3].rstrip().endswith("/")):
                close = _RAW_END[name].search(html, end)
                if close or name != "svg":
                    yield at, close.end() if close else n, False, "", ""
                    at = close.end() if close else n
                    continue
                svg = False
            yield at, end, bool(m[1]), name, m[3]
        elif at + 1 < n and (html[at + 1].isascii() and html[at + 1].isalpha() or html[at + 1] in "/!?"):
            # A declaration, or what looks like a tag that never ends: no text.
            cut = html.find("<", at + 1)
            cut = n if cut < 0 else cut
            end = html.find(">", at + 1, cut) + 1 or cut
            yield at, end, False, "", ""
        else:
            end = at + 1
        at = end


class Node:
    """A block element: its tag, its kind (the tag, or main by its role), its label (kind, first class and hint), what its labels say (2 strong, 1 weak, 0 nothing), and texts (text, characters in links) and elements in order, each with its group of the wrapper."""

    __slots__ = ("tag", "kind", "label", "hint", "children", "groups")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag = self.kind = tag
        self.hint, self.children, self.groups = 0, [], []
        first = ""
        for key, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
            if (key := key.lower()) not in ("class", "id", "role"):
                continue
            words = "".join(values).lower().split()
            if key == "class" and words:
                first = "." + _NUMBER.sub("0", words[0])
            if key == "role" and "main" in words:
                self.kind = "main"
            if tag not in ("html", "body", "main") and not (key == "id" and tag in _SLUGGED):
                self.hint = max(self.hint, 2 if not STRONG.isdisjoint(words) else 1 if not WEAK.isdisjoint(words) else 0)
        self.label = f"{self.kind}{first}{'!' * self.hint}"


class _Builder:
    """Puts tokens together to the tree of a page, lenient: end tags without a start are ignored, and missing ones are supplied."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.stack = [self.root]
        self.pieces: list[str] = []
        self.linked, self.links = False, 0

    def text(self, piece: str) -> None:
        self.pieces.append(piece)
        if self.linked:
            self.links += len(piece)

    def flush(self) -> None:
        if self.pieces:
            raw = "".join(self.pieces)
            if text := " ".join((_html.unescape(raw) if "&" in raw else raw).split()):
                self.stack[-1].children.append((text, min(self.links, len(text))))
            self.pieces.clear()
            self.links = 0

    def close(self, name: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == name:
                self.flush()
                del self.stack[i:]
                self.linked = False
                return

    def open(self, name: str, attributes: str) -> None:
        stack = self.stack
        if name in ("html", "body") and len(stack) <= 2:
            if name == "body":
                self.flush()
                del stack[1:]
                stack[0].children.append(node := Node(name, attributes))
                stack.append(node)
            return
        self.flush()
        if stack[-1].tag == "head" and name not in _IN_HEAD:
            stack.pop()
        if ends := _CLOSES.get(name, frozenset()) | ({"p"} if name in _ENDS_P else frozenset()):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    del stack[i:]
                    break
                if stack[i].tag in _SCOPES:
                    break
        stack[-1].children.append(node := Node(name, attributes))
        if name not in VOID and not attributes.rstrip().endswith("/") and len(stack) < DEEPEST:
            stack.append(node)


def parse(html: str) -> Node:
    """The tree of a page's tokens. Elements that stand in a line are part of the text around them, unless their label says boilerplate."""
    out = _Builder()
    at = 0
    spans: list[bool] = []  # of each open inline element, whether it is a token of its own
    for start, end, closes, name, attributes in tags(html):
        if start > at:
            out.text(html[at:start])
        at = end
        if not name:
            continue
        if name in INLINE:
            if name == "a":
                out.linked = not closes
            if name in VOID or attributes.rstrip().endswith("/"):
                continue
            if closes:
                if spans and spans.pop():
                    out.close(name)
            else:
                own = bool(attributes) and Node(name, attributes).hint == 2
                if len(spans) < DEEPEST:
                    spans.append(own)
                    if own:
                        out.open(name, attributes)
        elif closes:
            out.close(name)
        else:
            out.open(name, attributes)
    if at < len(html):
        out.text(html[at:])
    out.flush()
    return out.root


class Group:
    """A part of a wrapper: an element or a text slot, on how many pages it stands, whether it repeats, and, of texts, on how many pages each stands."""

    __slots__ = ("label", "kind", "hint", "pages", "last", "repeats", "children", "seen", "chars", "links", "varying", "gone")

    def __init__(self, label: str, kind: str, hint: int) -> None:
        self.label, self.kind, self.hint = label, kind, hint
        self.pages, self.last, self.repeats, self.children = 0, -1, False, []
        #: text: its last page, and its pages.
        self.seen: dict[str, list[int]] = {}
        self.chars = self.links = self.varying = 0
        self.gone = False

    def template(self, text: str, pages: int, least: int = 2) -> bool:
        """Whether a text stands here on so many pages at least, and on half of all."""
        n = self.seen[text][1]
        return n >= least and 2 * n >= pages


def fold(children: list) -> list[tuple[str, list[int]]]:
    """Places of children by label; those that stand near each other are one repeated group."""
    out: list[tuple[str, list[int]]] = []
    for i, x in enumerate(children):
        label = "#" if isinstance(x, tuple) else x.label
        for have, places in out[: -NEAR - 1 : -1]:
            if have == label:
                places.append(i)
                break
        else:
            out.append((label, [i]))
    return out


def align(have: list[str], new: list[str]) -> list[tuple[int | None, int | None]]:
    """Pairs of places in order, by a longest common subsequence; what has no partner is optional.

    The subsequence is the longest rise among the places of equal labels, found
    by binary search.
    """
    low, n, m = 0, len(have), len(new)
    while low < n and low < m and have[low] == new[low]:
        low += 1
    while n > low and m > low and have[n - 1] == new[m - 1]:
        n, m = n - 1, m - 1
    places: dict[str, list[int]] = {}
    for j in range(m - 1, low - 1, -1):
        places.setdefault(new[j], []).append(j)
    tails: list[int] = []
    ends: list[tuple] = []
    for i in range(low, n):
        for j in places.get(have[i], ()):
            k = bisect_left(tails, j)
            chain = (i, j, ends[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                ends.append(chain)
            else:
                tails[k], ends[k] = j, chain
    matched, chain = [], ends[-1] if ends else None
    while chain:
        matched.append(chain[:2])
        chain = chain[2]
    out: list[tuple[int | None, int | None]] = [(i, i) for i in range(low)]
    a = b = low
    for i, j in [*reversed(matched), (n, m)]:
        out += [(x, None) for x in range(a, i)] + [(None, y) for y in range(b, j)]
        if i < n:
            out.append((i, j))
        a, b = i + 1, j + 1
    return out + [(n + k, m + k) for k in range(len(have) - n)]


def _extend(group: Group, members: list, page: int) -> None:
    """Aligns one page's members of a group with the wrapper so far."""
    if group.last != page:
        group.last, group.pages = page, group.pages + 1
    group.repeats |= len(members) > 1
    if group.label == "#":
        for text, links in members:
            group.chars, group.links = group.chars + len(text), group.links + links
            at = group.seen.setdefault(text, [-1, 0])
            if at[0] != page:
                at[0], at[1] = page, at[1] + 1
        return
    for x in members:
        folded = fold(x.children)
        x.groups = [None] * len(x.children)
        out = []
        for i, j in align([c.label for c in group.children], [label for label, _ in folded]):
            child = group.children[i] if i is not None else None
            if j is not None:
                label, places = folded[j]
                if child is None:
                    child = Group("#", "#", 0) if label == "#" else Group(label, x.children[places[0]].kind, x.children[places[0]].hint)
                _extend(child, [x.children[k] for k in places], page)
                for k in places:
                    x.groups[k] = child
            out.append(child)
        group.children = out


def infer(pages: list[Node]) -> Group:
    """The wrapper of pages, aligned one after another; boilerplate is marked as gone."""
    wrapper = Group("html", "html", 0)
    for i, page in enumerate(pages):
        _extend(wrapper, [page], i)
    _weigh(wrapper, len(pages))
    _judge(wrapper, len(pages), wrapper.varying, False, _has_article(wrapper))
    _weigh(wrapper, len(pages))
    return wrapper


def _weigh(group: Group, pages: int) -> None:
    """Characters below a group that vary, what is gone aside; and characters and those in links."""
    if group.label == "#":
        group.varying = sum(len(t) * n for t, (_, n) in group.seen.items() if not group.template(t, pages))
        return
    group.varying = group.chars = group.links = 0
    for c in group.children:
        _weigh(c, pages)
        if not c.gone and c.kind not in NEVER:
            group.varying, group.chars, group.links = group.varying + c.varying, group.chars + c.chars, group.links + c.links


def _has_article(group: Group) -> bool:
    """Whether an article that no strong label takes back stands below a group."""
    return any(c.kind in MAIN and c.hint < 2 or c.label != "#" and c.kind not in NEVER and _has_article(c) for c in group.children)


def _judge(group: Group, pages: int, total: int, inside: bool, article: bool) -> None:
    """Marks elements that are boilerplate. article: whether the pages have one at all.

    That are those that never are main text, headers outside an article, and
    what a label says is boilerplate: with a weak one only where it never
    varies, some pages lack it, it is half links, or there is but one page.
    One that holds half of all that varies stays, if it holds the article or
    there is none: comments may well be longer than what they are on.
    """
    for c in group.children:
        if c.label == "#":
            continue
        if c.kind in NEVER:
            c.gone = True
        elif 2 * c.varying > total and (not article or c.hint < 2 and c.kind in MAIN or _has_article(c)):
            pass
        elif c.kind == "header":
            c.gone = not inside
        elif c.hint == 2:
            c.gone = True
        elif c.hint == 1:
            c.gone = pages < 2 or not c.varying or c.pages < group.pages or 2 * c.links >= c.chars
        elif c.repeats and 2 * c.pages >= pages > 1 and c.links * 10 >= c.chars * 9 > 0:
            c.gone = True  # a menu without a label
        if not c.gone:
            _judge(c, pages, total, inside or c.kind in MAIN, article)


def container(wrapper: Group) -> Group:
    """The element of the main text: an article that holds most, else where most of what varies stands together."""
    best, most = None, 0
    open_ = [wrapper]
    while open_:
        for c in open_.pop().children:
            if c.gone or c.label == "#":
                continue
            # Of two within each other the inner one, if it holds nearly as much.
            if c.kind in MAIN and (c.varying > most or best is not None and 10 * c.varying >= 7 * most and _holds(best, c)):
                best, most = c, c.varying
            open_.append(c)
    if best is not None:
        return best
    group = wrapper
    while wrapper.varying:
        inner = [c for c in group.children if c.label != "#" and not c.gone]
        top = max(inner, key=lambda c: c.varying, default=None)
        if top is None or top.kind in ("p", "ul", "ol", "table", "pre", "blockquote") or 10 * top.varying < 7 * wrapper.varying:
            break
        group = top
    return group


def _holds(group: Group, other: Group) -> bool:
    return any(c is other or c.label != "#" and _holds(c, other) for c in group.children)


def _texts(node: Node, within: Group | None, pages: int, out: list[tuple[str, bool]]) -> None:
    """Texts below a node in page order, each with whether it is template; within: only those below this group."""
    for c, group in zip(node.children, node.groups, strict=True):
        if isinstance(c, tuple):
            if within is None:
                out.append((c[0], group.template(c[0], pages, SHARED)))
        elif not group.gone:
            _texts(c, None if group is within else within, pages, out)


def main_text(page: Node, wrapper: Group, article: Group, pages: int) -> str:
    """The main text of a page that the wrapper was inferred from.

    A page without the article's element gives all that is not boilerplate. If
    more than half of a text is template, the page is a near copy of others,
    from which the wrapper can't tell template and text apart: all stays.
    """
    out: list[tuple[str, bool]] = []
    _texts(page, None if article is wrapper else article, pages, out)
    if not out:
        _texts(page, None, pages, out)
    shared = sum(len(t) for t, template in out if template)
    near_copy = 2 * shared > sum(len(t) for t, _ in out)
    return " ".join(t for t, template in out if near_copy or not template)


def _extract(table: pa.Table) -> pa.Table:
    html = table["html"].to_pylist()
    distinct = sorted(set(html))
    pages = [parse(x) for x in distinct]
    wrapper = infer(pages)
    article = container(wrapper)
    text = {x: main_text(p, wrapper, article, len(pages)) for x, p in zip(distinct, pages, strict=True)}
    return pa.table({"page_id": table["page_id"], "url": table["url"], "text": pa.array([text[x] for x in html], pa.string()), "host": table["host"]})


def extract_main_text(pages: DataFrame) -> DataFrame:
    """The main text of every page.

    pages: columns page_id, url and html; others are ignored. A row for each
    row, repeated rows too: page_id, url, text, n_chars (code points), host.
    Null or empty html gives an empty text. A page without a host (null url)
    belongs to the host "". Equal pages count once in a wrapper. Pages of a host
    are dealt by hash into groups of about GROUP_PAGES; a group that is far
    larger, as rows that are equal in id and url make, is dealt on by seeded
    chance, so no host and no such rows are gathered in one task.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))
    counts = written(rows.groupBy("host").agg(F.ceil(F.count("*") / F.lit(GROUP_PAGES)).alias("groups")))
    few = counts.count() <= BROADCAST_HOSTS

    def dealt(df: DataFrame) -> DataFrame:
        # The one key is a hash of host and part, so no exchange deals pages by host alone.
        return df.join(F.broadcast(counts) if few else counts, "host").withColumn("group", F.xxhash64("host", F.pmod(F.xxhash64("page_id", "url"), F.col("groups")))).drop("groups")

    large = written(dealt(rows.select("host", "page_id", "url")).groupBy("group").agg(F.floor(F.count("*") / F.lit(2 * GROUP_PAGES)).cast("int").alias("more")).filter("more > 0"))
    rows = dealt(rows)
    n_large = large.count()
    if n_large:
        rows = rows.join(F.broadcast(large) if n_large <= BROADCAST_HOSTS else large, "group", "left")
        rows = rows.withColumn("group", F.when(F.col("more").isNull(), F.col("group")).otherwise(F.xxhash64("group", F.floor(F.rand(7) * (F.col("more") + 1))))).drop("more")
    out = rows.groupBy("group").applyInArrow(lambda t: _extract(t.drop_columns(["group"])), "page_id long, url string, text string, host string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "host")
