"""Pages, vectors, and the pipeline."""

import collections
import itertools
import math
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.conftest import SF
from pyspark.sql import functions as F

from veritab.llm import components, neighbours, pages


def extract(spark, rows):
    df = spark.createDataFrame([(i, u, h, "g", 1) for i, u, h in rows], "page_id long, url string, html string, group string, groups int")
    return {r.page_id: r for r in pages.extract_main_text(df).collect()}


def test_pages(spark):
    page = "<html><head><title>T</title><style>p{{}}</style><script>var a='</p><p>no';</script></head><body><div class='nav'>menu</div><header>Top</header><aside>side</aside><article><h1>A &amp; B {0}</h1><p>one <b>tw</b>o&nbsp;{0}<br>three {0}<p>four {0}<ul><li>x{0}<li>y{0}</ul><!-- no --><div class='comments'>c {0}</div><form>f</form></article><div id='sidebar'>s</div><footer>f</footer></body></html>"
    got = extract(spark, [(i, f"https://h.example/{i}", page.format(i)) for i in range(4)] + [(10, None, None), (11, "x", ""), (12, "http://o.example", "just text"), (13, "http://o.example/2", "<p>a<p>b <i>c</i>d</p><nav>n</nav><p"), (14, "http://d.example", "<div>" * 3000 + "deep")])
    assert [got[i].text for i in range(4)] == [f"A & B {i} one two {i} three {i} four {i} x{i} y{i}" for i in range(4)]
    assert got[0].n_chars == len(got[0].text) and got[0].host == "h.example"
    assert [got[i].text for i in (10, 11, 12, 13, 14)] == ["", "", "just text", "a b cd", "deep"]


def test_pages_without_ids_repeated_and_empty(spark):
    page = "<body><article><p>story {0}</p></article><footer>f</footer></body>"
    rows = [(None, None, page.format(1))] * 1500 + [(5, "http://h.example/5", page.format(5))] * 3 + [(None, "http://h.example/6", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = collections.Counter((r.page_id, r.url, r.text) for r in pages.extract_main_text(df).collect())
    assert got == {(None, None, "story 1"): 1500, (5, "http://h.example/5", "story 5"): 3, (None, "http://h.example/6", ""): 1}
    assert pages.extract_main_text(df.limit(0)).count() == 0


def test_pages_without_article_use_what_varies(spark):
    page = "<body><div class='box'><p>Welcome to all readers of this site, as ever.</p></div><div class='story'><p>{0}</p><p>{1}</p></div><div class='box'>Terms of use</div></body>"
    got = extract(spark, [(i, f"https://v.example/{i}", page.format(f"story {i} " * 9, f"more {i * 7} " * 9)) for i in range(6)])
    assert all(got[i].text == " ".join((f"story {i} " * 9 + f"more {i * 7} " * 9).split()) for i in range(6))


@pytest.mark.parametrize("n", [1, 2, 5])
def test_headers_outside_an_article_go(n):
    page = "<body><header>Site Name</header><div><p>Story {0} goes on for a while</p><p>and {0} more</p></div></body>"
    assert texts_of([page.format(i) for i in range(n)]) == [f"Story {i} goes on for a while and {i} more" for i in range(n)]
    page = "<body><article><header><h1>Head {0}</h1></header><p>Story {0}</p></article></body>"
    assert texts_of([page.format(i) for i in range(n)]) == [f"Head {i} Story {i}" for i in range(n)]


def test_what_all_pages_share_is_template_also_inside_the_article():
    page = "<body><article><h1>Title {0}</h1><p>Story {0} of some length, told to the end.</p><div>Our licence has changed.</div><p>Closing {0} words.</p><p>Read this notice.</p></article></body>"
    assert texts_of([page.format(i) for i in range(4)]) == [f"Title {i} Story {i} of some length, told to the end. Closing {i} words." for i in range(4)]
    # One page alone, and near copies, tell nothing of the template.
    assert texts_of([page.format(1)])[0].endswith("Read this notice.")
    assert texts_of(["<article><p>A long passage that both pages have in full.</p><p>x</p></article>", "<article><p>A long passage that both pages have in full.</p><p>y</p></article>"]) == [f"A long passage that both pages have in full. {c}" for c in "xy"]


def test_class_words_are_whole():
    page = "<body><article><div class='alert-box side-by-side'><p>Body {0}</p></div><h2 id='related'>Head {0}</h2></article></body>"
    assert texts_of([page.format(i) for i in range(3)]) == [f"Body {i} Head {i}" for i in range(3)]


@pytest.mark.parametrize("broken", ["<a " * 40000, "<a href=\"" * 20000, "<" * 60000, "<!-- " * 20000, "<script>" * 10000, "<svg>" * 10000, "<p '" * 20000, "<div>" * 20000, "</div>" * 20000, "<b>" * 20000, "<span class=ad>" * 5000, "&#" * 30000])
def test_broken_pages_take_linear_time(broken):
    began = time.perf_counter()
    texts_of([f"<article><p>good</p></article>{broken}", "<article><p>fine</p></article>"])
    assert time.perf_counter() - began < 3


def test_long_lists_of_different_elements():
    """1200 children, of which the first differs: no recursion, and little time."""
    body = "".join(f"<h{i % 6 + 1}>t{i}</h{i % 6 + 1}><c{i}>x</c{i}>" for i in range(1200))
    began = time.perf_counter()
    got = texts_of([f"<body><article><q1>a</q1>{body}<p>one</p></article></body>", f"<body><article><q2>b</q2>{body}<p>two</p></article></body>"])
    assert got[0].startswith("a t0 x") and time.perf_counter() - began < 5


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9))
def test_alignment_against_brute_force(have, new):
    pairs = pages.align(have, new)
    assert [i for i, _ in pairs if i is not None] == list(range(len(have))) and [j for _, j in pairs if j is not None] == list(range(len(new)))
    both = [(i, j) for i, j in pairs if i is not None and j is not None]
    assert all(have[i] == new[j] for i, j in both)
    longest = next(k for k in range(min(len(have), len(new)), -1, -1) if any(c == d for c in itertools.combinations(have, k) for d in itertools.combinations(new, k))) if len(have) * len(new) <= 36 else None
    assert longest is None or len(both) == longest


def test_wrapper_has_repeated_and_optional_groups_and_slots():
    w = pages.infer([pages.parse("<body><ul><li>a<li>b</ul><p>x</p></body>"), pages.parse("<body><ul><li>a</ul><h2>h</h2><p>y</p></body>")])
    body = w.children[0]
    assert [c.label for c in body.children] == ["ul", "h2", "p"] and [c.pages for c in body.children] == [2, 1, 2]
    slot, items = body.children[2].children[0], body.children[0].children[0]
    assert items.repeats and not slot.template("x", 2) and items.children[0].template("a", 2)


def test_real_pages_hold_no_template(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    rows = pages.extract_main_text(table).join(table, ["page_id", "url"]).collect()
    assert len(rows) == table.count()
    assert all(r.text and "\n" not in r.text and "&copy;" not in r.text and "<" not in r.text for r in rows)


def texts_of(pages_html):
    table = pa.table({"page_id": list(range(len(pages_html))), "url": [""] * len(pages_html), "html": pages_html, "host": [""] * len(pages_html)})
    return pages._extract(table)["text"].to_pylist()


def test_labels_are_judged_over_the_host():
    page = (
        "<body><div class='content has-sidebar'><article><h2 id='side-effects'>Effects {0}</h2><section id='related-work'>Work {0}</section><p id='social-contract' data-id='ad'>Pact {0}</p>"
        "<div class='hidden'>Unfolds {0}</div><div class='notice'>Beware {0}</div><div class='share'><a href='/'>Mail {0}</a></div><div class='comments'>I think {0}</div></article></div></body>"
    )
    assert texts_of([page.format(i) for i in range(4)]) == [f"Effects {i} Work {i} Pact {i} Unfolds {i}" for i in range(4)]
    whole = "<body><div class='widget'><p>Story {0} of many words</p><p>more {0}</p></div><div class='box'>Terms</div></body>"
    assert texts_of([whole.format(i) for i in range(4)]) == [f"Story {i} of many words more {i}" for i in range(4)]


def test_comments_go_however_long():
    comments = "".join(f"<article class='comment'><p>I think {{0}} {k} and so on and on</p></article>" for k in range(9))
    page = f"<body><main><article class='post'><p>Short {{0}}</p></article><section class='comments'>{comments}</section>{comments}</main></body>"
    assert texts_of([page.format(i) for i in range(4)]) == [f"Short {i}" for i in range(4)]
    # An element with such a label that holds the article stays, and so does the only text there is.
    page = "<body><div class='sidebar'><article><p>Story {0}</p></article></div></body>"
    assert texts_of([page.format(i) for i in range(3)]) == [f"Story {i}" for i in range(3)]
    page = "<body><div class='promo'><p>Story {0} of some length</p></div><p>x</p></body>"
    assert texts_of([page.format(i) for i in range(3)]) == [f"Story {i} of some length" for i in range(3)]


def test_svg_takes_only_itself():
    page = "<body><article><p>one <svg class='i'/> two</p><svg><title>no</title></svg><p>three</p><svg viewBox='0 0 1 1'><p>four</p></article></body>"
    assert texts_of([page]) == ["one two three four"]
    assert texts_of([page.replace("<svg><title>no</title></svg>", "")]) == ["one two three four"]


def brute_nearest(rows, k=10):
    """By query row: (distance, vec_id) of its k nearest other rows."""
    out = collections.defaultdict(list)
    for i, (q, x) in enumerate(rows):
        if q % 100 == 0:
            found = sorted((math.dist(x, y), j) for n, (j, y) in enumerate(rows) if n != i and len(y) == len(x))
            out[q].append(found[:k])
    return out


def test_nearest(spark):
    """Ties, repeated rows, shared ids, lone lengths and unusable vectors."""
    rng = np.random.default_rng(6)
    v = rng.standard_normal((900, 8))
    v[300:600] = v[0]
    rows = [(i, [float(x) for x in v[i]]) for i in range(900)] + [(0, [float(x) for x in v[0]]), (100, [float(x) for x in v[7]]), (1500, [1.0, 2.0])]
    odd = [(1000, None), (1100, [0.0] * 8), (1200, [float("nan")] * 8), (1300, [1.0, None] * 4), (1400, []), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows + odd], "vec_id long, embedding array<double>, b string, dim int")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0, 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    want = brute_nearest(rows)
    assert set(got) == set(range(0, 900, 100))
    hits = sum(any(i == j and d == pytest.approx(e) for e, j in sum(w, [])) for q, w in want.items() for d, i in got[q])
    assert hits >= 0.9 * sum(len(x) for w in want.values() for x in w)
    # The other row with id 0 is a candidate of either, then the least of the 300 equal vectors.
    assert sorted(got[0]) == sorted([(0.0, i) for i in [0, *range(300, 309)]] * 2)
    assert len(got[100]) == 20
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_nearest_of_huge_and_tiny_vectors(spark):
    rows = [(i, [float((-1) ** i * i) * size, size]) for i, size in zip(range(100, 130), [1e200] * 10 + [1e-200] * 10 + [1.0] * 10, strict=True)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, 3).collect()
    assert len(got) == 9
    for q, x in rows[::10]:
        best = sorted((math.dist(x, y), j) for j, y in rows if j != q)[:3]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(j, pytest.approx(d, rel=1e-9)) for d, j in best]


def test_blocks_hold_every_row_once_and_queries_skip_far_ones(spark, monkeypatch):
    """Clustered vectors: the index has each row once, and few blocks are visited."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 16)) * 50
    v = np.concatenate([c + rng.standard_normal((300, 16)) for c in centres])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 64)
    index = neighbours.build_index(df, F.col("vec_id") % 100 == 0, 10).collect()
    ids = np.concatenate([np.frombuffer(r.ids, np.int64) for r in index])
    assert sorted(ids.tolist()) == list(range(len(v))) and len(index) > 60
    radii = [q.radius for r in index for q in r.queries]
    assert len(radii) == len(v) // 100
    reach = [(q.p0, q.p1, q.radius) for r in index for q in r.queries if q.radius < 50]
    visited = [sum(r.low0 - d <= a <= r.high0 + d and r.low1 - d <= b <= r.high1 + d for r in index) for a, b, d in reach]
    assert np.mean(visited) < 0.4 * len(index)
    got = collections.defaultdict(set)
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0, 10).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, len(v), 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * len(v) / 10


def test_recall_on_embeddings(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = table.collect()
    v, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = neighbours.nearest(table, F.col("vec_id") % 100 == 0).collect()
    hits = total = 0
    for k in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((v - v[k]) ** 2).sum(1))
        d[k] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        hits += len(best & {r.vec_id for r in got if r.query_id == ids[k]})
        total += 10
    assert hits >= 0.9 * total


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(i, i + 1) for i in range(60)] + [(int(a), int(b)) for a, b in rng.integers(100, 160, (40, 2))] + [(200, i) for i in range(201, 240)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_pipeline(spark):
    import corpus_pipeline as C
    import public_tokenizers as P

    from veritab.llm import bpe, jaccard, pii, quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = C.rules(spark, docs, SF)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.quality_rules(docs).filter("kept").collect()}
    kept = kept.cache()
    unique = C.unique(spark, kept, SF).cache()
    groups = jaccard.similar_sets(kept).collect()
    assert unique.columns == columns and sorted(r.doc_id for r in unique.collect()) == sorted({r.component_id for r in groups})
    private = C.private(spark, unique, SF).cache()
    rows = {r.doc_id: r for r in private.collect()}
    assert private.columns == columns and len(rows) == unique.count() and all(r.n_chars == len(r.text) for r in rows.values())
    again = pii.base_spans(private).select("doc_id", F.size("__base").alias("n")).filter("n > 0").count()
    assert again == 0
    mixed = C.mixed(spark, private, SF).cache()
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= set(rows)
    tokens = C.tokens(spark, mixed, SF).collect()
    assert len(tokens) == mixed.count()
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        codec = bpe.Codec(bpe.load_ranks(f.read()), P.PATTERN)
    assert all(codec.decode(bytes(r.ids)).decode() == rows[r.doc_id].text for r in tokens)
    assert len(C.STAGES) == 5 and C.run(spark, SF).columns == ["doc_id", "n_tokens", "ids"]


def test_one_row_stays_of_each_group(spark, corpus):
    """Rows without id, and rows that share an id but not their text, are judged by row."""
    import corpus_pipeline as C

    from .conftest import docs_of

    text, near, other = "one two three four five six seven eight nine ten " * 6, "one two three four five six seven eight nine ten " * 6 + "x", "quite another text of its own with some more words in it"
    rows = [(None, text, "en", "a"), (None, text, "en", "a"), (9, near, "en", "a"), (5, other, "en", "b"), (5, text, "en", "c"), (None, other + " y", "fr", "b"), (7, "", "en", "a"), (7, "", "en", "a"), (8, None, "en", "a")]
    got = sorted(((r.doc_id, r.text) for r in C.unique(spark, docs_of(spark, rows), SF).collect()), key=str)
    assert got == sorted([(5, text), (5, other), (7, ""), (7, ""), (8, None)], key=str)


def test_stages_take_odd_documents(spark, corpus):
    import corpus_pipeline as C

    from .conftest import docs_of

    docs = docs_of(spark, [*corpus, (None, "lone row without an id " * 20, None, None)])
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
        out.collect()
