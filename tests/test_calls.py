"""Model calls, connectors, reports as HTML, configuration, state and cases in YAML."""

import datetime as dt
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from veritab.functions import prompts
from veritab.functions import text as X
from veritab.operators import digest, grading, judging, postings, runs, usage
from veritab.operators.rules import FactType, Rule, RuleSet
from veritab.plans import project as P
from veritab.sources import connectors, fetching, readers
from veritab.streaming import state

DAY = dt.date(2026, 1, 2)
SPECS = {"total": {"type": "number", "describe": "what is due"}, "kind": {"type": "list", "of": "enum", "values": ["a", "b"]}}


def test_prompts(spark, tmp_path):
    told = prompts.instructions(SPECS)
    assert "- total (a number): what is due" in told and "- kind (list; each entry one of: a, b)" in told
    got = spark.range(1).select(prompts.posting_prompt(F.lit("T"), F.lit(None), F.lit("L"), F.lit("abcdef"), 3)).first()[0]
    assert got == "Title: T\nCompany: \nLocation: L\n\nabc"
    good = {"title": "Clerk", "description": "Due: 5", "facts": {"total": {"value": 5, "quote": "due: 5"}, "kind": []}}
    path = tmp_path / "x.yaml"
    path.write_text(json.dumps([good]))
    assert '"value": 5' in prompts.examples_block(prompts.load_examples(str(path), SPECS)) and prompts.examples_block([]) == ""
    for facts, why in (({"other": {}}, "no fact"), ({"total": {"value": 5, "quote": "due: 6"}}, "not quoted"), ({"kind": [{"value": "c", "quote": "Clerk"}]}, "no value")):
        path.write_text(json.dumps([good | {"facts": facts}]))
        with pytest.raises(ValueError, match=why):
            prompts.load_examples(str(path), SPECS)


def test_answers_cost_their_own_row_only(spark):
    def backend(system, asked):
        if "boom" in asked:
            raise RuntimeError("lost")
        return [None if p == "late" else ValueError("bad") if p == "bad" else "{" if p == "broken" else {"p": p} for p in asked]

    rows = [(str(i), p) for i, p in enumerate(["x", "late", "bad", "broken", "y"])]
    got = {r.id: (r.state, r.raw) for r in judging.ask(spark.createDataFrame(rows, "id string, prompt string").coalesce(1), backend, "s").collect()}
    assert got == {"0": ("answered", '{"p": "x"}'), "1": ("deferred", None), "2": ("error", None), "3": ("error", None), "4": ("answered", '{"p": "y"}')}
    assert {r.why for r in judging.ask(spark.createDataFrame([("1", "boom")], "id string, prompt string"), backend, "s").collect()} == {"RuntimeError: lost"}
    assert judging.status(lambda s, p: ["{}"]) == "" and "down" in judging.status(lambda s, p: [OSError("down")])
    assert judging.cache_usable(F.lit("m"), True) and not judging.cache_usable(None, True) and not judging.cache_usable(F.lit("m"), False)
    with pytest.raises(ValueError, match="no backend 'x'; known: chat"):
        judging.plugin("backend", "x", judging.BACKENDS)


def test_chat_backend_over_http():
    asked = []

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.headers.get("Authorization"), body["messages"][1]["content"]))
            fail = asked.count(asked[-1]) == 1 and body["messages"][1]["content"] == "twice"
            self.send_response(500 if fail else 200)
            self.end_headers()
            if not fail:
                self.wfile.write(json.dumps({"choices": [{"message": {"content": '{"a": 1}'}}]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    call = judging.chat_backend(f"http://127.0.0.1:{server.server_port}/v1", "m", "k", 5)
    assert call("s", ["once", "twice"]) == ['{"a": 1}'] * 2 and asked == [("Bearer k", "once"), ("Bearer k", "twice"), ("Bearer k", "twice")]
    server.shutdown()
    assert isinstance(call("s", ["x"])[0], Exception)


def test_connectors_page_and_stop():
    def service(pages):
        def send(method, url, params, body, headers):
            sent.append((method, url, params, body))
            page = pages[len(sent) - 1]
            if isinstance(page, Exception):
                raise page
            return json.dumps(page)

        sent = []
        return send, sent

    rows = lambda a, n: [{"id": i} for i in range(a, a + n)]
    api = connectors.APIS["smartrecruiters"]
    send, sent = service([{"content": rows(0, 100), "totalFound": 150}, {"content": rows(100, 50), "totalFound": 0}])
    assert [(x["page"], x["total"], x["note"]) for x in connectors.read_query(api, send, {"slug": "acme"}, 9)] == [(1, 150, ""), (2, 150, "")]
    assert sent[1] == ("GET", "https://api.smartrecruiters.com/v1/companies/acme/postings", {"limit": 100, "offset": 100}, None)
    send, _ = service([{"content": rows(0, 100)}, {"content": rows(0, 100)}])
    assert [x["note"] for x in connectors.read_query(api, send, {"slug": "a"}, 9)] == ["", "a page repeated rows, 100 read"]
    send, _ = service([{"content": rows(0, 100), "totalFound": 900}, {"content": rows(100, 100)}])
    assert [x["note"] for x in connectors.read_query(api, send, {"slug": "a"}, 2)][-1] == "stopped after 2 pages, 200 of 900 read"
    send, sent = service([connectors.HttpError("u", 404, "x"), [{"id": "1"}]])
    assert [x["page"] for x in connectors.read_query(connectors.APIS["lever"], send, {"slug": "a"}, 9)] == [1] and "api.eu.lever" in sent[1][1]
    send, sent = service([{"jobs": rows(0, 3), "nextPageToken": "t"}, {"jobs": rows(3, 3), "nextPageToken": "t"}, {"jobs": rows(6, 3), "nextPageToken": "t"}])
    assert [x["note"] for x in connectors.read_query(connectors.APIS["workable_search"], send, {"query": "q", "place": ""}, 9)] == ["", "the same page token came back, 6 read"]
    assert sent[0][2] == {"query": "q"} and sent[1][2] == {"query": "q", "pageToken": "t"}
    send, sent = service([{"jobPostings": rows(0, 2), "total": 2}])
    list(connectors.read_query(connectors.APIS["workday"], send, {"slug": "a", "host": "wd3", "site": "s", "query": "data", "facets": {"x": ["y"]}}, 9))
    assert sent[0][0] == "POST" and sent[0][3] == {"searchText": "data", "limit": 20, "offset": 0, "appliedFacets": {"x": ["y"]}}
    waits = []
    send, sent = service([connectors.HttpError("u", 503, "x"), connectors.HttpError("u", 429, "x", 7.0), {"jobs": []}])
    assert connectors.patient(send, sleep=waits.append, draw=lambda: 0.5)("GET", "u", {}, None, {}) == '{"jobs": []}' and waits == [0.5, 7.0]
    send, sent = service([connectors.HttpError("u", 404, "x")])
    with pytest.raises(connectors.HttpError):
        connectors.patient(send, sleep=waits.append)("GET", "u", {}, None, {})


def test_sources_that_fail_give_reports(spark):
    def send(method, url, params, body, headers):
        return json.dumps({"results": [{"jobId": 1, "jobTitle": "Clerk", "jobUrl": "http://x", "date": "03/02/2026"}, {"jobId": 2}], "totalResults": 2})

    known = dict(fetching.SOURCES)
    fetching.SOURCES["reed"] = connectors.source("reed", send)
    fetching.SOURCES["odd"] = lambda *_: 1 / 0
    try:
        reports, rows = fetching.fetch_all(spark, [{"kind": "reed", "slug": "uk", "key": "k", "queries": ["a", "b"]}, {"kind": "reed", "slug": "keyless"}, {"kind": "odd", "slug": "x"}, {"kind": "nowhere", "slug": "y"}])
        assert [(r.title, r.posted, r.source) for r in rows.collect()] == [("Clerk", dt.date(2026, 2, 3), "reed:uk")]
        got = {r.source_key: (r.skipped, r.error, r.n) for r in reports.collect()}
        assert got["reed:uk:"] == (False, None, 1) and got["reed:keyless:"][:2] == (True, "no key") and got["odd:x:"][1] == "ZeroDivisionError: division by zero" and "no source 'nowhere'" in got["nowhere:y:"][1]
    finally:
        fetching.SOURCES.clear()
        fetching.SOURCES.update(known)
    with pytest.raises(ValueError, match="pages needs a whole number"):
        fetching.entries([{"kind": "reed", "slug": "x", "pages": True}])
    with pytest.raises(ValueError, match="render needs true or false"):
        fetching.entries([{"kind": "structured", "slug": "x", "render": "yes"}])


def test_standard_input_and_config(spark, tmp_path):
    got = fetching.read_stdin(spark, "id", ["body"], ["n"], ['{"id": 1, "body": "x", "n": 2}\n', "\n", '{"id": "2"}\n']).collect()
    assert [tuple(r) for r in got] == [("1", "x", "2"), ("2", None, None)]
    with pytest.raises(ValueError, match="line 2"):
        fetching.read_stdin(spark, "id", ["body"], [], ['{"id": 1}', "{"])
    path = tmp_path / "scan.yaml"
    path.write_text("sources:\n- {kind: lever, slug: a}\n- {kind: lever, slug: b, enabled: false}\nmodel: {examples_file: e.yaml}\n")
    with pytest.raises(ValueError, match="no file"):
        fetching.load_config(str(path))
    (tmp_path / "e.yaml").write_text("[]")
    config = fetching.load_config(str(path))
    assert [e.key for e in config["sources"]] == ["lever:a:"] and config["model"]["examples_file"] == str(tmp_path / "e.yaml")
    path.write_text("sorces: []")
    with pytest.raises(ValueError, match="unknown sorces"):
        fetching.load_config(str(path))


def test_html_report_fits_and_escapes(spark):
    rows = [(i, f"<T{i}>", "http://x/a b" if i % 2 else "javascript:x", "C&o", 90 - i, "apply", "good" * 20) for i in range(1, 41)]
    shown = spark.createDataFrame(rows, "place int, title string, url string, company string, score int, verdict string, reason string")
    hidden = spark.createDataFrame([("gate", 1, "H", "http://h", "C", "low")], "group string, in_group int, title string, url string, company string, reason string")
    page = digest.html("R", shown, hidden, ["quiet: <x>"])
    assert "&lt;T1&gt;" in page and "javascript" not in page and "quiet: &lt;x&gt;" in page and "left out" not in page and page.count('class="c"') == 40
    small = digest.html("R", shown, hidden, most_bytes=4000)
    assert len(small.encode()) <= 4000 and 0 < small.count('class="c"') < 40 and "more are left out" in small

    class Server:
        def __init__(self, *a, **k):
            self.sent = []

        def __enter__(self):
            return self

        def __exit__(self, *a):
            pass

        def starttls(self):
            pass

        def login(self, *a):
            raise OSError("refused")

        def send_message(self, m):
            sent.append(m)

    sent = []
    mail = digest.message("Two\nlines", "a@x.org", "b@x.org", page, "plain")
    assert mail["Subject"] == "Two lines" and digest.send(mail, "h", connect=Server) == "" and sent == [mail]
    assert digest.send(mail, "h", user="u", connect=Server) == "OSError: refused"


def test_cases_in_yaml(spark, tmp_path):
    path = tmp_path / "cases.yaml"
    path.write_text("# two cases\ncases:\n- id: a\n  text: Total 5\n  expect: {facts: {total: {is: 5}}, outcome: low}\n  model_facts: {total: {value: 5, quote: Total 5}, kind: []}\n\n- id: b\n  text: Total 9\n  open_defect: misread\n  expect: {outcome: high}\n  model_facts: {total: {value: 5, quote: Total 5}, kind: []}\n")
    project = P.parse({"name": "p", "items": {"stdin": True, "fields": ["text"]}, "facts": SPECS, "rules": [{"name": "big", "when": {"total": {"gt": 7}}, "then": "high"}], "default_outcome": "low"})
    cases = grading.load_cases(spark, [str(path)], project.texts)
    assert [(r.id, r.source.rsplit(":", 1)[1]) for r in grading.check_cases(cases, SPECS, project.rules.outcomes).collect()] == [("a", "3"), ("b", "8")]
    params = grading.case_params(spark, project, str(path))
    grading.assert_case(params[0].values[0])
    with pytest.raises(AssertionError, match="b: "):
        grading.assert_case(params[1].values[0])
    assert [m.name for m in params[1].marks] == ["xfail"]
    states = grading.report(grading.offline(cases, project, DAY))
    assert grading.unexpected(states, cases).count() == 0
    path.write_text("- id: a\n  txet: x\n")
    with pytest.raises(ValueError, match="cases.yaml:1: unknown txet"):
        grading.read_yaml_cases(spark, str(path), ["text"])
    assert grading.not_quoted("`m`, 3 runs", grading.headline("m", 3, 0.97)) == ["pass@1 97%"]
    grading.save_run(spark, str(tmp_path / "run"), states, {"model": "m"}, "# R")
    assert spark.read.text(str(tmp_path / "run" / "report")).first()[0] == "# R"
    moves = spark.createDataFrame([("a", "fixed"), ("b", "same"), ("c", "broke")], "case string, move string")
    assert "| broke | 1 | c |" in grading.compare_markdown(moves)


def test_a_resolver_that_raises_costs_its_item(spark):
    def fix(texts, facts):
        if "bad" in texts["body"]:
            raise ValueError("no")
        return facts | {"n": {"value": 7, "quote": texts["body"]}}

    specs = {"n": {"type": "integer"}}
    rules = RuleSet({"n": FactType("facts.n.value", "integer", quote="facts.n.quote")}, [Rule("seven", {"n": {"is": 7}}, "yes")], "no")
    items = spark.createDataFrame([("a", 1, "is 7"), ("b", 2, "bad 7"), ("c", 3, "is 8")], "id string, ordinal long, body string")
    answers = spark.createDataFrame([(i, 1, '{"n": {"value": 1, "quote": "1"}}') for i in "abc"], "id string, line int, raw string")
    got = {r.id: (r.status, r.outcome, r.reason) for r in runs.run(items, answers, specs, rules, DAY, ["body"], resolvers=[runs.each_item(fix, ["body"])]).collect()}
    assert got == {"a": ("decided", "yes", None), "b": ("error", None, "ValueError after the answer: no"), "c": ("decided", "no", None)}


def test_limits_of_a_run(spark):
    rules = RuleSet({"n": FactType("facts.n.value", "integer", quote="facts.n.quote")}, [], "no")
    items = spark.createDataFrame([(str(i), i, "n 1") for i in range(8)], "id string, ordinal long, body string")
    good = '{"n": {"value": 1, "quote": "n 1"}}'
    answers = spark.createDataFrame([(str(i), 1, None if i in (2, 3) else good, "down" if i in (2, 3) else None, float(i)) for i in range(8)], "id string, line int, raw string, error string, started double")
    run = lambda **k: {r.id: r.reason or r.status for r in runs.run(items, answers, {"n": {"type": "integer"}}, rules, DAY, ["body"], **k).collect()}
    assert run(breaker_after=2, max_seconds=6, max_calls=7) == {"0": "decided", "1": "decided", "2": "down", "3": "down", "4": "breaker", "5": "breaker", "6": "breaker", "7": "call ceiling"}
    assert run(breaker_after=3, max_seconds=6)["6"] == "time limit" and run()["7"] == "decided"


def test_state_is_locked_and_backed_up(spark, tmp_path):
    table = state.Table(spark, str(tmp_path / "t"), "k string, v int")
    table.put(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), ["k"])
    table.put(spark.createDataFrame([("b", 2)], "k string, v int"), ["k"])
    assert sorted(map(tuple, table.read().collect())) == [("a", 1), ("b", 2)]
    with pytest.raises(state.Locked):
        table.commit(table.read(), expected=1)
    with state.run_lock(spark, str(tmp_path / "t")):
        with pytest.raises(state.Locked):
            with state.run_lock(spark, str(tmp_path / "t")):
                pass
    with state.run_lock(spark, str(tmp_path / "t")):
        pass
    for i in range(4):
        left = state.backup(table, str(tmp_path / "copies"), DAY + dt.timedelta(i), 2)
    assert left == ["2026-01-04", "2026-01-05"]
    assert state.kept_days(0, 5) == state.kept_days(5, 0) == 0 and state.kept_days(30, 60) == 60
    with pytest.raises(state.TooNew):
        state.migrated(table.read(), 2, [lambda df: df])
    state.record_answers(spark.createDataFrame([("a", "{}", 1)], "id string, raw string, x int"), str(tmp_path / "answers"))
    state.record_answers(spark.createDataFrame([("b", "{}", 1)], "id string, raw string, x int"), str(tmp_path / "answers"))
    assert spark.read.json(str(tmp_path / "answers")).count() == 2
    seen = state.Table(spark, str(tmp_path / "seen"), "uid string, first_seen date, last_seen date")
    scan = spark.createDataFrame([("u", DAY, DAY, False)], "uid string, first_seen date, last_seen date, reopened boolean")
    assert state.record_scan(seen, scan, scan, str(tmp_path / "out"), dry=True)["seen"].count() == 1 and seen.version() == 0
    assert state.record_scan(seen, scan, scan, str(tmp_path / "out"))["seen"].count() == 1 and seen.version() == 1


def test_verdict_spares_exempt_employers(spark):
    limits = postings.Limits(skip_fields=("sales",), exempt=("Example Bank",))
    df = spark.createDataFrame([("Example Bank Ltd", "sales"), ("Example Banking", "sales"), (None, "sales")], "company string, field string").select("*", F.lit(90).alias("fit_score"), *[F.lit(None).cast(t).alias(c) for c, t in (("level", "string"), ("years_required", "int"), ("student_only", "boolean"), ("graduation_year", "int"), ("bars", "array<struct<kind:string,quote:string>>"))])
    assert [r.verdict for r in postings.verdict(df, limits).collect()] == ["apply", "skip", "skip"]


def test_small_text_functions(spark):
    df = spark.createDataFrame([("eth0: flags\n inet 999.1.1.1\n inet 192.0.2.7 mask",), ("none",)], "t string")
    assert [r[0] for r in df.select(X.interface_address(F.col("t"))).collect()] == ["192.0.2.7", None]
    assert spark.range(1).select(X.body_text(F.lit("<style>a</style><p>x<script>b</script> y"))).first()[0] == "x y"
    window = usage.model_window(F.create_map(F.lit("a.context_length"), F.lit("5"), F.lit("general.architecture"), F.lit("b"), F.lit("b.context_length"), F.lit("7")))
    assert spark.range(1).select(window).first()[0] == 7
    assert readers.BOARDS["workable_search"].spare_location


def test_a_site_is_read_by_its_sitemap(spark):
    page = lambda n: f'<script type="application/ld+json">{json.dumps({"@type": "JobPosting", "title": f"Clerk {n}", "hiringOrganization": {"name": "Acme"}, "datePosted": "2026-02-03"})}</script>'
    days = {1: "2026-02-01", 2: "2026-02-02", 3: "2026-02-03", 4: "2026-01-01", 5: "2026-02-05", 6: "2026-02-04"}
    xml = "<urlset>" + "".join(f"<url><loc>https://s.example/{'news' if n == 5 else 'job'}/{n}</loc><lastmod>{d}</lastmod></url>" for n, d in days.items()) + "</urlset>"

    def send(method, url, params, body, headers):
        if url.endswith("robots.txt"):
            return "User-agent: *\nCrawl-delay: 0.01"
        if url.endswith("sitemap.xml"):
            return xml
        n = int(url.rsplit("/", 1)[1])
        if n in (2, 3):
            raise connectors.HttpError(url, 404 if n == 2 else 500, "x")
        return page(n)

    e = fetching.Entry("structured", "s", options={"sitemap": "https://s.example/sitemap.xml", "include": "/job/", "max_pages": 3})
    cache = spark.createDataFrame([("https://s.example/job/6", dt.date(2026, 2, 4), page(60))], "url string, lastmod date, html string")
    pages, note = connectors.site_pages(spark, e, "2026-02-01", send, cache)
    assert {r["loc"][-1]: r.outcome for r in pages.collect()} == {"6": "kept", "3": "failed", "2": "lost"} and note == "read 3 of 4 pages"
    rows = connectors.site(send, cache)(spark, fetching.Entry("structured", "s", options=e.options | {"max_pages": 9}), None).collect()
    assert sorted(r.title for r in rows) == ["Clerk 1", "Clerk 4", "Clerk 60"] and {r.company for r in rows} == {"Acme"}
    with pytest.raises(fetching.Skipped):
        connectors.site_pages(spark, fetching.Entry("structured", "s"), None, send)
