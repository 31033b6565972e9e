"""Exhaustive and traced investigation, public discovery, rendering, exports."""

import json
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from sitelume import report
from sitelume.functions import signatures
from sitelume.operators import backlinks, discovery, graph, investigation, links
from sitelume.sources import fetch, readers, render, sinks


@pytest.fixture(scope="module")
def corpus(spark):
    page = lambda u, d, s=200, k="text/html": (u, d, s, k)
    pages = [
        page("http://a.com/", "a.com"), page("https://a.com/", "a.com"), page("https://a.com/1", "a.com"), page("https://a.com/2", "a.com"), page("https://a.com/doc", "a.com", 200, "application/pdf"), page("https://a.com/map", "a.com"),
        page("https://b.com/", "b.com"), page("https://b.com/x", "b.com", None, None), page("https://b.com/far", "b.com"), page("https://c.com/", "c.com", 404),
    ]
    found = [
        ("https://a.com/", "/1", "", ""), ("https://a.com/", "/doc", "", ""), ("https://a.com/", "/lost", "", ""), ("https://a.com/1", "/2", "", ""), ("https://a.com/2", "https://www.t.com/p", "x", "nofollow"), ("https://a.com/map", "https://t.com/q", "y", ""),
        ("https://a.com/map", "https://t.com/q#z", "y", ""), ("https://b.com/", "x#f", "", ""), ("https://b.com/", "https://sub.t.com/", "", ""), ("https://b.com/", "mailto:q", "", ""), ("https://b.com/", "https://b.com/far", "", ""), ("https://b.com/far", "https://t.com/", "", ""),
    ]
    return (
        spark.createDataFrame(pages, "url string, domain string, status_code int, content_type string"),
        spark.createDataFrame(found, "source_url string, url string, anchor string, rel string"),
        spark.createDataFrame([("a.com",), ("b.com",), ("c.com",)], "domain string"),
    )


def test_exhaustive(spark, corpus):
    got = {r.domain: tuple(r)[1:] for r in investigation.exhaustive(*corpus, "t.com").collect()}
    # a.com: both origins, then 1, doc, lost by depth; 2 is the first with a hit
    assert got["a.com"] == ("confirmed", 6, 4, 1, 1, "https://a.com/2")
    assert got["b.com"] == ("confirmed", 3, 2, 1, 1, "https://b.com/far") and got["c.com"] == ("not_found", 2, 0, 1, 0, None)
    listed = spark.createDataFrame([("a.com", "https://a.com/map"), ("z.com", "https://z.com/")], "domain string, url string")
    got = {r.domain: tuple(r)[1:] for r in investigation.exhaustive(*corpus, "t.com", listed).collect()}
    assert got["a.com"] == ("confirmed", 3, 3, 0, 2, "https://a.com/map")
    got = {r.domain: r.status for r in investigation.exhaustive(*corpus, "t.com", max_pages=2).collect()}
    assert got == {"a.com": "timeout", "b.com": "timeout", "c.com": "not_found"}
    found = investigation.exhaustive(*corpus, "t.com")
    assert tuple(investigation.exhaustive_summary(found).first()) == ("success", 3, 2)
    assert tuple(investigation.exhaustive_summary(found.filter("domain = 'c.com'")).first())[0] == "not_found" and tuple(investigation.exhaustive_summary(found.limit(0)).first()) == ("no_referring_domains", 0, 0)


def test_deep_sites_and_a_stop_by_domain(spark):
    """A chain of 14 pages is followed to its end; a domain's traversal ends at its hit, in one loop for all; a cap on depth is a timeout."""
    pages = [(f"https://{d}.com/{n or ''}", f"{d}.com", 200, "text/html") for d in ("deep", "soon") for n in range(14)]
    found = [(f"https://{d}.com/{n or ''}", f"/{n + 1}", "", "") for d in ("deep", "soon") for n in range(13)] + [("https://deep.com/13", "https://t.com/", "", ""), ("https://soon.com/2", "https://t.com/", "", "")]
    corpus = spark.createDataFrame(pages, "url string, domain string, status_code int, content_type string"), spark.createDataFrame(found, "source_url string, url string, anchor string, rel string"), spark.createDataFrame([("deep.com",), ("soon.com",)], "domain string")
    got = {r.domain: (r.status, r.pages_checked, r.hit_url) for r in backlinks.investigate(*corpus, "https://t.com").collect()}
    assert got == {"deep.com": ("confirmed", 14, "https://deep.com/13"), "soon.com": ("confirmed", 3, "https://soon.com/2")}
    got = {r.domain: (r.status, r.pages_checked) for r in backlinks.investigate(*corpus, "https://t.com", max_depth=5).collect()}
    assert got == {"deep.com": ("timeout", 6), "soon.com": ("confirmed", 3)}
    own = corpus[1].selectExpr("regexp_extract(source_url, '//([^/]*)', 1) grp", "source_url source", "concat('https://', grp, url) target").filter("target not like '%t.com%'")
    starts = corpus[2].selectExpr("domain grp", "concat('https://', domain, '/') url", "0 rank", "0 depth")
    hits = spark.createDataFrame([("soon.com", "https://soon.com/2")], "grp string, url string")
    visits, cut = graph.search(own, starts, hits, max_pages=8)
    assert {r.grp: (r.n, r.last) for r in visits.groupBy("grp").agg(F.count("*").alias("n"), F.max("seq").alias("last")).collect()} == {"deep.com": (9, 9), "soon.com": (3, 3)}
    assert graph.search(own.limit(0), starts.limit(0))[0].isEmpty()


def test_trace(corpus):
    got = {r.url: (r.depth, r.status_code, r.n_links, r.n_hits, r.hits) for r in investigation.trace(*corpus, "t.com").collect()}
    assert got["https://a.com/2"] == (2, 200, 1, 1, ["https://www.t.com/p"]) and got["https://b.com/far"] == (1, 200, 1, 1, ["https://t.com/"]) and got["https://c.com/"] == (0, 404, 0, 0, [])
    assert set(got) == {"http://a.com/", "https://a.com/", "https://a.com/1", "https://a.com/2", "https://a.com/doc", "https://b.com/", "https://b.com/far", "https://c.com/"}


def test_investigated_domains(spark):
    rows = spark.createDataFrame([("A.com",), ("a.com ",), ("t.com",), ("",), (None,), ("b.org",)], "referring_domain string")
    assert sorted(r.domain for r in investigation.investigated_domains(rows, "https://www.T.com/x").collect()) == ["a.com", "b.org"]


def test_layer1_statuses(spark):
    vertices, edges = spark.createDataFrame([(1, "com.t"), (2, "com.a")], "id long, rev string"), spark.createDataFrame([(1, 2)], "node long, pred long")
    assert backlinks.layer1(vertices, edges, "http://t.com", configured=False)[0] == "not_configured" and backlinks.layer1(vertices, None, "http://t.com")[0] == "graph_missing"
    assert backlinks.layer1(vertices.select("id"), edges, "http://t.com") == ("failed", None)
    assert backlinks.layer1(vertices, edges, "http://t.com")[0] == "success"


def serp(n, first=0, site="r"):
    return "".join(f'<li class="b_algo"><a href="https://{site}{first + k}.org/">x</a></li>' for k in range(n))


def test_result_pages_stop(spark):
    rows = [
        ("bing", 0, 0, serp(10), None), ("bing", 0, 1, serp(4, 10), None), ("bing", 0, 2, serp(10, 20), None),  # the second page isn't full
        ("bing", 1, 0, serp(10, 100), None), ("bing", 1, 2, serp(10, 120), None),  # the second page is missing
        ("bing", 2, 0, None, "Timeout: x"), ("bing", 3, 0, serp(10, 200), None), ("bing", 3, 1, serp(10, 210), None), ("bing", 3, 2, "", None), ("bing", 3, 3, serp(10, 230), None),
        ("duckduckgo", 0, 0, '<a class="result__a" href="https://www.t.com/">t</a><a class="result__a" href="https://r0.org/">d</a><a class="result__a" href="https://d.org/">d</a>', None), ("duckduckgo", 1, 0, None, "HTTP 500"), ("duckduckgo", 2, 0, None, "late"),
    ]
    serps = spark.createDataFrame(rows, "engine string, query_no int, page_no int, html string, error string")
    got = {}
    for r in discovery.results(serps, 15).collect():
        got.setdefault((r.engine, r.query_no), []).append((r.pos, r.url))
    assert {k: len(v) for k, v in got.items()} == {("bing", 0): 14, ("bing", 1): 10, ("bing", 3): 15, ("duckduckgo", 0): 3}
    assert sorted(got["bing", 3])[-1] == (14, "https://r214.org/")
    found = {r.url: (r.engine_no, r.query_no, r.pos) for r in discovery.candidates(serps, "t.com", most_results=60).collect()}
    assert found["https://r0.org/"] == (1, 0, 0) and found["https://d.org/"] == (2, 0, 2) and "https://www.t.com/" not in found and len(found) == 14 + 10 + 15 + 1
    errors = {r.engine: r.errors for r in discovery.engine_errors(serps, ("bing", "duckduckgo", "other")).collect()}
    assert errors == {"bing": "Timeout: x", "duckduckgo": "HTTP 500 | late", "other": "unsupported_engine"}


def test_result_pages_in_parts(spark):
    """A page's parts count as one page, in their order; a query has no row that grows with its results."""
    rows = [("bing", 0, 0, 1, serp(4, 6)), ("bing", 0, 0, 0, serp(6)), ("bing", 0, 1, 0, serp(9, 10)), ("bing", 0, 2, 0, serp(10, 30)), ("bing", 1, 0, 2, serp(5, 10)), ("bing", 1, 0, 10, serp(5, 15)), ("bing", 1, 1, 0, serp(10, 50))]
    got = {}
    for r in discovery.results(spark.createDataFrame(rows, "engine string, query_no int, page_no int, part int, html string"), 18).collect():
        got.setdefault(r.query_no, {})[r.pos] = r.url
    assert got == {0: {k: f"https://r{k}.org/" for k in range(18)}, 1: {k: f"https://r{k + (10 if k < 10 else 40)}.org/" for k in range(18)}}


def test_result_pages_query_parses_parts(spark, tmp_path):
    """The query hands parts to the parser, however many results a page has."""
    from sitelume.plans import catalogue

    spark.range(27_000).selectExpr("id * 9 AS event_id", "0L AS user_id").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    longest, parse = [], discovery.backlinks.search_hits
    discovery.backlinks.search_hits = lambda serps, engine: longest.append(serps.agg(F.max(F.length("html"))).first()[0] or 0) or parse(serps, engine)
    try:
        rows = catalogue.QUERIES["result_pages"](spark, str(tmp_path)).collect()
    finally:
        discovery.backlinks.search_hits = parse
    assert sorted((r.pos, r.url) for r in rows) == [(k, f"https://r{9 * k}.org/") for k in range(25)]
    assert 0 < max(longest) < 100_000


def test_requests(spark):
    rows = discovery.requests(spark, "t.com", ("bing", "duckduckgo", "other"), 100).collect()
    assert [r.page_no for r in rows if r.engine == "bing" and r.query_no == 0] == [0, 1, 2] and "first=21" in [r for r in rows if r.engine == "bing"][2].url
    assert len([r for r in rows if r.engine == "duckduckgo"]) == 4 and {r.url for r in rows if r.engine == "other"} == {None} and '"t.com" -site:t.com' in {r.query for r in rows}


def test_collect(spark):
    serps = spark.createDataFrame([("duckduckgo", 0, 0, "".join(f'<a class="result__a" href="https://{x}.org/">d</a>' for x in "abc"), None), ("bing", 0, 0, None, "x")], "engine string, query_no int, page_no int, html string, error string")
    html = "<a href='https://t.com/1' rel='ugc'>one</a><a href='https://t.com/1' rel=ugc>one</a><a href='http://s.t.com/'>two</a>"
    fetched = [("https://a.org/", "https://a.org/x", 200, "text/html", html, None), ("https://b.org/", "https://b.org/", 503, "text/html", html, None), ("https://c.org/", None, None, None, None, "OSError: no"), ("https://no.org/", "https://no.org/", 200, "text/html", html, None)]
    rows, totals = discovery.collect(serps, spark.createDataFrame(fetched, "url string, final_url string, status_code int, content_type string, html string, error string"), "t.com")
    assert sorted((r.source_url, r.target_url, r.backlink_type) for r in rows.collect()) == [("https://a.org/x", "http://s.t.com/", "dofollow"), ("https://a.org/x", "https://t.com/1", "ugc")]
    t = totals.first()
    assert (t.status, t.candidate_pages, t.total_backlinks, t.referring_domains, t.ugc, t.dofollow) == ("success", 3, 2, 1, 1, 1)
    assert t.discovery_errors == {"bing": "x"} and t.verification_errors == {"https://b.org/": "HTTP 503", "https://c.org/": "OSError: no"}


def test_sitemap_documents(spark):
    image = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="i"><url><loc>http://a/?x=1&amp;y=&#233;</loc><image:image><image:loc>http://a/i.png</image:loc></image:image></url><url><loc/></url></urlset>'
    assert readers.sitemap_entries(image) == ("urlset", ["http://a/?x=1&y=é"])
    assert readers.sitemap_entries("<urlset><url><loc>x</url></urlset>") == ("", []) and readers.sitemap_entries(None) == ("", []) and readers.sitemap_entries("<html><loc>x</loc></html>") == ("", [])
    assert readers.sitemap_entries('<?xml version="1.0" encoding="ISO-8859-1"?><sitemapindex><sitemap><loc>é</loc></sitemap></sitemapindex>') == ("index", ["é"])


def test_sitemaps_of_domains(spark):
    urlset = lambda *u: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in u) + "</urlset>"
    files = [
        ("https://a.com/robots.txt", 200, "User-agent: *\nSitemap: https://cdn.net/a.xml\nsitemap: https://a.com/index.xml"), ("https://cdn.net/a.xml", 200, urlset("https://www.a.com/1", "https://b.com/no")),
        ("https://a.com/index.xml", 200, "<sitemapindex><sitemap><loc>https://a.com/deep.xml</loc></sitemap><sitemap><loc>https://a.com/index.xml</loc></sitemap></sitemapindex>"), ("https://a.com/deep.xml", 200, urlset("http://a.com/2/", "http://a.com/2")),
        ("http://b.com/sitemap.xml", 200, urlset("http://b.com/x")), ("https://b.com/sitemap_index.xml", 404, urlset("http://b.com/y")),
    ]
    got = readers.domain_sitemap_pages(spark.createDataFrame([("a.com",), ("b.com",), ("c.com",)], "domain string"), spark.createDataFrame(files, "url string, status_code int, xml string"))
    assert sorted(map(tuple, got.collect())) == [("a.com", "http://a.com/2"), ("a.com", "https://www.a.com/1"), ("b.com", "http://b.com/x")]
    table = spark.createDataFrame(files, "url string, status_code int, xml string")
    counts = {r.sitemap_url: (r.status_code, r.url_count) for r in readers.sitemap_counts(readers.sitemap_locations(table), table).collect()}
    assert counts["https://b.com/sitemap_index.xml"] == (404, 0) and counts["https://a.com/deep.xml"] == (200, 2)


def test_fetching_variants(spark):
    import gzip

    def opener(url, options):
        if url.startswith("https://down"):
            raise OSError("refused")
        if "range" in url:
            asked = dict(options.headers)["Range"]
            return 206, url, {}, gzip.compress(f"WARC/1.0\r\nX: y\r\n\r\nHTTP/1.1 200\r\nA: b\r\n\r\n{asked}".encode())
        if "-index" in url:
            return (200 if "CC-1" in url else 500), url, {}, b'{"urlkey": "k", "url": "http://d/", "filename": "range1", "offset": "5", "length": "10"}\n\nbad\n{"urlkey": "k", "url": "http://d/2"}\n'
        return (404 if "gone" in url else 200), url, {"content-type": "text/html"}, b"x"

    options = fetch.FetchOptions(retries=0, requests_per_second=1000)
    asked = spark.createDataFrame([("https://down.com/",), ("https://gone.com/",), ("https://ok.com/",)], "url string")
    got = {r.asked_url: (r.url, r.status_code) for r in fetch.fetch_either_scheme(asked, options, opener, 2).collect()}
    assert got == {"https://down.com/": ("http://down.com/", 200), "https://gone.com/": ("http://gone.com/", 404), "https://ok.com/": ("https://ok.com/", 200)}
    lines = fetch.index_lines(fetch.index_requests(spark, "https://index", ["CC-1", "CC-2"], "d", 9), options, opener)
    records = readers.cdx_records(lines, 9)
    assert [(r.crawl_no, r.row_no, r.url) for r in records.collect()] == [(0, 0, "http://d/")]
    got = readers.warc_html(fetch.fetch_ranges(records, "https://data/", options, opener, 1)).first()
    assert tuple(got) == ("http://d/", "bytes=5-14")
    resources = spark.createDataFrame([("http://a.com/p", "/s.js"), ("http://a.com/p", "gone.css")], "page_url string, resource_url string")
    assert sorted((r.url, r.status) for r in fetch.fetch_resources(resources, options, opener).collect()) == [("http://a.com/gone.css", 404), ("http://a.com/s.js", 200)]
    client = fetch.Client(options, opener)
    assert client.fetch("https://ok.com/")["status_code"] == 200
    client.close()
    assert client.fetch("https://ok.com/") is None
    corpus = spark.createDataFrame([("https://b/", 500, "e"), ("http://b/", 404, "r"), ("https://c/", 500, "only")], "url string, status_code int, html string")
    asked = spark.createDataFrame([("https://b/",), ("https://c/",)], "url string")
    assert {r.url: (r.fetched_url, r.html) for r in fetch.scheme_fallback(asked, corpus).collect()} == {"https://b/": ("http://b/", "r"), "https://c/": ("https://c/", "only")}


def test_rendering(spark):
    @contextmanager
    def opener():
        def page(url):
            if "bad" in url:
                raise ValueError("no page")
            return url + "/", 200, "<title>t</title>", 0.12345, 1.0

        yield page

    got = {r.url: tuple(r)[1:] for r in render.render(spark.createDataFrame([("u",), ("bad",), ("u",)], "url string"), opener, 2).collect()}
    assert got == {"u": ("u/", 200, "<title>t</title>", 0.123, 1.0, None), "bad": (None, None, None, None, None, "ValueError: no page")}
    with pytest.raises(RuntimeError, match="playwright"), render.browser():
        pass


def test_nested_export(spark, tmp_path):
    pages = spark.createDataFrame([("u\n1", "é", None), ("v", "t", [1])], "url string, title string, n array<int>")
    found, issues = spark.createDataFrame([("u", "v")], "source_url string, target_url string"), spark.createDataFrame([("z", "high"), ("z", "critical"), ("y", "low")], "url string, severity string")
    sinks.export_nested(spark, f"{tmp_path}/crawl.json", 3, "http://a.com", {"platform": "Wix"}, pages, found, issues)
    text = (tmp_path / "crawl.json").read_text(encoding="utf-8")
    data = json.loads(text)
    assert data == {"crawl_id": 3, "start_url": "http://a.com", "site": {"platform": "Wix"}, "pages": [{"url": "u\n1", "title": "é", "n": None}, {"url": "v", "title": "t", "n": [1]}], "links": [{"source_url": "u", "target_url": "v"}], "failed_urls": ["z"]}
    assert "é" in text and '\n  "pages": [' in text
    sinks.export_nested(spark, f"{tmp_path}/empty.json", 3, "s", {}, pages.limit(0), found.limit(0), issues.limit(0))
    assert json.loads((tmp_path / "empty.json").read_text())["pages"] == []
    assert readers.crawl_pages(readers.crawl_json(spark, f"{tmp_path}/crawl.json")).count() == 2


def test_issue_rows():
    assert sinks.issue_row(1, "u", "thin")["issue_type"] == "thin" and sinks.issue_row(1, "u", {"issue_type": "x", "severity": "low"}) == {"crawl_id": 1, "url": "u", "issue_type": "x", "severity": "low", "message": None, "details": "{'issue_type': 'x', 'severity': 'low'}"}


def test_crawl_edges_and_flagged_degrees(spark):
    kind = f"url string, links {readers.LINKS}"
    with_links = spark.createDataFrame([("http://a.com/", [("/x", None, None, None, None, None)])], kind)
    listed = spark.createDataFrame([("http://a.com/", "http://a.com/y")], "source_url string, target_url string")
    assert [r.target for r in links.crawl_edges(with_links, listed, "http://a.com").collect()] == ["http://a.com/x"]
    assert [r.target for r in links.crawl_edges(spark.createDataFrame([("http://a.com/", None)], kind), listed, "http://a.com").collect()] == ["http://a.com/y"]
    rows = spark.createDataFrame([("u", "v", True), ("u", "v", True), ("u", "http://s/x", False), ("u", "w", False)], "source_url string, target_url string, internal boolean")
    pages = spark.createDataFrame([("u",), ("v",), ("w",)], "url string")
    assert sorted(map(tuple, links.with_flagged_degrees(pages, rows, "http://s/").collect())) == [("u", 0, 3), ("v", 2, 0), ("w", 0, 0)]


def test_edges_against_plain_resolution(spark):
    import random
    from urllib.parse import urljoin

    from sitelume.functions import urls

    r = random.Random(9)
    sources = ["http://a.com/x/", "http://A.com/y?b=2&a=1", "https://a.com:443/z", "ftp://a.com/", "http://b.com/q"]
    refs = ["/r", "s", "../t", "?p=1", "http://a.com/u/", "HTTP://A.COM/u", "http://b.com/v", "//a.com/w", "mailto:x", " /padded ", "", "#f", "https://a.com/x#y"]
    pairs = [(r.choice(sources), r.choice(refs)) for _ in range(300)]
    want = {(urls.normal_form(s), t) for s, ref in pairs if ref and urls.normal_form(s) and (t := urls.normal_form(urljoin(urls.normal_form(s), ref.strip()))) and t.split("/")[2] == "a.com"}
    got = links.edges(spark.createDataFrame(pairs, "source_url string, target_url string"), "http://a.com/")
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)


def test_platform_report(spark):
    row = spark.createDataFrame([("wp-content /_next/", {"server": "nginx", "x-powered-by": "PHP"}), ("", None)], "h string, m map<string,string>").select(signatures.platform_report("h", "m", {"WordPress": ["wp-[a-z]+"], "Next.js": ["/_next/"], "Wix": ["wix"]}).alias("p")).collect()
    assert row[0].p.platforms == ["Next.js", "WordPress"] and (row[0].p.server, row[0].p.powered_by) == ("nginx", "PHP") and (row[1].p.platforms, row[1].p.server) == ([], "")


def test_reports_of_all_kinds(spark):
    rows = [(f"u{k:02}", 1, "high", "m", "d") for k in range(30)] + [("u00", 0, "low", "first", "")]
    findings = spark.createDataFrame(rows, "url string, seq int, severity string, message string, detail string")
    scores = spark.createDataFrame([(f"u{k:02}", float(k), k, 1) for k in range(30)] + [("clean", 100.0, 100, 0)], "url string, raw double, score int, n_issues int")
    issues = report.page_issues(findings, scores)
    assert issues.count() == 30
    shown, further = report.worst_pages(issues, 7)
    assert [p["url"] for p in shown] == [f"u{k:02}" for k in range(7)] and further == 23 and [i["message"] for i in shown[0]["issues"]] == ["first", "m"]
    assert report.worst_pages(issues, 30)[1] == 0 and report.worst_pages(issues, 31)[1] == 0
    summary = {"seo_score": 49, "site_health": 90, "crawl_coverage_score": 9}
    html = report.html_report(1, summary, {"tracking": ["T"], "domain": {"ssl": {"enabled": False}}}, shown, {"status": "success", "backlinks": [{"referring_domain": "r.org", "source_url": "https://r.org/"}]}, {"backlinks": []}, further, "out/issues")
    assert "23 more pages" in html and "out/issues" in html and "m (d)" in html and "r.org" in html and "Confirmed on pages" not in html and "disabled" in html and "<td>Backlinks</td>" in html
    assert "<td>Backlinks</td>" not in report.html_report(1, summary, {}, [], {"backlinks": []}, show_total=False) and "more pages" not in report.html_report(1, summary, {}, shown)
    assert json.loads(report.json_report(summary, {}, shown, further, "out/issues"))["further_pages"] == 23 and "further_pages" not in json.loads(report.json_report(summary, {}, shown))
    one = report.category_report([{"category": "A", "n": 1}], 40, [{"severity": "ERROR", "category": "A", "issue": "i<", "url": "http://u/", "details": None}])
    assert "i&lt;" in one and 'href="http://u/"' in one and "score-red" in one
    assert "No issues detected." in report.pipeline_report({"seo_score": 95, "health": 60}, {}, [{"url": "u", "issues": []}]) and "a, b" in report.pipeline_report({"seo_score": 95, "health": 60}, {}, [{"url": "u", "issues": ["a", "b"]}])
    assert "<h3>1. " in report.details_report([{"url": "http://u/", "tracking": ["x", "y"], "schemas": []}]) and "x, y" in report.details_report([{"url": "u", "tracking": ["x", "y"]}])
    assert json.loads(report.patched('{"site": {"a": 1}, "x": 2}', site={"b": 3}, x=[4])) == {"site": {"a": 1, "b": 3}, "x": [4]}
