"""Readers, sinks, fetching, streaming, reports and backlinks."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from sitelume import report
from sitelume.operators import backlinks
from sitelume.sources import fetch, readers, sinks
from sitelume.streaming import ingest


def test_crawl_document_to_reports(spark, tmp_path):
    import sitelume.__main__ as cli

    pages = [{"url": "http://a.com/", "status_code": 200, "title": "t" * 40, "links": [{"url": "/x"}], "h1s": ["h"]}, {"url": "http://a.com/x", "status_code": 500, "title": "<b>"}]
    crawl = {"crawl_id": 7, "start_url": "http://a.com", "site": {"platform": "Wix", "pages_discovered": 2, "domain": {"hostname": "a.com", "ssl": {"enabled": True}}}, "pages": pages, "links": []}
    (tmp_path / "crawl_7.json").write_text(json.dumps(crawl))
    cli.main(str(tmp_path / "crawl_7.json"), str(tmp_path / "out"))
    out = json.loads((tmp_path / "out" / "audit_crawl_7.json").read_text())
    assert out["summary"]["pages_crawled"] == 2 and {i["message"] for p in out["pages"] if p["url"].endswith("x") for i in p["issues"]} >= {"HTTP 500", "Short title", "No internal links"}
    html = (tmp_path / "out" / "report_7.html").read_text()
    assert "HTTP 500" in html and "/100" in html and '<a href="http://a.com/x">' in html


def test_jsonl(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"url": "u", "links": [{"url": "x", "anchor": "y"}]}\nnot json\n{"url": "v", "word_count": 3}\n')
    assert sorted(r.url for r in readers.pages_jsonl(spark, str(tmp_path / "p.jsonl")).collect()) == ["u", "v"]
    (tmp_path / "l.jsonl").write_text('{"source_url": "u", "target_url": "v", "anchor": "y"}\n')
    assert readers.links_jsonl(spark, str(tmp_path / "l.jsonl")).first().anchor_text == "y"


def test_vertices_and_releases(spark, tmp_path):
    with gzip.open(tmp_path / "v.txt.gz", "wt") as f:
        f.write("# comment\n1\tcom.example\n\nx\tcom.bad\n2\torg.b\n")
    assert sorted(tuple(r) for r in readers.vertices_tsv(spark, str(tmp_path / "v.txt.gz")).collect()) == [(1, "com.example"), (2, "org.b")]
    names = [f"{r}{e}" for r in ("r-2024", "r-2025") for e in (".graph", ".properties", "-vertices.txt.gz")] + ["r-2026.graph"]
    assert readers.graph_release(names) == "r-2025" and readers.graph_release([]) is None


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    files = [("i", 200, f"<?xml version='1.0'?><sitemapindex {ns}><sitemap><loc> a </loc></sitemap><sitemap><loc>b</loc></sitemap></sitemapindex>"), ("a", 200, f"<urlset {ns}><url><loc>http://x/?p=1&amp;q</loc></url><url><loc><![CDATA[http://y]]></loc></url></urlset>"), ("b", 404, "<urlset><loc>z</loc></urlset>"), ("c", 200, "<urlset><loc>unlisted</loc></urlset>"), ("i2", 200, "<urlset><loc>broken")]
    df = spark.createDataFrame(files, "url string, status_code int, xml string")
    got = readers.expand_sitemaps(df, spark.createDataFrame([("i",), ("i2",)], "url string"))
    assert [r["loc"] for r in got.orderBy("pos").collect()] == ["http://x/?p=1&q", "http://y"] and readers.sitemap_counts(got).first().url_count == 2


def test_robots(spark):
    robots = spark.createDataFrame([("h", 200, "User-agent: *\nDisallow: /p\nCrawl-delay: 3\nSitemap: https://h/s.xml\n"), ("k", 500, "User-agent: *\nDisallow: /")], "host string, status_code int, body string")
    asked = spark.createDataFrame([("h", "http://h/p/1"), ("h", "http://h/q"), ("k", "http://k/"), ("m", "http://m/")], "host string, url string")
    assert {(r.url, r.allowed, r.crawl_delay) for r in readers.robots_allowed(asked, robots, "x").collect()} == {("http://h/p/1", False, 3.0), ("http://h/q", True, 3.0), ("http://k/", True, None), ("http://m/", True, None)}
    assert not readers.robots_allowed(asked, robots, "x", missing_allows=False).filter("host = 'm'").first().allowed
    assert readers.robots_sitemaps(robots).first().sitemap == "https://h/s.xml"


def test_archives(spark):
    raw = b"WARC/1.0\r\nA: b\r\n\r\nHTTP/1.1 200 OK\r\nC: d\r\n\r\n<p>x\r\n\r\ny</p>"
    rows = spark.createDataFrame([("u", bytearray(gzip.compress(raw))), ("v", bytearray(b"junk")), ("w", None)], "url string, content binary")
    assert {r.url: r.html for r in readers.warc_html(rows).collect()} == {"u": "<p>x\r\n\r\ny</p>", "v": None, "w": None}
    lines = [(0, k, json.dumps({"urlkey": f"k{k // 2}", "url": f"u{k}", "status": "200" if k != 4 else "404"})) for k in range(8)] + [(1, 0, "bad")]
    got = readers.cdx_records(spark.createDataFrame(lines, "crawl_no int, row_no int, value string"), 3)
    assert sorted(r.url for r in got.collect()) == ["u0", "u2", "u5"]


def test_sinks(spark, tmp_path):
    root = str(tmp_path / "t")
    sinks.create_crawl(spark, root, 1, "http://a.com")
    assert sinks.crawl_status(spark, root, 1)["status"] == "queued" and sinks.crawl_status(spark, root, 2) == {"error": "crawl_not_found"}
    assert sinks.update_crawl(spark, root, 1, status="completed", start_url="no") and not sinks.update_crawl(spark, root, 1, nothing=1)
    assert (sinks.crawl_status(spark, root, 1)["status"], sinks.crawl_status(spark, root, 1)["start_url"]) == ("completed", "http://a.com")
    page = spark.createDataFrame([(1, "u", "t")], "crawl_id long, url string, title string")
    sinks.append(page, root, "pages")
    stored = readers.crawl_table(spark, f"{root}/pages", 1, ["url", "title", "no_such_column"])
    assert tuple(stored.first()) == ("u", "t", None)
    new = spark.createDataFrame([(1, "u", "t2"), (1, "v", "x")], "crawl_id long, url string, title string")
    assert sorted(tuple(r) for r in sinks.upsert_pages(page, new).collect()) == [(1, "u", "t2"), (1, "v", "x")]
    assert [r.url for r in sinks.new_urls(new, page.select("crawl_id", "url")).collect()] == ["v"]
    meta = sinks.merge_meta(spark, f"{tmp_path}/meta.json", crawl_id=1, status="running")
    assert sinks.merge_meta(spark, f"{tmp_path}/meta.json", status="done") | {"updated_at": 0} == meta | {"status": "done", "updated_at": 0}
    assert tuple(sinks.persistence_summary(new, page, page.limit(0)).first()) == (2, 1, 0)
    nested = spark.createDataFrame([(1, "u", [("i", None, None, None, None)], ["s"], ["c"], [("de", "x")], ["A"], [("l", "a", "r", True, False, False)])], f"crawl_id long, url string, images {readers.IMAGES}, scripts array<string>, stylesheets array<string>, hreflang array<struct<lang:string,url:string>>, schemas array<string>, links {readers.LINKS}")
    assert {k: v.count() for k, v in sinks.child_tables(nested).items()} == {"images": 1, "resources": 2, "hreflang": 1, "schemas": 1, "links": 1}
    issues = spark.createDataFrame([("u", "high"), ("u", "low")], "url string, severity string")
    sinks.append_jsonl(new, f"{tmp_path}/j")
    assert sinks.export_crawl(1, "s", {}, new, page, issues).count() == 5 and spark.read.json(f"{tmp_path}/j").count() == 2


def test_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS crawl_test")
    sinks.create_tables(spark, "crawl_test")
    assert spark.catalog.tableExists("crawl_test.pages") and not spark.catalog.tableExists("crawl_test.failed")
    spark.sql("DROP DATABASE crawl_test CASCADE")


def test_fetch(spark):
    def opener(url, options):
        if "down" in url:
            raise OSError("refused")
        return (404 if "gone" in url else 200), url + "/", {"content-type": "text/html; charset=latin-1"}, "é".encode("latin-1")

    waits = []
    client = fetch.Client(fetch.FetchOptions(retries=1, requests_per_second=1000), opener, waits.append)
    r = client.get("http://down")
    assert (r["status_code"], r["attempts"], r["error"]) == (None, 2, "OSError: refused") and 1.0 in waits
    urls = spark.createDataFrame([("http://a",), ("http://gone",), ("http://a",)], "url string")
    got = {r.url: (r.status_code, r.html, r.final_url) for r in fetch.fetch(urls, fetch.FetchOptions(retries=0, requests_per_second=1000), opener, 2).collect()}
    assert got == {"http://a": (200, "é", "http://a/"), "http://gone": (404, "é", "http://gone/")}
    assert fetch.decode(b"x", "image/png") is None and fetch.decode(b"\xff", "text/plain; charset=nope") == "�"
    with pytest.raises(ValueError):
        fetch.FetchOptions(max_depth=501)
    fetch.register(spark)
    assert spark.read.format("web_pages").option("urls", "http://localhost:1/x").option("retries", "0").option("timeout", "1").load().first().status_code is None


def test_scheme_fallback(spark):
    fetched = spark.createDataFrame([("http://a/x", 200, "h"), ("https://b/", 500, "e"), ("http://b/", 301, "r")], "url string, status_code int, html string")
    asked = spark.createDataFrame([("https://a/x",), ("https://b/",), ("http://c/",)], "url string")
    assert {r.url: (r.fetched_url, r.html) for r in fetch.scheme_fallback(asked, fetched).collect()} == {"https://a/x": ("http://a/x", "h"), "https://b/": ("http://b/", "r"), "http://c/": (None, None)}
    doc = json.dumps({"events": [{"eventAction": "last changed", "eventDate": "x"}, {"eventAction": "registration", "eventDate": "2001"}]})
    assert fetch.rdap_created(spark.createDataFrame([("d", doc)], "domain string, value string")).first().created == "2001"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps({"crawl_id": 1, "url": f"u{(k + j) % 4}", "fetched_at": f"2024-01-01T0{k}:00:00Z", "status_code": 500 if j else 200, "word_count": 999}) + "\n" for j in range(3)) + "broken\n")
    lines = ingest.page_lines(spark, str(tmp_path / "in"))
    ingest.audit_stream(ingest.first_pages(lines), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.url for r in spark.read.parquet(f"{tmp_path}/out/pages").collect()) == ["u0", "u1", "u2", "u3"]
    assert spark.read.parquet(f"{tmp_path}/out/issues").filter("type = 'missing_title'").count() == 4
    q = ingest.progress(lines).writeStream.format("memory").queryName("crawl_progress").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.pages for r in spark.sql("select * from crawl_progress order by start").collect()] == [3, 3, 3]


def test_reports():
    assert report.linkified("see http://a.com/x?y=1&z <b>") == 'see <a href="http://a.com/x?y=1&amp;z">http://a.com/x?y=1&amp;z</a> &lt;b&gt;' and report.linkified('<a href="x">y</a>') == '<a href="x">y</a>'
    assert "No issues detected." in report.html_report(1, {"seo_score": 49, "site_health": 90, "crawl_coverage_score": 9}, {}, [])
    html = report.category_report([{"category": "A", "n": 1}, {"category": "B", "n": 5}, {"category": "A", "n": 2}], 95)
    assert html.index(">B<") < html.index(">A<") and "score-green" in html
    assert [report.band(s) for s in (49, 50, 90)] == ["score-red", "score-orange", "score-green"]


def test_referring_domains(spark):
    vertices = spark.createDataFrame([(1, "com.t"), (2, "com.a"), (3, "org.B.x")], "id long, rev string")
    edges = spark.createDataFrame([(1, 2), (1, 3), (1, 2), (2, 3)], "node long, pred long")
    assert sorted((r.id, r.referring_domain, r.source_url) for r in backlinks.referring_domains(vertices, edges, "http://www.T.com/x").collect()) == [(2, "a.com", "https://a.com/"), (3, "x.b.org", "https://x.b.org/")]
    assert backlinks.referring_domains(vertices, edges, "http://none.com").count() == 0
    assert [backlinks.layer1(v, edges, t)[0] for v, t in ((None, "http://t.com"), (vertices, "t"), (vertices, "http://no.com"), (vertices, "http://t.com"))] == ["graph_missing", "invalid_target", "not_in_graph", "success"]


def test_investigation(spark):
    page = lambda u, d, s=200, k="text/html": (u, d, s, k)
    pages = [page("https://a.com/", "a.com"), page("https://a.com/1", "a.com"), page("https://a.com/2", "a.com"), page("https://b.com/", "b.com"), page("https://c.com/", "c.com", 404)]
    found = [("https://a.com/", "/1", "", ""), ("https://a.com/1", "/2", "", ""), ("https://a.com/2", "https://www.t.com/p", "x", "nofollow"), ("https://b.com/", "https://sub.t.com/", "", ""), ("https://b.com/", "mailto:q", "", "")]
    got = backlinks.investigate(spark.createDataFrame(pages, "url string, domain string, status_code int, content_type string"), spark.createDataFrame(found, "source_url string, url string, anchor string, rel string"), spark.createDataFrame([("a.com",), ("b.com",), ("c.com",)], "domain string"), "https://t.com")
    assert {r.domain: (r.status, r.pages_checked, r.hit_url, r.links_found) for r in got.collect()} == {"a.com": ("confirmed", 3, "https://a.com/2", 1), "b.com": ("not_found", 1, None, 0), "c.com": ("not_found", 0, None, 0)}
    assert tuple(backlinks.layer2_summary(got).first()) == ("confirmed", 3, 1) and tuple(backlinks.layer2_summary(got.limit(0)).first()) == ("no_referring_domains", 0, 0)


def test_search_results(spark):
    bing = '<li class="x b_algo"><h2><a class=q href="https://r.com/?a=1&amp;b">x</a></li><li class="b_algo"><a href="/rel">'
    duck = '<a rel="n" class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fs.com%2Fx&amp;r=1">s</a><a class="result__a" href="https://t.com/">'
    df = lambda h: spark.createDataFrame([(0, h)], "query_no int, html string")
    assert [r.url for r in backlinks.search_hits(df(bing), "bing").collect()] == ["https://r.com/?a=1&b"]
    found = backlinks.search_hits(df(duck), "duckduckgo")
    assert [r.url for r in found.orderBy("pos").collect()] == ["https://s.com/x", "https://t.com/"]
    assert [r.url for r in backlinks.candidates(found, "t.com", 10).collect()] == ["https://s.com/x"]


def test_page_hits(spark):
    rows = [("http://s.com/a", "//t.com/x#f", "one", "ugc"), ("http://s.com/a", "/y", "two", ""), ("http://s.com/a", "http://sub.t.com/", "three", "")]
    got = backlinks.page_hits(spark.createDataFrame(rows, "source_url string, url string, anchor string, rel string"), F.lit("t.com")).collect()
    assert [(r.target_url, r.ugc, r.nofollow) for r in got] == [("http://t.com/x", True, False)]


def test_probes(spark):
    resources = spark.createDataFrame([("http://a.com/p", "/s.js"), ("http://a.com/p", "x.css"), ("http://a.com/p", "data:x")], "page_url string, resource_url string")
    fetched = spark.createDataFrame([("http://a.com/s.js", 200, "text/javascript", 0.5, None)], "url string, status_code int, content_type string, elapsed double, error string")
    assert sorted((r.url, r.status, r.error) for r in fetch.probe_resources(resources, fetched).collect()) == [("http://a.com/s.js", 200, None), ("http://a.com/x.css", 0, "not_fetched")]

    def fails(host):
        raise OSError("no route")

    meta = fetch.site_metadata("h", "nginx", lambda h: ["2.2.2.2", "1.1.1.1", "2.2.2.2"], lambda h: {"subject": ((("commonName", "h"),),), "issuer": (), "notAfter": "x"})
    assert meta["ip_addresses"] == ["1.1.1.1", "2.2.2.2"] and meta["ssl"] == {"enabled": True, "subject": {"commonName": "h"}, "issuer": {}, "valid_from": None, "valid_until": "x"}
    assert fetch.site_metadata("h", None, fails, fails)["ssl"] == {"enabled": False, "error": "no route"}
    assert readers.graph_dir({"graph.dir": "/g"}, lambda d: d == "/g") == "/g" and readers.graph_dir({}, lambda d: False) is None
    pages = spark.createDataFrame([("u", None), ("v", 0.5)], "url string, pagerank double")
    assert sorted(tuple(r) for r in sinks.with_pagerank(pages, spark.createDataFrame([("u", 0.1)], "url string, pagerank double")).collect()) == [("u", 0.1), ("v", None)]
