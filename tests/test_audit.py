"""Rules, scores, link graph and graph operators on hand-made fixtures."""

import pytest
from pyspark.sql import functions as F

from sitelume.operators import duplicates, graph, links, merge, rules, scoring, site

PAGE = "url string, status_code int, title string, meta_description string, h1s array<string>, word_count int, canonical string, robots string, images array<struct<url:string,alt:string,width:string,height:string,loading:string>>, schemas array<string>, language string, viewport string, links_out long, redirect boolean, final_url string"
IMG = lambda alt: ("i", alt, None, None, None)


def page(spark, *rows):
    base = {"url": "http://a.com/", "status_code": 200, "title": "t" * 40, "meta_description": "d" * 100, "h1s": ["h"], "word_count": 500, "canonical": "http://a.com/", "robots": "", "images": [], "schemas": ["X"], "language": "en", "viewport": "w", "links_out": 1, "redirect": False, "final_url": "http://a.com/"}
    names = [c.split(" ")[0] for c in PAGE.split(", ")]
    return spark.createDataFrame([tuple((base | {"url": f"http://a.com/{k}"} | r)[n] for n in names) for k, r in enumerate(rows)], PAGE)


def said(spark, **changes):
    return [(r.severity, r.message, r.detail) for r in rules.evaluated(page(spark, changes), rules.audit_rules()).select(F.explode("findings").alias("f")).select("f.*").orderBy("seq").collect()]


@pytest.mark.parametrize("changes,want", [
    ({}, []),
    ({"status_code": 399}, []), ({"status_code": 404}, [("high", "HTTP 404", "")]), ({"status_code": 500}, [("critical", "HTTP 500", "")]), ({"status_code": None}, [("high", "HTTP 0", "")]),
    ({"title": None}, [("critical", "Missing title", "")]), ({"title": " \n"}, [("critical", "Missing title", "")]), ({"title": "t" * 29}, [("notice", "Short title", "29 characters")]), ({"title": "t" * 30}, []), ({"title": "t" * 60}, []), ({"title": "t" * 61}, [("medium", "Long title", "61 characters")]),
    ({"meta_description": "d" * 69}, [("notice", "Short meta description", "69 characters")]), ({"meta_description": "d" * 70}, []), ({"meta_description": "d" * 160}, []), ({"meta_description": "d" * 161}, [("notice", "Long meta description", "161 characters")]), ({"meta_description": ""}, [("medium", "Missing meta description", "")]),
    ({"h1s": None}, [("critical", "No H1", "0 H1s")]), ({"h1s": ["a", "b"]}, [("medium", "Multiple H1s", "2 H1s")]),
    ({"word_count": 99}, [("medium", "Very low word count", "99 words")]), ({"word_count": 100}, [("notice", "Low word count", "100 words")]), ({"word_count": 299}, [("notice", "Low word count", "299 words")]), ({"word_count": 300}, []),
    ({"images": [IMG("x"), IMG(None), IMG(" ")]}, [("notice", "2 images have no alt text", "2/3")]), ({"images": [IMG(None)] * 3}, [("medium", "3 images have no alt text", "3/3")]), ({"images": [IMG(None)] * 3 + [IMG("x")] * 3}, [("notice", "3 images have no alt text", "3/6")]),
    ({"robots": "NOINDEX"}, [("critical", "Noindex directive", "")]), ({"links_out": 0}, [("medium", "No internal links", "")]), ({"links_out": None}, [("medium", "No internal links", "")]),
    ({"canonical": " ", "schemas": [], "language": "", "viewport": None}, [("medium", "Missing canonical", ""), ("notice", "No structured data", ""), ("notice", "Missing HTML language", ""), ("notice", "Missing viewport", "")]),
])
def test_audit_rules(spark, changes, want):
    assert said(spark, **changes) == want


def test_checks_count_only_what_is_evaluated(spark):
    rows = rules.evaluated(page(spark, {}, {"title": "", "meta_description": None}, {"images": [IMG("x")]}), rules.audit_rules()).orderBy("url").collect()
    assert [(r.checks, r.passed) for r in rows] == [(13, 13), (11, 9), (14, 14)]


def test_duplicates_are_folded_and_shared_by_url(spark):
    pages = page(spark, {"title": " Same "}, {"title": "same"}, {"title": "other", "meta_description": None}, {"url": "http://a.com/0", "title": "x", "meta_description": ""})
    found = sorted(tuple(r) for r in rules.duplicate_findings(pages).collect())
    assert found == [("http://a.com/0", 15, "medium", "Duplicate title", "2 pages"), ("http://a.com/0", 16, "medium", "Duplicate meta description", "2 pages"), ("http://a.com/1", 15, "medium", "Duplicate title", "2 pages"), ("http://a.com/1", 16, "medium", "Duplicate meta description", "2 pages")]
    scores = scoring.page_scores(pages, rules.duplicate_findings(pages)).orderBy("url", "score").collect()
    assert [(r.url[-1], r.score) for r in scores] == [("0", 60), ("0", 60), ("1", 60), ("2", 100)]


def test_summary(spark):
    pages = page(spark, {"title": "a" * 40, "meta_description": "a" * 80}, {"title": "b" * 40, "meta_description": "b" * 80, "status_code": 500, "robots": "noindex"})
    one = lambda **k: spark.createDataFrame([(k.get("found"), k.get("ssl"), k.get("host", "a.com"), k.get("platform", "Wix"))], "pages_discovered long, ssl_enabled boolean, hostname string, platform string")
    s = scoring.summary(pages, one()).first()
    assert (s.seo_score, s.site_health, s.pages_crawled, s.pages_discovered, s.crawl_coverage_score, s.critical, s.total_issues, s.checks, s.passed) == (60, 70, 2, 2, 10, 2, 2, 26, 24)
    s = scoring.summary(pages, one(found=100, ssl=False, host="", platform=None)).first()
    assert (s.site_health, s.pages_discovered, s.crawl_coverage_score) == (30, 100, 7)
    s = scoring.summary(pages.limit(0), one()).first()
    assert (s.seo_score, s.site_health, s.pages_crawled, s.total_issues, s.checks) == (0, 100, 0, 0, 0)


def test_bands(spark):
    rows = spark.createDataFrame([(49,), (50,), (89,), (90,)], "s int").select(scoring.score_band(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["score-red", "score-orange", "score-orange", "score-green"]
    shares = spark.createDataFrame([(9499, 10000), (95, 100), (9799, 10000), (98, 100), (1, 0)], "c int, d int").select(scoring.coverage_score(F.col("c"), F.col("d"))).collect()
    assert [r[0] for r in shares] == [7, 9, 9, 10, 7]
    assert [r[0] for r in spark.createDataFrame([(7,), (9,), (10,)], "s int").select(scoring.coverage_band(F.col("s"))).collect()] == ["score-red", "score-orange", "score-green"]


def test_technical(spark):
    rows = page(spark, {"word_count": 199, "images": [IMG(None), IMG(""), IMG(None)]}, {"word_count": 200, "title": "", "robots": "NoFollow"})
    got = sorted((r.url[-1], r.type, r.severity) for r in rules.technical_issues(rows).collect())
    assert got == [("0", "image_missing_alt", "low"), ("0", "image_missing_alt", "low"), ("0", "thin_content", "medium"), ("1", "missing_title", "high"), ("1", "nofollow", "info")]


def test_indexability(spark):
    rows = page(spark, {"redirect": True, "final_url": "http://a.com/9"}, {"robots": "noindex", "canonical": "/1"}, {"canonical": "http://b.com/x?utm_source=1"}, {"status_code": 404, "canonical": "ftp://x"}, {"canonical": ""})
    got = sorted((r.url[-1], r.type, r.target) for r in rules.indexability_issues(rows).collect())
    assert got == [("0", "canonical_to_different_url", "http://a.com/"), ("0", "non_self_canonical", "http://a.com/"), ("0", "redirect_target", "http://a.com/9"), ("1", "blocked_by_noindex", ""), ("1", "non_self_canonical", "/1"), ("2", "canonical_to_different_url", "http://b.com/x"), ("2", "non_self_canonical", "http://b.com/x?utm_source=1")]


def test_hreflang(spark):
    rows = [("p", 0, "en", "http://a/"), ("p", 1, " EN ", "http://b/"), ("p", 2, "", "http://c/"), ("p", 3, "de", "ftp://x"), ("p", 4, "de", "http://d/"), ("p", 5, "en", "http://e/")]
    got = sorted((r.pos, r.type) for r in rules.hreflang_issues(spark.createDataFrame(rows, "page_url string, pos int, lang string, url string")).collect())
    assert got == [(1, "duplicate_hreflang_language"), (2, "hreflang_missing_language"), (3, "hreflang_invalid_url"), (5, "duplicate_hreflang_language")]


def test_edges(spark):
    rows = [("http://a.com/x", "/y"), ("http://a.com/x", "y"), ("http://a.com/x#f", "/y/"), ("http://a.com/x", "http://A.com:80/x"), ("http://a.com/x", "http://b.com/"), ("bad", "/y"), ("http://a.com/x", ""), ("http://a.com/x", "mailto:z"), ("http://a.com/x", None)]
    got = sorted(tuple(r) for r in links.edges(spark.createDataFrame(rows, "source_url string, target_url string"), "http://a.com").collect())
    assert got == [("http://a.com/x", "http://a.com/x"), ("http://a.com/x", "http://a.com/y")]


def link_table(spark, pairs):
    return spark.createDataFrame([(a, b, True) for a, b in pairs], "source_url string, target_url string, internal boolean")


def test_pagerank_by_hand(spark):
    pages = spark.createDataFrame([(x,) for x in "abcd"], "url string")
    pairs = [("a", "b"), ("a", "b"), ("a", "c"), ("b", "c"), ("b", "zz"), ("c", "a"), ("zz", "a")]
    rank = dict.fromkeys("abcd", 0.25)
    out = {"a": 3, "b": 2, "c": 1, "zz": 1}
    for _ in range(20):
        rank = {v: 0.15 / 4 + 0.85 * sum(rank.get(u, 0) / out[u] for u in {s for s, t in pairs if t == v}) for v in rank}
    got = {r.url: r.pagerank for r in graph.pagerank(pages, link_table(spark, pairs)).collect()}
    assert got == pytest.approx(rank)
    assert graph.pagerank(pages.limit(0), link_table(spark, pairs)).count() == 0


def test_bfs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "a"), ("x", "y")], "source string, target string")
    start = spark.createDataFrame([("a",)], "url string")
    depth = lambda **k: {r.url: r.depth for r in graph.bfs(edges, start, **k).collect()}
    assert depth(max_depth=9) == {"a": 0, "b": 1, "c": 1, "d": 2} and depth(max_depth=1) == {"a": 0, "b": 1, "c": 1} and depth(max_depth=9, max_pages=2) == {"a": 0, "b": 1}


def test_frontier(spark):
    rows = [("http://a.com/", 0, 1), ("http://a.com/blog/x", 1, 2), ("http://a.com/y", 1, 3), ("http://a.com/z", 1, 4), ("http://a.com", 3, 5)]
    got = [(r.url, r.priority) for r in graph.frontier_order(spark.createDataFrame(rows, "url string, depth int, seq int")).orderBy("visit").collect()]
    assert got == [("http://a.com/", -100), ("http://a.com", -70), ("http://a.com/blog/x", 5), ("http://a.com/y", 10), ("http://a.com/z", 10)]
    assert spark.range(1).select(graph.priority(F.lit(2), F.lit("http://a.com/"), F.lit(True))).first()[0] == -50


def test_admission(spark):
    found = spark.createDataFrame([("http://a.com/x/", 1, 1), ("http://a.com/x", 2, 2), ("http://b.com/", 1, 3), ("http://a.com/s", 1, 4), ("http://a.com/deep", 9, 5), ("bad", 1, 6), ("http://a.com/y", 1, 7), ("http://a.com/z", 1, 8)], "url string, depth int, seq int")
    seen = spark.createDataFrame([("http://a.com/s",)], "url string")
    assert [(r.url, r.depth) for r in graph.admitted(found, seen, "http://a.com/", 5, 3).orderBy("seq").collect()] == [("http://a.com/x", 1), ("http://a.com/y", 1)]


def test_hubs_change_nothing(spark, monkeypatch):
    """Sources dealt as several keys give the same ranks and depths, and the caller's session keeps its settings."""
    import random

    r = random.Random(2)
    names = [f"p{i}" for i in range(60)]
    pairs = [("p0", x) for x in names] + [("p1", x) for x in names[:40]] + [(r.choice(names), r.choice(names)) for _ in range(80)]
    pages, table = spark.createDataFrame([(x,) for x in names], "url string"), link_table(spark, pairs)
    edges, start = table.selectExpr("source_url source", "target_url target"), spark.createDataFrame([("p1",)], "url string")
    get = lambda: ({x.url: x.pagerank for x in graph.pagerank(pages, table, 4).collect()}, {x.url: x.depth for x in graph.bfs(edges, start, 9).collect()})
    whole = get()
    monkeypatch.setattr(graph, "HUB", 3)
    split = get()
    assert split[0] == pytest.approx(whole[0]) and split[1] == whole[1] and len(whole[1]) > 40
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_frontier_of_one_priority(spark):
    """Places are gapless and in order over many partitions of one priority."""
    rows = spark.range(5000).selectExpr("concat('http://a.com/', id) url", "1 + cast(id % 2 as int) depth", "cast((id * 7919) % 5003 as int) seq").repartition(11)
    got = graph.frontier_order(rows).collect()
    want = sorted((r.priority, r.seq, r.url) for r in got)
    assert [(r.priority, r.seq, r.url) for r in sorted(got, key=lambda r: r.visit)] == want and sorted(r.visit for r in got) == list(range(1, 5001))
    assert graph.frontier_order(rows.limit(0)).count() == 0


def test_admission_by_robots_and_netloc(spark):
    found = spark.createDataFrame([("http://a.com/x", 1, 1), ("http://a.com/private", 1, 2), ("http://a.com/y", 2, 3)], "target_url string, depth int, seq int")
    seen = spark.createDataFrame([], "url string")
    asked = spark.createDataFrame([("http://a.com/private", False), ("http://a.com/x", True), ("http://a.com/y", None)], "url string, allowed boolean")
    get = lambda deep: [(r.url, r.depth) for r in graph.admitted_children(found, seen, "http://a.com/", deep, 10, asked).orderBy("seq").collect()]
    assert get(5) == [("http://a.com/x", 2), ("http://a.com/y", 3)] and get(2) == [("http://a.com/x", 2)] and get(1) == []
    links_ = spark.createDataFrame([("http://a.com/x",), ("http://A.com/x",), ("http://a.com:80/x",), ("/rel",), ("http://b.com/",)], "u string")
    assert [r[0] for r in links_.select(graph.internal_link("u", "http://a.com/")).collect()] == [True, False, False, True, False]


def test_latest(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", None, "z"), ("b", None, "w"), (None, 2, "v"), (None, 5, "u")], "k string, n int, row string")
    assert sorted(map(str, merge.latest(rows, ["k"], [F.col("n")]).collect())) == sorted(["Row(k='a', n=3, row='y')", "Row(k='b', n=None, row='w')", "Row(k=None, n=5, row='u')"])


def test_orphans_and_rel(spark):
    pages = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    table = link_table(spark, [("a", "b")])
    assert sorted(r.url for r in links.orphans(pages, table).collect()) == ["a", "c"] and [r.url for r in links.orphans(pages, table, "a").collect()] == ["c"]
    rels = spark.createDataFrame([("sponsored ugc nofollow",), ("UGC",), ("NOFOLLOW",), ("",), (None,)], "r string").select(links.classify_rel("r")).collect()
    assert [r[0] for r in rels] == ["sponsored", "ugc", "nofollow", "dofollow", "dofollow"]


def test_merging(spark):
    stored = spark.createDataFrame([("a", "old", 1), ("b", "keep", 2)], "url string, title string, n int")
    rich = spark.createDataFrame([("a", "first", 9, "x", 1), ("a", "last", 8, "y", 2), ("z", "no", 7, "z", 3)], "url string, title string, n int, extra string, line int")
    assert sorted(tuple(r) for r in merge.rich_merge(stored, rich, "url", "line", {"title"}).collect()) == [("a", "last", 1, "y"), ("b", "keep", 2, None)]
    assert sorted(tuple(r) for r in merge.first_seen(spark.createDataFrame([("u", 3), ("u", 1), ("v", 2)], "k string, pos int"), "k", "pos").collect()) == [("u", 1), ("v", 2)]


def test_duplicate_groups(spark):
    rows = spark.createDataFrame([("1", "h"), ("2", "h"), ("3", ""), ("4", ""), ("5", None), ("6", "g")], "url string, content_hash string")
    assert sorted(tuple(r) for r in duplicates.content(rows).collect()) == [("1", "duplicate_content", "high", 2), ("2", "duplicate_content", "high", 2)]


def test_rollup(spark):
    rows = [(1, 200, "Wix", ["b", "a"], 0.0, 2.0, "", True), (2, 404, "", [], 1.0, 4.0, "noindex", False), (3, 200, None, ["a"], 2.0, 0.0, "", True), (4, 200, "Wix", [], 0.0, 0.0, "", True), (5, None, "Zed", [], 0.0, 0.0, "", False)]
    r = site.rollup(spark.createDataFrame(rows, "page_id int, status_code int, platform string, tracking array<string>, dom_loaded_seconds double, fully_loaded_seconds double, robots string, is_indexable boolean")).first()
    assert (r.platform, r.tracking, r.average_dom_loaded_seconds, r.average_fully_loaded_seconds, r.pages_crawled, r.n_failed, r.n_noindex, r.pages_indexable) == ("Wix", "a,b", 1.5, 3.0, 5, 1, 1, 3)


def test_status_precedence(spark):
    rows = [("a", "not_found"), ("a", "timeout"), ("a", "confirmed"), ("b", "error"), ("b", "blocked"), ("c", "not_found")]
    assert {r.k: r.status for r in site.resolved_status(spark.createDataFrame(rows, "k string, status string"), "k").collect()} == {"a": "confirmed", "b": "error", "c": "not_found"}


def test_profiles(spark):
    pages = page(spark, {"title": "x", "images": [IMG(None), IMG(" ")], "word_count": 50}, {"status_code": 503, "canonical": ""}, {"status_code": 301})
    table = link_table(spark, [("http://a.com/0", "http://a.com/1")])
    issues = rules.legacy_issues(pages, table, "http://a.com/0", spark.createDataFrame([("http://a.com/q",)], "url string"))
    got = sorted((r.url[-1], r.issue) for r in issues.collect())
    assert got == [("0", "Duplicate meta description"), ("0", "Image missing ALT text"), ("0", "Image missing ALT text"), ("0", "Title tag too short"), ("0", "Very thin content"), ("1", "5xx HTTP status"), ("1", "Duplicate meta description"), ("1", "Duplicate title tag"), ("1", "Missing canonical"), ("1", "Page has no internal outgoing links"), ("2", "Duplicate meta description"), ("2", "Duplicate title tag"), ("2", "Page has no internal outgoing links"), ("2", "Potential orphan page"), ("2", "Redirected URL"), ("q", "Broken URL / failed crawl")]
    h = scoring.legacy_health(issues, pages).first()
    assert (h.errors, h.warnings, h.notices, h.health) == (4, 12, 0, 0)
    short = rules.pipeline_issues(pages)
    assert [r.issues for r in short.orderBy("url").collect()] == [["Short title", "Low word count", "2 images without ALT", "Low internal links"], ["HTTP 503", "Low internal links", "Missing canonical"], ["Low internal links"]]
    assert rules.pipeline_issues(pages, status_last=True).orderBy("url").collect()[1].issues[-1] == "HTTP 503"
    assert tuple(scoring.pipeline_scores(short).first()) == (73, 73) and tuple(scoring.template_scores(short).first()) == (0, 85)


def test_redirects_and_overlay(spark):
    moved = spark.createDataFrame([("http://a.com/x", 301, "/y", 2), ("http://a.com/z", 200, "/y", 2), ("http://a.com/q", 302, None, 1)], "url string, status_code int, location string, depth int")
    assert [tuple(r) for r in graph.redirect_targets(moved).collect()] == [("http://a.com/y", 3, -50)]
    parsed = spark.createDataFrame([("u", "t", "d", 9, ["a"]), ("v", "t2", "d2", 8, ["b"])], "url string, title string, meta_description string, word_count int, h1s array<string>")
    rendered = spark.createDataFrame([("u", "", "D", "one two", [], 1.5)], "url string, title string, meta_description string, body_text string, h1s array<string>, dom_loaded_seconds double")
    assert sorted(tuple(r) for r in merge.overlay_pages(parsed, rendered).collect()) == [("u", "t", "D", 2, [], 1.5), ("v", "t2", "d2", 8, ["b"], None)]
