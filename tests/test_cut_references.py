"""Queries over pages against their SQL where titles end within a reference and where pages share an URL."""

import os

import duckdb
import pytest

from sitelume.plans import adapters, catalogue

AT = "/root/testdata/sf0.001"
TITLES = ["Plain & more", "Cut &amp", "Cut &", "Cut &am", "Half &quo", "A &amp;&amp;&amp", "A &&&", "Words&nbsp", "&copy 2020 &copy; x", "t" * 58 + "&amp", "t" * 28 + "&amp", "&lt&gt;"]
NAMES = (
    "html_metadata html_headings html_parse html_fields ranked_pages overlaid_pages historical_first_hit audit_findings audit_page_scores audit_summary "
    "legacy_audit legacy_categories legacy_health pipeline_issues text_word_count"
).split()


@pytest.fixture(scope="module")
def at(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pages"))
    rows = [(k, f"https://s{k % 5}.example.org/{k % 7}", f"<html lang='en'><head><title>{t}</title></head><body><h1>{t}</h1><p>a&amp b {t}</p></body></html>") for k in range(60) for t in [TITLES[k % len(TITLES)]]]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{at}/pages.parquet")
    for f in os.listdir(AT):
        if f != "pages.parquet":
            os.symlink(f"{AT}/{f}", f"{at}/{f}")
    return at


@pytest.mark.parametrize("name", NAMES)
def test_against_oracle(spark, at, name):
    c = duckdb.connect()
    for t in ("pages", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet{'/*.parquet' if t == 'pages' else ''}')")
    df = catalogue.QUERIES[name](spark, at)
    res = c.execute(catalogue.ORACLE[name])
    names = [d[0] for d in res.description]
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    assert sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr) == sorted((tuple(map(plain, r)) for r in res.fetchall()), key=repr)


def test_only_references_with_a_semicolon(spark):
    got = spark.createDataFrame([("a &amp; &#39; &#x27; &eacute; & &amp &#39 &#x &; &&lt;",)], "h string").select(adapters.terminated("h")).first()[0]
    assert got == "a &amp; &#39; &#x27; &eacute; &amp; &amp;amp &amp;#39 &amp;#x &amp;; &amp;&lt;"


def test_history_sees_urls_domain_by_domain(spark):
    from sitelume.operators import backlinks

    rows = [(d, 0, k, "https://s.example/", '<a href="https://target.example/x">') for k, d in enumerate(("a", "b", "b"))]
    found = backlinks.historical_first_hits(spark.createDataFrame(rows, "domain string, crawl_no int, row_no int, url string, html string"), "target.example").collect()
    assert sorted((r.domain, r.status, r.pages_available, r.row_no) for r in found) == [("a", "confirmed_historical", 1, 0), ("b", "confirmed_historical", 1, 1)]
