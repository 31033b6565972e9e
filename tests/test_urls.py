"""URL functions: a table of normal forms, and Columns against the exact forms on random URLs."""

import random

import pytest
from pyspark.sql import functions as F

from sitelume.functions import urls

FORMS = [
    ("http://a.com", "http://a.com/"), ("HTTP://A.Com:80/", "http://a.com/"), ("https://a.com:443/x/", "https://a.com/x"), ("https://a.com:8080/x", "https://a.com:8080/x"),
    ("http://a.com:0/x", "http://a.com/x"), ("http://u:p@a.com/x", "http://a.com/x"), ("http://a.com//x///y//", "http://a.com/x/y"), ("http://a.com/x;p=1", "http://a.com/x"),
    ("http://a.com/?b=&a=1", "http://a.com/?a=1&b="), ("http://a.com/?a=2&a=1", "http://a.com/?a=1&a=2"), ("http://a.com/?UTM_Source=x&q=1&GCLID=2", "http://a.com/?q=1"),
    ("http://a.com/a+b?q=a+b", "http://a.com/a+b?q=a+b"), ("http://a.com/a%20b?q=a%20b", "http://a.com/a b?q=a+b"), ("http://a.com/a%2Fb", "http://a.com/a/b"), ("http://a.com/%zz", "http://a.com/%zz"),
    ("http://a.com/x#f", "http://a.com/x"), ("mailto:x@a.com", ""), ("ftp://a.com/", ""), ("", ""), (None, ""), ("  http://a.com/x  ", "http://a.com/x"), ("http:///x", ""),
    ("http://a.com/?q=~*-._", "http://a.com/?q=~%2A-._"), ("http://a.com/é?ü=ß", "http://a.com/é?%C3%BC=%C3%9F"), ("http://a.com?x=1", "http://a.com/?x=1"), ("http://a.com/?b", "http://a.com/?b="),
    ("http://a.com/?a=1&&b=2&", "http://a.com/?a=1&b=2"), ("//a.com/x", ""), ("/x", ""), ("http://a.com/x?utm_source=feed", "http://a.com/x"), ("https://a.com/p?page=2&ref=x#top", "https://a.com/p?page=2&ref=x"),
]


def values(spark, column, rows, names="u"):
    schema = ", ".join(f"{n} string" for n in names.split())
    return [r[0] for r in spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + schema).select(column.alias("x"), "i").orderBy("i").collect()]


def test_normal_forms(spark):
    given = [g for g, _ in FORMS]
    want = [w for _, w in FORMS]
    assert [urls.normal_form(g) for g in given] == want
    assert values(spark, urls.normalize("u"), given) == want
    assert values(spark, urls.normalize_exact("u"), given) == want


def test_bad_urls_have_no_normal_form():
    assert [urls.normal_form(u) for u in ("http://h:99999/", "http://[bad/", "http://a.com:x/")] == ["", "", ""]


def random_url(r):
    piece = lambda n: "".join(r.choice("abzA Z09._~-") for _ in range(r.randint(0, n))).strip()
    host = r.choice(["a.com", "WWW.b.Org", "x.y.z", "u@a.com", "a.com:80", "a.com:443", "a.com:81"])
    path = "".join("/" * r.randint(1, 2) + r.choice([piece(4), "%20", "a+b", "%2F", "x;p", ""]) for _ in range(r.randint(0, 4)))
    query = "&".join(r.choice(["a", "b", "utm_term", "GCLID", "é"]) + r.choice(["", "=", "=" + piece(3), "=a%20b", "=a+b", "=a=b"]) for _ in range(r.randint(0, 4)))
    return r.choice(["http", "https", "HTTP", "ftp"]) + "://" + host + path + ("?" + query if r.random() < 0.6 else "") + r.choice(["", "#f", "#"])


def test_columns_are_the_exact_forms(spark):
    r = random.Random(11)
    given = [random_url(r) for _ in range(800)]
    assert values(spark, urls.normalize("u"), given) == [urls.normal_form(u) for u in given]


def test_resolve(spark):
    base = ["http://a.com/b/c/d?q#f", "https://a.com", "http://a.com/x/"]
    refs = ["", "g", "./g", "g/", "/g", "//h.com/x", "?y", "#s", "../g", "../../g", "../../../g", "g;x=1/../y", ".", "..", "../", "http://z.com/", "mailto:a@b", "g?y#s", "/./g/../h", "a/./b"]
    pairs = [(b, x) for b in base for x in refs]
    got = values(spark, urls.resolve("b", "r"), pairs, "b r")
    exact = values(spark, urls.resolve_exact("b", "r"), pairs, "b r")
    assert [p for p, g, e in zip(pairs, got, exact, strict=True) if g != e] == []


@pytest.mark.parametrize("column,given,want", [
    (urls.bare_domain, "https://www.Example.com/a", "example.com"), (urls.bare_domain, "example.com", ""), (urls.domain_of, "Example.com.", "example.com"), (urls.text_host, "WWW.a.com:80/x", "a.com"),
    (urls.reverse_domain, "example.com", "com.example"), (urls.reverse_domain, "a..b.", "b.a"), (urls.origin, "https://a.com:1/x", "https://a.com:1"), (urls.host, "http://U@A.com:9/", "a.com"),
    (urls.registered_domain, "http://x.y.co.uk/", "y.co.uk"), (urls.registered_domain, "http://x.y.com/", "y.com"), (urls.registered_domain, "http://localhost/", "localhost"), (urls.without_fragment, "a#b#c", "a"),
    (urls.canonical_or_self, "tel:1", "tel:1"),
])
def test_parts(spark, column, given, want):
    assert values(spark, column("u"), [given]) == [want]


def test_predicates(spark):
    rows = [("https://shop.a.com/", "a.com"), ("https://www.a.com/", "https://a.com"), ("https://nota.com/", "a.com"), ("a.com", "a.com")]
    assert values(spark, urls.is_target("u", "t"), rows, "u t") == [True, True, False, True]
    assert values(spark, urls.is_relative("u"), ["/x", "x", " HTTP://a", "//a", "mailto:x"]) == [True, True, False, False, True]
    assert values(spark, urls.skipped("u"), ["", "#a", "javascript:x", "JavaScript:x", "data:1", "/a", None]) == [True, True, True, False, True, False, True]
    assert values(spark, urls.same_host("u", "t"), [("http://A.com/", "https://a.com:9/"), ("x", "y")], "u t") == [True, True]
    assert values(spark, urls.same_domain("u", "t"), [("http://www.a.com", "http://a.com"), ("x", "y")], "u t") == [True, False]
    assert values(spark, urls.same_registered_domain("u", F.lit("http://z.b.co.uk")), ["http://a.b.co.uk/", "http://b.uk"]) == [True, False]
    assert values(spark, F.array_join(urls.host_suffixes("u"), ","), ["http://a.b.c/"]) == ["a.b.c,b.c,c"]
    assert values(spark, F.array_join(urls.origins("u"), ","), ["a.b"]) == ["https://a.b/,http://a.b/"]


def test_suffix_list(spark):
    rules = urls.SuffixList(iter("// comment\ncom\nuk\nco.uk\n*.ck\n!www.ck\nblogspot.com\nкорм\nsg\ncom.sg\na.b.c.sg\n\n".splitlines()))
    want = {
        "x.y.com": "y.com", "y.com": "y.com", "com": "com", "a.b.co.uk": "b.co.uk", "co.uk": "co.uk", "a.b.ck": "a.b.ck", "x.a.b.ck": "a.b.ck", "b.ck": "b.ck", "www.ck": "www.ck", "x.www.ck": "www.ck", "me.blogspot.com": "me.blogspot.com",
        "x.me.blogspot.com": "me.blogspot.com", "a.com.sg": "a.com.sg", "w.a.b.c.sg": "w.a.b.c.sg", "z.w.a.b.c.sg": "w.a.b.c.sg", "x.unknown.zz": "unknown.zz", "localhost": "localhost", "": "", "10.0.0.1": "10.0.0.1", "X.Y.COM.": "y.com",
    }
    assert {h: rules.registered(h) for h in want} == want
    column = lambda u: urls.registered_domain_of(u, rules)
    assert values(spark, column("u"), ["http://w.a.com.sg:80/x", "https://b.com.sg/", "nothing", None]) == ["a.com.sg", "b.com.sg", "", ""]
    assert values(spark, urls.same_registered_domain("u", "t", rules), [("http://a.com.sg/", "http://b.com.sg/"), ("http://x.a.com.sg/", "http://y.a.com.sg")], "u t") == [False, True]


def test_suffix_file(tmp_path):
    (tmp_path / "list.dat").write_text("// x\ncom\nco.jp\n", encoding="utf-8")
    assert urls.suffix_list(str(tmp_path / "list.dat")).registered("a.b.co.jp") == "b.co.jp"


def test_shortcuts_of_the_normal_form(spark):
    """URLs that are told by one match, and those that are not, have the form that the library gives."""
    given = ["https://a.example/", "https://a.example/#x", "http://a.example/1#x y", "http://a.example/1 #x", "http://a.example/1/#x", "https://a.example#x", "https://a.example", "mailto:a@b.example", "#x", "", "HTTP://A.example/#", "ftp://a.example/x#y", "https://a.example//#x"]
    got = spark.createDataFrame([(u,) for u in given], "u string").select("u", urls.normalize("u").alias("n"), urls.canonical_or_self("u").alias("c")).collect()
    assert [(r.n, r.c) for r in got] == [(urls.normal_form(r.u), urls.normal_form(r.u) or r.u) for r in got]


def test_corpora_are_joined_without_broadcasts(spark):
    """The sides of an investigation grow with its corpus, however few bytes a plan takes them for."""
    from sitelume.operators import backlinks, graph, investigation

    pages = spark.createDataFrame([("https://a.example/", "a.example", 200, "text/html")], "url string, domain string, status_code int, content_type string")
    links = spark.createDataFrame([("https://a.example/", "https://t.example/", "x", "")], "source_url string, url string, anchor string, rel string")
    out = [f(pages, links, pages.select("domain"), "https://t.example/") for f in (backlinks.investigate, investigation.exhaustive, investigation.trace)]
    assert all("Broadcast" not in df._jdf.queryExecution().sparkPlan().toString() for df in out)
    assert out[0].first().status == out[1].first().status == "confirmed"
    with graph.Rounds(spark) as rounds:
        assert rounds.own.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
