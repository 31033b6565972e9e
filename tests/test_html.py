"""Extraction from HTML, JSON-LD and signatures."""

from pyspark.sql import functions as F

from sitelume.functions import html as H
from sitelume.functions import signatures
from sitelume.functions import text as tx

PAGE = """<!doctype html><html lang="en"><head><title> A <b>title</b> &amp; more </title>
<meta NAME="Description" content=" d1 "><meta name="description" content="d2"><meta name="robots" content="NoIndex, follow"><meta name=viewport content="w">
<link rel="Canonical" href="/no"><link rel="canonical next" href="/c1"><link rel=canonical href="/c2"><link rel="STYLESHEET" href="s.css"><link rel=alternate hreflang=de href="/de"><link hreflang="" href="/x">
<meta property="og:title" content="OG"><meta name="twitter:card" content="tw"><script type="application/ld+json">{"@type": ["A", "B"], "x": [{"@type": "C"}]}</script>
<script type="application/ld+json">{bad</script><script src="/j.js">var t="</p>"</script><style>p{}</style></head>
<body><!-- hidden --><h1>One <i>two</i></h1><h1> </h1><h2>Sub</h2><noscript>no</noscript><svg><text>no</text></svg>
<a href="/a" rel="NOFOLLOW ugc">go <b>there</b></a><a href="#x">x</a><a href="JavaScript:1">j</a><a>none</a><a href="//h.com/p">h</a>
<img src="i.png"><img data-src="l.png" alt="" width=3><img alt=x><iframe></iframe><form></form><p>It&#39;s text</p></body></html>"""


def test_parse():
    p = H.parse(PAGE, "https://a.com/dir/page")
    assert (p["title"], p["meta_description"], p["canonical"], p["robots"], p["language"], p["viewport"]) == ("A title & more", "d1", "https://a.com/c1", "NoIndex, follow", "en", "w")
    assert [(x["url"], x["anchor"], x["nofollow"], x["ugc"], x["sponsored"]) for x in p["links"]] == [("https://a.com/a", "go there", True, True, False), ("JavaScript:1", "j", False, False, False), ("https://h.com/p", "h", False, False, False)]
    assert [(x["url"], x["alt"], x["width"]) for x in p["images"]] == [("https://a.com/dir/i.png", None, None), ("https://a.com/dir/l.png", "", "3")]
    assert p["scripts"] == ["https://a.com/j.js"] and p["stylesheets"] == ["https://a.com/dir/s.css"] and p["hreflang"] == [{"lang": "de", "url": "https://a.com/de"}]
    assert p["schema_types"] == ["A", "B", "C"] and len(p["schemas"]) == 2 and p["open_graph"] == {"og:title": "OG"} and p["twitter"] == {"twitter:card": "tw"}
    assert p["headings"]["h1"] == ["One two"] and p["headings"]["h2"] == ["Sub"] and (p["iframes"], p["forms"]) == (1, 1)
    assert "It's text" in p["text"] and "hidden" not in p["text"] and "no" not in p["text"].split() and "var" not in p["text"]
    assert p["word_count"] == len(p["text"].split())


def test_parse_of_nothing_and_of_junk():
    for h in (None, "", "<", "<<<>>>", "<a href='", "<title>open", "</p></b>", "<p " * 500):
        p = H.parse(h, None)
        assert set(p) == set(H.PAGE.names)


def test_long_anchor():
    assert len(H.parse(f"<a href='/x'>{'y' * 1200}</a>", "http://a.com")["links"][0]["anchor"]) == 1000


def test_udf(spark):
    row = spark.createDataFrame([(PAGE, "https://a.com/")], "h string, u string").select(H.parse_html("h", "u").alias("p"), H.schema_types("h").alias("t"), H.unescape_html("h").alias("e")).first()
    assert row.p.canonical == "https://a.com/c1" and row.t == ["A", "B", "C"] and "&amp;" not in row.e


def test_regex_forms(spark):
    df = spark.createDataFrame([(PAGE,), (None,)], "h string")
    rows = df.select(tx.html_language("h").alias("l"), tx.words(tx.visible_text("h")).alias("w"), F.array_join(tx.html_headings("h", 1), "|").alias("h1"), F.array_join(tx.html_hrefs("h"), "|").alias("a")).collect()
    assert (rows[0].l, rows[0].h1) == ("en", "One two") and rows[0].a.startswith("/a|#x|") and rows[1].w == 0


def test_text(spark):
    df = spark.createDataFrame([(" \n a  b\t",), (None,), ("",)], "t string")
    assert [tuple(r) for r in df.select(tx.strip("t"), tx.words("t"), tx.present("t"), tx.regex_words(F.lit("don't re-use 3 x")), tx.number("t")).collect()] == [("a  b", 2, True, 4, 0), ("", 0, False, 4, 0), ("", 0, False, 4, 0)]
    assert [r[0] for r in spark.createDataFrame([(74.5,), (75.5,), (2.4,)], "x double").select(tx.banker(F.col("x"))).collect()] == [74, 76, 2]


def test_signatures(spark):
    html = "<script>gtag('x'); AW-1</script> wp-content/ /_next/ react"
    low = signatures.searched(F.col("h"), F.array(F.lit("https://clarity.ms/x")))
    t, p = signatures.hits(low, signatures.TRACKING), signatures.hits(low, signatures.PLATFORMS)
    r = spark.createDataFrame([(html,)], "h string").select(
        signatures.names(t).alias("t"), signatures.evidence(t).alias("e"), signatures.first_name(p).alias("p"), signatures.best_name(low, F.lit("wordpress"), signatures.PLATFORMS).alias("b"),
        signatures.regex_names("h", signatures.PLATFORM_PATTERNS).alias("r"), signatures.tracker_snippets("h").alias("s"),
    ).first()
    assert r.t == ["Google Ads", "Google Analytics", "Microsoft Clarity"] and r.e["Google Ads"] == ["AW-"] and r.p == "Next.js" and r.b == "WordPress"
    assert r.r == ["Next.js", "React"] and [x.name for x in r.s] == ["Google Analytics / Google tag"] and "gtag(" in r.s[0].evidence[0]
    assert spark.range(1).select(signatures.first_name(signatures.hits(F.lit(""), signatures.PLATFORMS))).first()[0] == signatures.UNKNOWN


def test_marks_equal_a_search_for_each(spark):
    """Marks that begin, end or hold one another, the empty mark, marks beyond ASCII, null texts and an empty table."""
    table = {"b": ["react", "act", "react-dom"], "a": ["REACT-DOM x", "", "é€😀"], "c": ["ct-d", "never"], "none": []}
    texts = ["react-dom x", "REACT é€😀", "ac t", "", None, "ct-dact", "x" * 50_000 + "never", "reactreact"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, h string")
    low = signatures.searched("h")
    got = {r.i: {x.name: x.evidence for x in r.f} for r in rows.select("i", signatures.hits(low, table).alias("f")).collect()}
    held = lambda t, ps: [p for p in ps if p.lower() in (t or "").lower()]
    assert got == {i: {n: held(t, ps) for n, ps in sorted(table.items()) if held(t, ps)} for i, t in enumerate(texts)}
    assert all(r.f == [] for r in rows.select(signatures.hits(low, {}).alias("f")).collect())
    two = {k: v for k, v in table.items() if k in "bc"}
    count = lambda t, ps: sum(p in (t or "").lower() or p in "never ct-d" for p in ps)
    best = {r.i: r.b for r in rows.select("i", signatures.best_name(low, F.lit("never ct-d"), two).alias("b")).collect()}
    assert best == {i: max(two, key=lambda n: count(t, two[n])) for i, t in enumerate(texts)}


def test_plain_and_other_expressions(spark):
    table = {"Generator": [r"""name=["']generator["'][^>]+wordpress""", r"wp\.json"], "Plain": [r"cdn\.shop\.com", "/_Next/"], "Digits": [r"gtm-[0-9]+"], "Neither": [r"\bzzz\b"]}
    pages = ["<meta NAME='generator' content='WordPress 6'>", "wp.json", "wpxjson", "https://CDN.shop.com/_next/", "cdnxshop.com GTM-12", "zzzz", "a zzz b", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string").coalesce(1).orderBy("i").select(signatures.regex_names("h", table)).collect()]
    assert got == [["Generator"], ["Generator"], [], ["Plain"], ["Digits"], [], ["Neither"], [], []]


def test_vendors_are_found_in_one_pass(spark):
    """Both vendor tables are one Arrow function in the plan, and no search for single marks."""
    low = signatures.searched("h")
    found = signatures.marks(low, signatures.TRACKING, signatures.PLATFORMS)
    rows = spark.createDataFrame([("gtag( wix.com",)], "h string").select(*(signatures.names(signatures.hits(low, t, found)).alias(n) for n, t in (("t", signatures.TRACKING), ("p", signatures.PLATFORMS))))
    assert tuple(rows.first()) == (["Google Analytics"], ["Wix"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Contains(" not in plan and "contains(lower" not in plan


def test_anchors():
    got = H.anchors("<a HREF='/x?a=1&amp;b=2' rel=\" UGC \">a <b>b</b>\n&lt;c</a><a name=x>n</a>", "https://a.com/")
    assert got == [{"url": "https://a.com/x?a=1&b=2", "anchor": "a b <c", "rel": "UGC"}]


def test_unescape_decodes_as_html_does(spark):
    """Against the standard library, on made-up references of all kinds."""
    import html
    import random
    from html.entities import html5

    r = random.Random(6)
    names = list(html5)
    ref = lambda: r.choice([
        "&" + r.choice(names), "&" + r.choice(names).rstrip(";"), "&" + r.choice(names).rstrip(";") + r.choice("xé 1;"), f"&#{r.choice([0, 9, 65, 128, 150, 159, 160, 233, 8364, 55296, 64976, 65534, 128512, 1114111, 1114112, 10**12])};",
        f"&#x{r.choice(['41', 'e9', 'E9', '20ac', '1F600', '0', '80', 'd800', 'fffe', '110000', 'fffffffffff'])}" + r.choice([";", "", " "]), "&", "&&", "&;", "&#", "&#x;", "&bogus;", "&amp;lt;", "&notit;", "&copy2020", "a < b", "é",
    ])
    given = ["caf&eacute; &euro;5", "", "plain", "&", "x&y", *("".join(r.choice(["", "a", " "]) + ref() for _ in range(r.randint(1, 6))) for _ in range(800))]
    got = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", tx.unescape(F.col("t")).alias("u")).orderBy("i").collect()
    assert [(g, x.u) for g, x in zip(given, got, strict=True) if x.u != html.unescape(g)] == []
    assert spark.range(1).select(tx.unescape(F.lit(None).cast("string"))).first()[0] is None


def test_anchors_of_malformed_pages():
    assert H.anchors("<a href=/u rel=nofollow>un<i>quoted</i></a><a href='/open'>never closed", "https://a.com/") == [{"url": "https://a.com/u", "anchor": "un quoted", "rel": "nofollow"}]
    assert H.anchors("<script>'<a href=\"/s\">s</a>'</script><!-- <a href='/c'>c</a> --><A HREF='/y' href='/z'>y</A>", None) == [{"url": "/y", "anchor": "y", "rel": ""}]
    assert H.anchors(None, None) == [] and H.anchors("<a href='http://[x'>x</a>", "http://a.com") == []


def test_json_ld_blocks():
    html = "<script type='application/LD+json'>{\"@type\": \"A\"}</script><script type=\"text/ld+json\">{\"@type\": \"B\"}</script><script>ld+json</script>"
    assert H.json_ld(html) == ['{"@type": "A"}'] and H.json_ld(None) == [] and H.json_ld("<script type=application/ld+json>{") == []


def test_result_pages(spark):
    bing = '<ol><li class="b_algo x"><h2><a target="_blank" href="https://x.org/a?p=1&amp;q=2">t</a></h2><a href="https://no.org/">n</a></li><li class="b_ad"><a href="https://ad.org/">a</a></li><li class=b_algo><div><a href="https://y.org/">y</a></div></li></ol>'
    assert H.result_hrefs(bing, "bing") == ["https://x.org/a?p=1&q=2", "https://y.org/"]
    assert H.result_hrefs('<a rel=nofollow class="result__a big" href="/l/?uddg=x">t</a><a class="result__ab" href="/no">n</a>', "duckduckgo") == ["/l/?uddg=x"]
    assert H.result_hrefs(None, "bing") == []
