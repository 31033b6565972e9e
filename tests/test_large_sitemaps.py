"""Sitemaps of any size, gzipped or not, in bounded memory."""

import gzip
import tracemalloc

from sitelume.sources import readers


def urlset(n):
    return b'<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' + b"".join(b"<url><loc> https://a.example/%d?x=1&amp;y=2 </loc><lastmod>2024-01-01</lastmod><news:loc xmlns:news='n'></news:loc></url>\n" % k for k in range(n)) + b"</urlset>"


def test_a_large_one_takes_little_memory():
    """50 MB of XML, a few MB of gzip: locations come in batches, and what is held besides the bytes themselves is bounded."""
    content = gzip.compress(urlset(430_000), 1)
    tracemalloc.start()
    n = last = 0
    for kind, locs in readers.sitemap_batches(content):
        assert kind == "urlset" and len(locs) < readers._ROWS + 2000
        n, last = n + len(locs), locs[-1] if locs else last
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 430_000 and last == "https://a.example/429999?x=1&y=2" and peak < 16 << 20


def test_odd_documents():
    for bad in (None, "", b"", "no xml", urlset(3)[:-3], gzip.compress(urlset(50_000))[:-50], b"\x1f\x8b broken", b'<!DOCTYPE x [<!ENTITY a "aaaa">]><urlset><url><loc>&a;</loc></url></urlset>', urlset(30_000) + b"<x>"):
        assert readers.sitemap_entries(bad) == ("", [])
    assert readers.sitemap_entries("  <html><url><loc>x</loc></url></html> ") == ("", [])
    assert readers.sitemap_entries("<SitemapIndex><sitemap><loc>\n a </loc></sitemap><sitemap><loc/></sitemap><url><loc>b</loc></url><sitemap><x><loc>c</loc></x></sitemap></SitemapIndex>") == ("index", ["a"])
    assert readers.sitemap_entries("<urlset><url><loc>a<b>c</b>d</loc></url><url><loc><![CDATA[e&f]]></loc></url></urlset>") == ("urlset", ["a", "e&f"])


def test_gzipped_files_in_a_frame(spark):
    rows = [("https://s/1.xml.gz", 200, gzip.compress(urlset(25_000))), ("https://s/2.xml", 200, urlset(2)), ("https://s/3.xml", 404, urlset(2)), ("https://s/4.xml", 200, None)]
    found = readers.sitemap_locations(spark.createDataFrame(rows, "url string, status_code int, xml binary"))
    assert {(r.sitemap_url, r.n, r.last) for r in found.groupBy("sitemap_url").agg({"loc": "count", "pos": "max"}).toDF("sitemap_url", "n", "last").collect()} == {("https://s/1.xml.gz", 25_000, 24_999), ("https://s/2.xml", 2, 1)}


def test_small_sitemaps_share_batches(monkeypatch):
    """Many small files come out as few frames, each with its own positions; a sound document of one batch is read once."""
    from types import SimpleNamespace

    from sitelume.sources import readers

    built, begun = [], []
    frame, pulled = readers.pd.DataFrame, readers._Locations
    monkeypatch.setattr(readers, "pd", SimpleNamespace(DataFrame=lambda *a, **k: built.append(1) or frame(*a, **k)))
    monkeypatch.setattr(readers, "_Locations", lambda: begun.append(1) or pulled())
    files = frame({"url": [f"s{k}" for k in range(500)], "xml": [f"<urlset><url><loc>a{k}</loc></url><url><loc>b</loc></url></urlset>" if k % 2 else "Sitemap: x" for k in range(500)]})

    class Files:
        filter = select = lambda self, *a: self

        def mapInPandas(self, f, schema):
            return [r for d in f(iter([files])) for r in d.itertuples(index=False, name=None)]

    got = readers.sitemap_locations(Files())
    assert got == [(f"s{k}", "urlset", pos, loc) for k in range(1, 500, 2) for pos, loc in enumerate([f"a{k}", "b"])]
    assert len(built) == 1 and len(begun) == 500
