"""Archives and capture indexes as data sources."""

import gzip
import io
import json
import random

import pyarrow as pa
import pytest

from sitelume.operators import backlinks
from sitelume.sources import archive, files, readers


def member(url, html, status=200, kind="text/html", record_type="response"):
    block = f"HTTP/1.1 {status} OK\r\nContent-Type: {kind}\r\nX: y\r\n\r\n".encode() + html
    head = f"WARC/1.0\r\nWARC-Type: {record_type}\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2024-05-06T07:08:09Z\r\nContent-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n")


@pytest.fixture(scope="module")
def archived(tmp_path_factory):
    """A folder of two files: records of all sizes, some of which hold what a member begins with, one damaged, one cut off."""
    r, folder, rows = random.Random(4), tmp_path_factory.mktemp("archive"), []
    for name, n in (("a.warc.gz", 300), ("b.warc.gz", 7)):
        with open(folder / name, "wb") as f:
            f.write(gzip.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nhello"))
            for k in range(n):
                body = r.randbytes(r.choice([0, 10, 3000, 40_000])) if k % 3 else archive.MAGIC * 20 + gzip.compress(b"WARC/1.0 no record") + "é\r\n\r\nx".encode()
                made = member(f"https://h{k % 5}.example/{name}/{k}", body, 404 if k % 7 == 0 else 200, "image/png" if k % 11 == 5 else "text/html; charset=utf-8")
                if k == 100:
                    made = made[:40] + b"\x00\xff" + made[42:]  # damaged
                else:
                    rows.append((name, f.tell(), len(made), f"https://h{k % 5}.example/{name}/{k}", 404 if k % 7 == 0 else 200, len(body), None if k % 11 == 5 else body.decode("utf-8", "replace")))
                f.write(made)
            f.write(member("https://cut.example/", r.randbytes(5000))[:-700])
    return str(folder), rows


@pytest.mark.parametrize("split", [20_000, 1 << 25])
def test_records_by_splits(spark, archived, split):
    """Every record is read once, by the split in which it begins, whatever the splits."""
    folder, rows = archived
    df = archive.records(spark, folder, split_bytes=split)
    got = df.select("filename", "offset", "length", "url", "status_code", "payload_bytes", "html")
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    assert df.rdd.getNumPartitions() == sum(-(-files.size(f"{folder}/{n}") // split) for n in ("a.warc.gz", "b.warc.gz"))


def test_types_and_statuses(spark, archived):
    folder, rows = archived
    assert archive.records(spark, folder, ["warcinfo"]).select("record_type", "url").distinct().collect() == [("warcinfo", None)]
    good = archive.records(spark, f"{folder}/a.warc.gz", statuses=[200])
    bad = archive.records(spark, f"{folder}/a.warc.gz", statuses=[404, 500])
    assert (good.count(), bad.count()) == tuple(sum(r[0] == "a.warc.gz" and r[4] == s for r in rows) for s in (200, 404))
    assert good.union(bad).count() == sum(r[0] == "a.warc.gz" for r in rows)


def test_odd_files(spark, tmp_path):
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    (tmp_path / "other.warc.gz").write_bytes(b"no archive at all" * 1000)
    (tmp_path / "lines.warc.gz").write_bytes(gzip.compress(b"WARC/ but no headers") + gzip.compress(b"WARC/1.0\r\nContent-Length: x\r\n\r\nHTTP/1.1\r\n"))
    assert [tuple(r) for r in archive.records(spark, str(tmp_path), [""]).collect()] == []
    assert archive.records(spark, str(tmp_path / "none")).isEmpty()


def test_written_records(spark, tmp_path):
    pages = spark.createDataFrame([(f"https://w{k % 3}.example/p?{k}", "<p>é" * k, k % 2 * 100 + 200 if k % 4 else None) for k in range(50)] + [("https://w.example/", None, 200)], "url string, html string, status_code int").repartition(3)
    archive.write_records(pages, f"{tmp_path}/made")
    got = archive.records(spark, f"{tmp_path}/made", split_bytes=2000)
    want = {(r.url, r.html or "", r.status_code or 200) for r in pages.collect()}
    assert {(r.url, r.html, r.status_code) for r in got.collect()} == want and got.count() == 51
    content = archive.content_at(got.select("url", "filename", "offset", "length"), f"{tmp_path}/made")
    assert {(r.url, r.html.removesuffix("\r\n\r\n")) for r in readers.warc_html(content).collect()} == {w[:2] for w in want}
    assert archive.content_at(got.selectExpr("'none' filename", "offset", "length"), f"{tmp_path}/made").first().content is None


def keyed(n):
    return sorted((f"com,d{k % 40:02d})/p{k}", f"2024{k % 12 + 1:02d}01", k) for k in range(n))


@pytest.fixture(scope="module")
def index(tmp_path_factory):
    """A plain index as archives publish it: one table, two files of blocks, with lines that don't parse."""
    folder, rows, table = tmp_path_factory.mktemp("index"), keyed(2000), []
    for name, part in (("cdx-0.gz", rows[:1300]), ("cdx-1.gz", rows[1300:])):
        out = io.BytesIO()
        for at in range(0, len(part), 37):
            lines = [f"{key} {stamp} " + json.dumps({"url": f"https://x/{k}", "status": "404" if k % 5 == 0 else "200", "filename": "f.gz", "offset": str(k), "length": "9"}) for key, stamp, k in part[at : at + 37]]
            block = gzip.compress("\n".join([*lines, "broken", f"{part[at][0]} 1 {{", ""]).encode())
            table.append(f"{' '.join(part[at][:2])}\t{name}\t{out.tell()}\t{len(block)}\t{len(table) + 1}")
            out.write(block)
        (folder / name).write_bytes(out.getvalue())
    (folder / "cluster.idx").write_text("\n".join(table) + "\n")
    return str(folder), rows


def test_captures(spark, index, monkeypatch):
    folder, rows = index
    whole = archive.captures(spark, folder, index_bytes=500)
    assert whole.rdd.getNumPartitions() > 3
    assert sorted((r.urlkey, r.timestamp, r.offset) for r in whole.collect()) == rows
    for d in (0, 1, 17, 39):
        one = archive.captures(spark, folder, f"www.d{d:02d}.com", [200], index_bytes=500)
        assert sorted((r.urlkey, r.timestamp, r.offset) for r in one.collect()) == [r for r in rows if r[0].startswith(f"com,d{d:02d})/") and r[2] % 5]
        assert one.rdd.getNumPartitions() == 1
    read = []
    reader = archive._Captures({"path": folder, "prefix": archive.domain_prefix("d17.com")})
    monkeypatch.setattr(archive.files, "read", lambda path, *a, real=files.read: read.append(path) or real(path, *a))
    for part in reader.partitions():
        list(reader.read(part))
    assert 2 <= len(read) <= 4  # of 55 blocks those that can have the domain's 50 keys
    assert archive.captures(spark, folder, "nowhere.org").isEmpty() and archive.captures(spark, folder, "aaa.aero").isEmpty()
    assert sorted(r.offset for r in archive.captures(spark, folder, statuses=[404]).collect()) == list(range(0, 2000, 5))


def test_places_in_sorted_lines():
    r = random.Random(8)
    for _ in range(60):
        lines = sorted({bytes(r.choices(b"abc", k=r.randint(1, 6))) for _ in range(r.randint(0, 30))})
        source = pa.BufferReader(b"".join(x + b"\n" for x in lines))
        starts = [sum(len(x) + 1 for x in lines[:k]) for k in range(len(lines) + 1)]
        for key in (b"", b"a", b"b", b"bb", b"cac", b"d"):
            k = sum(x < key for x in lines)
            assert archive.place_of(source, key) == starts[k]
            assert archive._line_before(source, starts[k]) == starts[max(0, k - 1)]


def test_written_index(spark, archived, tmp_path):
    """An archive, its index, a domain's first captures in two crawls, and their records."""
    folder, rows = archived
    found = archive.records(spark, folder)
    for k in range(2):
        archive.write_index(found.filter(f"offset % 3 <> {k}"), f"{tmp_path}/{k}", lines=10)
    got = archive.domain_captures(spark, [f"{tmp_path}/0", f"{tmp_path}/1"], "h2.example", 4).collect()
    for k in range(2):
        want = sorted(f"example,h2)/{r[3].split('/', 3)[3]}" for r in rows if "//h2." in r[3] and r[4] == 200 and r[1] % 3 != k)[:4]
        assert [r.urlkey for r in sorted(got, key=lambda r: r.row_no) if r.crawl_no == k] == want
    assert archive.captures(spark, f"{tmp_path}/0").count() == sum(r[1] % 3 != 0 for r in rows)


def test_history_from_index_and_archive(spark, tmp_path):
    """The first archived page of a domain that links to the target, from local files alone."""
    pages = [(f"https://s.example/{k}", f'<a href="https://{"target" if k in (5, 7) else "other"}.example/{k}">x</a>') for k in range(9)]
    archive.write_records(spark.createDataFrame(pages, "url string, html string"), f"{tmp_path}/data")
    archive.write_index(archive.records(spark, f"{tmp_path}/data"), f"{tmp_path}/index")
    captured = archive.domain_captures(spark, [f"{tmp_path}/index"], "s.example", 100)
    html = readers.warc_html(archive.content_at(captured.select("url", "filename", "offset", "length"), f"{tmp_path}/data"))
    rows = captured.join(html, "url").selectExpr("'s.example' domain", "crawl_no", "row_no", "url", "html")
    r = backlinks.historical_first_hits(rows, "target.example").first()
    assert (r.status, r.pages_available, r.url, r.href) == ("confirmed_historical", 9, "https://s.example/5", "https://target.example/5")


def test_keys(spark):
    asked = ["https://www.Example.com/A/b?C=1#f", "http://x.y.co.uk:8080", "https://a.b?q"]
    got = [r[0] for r in spark.createDataFrame([(k, u) for k, u in enumerate(asked)], "k int, u string").orderBy("k").select(archive.urlkey("u")).collect()]
    assert got == ["com,example)/a/b?c=1", "uk,co,y,x)/", "b,a)/?q"]
    assert archive.domain_prefix(" WWW.Example.com. ") == "com,example)/"
