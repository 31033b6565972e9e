"""Exports and upserts that tasks write; limits of a fetched body."""

import http.server
import json
import os
import threading
from pathlib import Path

import pytest

from sitelume.sources import fetch, sinks


def crawl(spark, n):
    pages = spark.range(n).selectExpr("concat('https://a/', id, '?\"é\\n') url", "if(id % 3 = 0, null, id) status", "array(named_struct('k', id, 'x', 'y')) found").repartition(5)
    links = spark.range(2 * n).selectExpr("concat('s', id) source_url", "id % 2 = 0 nofollow")
    issues = spark.range(n).selectExpr("concat('u\"', id % 7, 'ü') url", "if(id % 2 = 0, 'high', 'low') severity")
    return pages, links, issues


@pytest.mark.parametrize("n", [0, 1, 300])
def test_document_is_the_same_by_tasks(spark, tmp_path, n):
    frames = [spark.createDataFrame(df.collect(), df.schema).repartition(3 + k) for k, df in enumerate(crawl(spark, n))]
    site = {"name": "é", "list": [1, {"a": None}], "empty": {}}
    sinks.export_nested(spark, f"{tmp_path}/driver.json", 7, "https://a/", site, *frames)
    sinks.export_document(spark, f"{tmp_path}/tasks.json", 7, "https://a/", site, *frames)
    sinks.export_document(spark, f"{tmp_path}/tasks.json", 7, "https://a/", site, *frames)
    assert Path(f"{tmp_path}/tasks.json").read_bytes() == Path(f"{tmp_path}/driver.json").read_bytes()
    assert [f for f in os.listdir(tmp_path) if "tasks" in f] == ["tasks.json"] and len(json.loads(Path(f"{tmp_path}/tasks.json").read_text())["links"]) == 2 * n


def test_only_the_tasks_that_count_are_joined(tmp_path):
    w = sinks._DocumentWriter({"path": f"{tmp_path}/d.json", "head": '"crawl_id": 1', "sections": "pages,links"})
    made = {}
    for name, text in (("a", "\n    1,\n    2"), ("lost", "\n    9"), ("b", "\n    3"), ("c", "\n    4")):
        Path(f"{tmp_path}/d.json.parts").mkdir(exist_ok=True)
        made[name] = f"{tmp_path}/d.json.parts/{name}"
        Path(made[name]).write_text(text)
    w.commit([sinks._Item(2, {0: (1, made["b"])}), None, sinks._Item(0, {0: (2, made["a"]), 1: (1, made["c"])}), sinks._Item(1, {})])
    assert json.loads(Path(f"{tmp_path}/d.json").read_text()) == {"crawl_id": 1, "pages": [1, 2, 3], "links": [4]} and os.listdir(tmp_path) == ["d.json"]


def folders(table):
    return {str(d): sorted(f.name for f in d.glob("*.parquet")) for d in Path(table).glob("crawl_id=*/bucket=*")}


def test_upsert_rewrites_touched_folders_only(spark, tmp_path):
    table = f"{tmp_path}/pages"
    rows = spark.range(200).selectExpr("1L crawl_id", "concat('u', id) url", "cast(id as string) title")
    assert sinks.upsert(rows, table, 0, buckets=16) == 1
    before = folders(table)
    new = spark.createDataFrame([(1, "u7", "new"), (1, "u7", "newer"), (2, "u7", "other crawl")], "crawl_id long, url string, title string").coalesce(1)
    assert sinks.upsert(new, table, 1, buckets=16) == 2
    after = folders(table)
    assert len(before) == 16 and sum(before[k] != after[k] for k in before) == 1 and len(after) == 17
    got = {(r.crawl_id, r.url): r.title for r in spark.read.parquet(table).collect()}
    assert got == {(1, f"u{k}"): "newer" if k == 7 else str(k) for k in range(200)} | {(2, "u7"): "other crawl"}


def test_a_second_writer_fails(spark, tmp_path):
    table = f"{tmp_path}/pages"
    row = lambda t: spark.createDataFrame([(1, "u", t)], "crawl_id long, url string, title string")
    sinks.upsert(row("a"), table)
    seen = sinks.version(spark, table)
    sinks.upsert(row("b"), table, seen)
    with pytest.raises(sinks.StaleTable):
        sinks.upsert(row("c"), table, seen)
    Path(f"{table}/_versions/{3:012d}.begun").touch()  # one that has begun and never ended
    with pytest.raises(sinks.StaleTable):
        sinks.upsert(row("d"), table)
    assert [r.title for r in spark.read.parquet(table).collect()] == ["b"]
    assert sinks.upsert(row("e"), table, again=True) == 3 and sinks.upsert(row("f"), table) == 4
    assert [r.title for r in spark.read.parquet(table).collect()] == ["f"]


@pytest.fixture
def server():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(302 if self.path == "/moved" else 200)
            self.send_header("Location", "/big")
            self.send_header("Content-Type", "image/png" if self.path == "/image" else "text/html")
            self.end_headers()
            self.wfile.write(b"x" * 5000)

        def log_message(self, *a):
            pass

    s = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_redirects_and_limits(server):
    get = lambda path, **o: fetch.open_url(server + path, fetch.FetchOptions.of({k: str(v) for k, v in o.items()}))
    assert get("/moved")[:2] == (200, server + "/big") and get("/moved", follow_redirects=False)[:2] == (302, server + "/moved")
    assert len(get("/big", max_body_bytes=100)[3]) == 100 and len(get("/big")[3]) == 5000
    assert get("/image", textual_only=True)[3] == b"" and len(get("/image")[3]) == 5000
