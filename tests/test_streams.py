"""The rate for each host and the streaming frontier."""

import random
import time

import pytest

from sitelume.operators import graph
from sitelume.streaming import frontier, politeness


def written(spark, rows, schema, folder, cuts):
    """rows as files, one for each cut, in the order of their names and times."""
    import os

    for k, (a, z) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:z], schema).coalesce(1).write.mode("append").parquet(f"{folder}/.{k}")
        part = next(f for f in os.listdir(f"{folder}/.{k}") if f.endswith(".parquet"))
        os.rename(f"{folder}/.{k}/{part}", f"{folder}/{k:03d}.parquet")
        os.utime(f"{folder}/{k:03d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))


def test_a_rate_for_each_host(spark, tmp_path):
    """Hosts of different delays in several files and partitions: no host is asked sooner than it may be, none waits for another, and a restart goes on."""
    (tmp_path / "in").mkdir()
    delays = {"a": None, "b": 0.4, "c": 1.5}
    rows = [(h, f"https://{h}/{k}", delays[h]) for k in range(8) for h in ("a", "b", "c") if k < 3 or h != "c"] + [(None, "x", None), ("d", None, None)]
    written(spark, rows, "host string, url string, crawl_delay double", tmp_path / "in", [5, 6, 13])
    asked = spark.readStream.schema("host string, url string, crawl_delay double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).repartition(4)

    def run(until):
        q = politeness.paced(asked, interval=0.2).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(processingTime="100 milliseconds").start()
        end = time.time() + 90
        while time.time() < end and q.isActive and sum(1 for _ in done()) < until:
            time.sleep(0.3)
        assert q.exception() is None
        q.stop()

    def done():
        try:
            return spark.read.schema("host string, url string, due timestamp, waited_ms long").parquet(f"{tmp_path}/out").collect()
        except Exception:  # no file yet
            return []

    run(6)
    first = len(done())
    run(19)
    got = done()
    assert len(got) == 19 == len({r.url for r in got}) and first < 19
    for host, delay in delays.items():
        due = sorted((r.due.timestamp(), r.waited_ms) for r in got if r.host == host)
        assert all(b[0] - a[0] >= max(delay or 0, 0.2) - 0.0011 for a, b in zip(due, due[1:])), host


def test_lookahead_gives_times_ahead(spark, tmp_path):
    (tmp_path / "in").mkdir()
    written(spark, [("h", f"u{k}") for k in range(10)], "host string, url string", tmp_path / "in", [])
    asked = spark.readStream.schema("host string, url string").parquet(str(tmp_path / "in"))
    q = politeness.paced(asked, interval=2.0, lookahead=7.0).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(processingTime="1 second").start()
    end, due = time.time() + 60, []
    while time.time() < end and len(due) < 4:
        time.sleep(0.5)
        if (tmp_path / "out" / "_spark_metadata").exists():
            due = sorted(r.due.timestamp() for r in spark.read.schema(politeness.PACED).parquet(f"{tmp_path}/out").collect())
    q.stop()
    assert len(due) >= 4 and all(b - a >= 1.998 for a, b in zip(due, due[1:])) and abs(due[3] - due[0] - 6) < 0.002  # four of the first batch


def test_fetching_waits_for_its_time(spark):
    at = time.time()
    due = spark.createDataFrame([("h", "https://h/1", at + 1.0), ("h", "https://h/0", at)], "host string, url string, due double").selectExpr("host", "url", "timestamp_seconds(due) due")
    got = politeness.fetched(due, opener=lambda url, options: (200, url, {"content-type": "text/html", "at": str(time.time())}, b"x")).collect()
    asked = {r.url: float(r.headers["at"]) for r in got}
    assert len(got) == 2 and asked["https://h/1"] >= at + 1.0


START = "https://www.s.example/"


def crawl_links(n=400, seed=1):
    r = random.Random(seed)
    make = lambda: r.choice([f"https://www.s.example/p{r.randrange(60)}", f"https://www.s.example/q{r.randrange(60)}?utm_source=x#f", f"https://other.example/{r.randrange(9)}", "", "mailto:x", f"https://www.s.example/private/{r.randrange(20)}", START])
    return [(make(), r.randrange(5), k) for k in range(n)]


def robots(asked):
    return asked.selectExpr("url", "not contains(url, '/private/1') allowed")


@pytest.mark.parametrize("cuts,remember,max_pages", [([50, 51, 200], 3600, 1000), ([100, 200], 0.001, 1000), ([30], 3600, 40)])
def test_frontier_equals_the_batch_form(spark, tmp_path, cuts, remember, max_pages):
    """Whatever the batches, also when the state forgets at once, the stream adds what one batch over all links does."""
    rows = crawl_links()
    (tmp_path / "in").mkdir()
    written(spark, rows, frontier.LINK, tmp_path / "in", cuts)
    links = spark.createDataFrame(rows, frontier.LINK)
    seen = spark.createDataFrame([(START,)], "url string")
    allowed = robots(links.selectExpr("target_url url").distinct()).filter("not allowed")
    want = graph.admitted_children(links, seen, START, 4, max_pages, allowed)
    stream = spark.readStream.schema(frontier.LINK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = f"{tmp_path}/table"
    frontier.frontier(stream, path, f"{tmp_path}/cp", START, 4, max_pages, robots, remember).awaitTermination(60)
    got = frontier.stored(spark, path)
    assert got.count() == min(max_pages, want.count() + 1) and got.filter("depth = 0").first().url == START
    assert sorted((r.url, r.depth, r.seq) for r in got.filter("depth > 0").collect()) == sorted((r.url, r.depth, r.seq) for r in want.collect())
    assert {r.priority for r in got.filter("depth = 0").collect()} == {-100}


def test_a_batch_that_runs_twice(spark, tmp_path):
    batch = lambda urls: spark.createDataFrame([(u, 1, k) for k, u in enumerate(urls)], "url string, depth int, seq long")
    path = f"{tmp_path}/table"
    frontier.admit(batch("abc"), 0, path, 5)
    for _ in range(2):
        frontier.admit(batch("bcdef"), 1, path, 5)
    assert sorted((r.url, r.batch) for r in frontier.stored(spark, path).collect()) == [("a", 0), ("b", 0), ("c", 0), ("d", 1), ("e", 1)]
    frontier.admit(batch("xyz"), 2, path, 5)
    assert frontier.stored(spark, path).count() == 5 and frontier.stored(spark, f"{tmp_path}/none").isEmpty()
