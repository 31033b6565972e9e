"""The domain graph's own file: the format, the source's pushdown and partitions, and its writer."""

import gzip
import random

import pytest

from sitelume.operators import backlinks
from sitelume.sources import files, webgraph

SHAPES = [{}, {"window": 0}, {"least_interval": 0}, {"references": 100, "window": 16}, {"zeta": 1}, {"zeta": 5, "references": 1}]


def neighbours(n, seed=1):
    """Lists with common parts, intervals and strays; some nodes have none."""
    r, out = random.Random(seed), []
    for _ in range(n):
        own = {y for y in out[-r.randint(1, min(len(out), 8))] if r.random() < 0.8} if out and r.random() < 0.6 else set()
        if r.random() < 0.5:
            start = r.randrange(n)
            own.update(range(start, min(n, start + r.randint(1, 20))))
        own.update(r.randrange(n) for _ in range(r.randint(0, 5)))
        out.append([] if r.random() < 0.1 else sorted(own))
    return out


def plain(path, lists, offsets=True, **shape):
    """A graph in the plain format, made record by record."""
    s, bits, lengths, recent = webgraph.Shape(len(lists), **shape), webgraph.Written(), webgraph.Written(), {}
    lengths.gamma(0)
    for x, own in enumerate(lists):
        made, chain = webgraph.record(s, x, own, recent)
        recent[x] = own, chain
        recent.pop(x - s.window, None)
        bits.parts += made.parts
        lengths.gamma(made.length)
    files.write(path + ".graph", bits.bytes())
    files.write(path + ".properties", s.write(sum(map(len, lists))).encode())
    if offsets:
        files.write(path + ".offsets", lengths.bytes())


def arcs(df):
    return sorted(map(tuple, df.collect()))


def test_published_example():
    """The example of the format's description: nodes 15, 16 and 18 by the numbers of its tables, and by our own records."""
    n15, n16, n18 = [13, 15, 16, 17, 18, 19, 23, 24, 203, 315, 1034], [15, 16, 17, 22, 23, 24, 315, 316, 317, 3041], [13, 15, 16, 17, 50]
    lists = {15: n15, 16: n16, 17: [], 18: n18}
    s = webgraph.Shape(20_000, window=7, references=3, least_interval=2)

    def bits(w):
        return webgraph.Bits(w.bytes(), 0, 0)

    def written(degree, reference, blocks, intervals, residuals):
        w = webgraph.Written()
        w.gamma(degree)
        w.unary(reference)
        for x in [*([len(blocks), *blocks] if reference else []), len(intervals) // 2, *intervals]:
            w.gamma(x)
        for x in residuals:
            w.zeta(x, 3)
        return w

    published = {15: (11, 0, [], [0, 3, 2, 0], [3, 189, 111, 718]), 16: (10, 1, [0, 0, 2, 1, 1, 0, 0], [600, 0], [12, 3018]), 18: (5, 3, [4], [], [64])}
    for x, numbers in published.items():
        assert webgraph.Decoder(s).record(bits(written(*numbers)), x, lists.__getitem__) == lists[x]
        made, _ = webgraph.record(s, x, lists[x], {y: (own, 0) for y, own in lists.items() if y < x})
        assert made.length <= written(*numbers).length and webgraph.Decoder(s).record(bits(made), x, lists.__getitem__) == lists[x]


def test_codes():
    """Codes as the format defines them, bit by bit."""
    for make, want in ((lambda w: w.gamma(0), "1"), (lambda w: w.gamma(1), "010"), (lambda w: w.gamma(2), "011"), (lambda w: w.gamma(3), "00100"), (lambda w: w.unary(3), "0001"), (lambda w: w.zeta(0, 3), "100"), (lambda w: w.zeta(1, 3), "1010"), (lambda w: w.zeta(6, 3), "1111"), (lambda w: w.zeta(7, 3), "0100000"), (lambda w: w.zeta(0, 1), "1"), (lambda w: w.zeta(2, 1), "011")):
        w = webgraph.Written()
        make(w)
        assert "".join(w.parts) == want
    w, numbers = webgraph.Written(), [0, 1, 5, 1000, 2**31, 2**62]
    for x in numbers:
        w.gamma(x)
        for k in (1, 2, 3, 7):
            w.zeta(x, k)
    w.unary(700)
    bits = webgraph.Bits(w.bytes(), 0, 0)
    for x in numbers:
        assert [bits.gamma(), *(bits.zeta(k) for k in (1, 2, 3, 7))] == [x] * 5
    assert bits.unary() == 700
    with pytest.raises(EOFError):
        bits.bits(9)
    assert webgraph.Bits(bytes([0b01101_000]), 0, 0).delta() == 4
    assert [webgraph.signed(webgraph.unsigned(x)) for x in range(-5, 6)] == list(range(-5, 6))


@pytest.mark.parametrize("shape", SHAPES)
def test_records_by_range_and_by_node(tmp_path, shape, monkeypatch):
    monkeypatch.setattr(webgraph, "EVERY", 64)
    lists, path = neighbours(1000), f"{tmp_path}/g"
    plain(path, lists, **shape)
    webgraph._indexed(path)
    g = webgraph.Graph(path)
    assert dict(g.scan(0, 1000)) == dict(enumerate(lists)) and dict(g.scan(501, 733)) == {x: lists[x] for x in range(501, 733)}
    assert all(webgraph.Graph(path).neighbours(x) == lists[x] for x in range(0, 1000, 7))


def test_missing_offsets_are_made(tmp_path):
    lists, path, other = neighbours(300), f"{tmp_path}/g", f"{tmp_path}/h"
    plain(path, lists)
    plain(other, lists, offsets=False)
    webgraph._indexed(path)
    webgraph._indexed(other)
    assert files.read(path + ".offsets") == files.read(other + ".offsets") and files.read(path + ".index") == files.read(other + ".index")


def test_source(spark, tmp_path, monkeypatch):
    lists, path = neighbours(5000), f"{tmp_path}/g"
    plain(path, lists, offsets=False)
    want = [(x, y) for x, own in enumerate(lists) for y in own]
    whole = webgraph.graph(spark, path, partition_bytes=2000)
    assert whole.rdd.getNumPartitions() > 4 and arcs(whole) == want
    of = lambda nodes: [a for a in want if a[0] in nodes]
    one = webgraph.graph(spark, path, [4321])
    assert one.rdd.getNumPartitions() == 1 and arcs(one) == of([4321])
    assert arcs(one.union(webgraph.graph(spark, path, [10, 70_000]))) == of([10, 4321]) and arcs(webgraph.graph(spark, path, [])) == []
    part = webgraph.graph(spark, path, low=1000, high=1100, partition_bytes=100)
    assert arcs(part) == of(range(1000, 1100)) and 1 <= part.rdd.getNumPartitions() < whole.rdd.getNumPartitions()
    assert arcs(webgraph.graph(spark, path, low=5000)) == [] and arcs(webgraph.graph(spark, path, [5, 4000], low=10)) == of([4000])
    assert arcs(whole.filter("node = 10").union(whole.filter("node > 4990"))) == of([10, *range(4991, 5000)])
    assert whole.agg({"*": "count"}).first()[0] == len(want)


def test_pushdown(spark, tmp_path):
    """Conditions reach the source where that is asked for; a frame must then be used once."""
    lists, path = neighbours(3000), f"{tmp_path}/g"
    plain(path, lists)
    want = [(x, y) for x, own in enumerate(lists) for y in own]
    pushed = lambda: webgraph.graph(spark, path, partition_bytes=2000, pushdown=True)
    try:
        one = pushed().filter("node = 2321")
        assert one.rdd.getNumPartitions() == 1 and arcs(one) == [a for a in want if a[0] == 2321]
        assert "+- Filter" not in one._jdf.queryExecution().optimizedPlan().toString()  # the source takes it all
        assert arcs(pushed().filter("node in (3, 1024, 2999, 70000) and neighbour % 2 = 0")) == [a for a in want if a[0] in (3, 1024, 2999) and a[1] % 2 == 0]
        assert arcs(pushed().filter("node >= 1000 and node < 1100 and neighbour > 50")) == [a for a in want if 1000 <= a[0] < 1100 and a[1] > 50]
        assert arcs(pushed().filter("node > 2999 or node < 0")) == [] and arcs(pushed().filter("node > 2990 and node <= 2995")) == [a for a in want if 2990 < a[0] <= 2995]
        assert arcs(pushed().filter("node = 10").union(pushed().filter("node = 20"))) == [a for a in want if a[0] in (10, 20)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_written_graph(spark, tmp_path):
    """Ranges of nodes as shards: gaps between them, repeated edges, a node with very many neighbours, ids far from zero."""
    lists = neighbours(2000)
    want = {(x + 10**6 * (x > 900), y) for x, own in enumerate(lists) for y in own} | {(1_000_950, 3 * y) for y in range(20_000)}
    edges = spark.createDataFrame([*want, *list(want)[:500], (None, 3), (4, None)], "node long, neighbour long")
    path = f"{tmp_path}/graph"
    webgraph.write(edges, path, 5, window=4)
    assert len(webgraph.shards(path)) == 5
    back = webgraph.graph(spark, path)
    assert arcs(back) == sorted(want) and arcs(webgraph.graph(spark, path, [1_000_950])) == sorted(a for a in want if a[0] == 1_000_950)
    webgraph.write(edges.limit(0), f"{tmp_path}/none", 2)
    assert webgraph.graph(spark, f"{tmp_path}/none").isEmpty()


def test_failed_and_repeated_tasks_leave_nothing_that_is_read(spark, tmp_path):
    path = f"{tmp_path}/graph"
    webgraph.write(spark.createDataFrame([(1, 2)], "node long, neighbour long"), path, 1)
    files.write(f"{path}/shard-of-a-lost-task.graph", b"\x00")
    assert arcs(webgraph.graph(spark, path)) == [(1, 2)]


def test_referring_domains_of_the_file(spark, tmp_path):
    vertices = spark.createDataFrame([(0, "com.a"), (1, "com.b"), (2, "org.c"), (3, "com.d")], "id long, rev string")
    edges = spark.createDataFrame([(0, 1), (0, 2), (2, 3), (3, 0)], "node long, pred long")
    path = f"{tmp_path}/graph"
    webgraph.write(edges.selectExpr("node", "pred neighbour"), path)
    for target in ("a.com", "https://www.A.com/x", "b.com", "d.com", "nowhere.net"):
        assert sorted(backlinks.referring_domains_of_file(vertices, path, target).collect()) == sorted(backlinks.referring_domains(vertices, edges, target).collect())


def test_report_of_a_graph_folder(spark, tmp_path):
    """The last release of a folder, read from the graph's own file."""
    (tmp_path / "old-vertices.txt.gz").write_bytes(b"")
    stem = f"{tmp_path}/release-2"
    plain(stem, [[1, 2], [0], [], [0, 1, 2]])
    with gzip.open(stem + "-vertices.txt.gz", "wt") as f:
        f.write("0\tcom.a\n1\tcom.b\n2\torg.c\n3\tcom.d\n")
    facts = lambda target, most=10: backlinks.layer1_facts(spark, str(tmp_path), target, most)
    got = facts("https://www.d.com/")
    assert (got["status"], got["graph_release"], got["total_backlinks"]) == ("success", "release-2", 3) and [r["referring_domain"] for r in got["backlinks"]] == ["a.com", "b.com", "c.org"]
    assert len(facts("https://d.com/", 2)["backlinks"]) == 2 and facts("https://c.org/")["total_backlinks"] == 0 and facts("https://e.com/")["status"] == "not_in_graph"
    assert backlinks.layer1_facts(spark, f"{tmp_path}/none", "https://d.com/", 5)["status"] == "graph_missing" and backlinks.layer1_facts(spark, None, "https://d.com/", 5)["status"] == "not_configured"
