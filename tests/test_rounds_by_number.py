"""What the rounds of a loop hold: numbers in place of URLs, and one row for each group."""

from sitelume.operators import graph


def test_ranks_go_by_numbers(spark, monkeypatch):
    dealt, given = [], graph.Rounds.given
    monkeypatch.setattr(graph.Rounds, "given", lambda self, df, *keys: dealt.append(dict(df.dtypes)) or given(self, df, *keys))
    pages = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "url string")
    rows = [("a", "b", True), ("a", "b", True), ("a", "x", True), ("b", "a", True), ("b", "c", True), ("x", "c", True), ("c", "a", False), (None, "a", True)]
    got = {r.url: r.pagerank for r in graph.pagerank(pages, spark.createDataFrame(rows, "source_url string, target_url string, internal boolean"), 2).collect()}
    rank = dict.fromkeys(["a", "b", "c", None], 0.25)
    for _ in range(2):
        own = 0.15 / 4
        rank = {"a": own + 0.85 * rank["b"] / 2, "b": own + 0.85 * rank["a"] / 3, "c": own + 0.85 * rank["b"] / 2, None: own}
    assert got.keys() == rank.keys() and all(abs(got[u] - rank[u]) < 1e-12 for u in rank)
    assert dealt and not [x for x in dealt if "string" in x.values()]


def test_a_level_aggregates_no_earlier_one(spark, monkeypatch):
    """A group's state is stored by each level; only its rows and the new level's are aggregated."""
    stored, checkpoint = [], graph.checkpoint
    monkeypatch.setattr(graph, "checkpoint", lambda df: stored.append(df.columns) or checkpoint(df))
    edges = spark.createDataFrame([(g, str(k), str(k + 1)) for g in "pq" for k in range(5)], "grp string, source string, target string")
    starts = spark.createDataFrame([("p", "0", 0, 0), ("q", "0", 0, 0)], "grp string, url string, rank int, depth int")
    hits = spark.createDataFrame([("p", "2")], "grp string, url string")
    visits, cut = graph.search(edges, starts, hits, max_pages=4)
    assert sorted((x.grp, x.url, x.depth, x.seq, x.hit) for x in visits.collect()) == [("p", str(k), k, k + 1, k == 2) for k in range(3)] + [("q", str(k), k, k + 1, False) for k in range(5)]
    assert stored.count(["grp", "visited", "found"]) == 5
