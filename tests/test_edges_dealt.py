"""Link pairs are dealt by number, so that no task's share is set by compressed bytes or by a split of the input."""

from sitelume.operators import graph, links


def test_pairs_are_dealt_by_number(spark):
    rows = [(f"https://a.example/{k % 40}", f"https://a.example/{k % 70}#x") for k in range(1000)]
    got = links.edges(spark.createDataFrame(rows, "source_url string, target_url string"), "https://a.example/")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan  # each distinct rests on its deal
    want = {(a, b.removesuffix("#x")) for a, b in rows}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_task_has_so_many_pairs_at_most(spark, monkeypatch):
    monkeypatch.setattr(links, "PAIRS", 50, raising=False)
    rows = [(f"https://a.example/{k % 40}", f"https://a.example/{k % 70}") for k in range(1000)]
    got = links.edges(spark.createDataFrame(rows, "source_url string, target_url string"), "https://a.example/")
    assert got.rdd.getNumPartitions() == 20
    assert sorted(map(tuple, got.collect())) == sorted(set(rows))


def test_rounds_of_a_traversal_have_as_many_partitions_as_its_pairs_need(spark, monkeypatch):
    monkeypatch.setattr(links, "PAIRS", 10, raising=False)
    dealt, given = [], graph.Rounds.given
    monkeypatch.setattr(graph.Rounds, "given", lambda self, df, *keys: dealt.append(given(self, df, *keys)) or dealt[-1])
    pairs = spark.createDataFrame([(str(k), str(j)) for k in range(30) for j in range(k + 1, k + 11)], "source string, target string")
    got = graph.bfs(pairs, spark.createDataFrame([("0",)], "url string"), 6)
    assert sorted((int(x.url), x.depth) for x in got.collect()) == [(k, -(-k // 10)) for k in range(40)]
    assert dealt and {x.rdd.getNumPartitions() for x in dealt} == {30}


def test_degrees_behind_scores_come_from_tasks_of_so_many_pairs(spark, monkeypatch):
    monkeypatch.setattr(links, "PAIRS", 50, raising=False)
    rows = [(f"https://a.example/{k % 40}", f"https://a.example/{k % 70}") for k in range(1000)]
    pages = spark.createDataFrame([(f"https://a.example/{k}",) for k in range(80)], "url string")
    own = links.with_degrees(pages, links.edges(spark.createDataFrame(rows, "source_url string, target_url string"), "https://a.example/"))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 20), REPARTITION_BY_NUM") >= 2  # each deal of the pairs
    want = {u: (sum(b == u for _, b in set(rows)), sum(a == u for a, _ in set(rows))) for (u,) in pages.collect()}
    assert {x.url: (x.links_in, x.links_out) for x in own.collect()} == want
