"""Operator 4 against plain Python."""

import random

import brute
import numpy as np
import pytest

from sitelume.llm import decontamination, fm_index


def test_index_against_scanning():
    r = random.Random(3)
    for _ in range(30):
        text = np.array([x for _ in range(r.randint(1, 6)) for x in [*(r.randint(1, 3) for _ in range(r.randint(1, 40))), 0]], np.int32)
        index = fm_index.FmIndex(text, 4)
        patterns = [[r.randint(1, 3) for _ in range(r.randint(1, 5))] for _ in range(40)]
        rows = np.array([[0] * (5 - len(p)) + p for p in patterns], np.int32)
        low, high = index.search(rows, np.array([len(p) for p in patterns]))
        for p, a, z in zip(patterns, low, high, strict=True):
            want = [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)].tolist() == p]
            assert sorted(index.locate(np.arange(a, z)).tolist()) == want


def compare(docs, items, **more):
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = brute.contamination(texts, {str(r.item_id): r.text for r in items.collect()})
    got = decontamination.digest(decontamination.find(docs, items, **more)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert {k: r[k] for k in want[r.doc_id]} == want[r.doc_id], texts[r.doc_id]


@pytest.fixture(scope="module")
def planted(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(30)] + ["été", "Über", "漢字"]
    say = lambda n: " ".join(r.choice(words) + r.choice(["", "", ",", ".\n", "-"]) for _ in range(n))
    items = [(i, say(r.choice([1, 2, 3, 9, 10, 11, 25]) + 8 * (i > 3))) for i in range(25)] + [(90, ""), (91, None), (92, "!?")]
    docs = [(i, say(30) + " " + r.choice(items[4:25])[1].upper() * (i % 3 == 0) + " x " + r.choice(items[:25])[1] * (i % 2) + say(5)) for i in range(150)]
    return spark.createDataFrame(docs + [(500, None), (501, ""), docs[0]], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_planted(planted):
    compare(*planted)


def test_in_blocks(planted):
    compare(*planted, block_bytes=400)


def test_repeated_rows_and_items_in_blocks(planted):
    """Repeated items make no block large, and repeated rows and rows of one id stay apart."""
    docs, items = planted
    many = items.union(items.limit(9)).union(items.filter("item_id = 12").crossJoin(items.limit(20).select("item_id").withColumnRenamed("item_id", "k")).select("item_id", "text"))
    assert decontamination.blocks(many, 400)[0] == decontamination.blocks(items, 400)[0] > 3
    compare(docs.union(docs.limit(30)), many, block_bytes=400)
    one_id = docs.selectExpr("1 doc_id", "text")
    got = lambda **more: sorted(map(str, decontamination.find(one_id, many, **more).collect()))
    assert got(block_bytes=400) == got()


def test_empty_blocks(spark, planted):
    docs, _ = planted
    items = spark.createDataFrame([(1, " ! " * 300), (2, None), (3, "?" * 300)], "item_id long, text string")
    assert decontamination.blocks(items, 100)[0] > 1
    compare(docs, items, block_bytes=100)


def test_small_shards(planted, monkeypatch):
    docs, items = planted
    b = next(decontamination.blocks(items)[1])
    whole = decontamination._Shard(b)
    texts = [r.text for r in docs.collect()]
    for t in texts:
        whole.add(t)
    spans, found = whole.hits()
    for t, s, f in zip(texts, spans, found, strict=True):
        one = decontamination._Shard(b)
        one.add(t)
        assert one.hits() == ([s], [f])


def test_small_table(spark, small_docs):
    compare(small_docs.select("doc_id", "text"), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))


def test_odd(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "Mail é a.b c d e org and x y co z w net"), (None, "token=ééé token='𝒳' secret"), (2, "nothing of this stands anywhere")], "item_id long, text string")
    assert decontamination.find(odd_docs, items).count() == odd_docs.count()
    assert decontamination.find(no_docs, items).count() == 0
    assert {r.contaminated for r in decontamination.digest(decontamination.find(odd_docs, items.limit(0))).collect()} == {False}
    got = [r for r in decontamination.digest(decontamination.find(odd_docs, items)).collect() if r.contaminated]
    assert [(r.doc_id, r.n_items) for r in got] == [(10, 1), (10, 1), (16, 0)] or sorted((r.doc_id, r.n_items) for r in got) == [(10, 1), (10, 1), (16, 0)]


def test_clean(spark):
    leak = "one two three four five six seven eight nine ten eleven twelve"
    rest = " ".join(f"own{i}" for i in range(20))
    docs = spark.createDataFrame([(1, rest, 5, "en"), (2, f"{rest}. {leak.title()}! {rest}", 5, "en"), (3, leak + " more", 5, "de"), (4, None, None, None)], "doc_id long, text string, n_chars long, lang string")
    out = {r.doc_id: r.asDict() for r in decontamination.clean(docs, spark.createDataFrame([(1, leak)], "item_id long, text string")).collect()}
    assert set(out) == {1, 2, 4} and out[1] == {"doc_id": 1, "text": rest, "n_chars": 5, "lang": "en"}
    assert out[2]["text"] == f"{rest}. ! {rest}" and out[2]["n_chars"] == len(out[2]["text"]) and out[4]["text"] is None


def test_clean_in_blocks(spark):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    passage, own = words("shared", 14), words("own", 60)
    items = [(k, f"{passage} {words(f'ask{k}x', 5)}") for k in range(12)]  # one context, many questions
    docs = [(k, f"{own}. {text}. {own}", 7) for k, text in items] + [(50, own, 7), (51, None, None), (52, own + " " + items[3][1], 7)]
    halves = [f"{words('left', 11)}", f"{words('right', 11)}", f"{words('mid', 11)}"]
    items += [(20 + k, t) for k, t in enumerate(halves)]
    docs += [(60, f"{halves[0]} {words('a', 5)} {halves[1]} {words('b', 5)} {halves[2]}", 7)] * 2  # each block's share is under a half
    docs, items = spark.createDataFrame(docs, "doc_id long, text string, spans int"), spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.blocks(items, 150)[0] > 8
    get = lambda **more: sorted(map(str, decontamination.clean(docs, items, **more).collect()))
    whole = get()
    assert get(block_bytes=150) == whole and not any("ask" in r or "doc_id=60" in r for r in whole) and len(whole) == 15
    assert get(block_bytes=150, most_hit=1.0) == get(most_hit=1.0)
