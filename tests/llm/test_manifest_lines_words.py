"""Operators 11, 12 and 13 against plain Python, on odd rows and on the small table."""

import random
import re
import zlib
from collections import Counter
from itertools import groupby

import brute
import numpy as np
import pytest

from sitelume.llm import line_dedup, merkle, queries, spelling
from sitelume.llm.common import Folder, placed

EMPTY_TABLES = "doc_id long, text string, lang string, source string, n_chars long, tree string, place int, word string, n long, pos int"


def full(docs):
    """odd_docs with all columns of documents, some of them null, and extra ones whose names operators use inside."""
    return docs.selectExpr("*", "case pmod(coalesce(doc_id, 0), 5) when 0 then null when 1 then 'én' else 'en' end lang", "nullif('s', key) source", "nullif(length(text), 0) n_chars", "'x' tree", "1 place", "'y' word", "2 n", "3 pos", "4 path", "5 row")


# ---- 13, line dedup


def dropped(rows, documents=2, chars=10):
    """(doc_id, n_lines, n_dropped, kept) of each row (doc_id, text)."""
    last = 1 << 63
    key = lambda line: brute.lower(line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    holders: dict = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(last if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        lost = [len(k := key(x)) >= chars and len(holders[k]) >= documents and min(holders[k]) != (last if d is None else d) for x in lines]
        out.append((d, len(lines), sum(lost), "\n".join(x for x, gone in zip(lines, lost, strict=True) if not gone)))
    return out


def same(got, want):
    order = lambda r: (r[0] is None, *map(str, r))
    assert sorted(map(tuple, got), key=order) == sorted(map(tuple, want), key=order)


LINES = [
    (5, "a shared line here\n\tA SHARED line here \nown line of five\nshort"), (3, " a Shared line here\nshort\n"), (9, "\x0ba shared line here\x0c\x85\nÄ shared LINE here"), (2, "ä shared line here\nÄ SHARED line here\n123456789"),
    (7, "123456789\n1234567890\n\n"), (8, "1234567890 \n"), (None, "1234567890\na line of no one"), (None, "a line of no one\nother"), (3, "own line of five"), (3, " a Shared line here\nshort\n"), (11, None), (12, ""), (13, "a shared line here"),
]


@pytest.mark.parametrize("documents,chars", [(2, 10), (3, 10), (2, 1), (4, 19)])
def test_lines(spark, documents, chars):
    docs = spark.createDataFrame(LINES, "doc_id long, text string").repartition(4)
    got = line_dedup.find(docs, documents, chars).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    same(got, dropped(LINES, documents, chars))


@pytest.mark.parametrize("which", ["odd_docs", "small_docs"])
def test_lines_of_tables(which, request):
    docs = request.getfixturevalue(which)
    docs = full(docs) if which == "odd_docs" else docs
    want = [(d, n, m, brute.sha(kept)) for d, n, m, kept in dropped([(r.doc_id, r.text) for r in docs.collect()])]
    same(line_dedup.digest(line_dedup.find(docs)).collect(), want)


def test_cleaned_lines_keep_the_columns(spark, odd_docs):
    docs = full(odd_docs).union(full(odd_docs).filter("doc_id = 15").withColumn("doc_id", odd_docs["doc_id"] + 100))
    got = line_dedup.clean(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[0].text is None and rows[0].n_chars is None and rows[8].text == docs.filter("doc_id = 8").first().text
    assert rows[115].n_chars == len(rows[115].text) < rows[15].n_chars == len(rows[15].text)


def test_lines_of_very_many_documents(spark):
    """A line in all of 20,000 documents stays in the smallest one; a text of 100,000 lines loses every other one."""
    many = spark.range(20_000).selectExpr("id + 10 doc_id", "concat('the line of all of them\nown line ', id) text")
    long = spark.range(2).selectExpr("id doc_id", "array_join(transform(sequence(1, 100000), i -> concat('numbered line ', if(i % 2 = 0, concat(id, ' '), ''), i)), '\n') text")
    r = line_dedup.find(many.union(long)).selectExpr("sum(n_lines)", "sum(n_dropped)", "sum(if(row.doc_id = 1, n_dropped, 0))").first()
    assert tuple(r) == (20_000 * 2 + 200_000, 19_999 + 50_000, 50_000)


# ---- 12, Merkle manifest


def manifest(rows, every=3):
    """rows: doc_id, source, lang, n_chars, text, in any order. The contract's columns of each row."""
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: brute.sha("".join(map(part, r)))
    first = lambda x: (x is not None, x)
    order = lambda r: ((r[2] is not None, (r[2] or "").encode()), (r[0] is not None, r[0] or 0), leaf(r))

    def tree(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append([brute.sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
        return levels

    def way(levels, k):
        out = []
        for level in levels[:-1]:
            run = k - k % 8
            out.append(("".join(level[run:k]), "".join(level[k + 1 : run + 8])))
            k //= 8
        return out

    groups = [(lang, list(g)) for lang, g in groupby(sorted(rows, key=order), key=lambda r: r[2])]
    trees = [tree([leaf(r) for r in g]) for _, g in groups]
    top = tree([t[-1][0] for t in trees])
    out = []
    for j, (_, g) in enumerate(groups):
        for k, r in enumerate(g):
            path = way(trees[j], k) + way(top, j)
            at = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % every == 0:
                at = leaf((*r[:4], None if r[4] is None else brute.lower(r[4])))
            for left, right in path:
                at = brute.sha(left + at + right)
            out.append((r[0], leaf(r), trees[j][-1][0], top[-1][0], brute.sha("".join(a + b for a, b in path)), at, at == top[-1][0]))
    return out


def leaf_rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("which", ["odd_docs", "small_docs"])
def test_manifest(which, request):
    docs = request.getfixturevalue(which)
    docs = full(docs) if which == "odd_docs" else docs
    same(merkle.digest(merkle.manifest(docs)).collect(), manifest(leaf_rows(docs)))


@pytest.mark.parametrize("sizes", [(1,), (9,), (64, 65, 1, 7), (3,) * 9, (513,)])
def test_manifest_of_sizes(spark, sizes):
    """Trees of every kind of shape, unicode language names in bytewise order, repeated rows."""
    names = [None, "", "Z", "a", "é", "\U0001d4b3", "￿", "-", ":"]
    rows = [(k // 2, "s", names[j], 3, f"Text {j}") for j, n in enumerate(sizes) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    same(merkle.digest(merkle.manifest(docs)).collect(), manifest(rows))


def test_manifest_tells_tampering(spark):
    rows = [(k, None, "en", k, "lower" if k % 2 else "Upper") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for r in merkle.manifest(docs, paths=True).collect():
        changed = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.doc_id % 2 == 0
        assert r.verified == (not changed) and len(r.path) == 3 == r.n_levels
    assert merkle.manifest(docs.limit(0)).isEmpty()


@pytest.mark.parametrize("partitions", [1, 30])
def test_places(spark, partitions):
    """One value holds most rows, and most of these are equal."""
    r = random.Random(partitions)
    rows = [("b" if r.random() < 0.9 else r.choice("ac"), r.choice([None, 5, 5, 5, *range(9)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(partitions)
    with Folder(spark, "places") as folder:
        got = [tuple(x) for x in placed(folder, df, "k", ["v"]).collect()]
    want = []
    for k, g in groupby(sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1] or 0)), key=lambda x: x[0]):
        g = list(g)
        want += [(*x, i, len(g)) for i, x in enumerate(g)]
    same(got, want)


# ---- 11, spelling variants


def spelled(rows, every=199):
    counts: Counter = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = brute.lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    forms, numbers = {}, {}
    for w, n in words.items():
        others = sorted((-words[x], x) for x in words if abs(len(x) - len(w)) < 2 and near(w, x))
        numbers[w] = len(others)
        forms[w] = others[0][1] if others and -others[0][0] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, numbers[w], words.get(forms[w])))
    return out


def told(df):
    return df.select("word", "form", "root", "n", "n_near", "form_n").collect()


def test_spelling_of_odd_rows(odd_docs):
    docs = full(odd_docs)
    same(told(spelling.variants_of(docs)), spelled([(r.doc_id, r.text) for r in docs.collect()]))


def test_spelling_of_the_small_table(small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.limit(60).collect()]
    same(told(spelling.variants_of(small_docs.limit(60))), spelled(rows))


@pytest.mark.parametrize("every", [0, 3])
def test_spelling_of_dense_words(spark, every):
    """Words over three letters: every kind of step, ties, runs of equal letters, chains of forms."""
    r = random.Random(every)
    words = ["".join(r.choice("aaéb") for _ in range(r.randint(5, 8))) for _ in range(250)]
    rows = [(k, " ".join(w.upper() if r.random() < 0.2 else w for w in r.choices(words, [1.5 ** (i % 12) for i in range(250)], k=60))) for k in range(150)]
    rows += [(None, "aaaaaa, AAAAAA-aaaaaa\naaaaaa aaaaaa " + "aaaaaaa " * 30), (4, None), (5, ""), (5, "")]
    rows += [(6, "stepone " * 5 + "steponed " * 25 + "steponede " * 125 + "xteponede " * 625 + "xteponedes " * 5 + "stepzne " * 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = told(spelling.variants_of(docs, every))
    same(got, spelled(rows, every))
    if not every:
        assert {x.word: (x.form, x.root) for x in got}["stepone"] == ("steponed", "xteponede")  # of two forms as frequent the first


def test_spelling_of_very_long_words(spark):
    """Words of 200,000 letters: their variants are numbers, not copies."""
    long = "".join(random.Random(3).choices("abcdefgh", k=200_000))
    rows = [(k, f"{long} {long[:-1]} {long[1:]} x{long[1:]}" + f" {long}" * 9) for k in range(5)]
    got = {r.word: r for r in told(spelling.variants_of(spark.createDataFrame(rows, "doc_id long, text string"), 0))}
    x = "x" + long[1:]
    assert {w: (r.form == long, r.root == long, r.n, r.n_near) for w, r in got.items()} == {long: (False, True, 50, 3), long[:-1]: (True, True, 5, 1), long[1:]: (True, True, 5, 2), x: (True, True, 5, 2)}


def test_pieces_of_texts(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = "short " + "averyverylongrunofletters, " * 3 + "x1y2 " + "é" * 40
    assert spelling.runs(text) == Counter(re.findall(spelling.RUNS, text))


def test_variant_hashes_tell_words():
    words = ["abcabc", "abcab", "bcabca", "aabbcc", "abbcca", "é" * 9, "é" * 8, "x"]
    v = spelling.variants(words)
    whole = {(a, b): w for w, a, b in zip(words, v["whole0"], v["whole1"], strict=True)}
    wild = {}
    for k, (of, p) in enumerate(zip(v["of"], v["position"], strict=True)):
        w = words[of]
        less = (v["less0"][k], v["less1"][k])
        assert whole.get(less) == (w[:p] + w[p + 1 :] if w[:p] + w[p + 1 :] in words else None)
        assert wild.setdefault((v["wild0"][k], v["wild1"][k], p, len(w)), (w[:p], w[p + 1 :])) == (w[:p], w[p + 1 :])
    assert np.array_equal(v["first"], [True] * 6 + [True] * 5 + [True] * 6 + [True, False] * 3 + [True, True, False, True, False, True] + [True] + [False] * 8 + [True] + [False] * 7 + [True])


def test_empty_tables(spark, no_docs):
    docs = spark.createDataFrame([], EMPTY_TABLES)
    assert merkle.manifest(docs).isEmpty() and line_dedup.find(docs).isEmpty() and spelling.variants_of(docs).isEmpty()
    assert spelling.variants_of(no_docs).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_queries_at_the_entry(spark):
    """The registered queries return the contracts' columns."""
    at = "/root/testdata/sf0.001"
    assert queries.QUERIES["op13_line_dedup"](spark, at).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
