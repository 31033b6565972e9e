"""Operators 8 and 9, and the pipeline."""

import zlib

import brute
import numpy as np
import pytest

from sitelume.llm import packing, quality_model, token_counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_allocate(rule):
    import random

    r = random.Random(rule)
    for _ in range(200):
        ends = np.cumsum([r.randint(1, 6) for _ in range(r.randint(1, 20))])
        cuts = sorted({r.randint(1, int(ends[-1])) for _ in range(r.randint(0, 6))} | {int(ends[-1])})
        want, crossing = [0] * len(cuts), [0] * len(cuts)
        for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            of = [next(k for k, c in enumerate(cuts) if b < c) for b in range(a, z)]
            to = {"start": of[0], "end": of[-1], "most": max(sorted(set(of)), key=of.count)}[rule]
            want[to] += 1
            crossing[to] += len(set(of)) > 1
        got = token_counts.allocate(ends, np.array(cuts), rule)
        assert (got[0].tolist(), got[1].tolist()) == (want, crossing)


@pytest.mark.parametrize("which", ["odd_docs", "small_docs", "no_docs", "special_docs"])
def test_attributed(which, request):
    docs = request.getfixturevalue(which)
    fields = ("key", "text") if "key" in docs.columns else ("source", "lang", "text")
    encode = packing.encoder(packing.VOCABULARY)
    got = {}
    for r in token_counts.attributed(docs, fields).collect():
        got.setdefault(r.doc_id, []).append(r)
    seen = {}
    for d in docs.collect():
        seen[d.doc_id] = seen.get(d.doc_id, 0) + 1
    assert set(got) == set(seen)
    for d in docs.collect():
        rows, whole = got[d.doc_id], "".join((d[f] or "") + "\n" for f in fields)
        assert sum(r.n_tokens for r in rows) == seen[d.doc_id] * len(encode(whole))
        for f in fields:
            own = sorted((r.start, r.length) for r in rows if r.field == f)[:: seen[d.doc_id]]
            assert own[0][0] == 0 and sum(n for _, n in own) == len(d[f] or "") + 1
            assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attributed_against_plain_counting(spark, special_docs, small_docs, rule):
    """Every section's tokens and crossing tokens, byte by byte from the tokenizer's own offsets."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    texts = [None, "", "one\n\ntwo. Three\nfour", "a\n", "\n\n\na", "ends in blanks  \n  begins in blanks", "x,\ny'll\n\n\n 12345"] + [r.text for r in [*special_docs.collect(), *small_docs.limit(25).collect()]]
    docs = spark.createDataFrame([(i, x, "src") for i, x in enumerate(texts)], "doc_id long, text string, source string")
    got = {(r.doc_id, r.field, r.section): tuple(r)[3:] for r in token_counts.attributed(docs, ("source", "text"), rule).collect()}
    want = {}
    for i, text in enumerate(texts):
        sections = []  # (field, number, start, text)
        for field, value in (("source", "src"), ("text", text or "")):
            at = number = 0
            for line in value.split("\n"):
                if number and not line.strip():
                    f, k, a, said = sections.pop()
                    sections.append((f, k, a, said + line + "\n"))
                else:
                    sections.append((field, number, at, line + "\n"))
                    number += 1
                at += len(line) + 1
        whole = "".join(x for *_, x in sections)
        owner = [k for k, (*_, x) in enumerate(sections) for _ in range(len(x.encode()))]
        n, crossing, at = [0] * len(sections), [0] * len(sections), 0
        for token, (a, z) in zip(t.encode(whole, add_special_tokens=False).tokens, t.encode(whole, add_special_tokens=False).offsets, strict=True):
            size = len(token)
            of = owner[at : at + size]
            at += size
            to = {"start": of[0], "end": of[-1], "most": max(sorted(set(of)), key=of.count)}[rule]
            n[to] += 1
            crossing[to] += len(set(of)) > 1
        for k, (f, number, a, x) in enumerate(sections):
            want[i, f, number] = (a, len(x), n[k], crossing[k])
    assert got == want


def test_token_bytes_against_the_tokenizer(small_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    size = token_counts.token_bytes(packing.VOCABULARY)
    for text in ["", "a  b\n\n\tc", "don't 1234 漢字 𝒳 é x", "x" * 300, " " * 50, "a <|endoftext|> b <|endoftext|>", *(r.text for r in small_docs.limit(40).collect())]:
        e = t.encode(text, add_special_tokens=False)
        assert packing.encoder(packing.VOCABULARY)(text) == e.ids
        assert int(size[np.array(e.ids, np.int64)].sum()) == len(text.encode())


def test_classifier_on_the_held_out_fold(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    model = quality_model.train(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality_model.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    test = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, q in test if q == 1], [s for s, q in test if q == 0]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.97, auc
    assert 0.7 < model.prior < 0.97


def test_classifier_never_sees_held_out_labels(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i} " * (i % 9)) for i in range(300)], "doc_id long, text string")
    make = lambda other: spark.createDataFrame([(i, int(i % 2) if zlib.crc32(str(i).encode()) % 5 else other) for i in range(300)], "doc_id long, quality int")
    a, b = (quality_model.train(docs, make(x)) for x in (0, 1))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_classifier_fits_one_row_of_an_id(spark):
    """Rows of one id, however many, give one vector, whatever their order."""
    good, bad = "A sentence of sound words, and then another. ", "## || buy $$ now "
    rows = [(i, (good if i % 2 else bad) * (2 + i % 5)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    many = [(r, t) for r, t in rows for _ in range(1 + 300 * (r == 3))] + [(3, "other words of the same id")] * 200 + [(7, None)]
    seen = []
    fit = quality_model.fit
    try:
        quality_model.fit = lambda p, u, prior=None: (seen.append((len(p[0]), len(u[0]))), fit(p, u, prior))[1]
        models = [quality_model.train(spark.createDataFrame(x, "doc_id long, text string").repartition(n), labels) for x, n in ((many, 3), (many[::-1], 7))]
    finally:
        quality_model.fit = fit
    held = sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(60))
    assert seen == [(sum(i % 2 and zlib.crc32(str(i).encode()) % 5 != 0 for i in range(60)), 60 - held)] * 2
    assert np.array_equal(models[0].weights, models[1].weights)


def test_scores_and_risk_against_plain_python(spark):
    """Scores, and the risk that is minimised, computed row by row without arrays."""
    import math

    r = np.random.default_rng(3)
    make = lambda n, at: (r.normal(at, 1, (n, quality_model.STATISTICS)), [sorted(set(r.integers(0, 50, 5).tolist())) for _ in range(n)])
    p, u, pi = make(40, 1.0), make(90, 0.0), 0.4

    def margin(m, stats, hashed):
        z = m.bias
        for k, v in enumerate(stats):
            z += m.weights[k * quality_model.BINS + sum(e <= v for e in m.edges[k])]
        return z + sum(m.weights[quality_model.STATISTICS * quality_model.BINS + h] for h in hashed) / math.sqrt(len(hashed) or 1)

    def risk(m):
        loss = lambda z: math.log1p(math.exp(z))
        zp, zu = ([margin(m, s, h) for s, h in zip(*x, strict=True)] for x in (p, u))
        return pi * sum(loss(-z) for z in zp) / 40 + max(0.0, sum(loss(z) for z in zu) / 90 - pi * sum(loss(z) for z in zp) / 40)

    models = [quality_model.fit(p, u, pi, steps) for steps in (1, 5, 40, 400)]
    risks = [risk(m) for m in models]
    assert risks == sorted(risks, reverse=True) and risks[-1] < 0.5 * risks[0]
    for s, h, got in zip(*u, models[2].scores(*u), strict=True):
        assert abs(1 / (1 + math.exp(-margin(models[2], s, h))) - got) < 1e-9
    docs = spark.createDataFrame([(1, "Some words. And more!"), (2, None)], "doc_id long, text string")
    for x in quality_model.score(docs, models[2]).collect():
        stats, hashed = quality_model.statistics({1: "Some words. And more!", 2: None}[x.doc_id])
        assert abs(1 / (1 + math.exp(-margin(models[2], stats, hashed))) - x.score) < 1e-9


def test_classifier_odd(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(4, 1), (5, 1), (8, 0), (None, 1), (999, 1)], "doc_id long, quality int")
    model = quality_model.train(odd_docs, labels)
    assert quality_model.score(odd_docs, model).count() == odd_docs.count()
    assert quality_model.score(no_docs, quality_model.train(no_docs, labels)).count() == 0
    assert {r.score for r in quality_model.score(odd_docs, quality_model.train(odd_docs, labels.limit(0))).collect()} == {0.5}


def test_non_negative_risk_with_a_known_prior():
    r = np.random.default_rng(0)
    make = lambda n, good: np.column_stack([r.normal(2.0 if good else -2.0, 1, n), *(r.normal(0, 1, n) for _ in range(quality_model.STATISTICS - 1))])
    p, u = make(400, True), np.concatenate([make(300, True), make(700, False)])
    m = quality_model.fit((p, [[]] * 400), (u, [[]] * 1000), prior=0.3, steps=300)
    assert np.mean(m.scores(make(300, True), [[]] * 300) > 0.5) > 0.9 and np.mean(m.scores(make(300, False), [[]] * 300) < 0.5) > 0.85
    assert 0.2 < quality_model.fit((p, [[]] * 400), (u, [[]] * 1000), steps=1).prior < 0.45


def test_pipeline(spark, tmp_path):
    """Each stage held against plain Python on its own input."""
    import corpus_pipeline

    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    bench = {str(r.item_id): r.text for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, at).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r for r in docs.collect()} if k < 4 else {}
        assert k == 4 or docs.columns == columns, name
        if k == 0:
            assert after and not [i for i in after if brute.quality(before[i].text)["base_failed"]]
            for i, r in after.items():
                assert set(r.text.split("\n")) <= set(before[i].text.split("\n")) and r.n_chars == len(r.text)
        if k == 1:
            root = brute.components({i: brute.fingerprint(r.text) for i, r in before.items()})
            alone = brute.similar({i: before[i].text for i in set(root.values())})
            assert set(after) == set(alone.values()) and all(after[i] == before[i] for i in after)
        if k == 2:
            was = brute.contamination({i: r.text for i, r in before.items()}, bench)
            for i, r in before.items():
                if not was[i]["contaminated"]:
                    assert after[i] == r
                elif i in after:
                    assert after[i].text != r.text
                else:
                    assert was[i]["n_hit"] > 0.5 * was[i]["n_words"]
        if k == 3:
            assert set(after) == set(before)
            for i, r in before.items():
                found = brute.pii(r.text)
                assert not sum(v for c, v in brute.pii(after[i].text).items() if c != "base_sha256")
                assert (after[i].text == r.text) or sum(v for c, v in found.items() if c != "base_sha256")
        if k == 4:
            assert {r.doc_id for r in docs.collect()} == set(before)
    assert corpus_pipeline.run(spark, at).drop("sequence_id", "offset").exceptAll(docs.drop("sequence_id", "offset")).count() == 0


def folders(spark):
    import os

    from sitelume.llm import common

    return {f"{x}/{y}" for x in os.listdir(at) if x.startswith("pipeline-") for y in os.listdir(f"{at}/{x}")} if os.path.isdir(at := common.shared_folder(spark).removeprefix("file:")) else set()


ODD = [
    [],
    [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "few words", None, "s", 9)],
    [(7, " ".join(f"one{i} two." for i in range(60)), "en", "s", 5)] * 3 + [(None, " ".join(f"word{i} here." for i in range(70)), "en", "s", None)] * 2 + [(7, " ".join(f"mail a{i}@b.org now." for i in range(40)), "de", None, 1)],
]


@pytest.mark.parametrize("rows", ODD)
def test_pipeline_on_odd_tables(spark, tmp_path, rows):
    """Against plain steps: rejected, repeated and personal data gone, every kept row in sequences; extra columns go along; no folder but the last stays."""
    import corpus_pipeline

    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, spans int")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a passage of the benchmark that stands in none of the documents at all")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    had = folders(spark)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = {(i, t) for i, t, *_ in rows if not brute.quality(t)["base_failed"]}
    assert sorted(str(r.doc_id) for r in out if r.piece == 0) == sorted(str(i) for i, _ in want)
    assert {x.split("/")[1] for x in folders(spark) - had} == {"4-best_fit_packing"}


def test_pipeline_leaves_nothing_behind_a_failure(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    spark.createDataFrame(ODD[2], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def fails(*_):
        raise ValueError("a stage fails")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [corpus_pipeline.STAGES[0], ("fails", fails)])
    had = folders(spark)
    with pytest.raises(ValueError, match="a stage fails"):
        corpus_pipeline.run(spark, str(tmp_path))
    assert folders(spark) == had
