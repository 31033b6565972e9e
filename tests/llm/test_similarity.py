"""Texts of a similarity of 0.8 or more, against comparing all pairs."""

import random
from itertools import combinations

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelume.llm import similarity, simhash


def near_copies(r, text, changes):
    words = text.split()
    for _ in range(changes):
        words[r.randrange(len(words))] = f"changed{r.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    """Texts with near copies of every degree, a large group of near copies, and many texts that share a passage."""
    r = random.Random(12)
    prose = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    out = []
    for _ in range(40):
        base = prose(r.choice([60, 120, 300]))
        out += [base, *(near_copies(r, base, k) for k in (1, 2, 3, 5, 9))]
    one, shared = prose(200), prose(45)
    out += [near_copies(r, one, r.randint(1, 3)) for _ in range(150)]
    for _ in range(120):
        own = prose(15)
        out += [f"{shared} {own}"] + ([f"{shared} {own} end"] if r.random() < 0.3 else [])
    return out + ["", "  ", "one", "one two three", "One TWO three", prose(20_000)]


def banded(spark, texts):
    sets = [similarity.shingle_set(simhash.shingle_hashes(t, 5)) for t in texts]
    rows = [(i, t, len(s), similarity.band_keys(s)) for i, (t, s) in enumerate(zip(texts, sets, strict=True))]
    return spark.createDataFrame(rows, "node long, text string, n int, bands array<long>").repartition(5)


def test_links_against_all_pairs(spark, texts):
    rows = banded(spark, texts)
    got = {(x.a, x.b) for x in similarity.similar(rows.filter("n > 0").select("node", "n", "bands"), rows.select("node", "text"), lambda t: simhash.shingle_hashes(t, 5)).collect()}
    sets = [brute.five_words(t) for t in texts]
    want = {(a, b) for a, b in combinations(range(len(texts)), 2) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert got <= want
    outside = {(a, b) for a, b in want if b < 240 or a >= 390}  # the large group is linked along its order, not by all pairs
    assert len(got & outside) >= 0.95 * len(outside) and len(outside) > 100
    assert len(got) < 60 * len(texts)
    root = {}
    for group in (range(240, 390),):
        todo, seen = [group[0]], {group[0]}
        while todo:
            x = todo.pop()
            more = {b if a == x else a for a, b in got if x in (a, b)} - seen
            seen |= more
            todo += more
        root[0] = seen
    assert root[0] >= set(range(240, 390))


def in_order(rows, reach, on=1):
    """Candidates and crowded nodes of the whole order, in plain Python. rows: (node, n, bands, root)."""
    pairs, crowded = set(), set()
    for k in range(similarity.BANDS):
        row = sorted((b[k], b[(k + on) % similarity.BANDS], node, n, root) for node, n, b, root in rows)
        for i, x in enumerate(row):
            for y in row[i + 1 : i + 1 + reach]:
                if x[0] == y[0] and x[4] != y[4] and min(x[3], y[3]) >= 0.8 * max(x[3], y[3]):
                    pairs.add((min(x[2], y[2]), max(x[2], y[2])))
        crowded |= {x[2] for x in row if sum(y[0] == x[0] for y in row) > reach + 1}
    return pairs, crowded


@pytest.mark.parametrize("partitions", [1, 8, 60])
def test_candidates_do_not_depend_on_partitions(spark, partitions):
    """Keys of one, a few and of most rows, cut anywhere: short partitions, a key over several of them, equal second keys."""
    r = random.Random(partitions)
    key = lambda: r.choice([1, 1, 1, 2, 3, r.randrange(1 << 40)])
    rows = [(i, r.choice([100, 110, 200]), [key() for _ in range(similarity.BANDS)], r.randrange(90)) for i in range(100)]
    frame = spark.createDataFrame(rows, "node long, n int, bands array<long>, root long")
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for reach, on in ((1, 1), (3, 5)):
            pairs, crowded = similarity.neighbours(frame, reach, (on,))
            got = {tuple(x) for x in pairs.collect()}, {x.node for x in crowded.collect()}
            assert got == in_order(rows, reach, on) and got[0] and got[1]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_crowded_keys_are_searched_further(spark):
    """Texts of one passage in whose keys a pair's two texts are seldom neighbours: the further orders find what the first leaves out."""
    r = random.Random(4)
    prose = lambda n: " ".join(f"w{r.randrange(9000)}" for _ in range(n))
    passage, texts = prose(150), []
    for _ in range(300):
        own = prose(26)
        texts += [f"{passage} {own}", near_copies(r, f"{passage} {own}", 3)]
    rows = banded(spark, texts)
    get = lambda further: {tuple(x) for x in similarity.similar(rows.select("node", "n", "bands"), rows.select("node", "text"), simhash._five_words, reach=1, further=further).collect()}
    sets = [brute.five_words(t) for t in texts]
    planted = {(a, a + 1) for a in range(0, len(texts), 2) if 5 * len(sets[a] & sets[a + 1]) >= 4 * len(sets[a] | sets[a + 1])}
    once, on = get(()), get(similarity.FURTHER)
    assert once <= on and len(planted) > 250
    assert len(once & planted) < len(on & planted) and len(on & planted) >= 0.99 * len(planted)


@pytest.mark.parametrize("block", [40, 2048])
def test_crowded_keys_are_searched_whole(spark, block):
    """Every similar pair that agrees in a band is in one group, however crowded its keys are and however little the orders find."""
    r = random.Random(5)
    prose = lambda n: " ".join(f"w{r.randrange(9000)}" for _ in range(n))
    passage, texts = prose(150), []
    for _ in range(200):
        own = prose(26)
        texts += [f"{passage} {own}", near_copies(r, f"{passage} {own}", 3)]
    rows = banded(spark, texts)
    got = {tuple(x) for x in similarity.similar(rows.select("node", "n", "bands"), rows.select("node", "text"), simhash._five_words, reach=1, further=(3,), block=block).collect()}
    sets = [similarity.shingle_set(simhash.shingle_hashes(t, 5)) for t in texts]
    keys = [similarity.band_keys(s) for s in sets]
    share = lambda a, b: any(x == y for x, y in zip(keys[a], keys[b], strict=True))
    alike = lambda a, b: 9 * len(set(sets[a].tolist()) & set(sets[b].tolist())) >= 4 * (len(sets[a]) + len(sets[b]))
    want = {(a, b) for a, b in combinations(range(len(texts)), 2) if share(a, b) and alike(a, b)}
    assert all(alike(a, b) for a, b in got) and len(want) > 150
    group = list(range(len(texts)))
    for _ in texts:
        before = list(group)
        for a, b in got:
            group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    assert not [(a, b) for a, b in want if group[a] != group[b]]


def test_parities_drop_no_similar_pair():
    """Exactly at the least similarity a pair is possible; one shingle less is told by its parities unless they clash."""
    r = random.Random(6)
    common = [r.getrandbits(64) for _ in range(400)]
    row = lambda node, more: [np.array([node]), np.array([400 + more]), np.array([node]), None]
    for more, possible in ((50, True), (90, False)):
        sides = []
        for node in (0, 1):
            s = similarity.shingle_set(common + [r.getrandbits(64) for _ in range(more)])
            sides.append([*row(node, more)[:3], np.frombuffer(similarity.parities(s), np.uint64).reshape(1, -1)])
        assert bool(sum(len(a) for a, _ in similarity._possible(*sides))) is possible


def test_five_words_by_their_ends():
    """Two shingles have one hash only if they are the same words, at every length of text."""
    texts = ["", " ", "a", "a b", "a b c", "a b c d", "a b c d e", "a b c d e f", "A b\nc D e F", "b c d e f", "a b d c", "a b c a b c a b c", "a a a a", "a a a", "a a a a a", "a a a a a a"]
    hashes = [simhash._five_words(t).tolist() for t in texts]
    words = [t.lower().split() for t in texts]
    shingles = [[tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [] for w in words]
    assert [len(h) for h in hashes] == [len(x) for x in shingles]
    flat = [(h, x) for hs, xs in zip(hashes, shingles, strict=True) for h, x in zip(hs, xs, strict=True)]
    assert len({h for h, _ in flat}) == len({x for _, x in flat}) == len(set(flat))


def test_broadcast_or_shuffle_is_the_same(spark, texts):
    rows = banded(spark, texts[:120])
    get = lambda few: {tuple(x) for x in similarity.similar(rows.filter("n > 0").select("node", "n", "bands"), rows.select("node", "text"), lambda t: simhash.shingle_hashes(t, 5), few=few).collect()}
    assert get(0) == get(10**6) != set()


def test_deduplicated_keeps_one_of_each_group(spark, texts):
    docs = spark.createDataFrame([(i * 3 + 1, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, bands string")
    kept = {r.doc_id for r in simhash.deduplicated(docs).collect()}
    by_id = {i * 3 + 1: t for i, t in enumerate(texts)}
    first = brute.components({i: brute.fingerprint(t) for i, t in by_id.items()})
    want = set(brute.similar({i: by_id[i] for i in set(first.values())}).values())
    assert want <= kept and len(kept - want) <= 0.02 * len(by_id)


def test_texts_of_one_hash_stay_apart(spark, monkeypatch):
    """Two texts that share a 64-bit hash, one of them a near copy of a third: the other one stays."""
    r = random.Random(9)
    prose = lambda: " ".join(f"w{r.randrange(3000)}" for _ in range(150))
    one, other = prose(), prose()
    docs = spark.createDataFrame([(1, one), (2, near_copies(r, one, 3)), (3, other)], "doc_id long, text string")
    first = lambda c: F.when(F.col("text").startswith(other[:40]) | F.col("text").startswith(one[:5]), F.lit(7)).otherwise(F.xxhash64(c))
    monkeypatch.setattr(simhash, "_TEXT", (first, simhash._TEXT[1]))
    assert [r.doc_id for r in simhash.deduplicated(docs).orderBy("doc_id").collect()] == [1, 3]


def test_no_texts(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.deduplicated(docs).count() == 0
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == [1, 3]


def test_agreement_of_bands():
    """A band agrees about as often as the similarity's power says."""
    r = random.Random(3)
    hits = total = 0
    for _ in range(60):
        common = [r.getrandbits(64) for _ in range(400)]
        a, b = (similarity.band_keys(similarity.shingle_set(common + [r.getrandbits(64) for _ in range(50)])) for _ in range(2))
        hits += sum(x == y for x, y in zip(a, b, strict=True))
        total += similarity.BANDS
    assert abs(hits / total - 0.8**similarity.ROWS) < 0.06
