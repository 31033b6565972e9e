"""Operator 10 against plain Python."""

import random
import re
from collections import defaultdict

import pytest
import xxhash

from sitelume.llm import sentence_spans as S


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def runs(text):
    """(words, start, end) of every run, word by word."""
    text = text or ""
    words = [(m.start(), m.end(), fold(m[0])) for m in WORD.finditer(text)]
    gaps = [text[z : words[k + 1][0] if k + 1 < len(words) else len(text)] + "\n" * (k + 1 == len(words)) for k, (_, z, _) in enumerate(words)]

    def parts(ws, end):
        out = [[]]
        for k in ws:
            out[-1].append(k)
            if end(k):
                out.append([])
        return [p for p in out if p]

    picks = lambda k: int(picked(words[k][2])) == 0
    units = []
    for s in parts(range(len(words)), lambda k: re.search(r"[.!?\n]", gaps[k])):
        for c in [s] if len(s) <= S.LONG else parts(s, lambda k: re.search("[,;:|]", gaps[k])):
            units += [c] if len(c) <= S.LONG else parts(c, picks)
    found = set()
    size = lambda i, j: sum(map(len, units[i:j]))
    for i in range(len(units)):
        for j in range(i + S.RUN, len(units) + 1):
            if size(i, j) >= S.LEAST_WORDS:
                found.add((i, j))
                break
    ends = {j for _, j in found}
    for j in set(range(1, len(units) + 1)) - ends:  # where no run ends, the shortest one up to there
        for i in range(j - S.RUN, -1, -1):
            if size(i, j) >= S.LEAST_WORDS:
                found.add((i, j))
                break
    out = []
    for i, j in found:
        ks = [k for u in units[i:j] for k in u]
        out.append((tuple(words[k][2] for k in ks), words[ks[0]][0], words[ks[-1] + 1][0] if ks[-1] + 1 < len(words) else len(text)))
    return out


def picked(word):
    """The hash that picks cuts, in plain arithmetic."""
    h = sum((b + 1) * pow(S._BASES[0], k, 1 << 64) for k, b in enumerate(word.encode() + b" ")) % (1 << 64)
    h = (h ^ h >> 31) * 0xD6E8FEB86659FD93 % (1 << 64)
    return (h ^ h >> 32) % 8


def body(text):
    """The hash of a text that orders rows of one id."""
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def plain(texts):
    """Per (id, text) the removed characters."""
    places = defaultdict(set)
    for i, t in texts:
        for h, a, z in runs(t):
            places[h].add((S._LAST if i is None else i, body(t), a << 32 | z, t))
    gone = defaultdict(set)
    for p in places.values():
        for i, _, az, t in sorted(p)[1:]:
            gone[i, t] |= set(range(az >> 32, az & 0xFFFFFFFF))
    return gone


def compare(docs):
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    gone = plain(texts)
    by_id = defaultdict(list)
    for r in S.clean(docs).collect():
        by_id[r.doc_id].append(r.text)
    want = defaultdict(list)
    for r in docs.collect():
        cut = gone[S._LAST if r.doc_id is None else r.doc_id, r.text]
        want[r.doc_id].append(None if r.text is None else "".join(c for k, c in enumerate(r.text) if k not in cut))
    assert {k: sorted(v, key=str) for k, v in by_id.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    found = S.find(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        sums = [len(g) for (i, _), g in gone.items() if i == (S._LAST if r.doc_id is None else r.doc_id)]
        assert r.removed_chars in [*sums, 0]
        assert sum(int(s.split(":")[1]) - int(s.split(":")[0]) for s in r.removed_spans.split(",") if s) == r.removed_chars
        assert (r.n_removed > 0) == (r.removed_chars > 0)


def test_runs_of_a_block(odd_texts):
    texts = [*(t for t in odd_texts if len(t or "") < 100_000), "a b. c d! e f? g h\ni j k l m n o p.", "x, y, " * 30 + "z | " * 40, "w" + " w1 w2 w3" * 30]
    h, check, doc, a, z = S.block_runs([(t or "").encode() for t in texts])
    want = sorted((k, x, y) for k, t in enumerate(texts) for _, x, y in runs(t))
    assert sorted(zip(doc.tolist(), a.tolist(), z.tolist(), strict=True)) == want
    assert len(S.block_runs([])[0]) == 0
    said = {(k, x, y): w for k, t in enumerate(texts) for w, x, y in runs(t)}
    by_hash = defaultdict(set)
    for key, one, two in zip(zip(doc.tolist(), a.tolist(), z.tolist(), strict=True), h.tolist(), check.tolist(), strict=True):
        by_hash[said[key]].add((one, two))
    assert all(len(x) == 1 for x in by_hash.values()) and len({x for v in by_hash.values() for x in v}) == len(by_hash)


@pytest.mark.parametrize("which", ["odd_docs", "small_docs", "no_docs"])
def test_tables(which, request):
    compare(request.getfixturevalue(which))


def test_planted_passages(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8)))
    prose = lambda n: " ".join(word() + r.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))
    passages = [prose(55), " ".join(word() for _ in range(60)), prose(80).upper()]
    rows = [(i, prose(40) + " " + passages[i % 3] + " " + prose(40)) for i in range(60)] + [(i, prose(150)) for i in range(100, 130)]
    found = {x.doc_id: x.n_removed for x in S.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i] == 0 for i in [0, 1, 2, *range(100, 130)]) and all(found[i] > 0 for i in range(3, 60))


def test_tail_of_a_passage(spark):
    """A repeated passage goes up to its last short sentence."""
    passage = "One long sentence of the passage stands here with ten. And then another one of nine words follows it. Here is one more. So it. Is. Done now."
    docs = spark.createDataFrame([(i, f"{x} own words lead in here. {passage} {x} own words lead out of it again at the end.") for i, x in enumerate(("First", "Second"))], "doc_id long, text string")
    out = {r.doc_id: r.text for r in S.clean(docs).collect()}
    assert passage in out[0] and "Is. Done" not in out[1] and out[1].endswith("Second own words lead out of it again at the end.")


def test_hot_hashes_change_nothing(spark, monkeypatch):
    r = random.Random(2)
    passage = "This is. A passage, that. Stands in very many. Of all the texts. And is longer than a dozen words, much longer."
    docs = spark.createDataFrame([(i, " ".join(str(r.random()) for _ in range(20)) + ". " + passage * (i % 3 > 0) + " Own end.") for i in range(200)], "doc_id long, text string")
    get = lambda: sorted(map(tuple, S.find(docs).collect()))
    listed = lambda heavy: {x.hash for x in S.frequent_hashes(docs, heavy).collect()}
    monkeypatch.setattr(S, "HEAVY", 0.001)
    cold = get()
    monkeypatch.setattr(S, "HEAVY", 50)
    n = defaultdict(int)
    for x in S.all_runs(docs).collect():
        n[x.hash] += 1
    total = sum(n.values())
    for heavy in (30, 400):
        assert {h for h, k in n.items() if k * heavy >= 2 * total} <= listed(heavy) and len(listed(heavy)) <= heavy
    assert listed(400) and not listed(0.01)
    assert get() == cold
    compare(docs)


def test_a_row_repeated_very_often(spark):
    text = " ".join(f"Word{i} and, other{i} ones. So it{i} is." for i in range(12))
    docs = spark.createDataFrame([(7, text)] * 3000 + [(9, text), (None, text + " More of it."), (None, "x"), (None, "y")], "doc_id long, text string").repartition(5)
    compare(docs)
    assert [r.n_removed for r in S.find(docs).filter("doc_id = 7").distinct().collect()] == [0]
