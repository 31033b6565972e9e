"""Operator 10: substring dedup by sliding sentence spans.

A text is cut into sentences (behind . ! ? or a line break). A long sentence is cut further at
its commas, colons and bars and, failing those, behind words that a hash picks, so that the cuts
depend on the words around them alone. From every sentence on, the shortest run of at least RUN
sentences and LEAST_WORDS words is hashed, and likewise the shortest run up to every sentence at
which none of these ends; words are compared without case (A to Z) and ASCII punctuation. Runs are
joined globally, and a sentence is removed if any run that covers it isn't the first of its kind,
by (doc_id, text hash, position).

Sentences and hashes of a batch of texts are array operations over its bytes: a polynomial hash's
running sums give the hash of any run of words by one difference. A run is known by two such
hashes, of 64 and 32 bits, over different bases; a row by its doc_id and a 64-bit hash of its text.

Runs are dealt by their hash once, and within a partition every row behind the first of its run is a
removal. No partition may get a run that stands in a large part of all documents. So a first pass
over the texts lists, task by task, the hashes that make up one in HEAVY x partitions of the task's
runs: every hash with as many of all runs as an average partition is on some task's list. The listed
hashes with that share at least are at most HEAVY x partitions; they are broadcast, their firsts
found by partial aggregates, and their rows never dealt by hash. The split only decides how a run is
joined, never whether.

Texts are hashed in both passes, the same way, so a lost task gives the same rows again: hashing takes
less than a table of runs would, which is 1.3 times the texts' size on disk.

Defined cases: null and empty texts have no sentences; a text with fewer than RUN sentences or
LEAST_WORDS words has no run. A repeated row (same id and text) counts once as an occurrence and
is cut like its twin; rows of one id with different texts are told apart by the hash of the text.
A row without doc_id comes after all others. Empty tables give no rows. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelume.llm import common

RUN = 3
LEAST_WORDS = 18
LONG = 10  # words of a sentence beyond which it is cut further
BLOCK_BYTES = 2 << 20
HEAVY = 2  # a task lists the hashes of over one in HEAVY x partitions of its runs

_LAST = 1 << 62  # stands for a missing doc_id in comparisons
#: Odd, so they have inverses modulo 2 ** 64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if _WORD[b] else 32 for b in range(256))
#: 2 ends a sentence, 1 a clause.
_END = np.array([2 * (b in b".!?\n") + (b in b",;:|") for b in range(256)], np.uint8)
_powers: dict[int, list[np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of a base and of its inverse."""
    if base not in _powers or len(_powers[base][0]) <= n:
        _powers[base] = []
        for x in (base, pow(base, -1, 1 << 64)):
            steps = np.full(2 * n + 1, x, np.uint64)
            steps[0] = 1
            _powers[base].append(np.cumprod(steps, dtype=np.uint64))
    up, down = _powers[base]
    return up[: n + 1], down[: n + 1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _cut_ids(cut: np.ndarray) -> np.ndarray:
    """Number of the piece of each word; cut: pieces end behind these words."""
    return np.concatenate([[0], np.cumsum(cut[:-1])])


def block_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, check, text number, start and end (code points) of all runs of some texts."""
    none = np.empty(0, np.int64)
    raw = b"\n".join(texts) + b"\n"
    data = np.frombuffer(raw, np.uint8)
    folded = raw.translate(_FOLD)
    word = np.concatenate([[False], _WORD[data]])
    edge = np.flatnonzero(word[1:] != word[:-1])  # the last byte is no word's, so edges come in pairs
    start, behind = edge[::2], edge[1::2]
    n = len(start)
    if n < RUN:
        return none, np.empty(0, np.int32), none, none, none
    text_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    of = np.searchsorted(text_at, start, side="right") - 1

    # words one blank apart, and the running hashes over them
    joined = np.frombuffer(b" ".join(folded.split()) + b" ", np.uint8)
    at = np.concatenate([[0], np.cumsum(behind - start + 1)])  # word k is joined[at[k] : at[k + 1]], blank included
    symbols = joined.astype(np.uint64) + np.uint64(1)

    def hashing(base: int):
        power, inverse = _power(base, len(joined))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * power[:-1], dtype=np.uint64)])[at]
        inverse = inverse[at]
        return lambda a, z: _mixed((total[z] - total[a]) * inverse[a])

    spanned, checked = map(hashing, _BASES)

    ends = _END[data]
    of_kind = lambda k: np.concatenate([[0], np.cumsum(ends == k)])
    next_start = np.append(start[1:], len(data))
    sentence, clause = of_kind(2), of_kind(1)
    cut = sentence[next_start] > sentence[behind]
    comma = clause[next_start] > clause[behind]
    words = np.arange(n)
    picked = spanned(words, words + 1) % np.uint64(8) == 0
    for further in (comma, picked):
        ids = _cut_ids(cut)
        cut = cut | ((np.bincount(ids)[ids] > LONG) & further)
    cut[-1] = True
    last = np.flatnonzero(cut)
    first = np.concatenate([[0], last[:-1] + 1])
    upto = np.append(first, n)  # sentence i is words upto[i] to upto[i + 1] - 1
    m = len(first)
    text_of = of[first]
    i = np.arange(m)
    j = np.maximum(np.searchsorted(upto, upto[:-1] + LEAST_WORDS), i + RUN)
    inside = (j <= m) & (text_of[np.minimum(j, m) - 1] == text_of)
    i, j = i[inside], j[inside]
    # sentences at which no run ends: the shortest run up to there, which reaches back over the longer sentence that the next start leaves out
    ended = np.zeros(m + 1, bool)
    ended[j] = True
    z = np.flatnonzero(~ended[1:]) + 1
    back = np.minimum(np.searchsorted(upto, upto[z] - LEAST_WORDS, side="right") - 1, z - RUN)
    inside = (back >= 0) & (text_of[np.maximum(back, 0)] == text_of[z - 1])
    i, j = np.concatenate([i, back[inside]]), np.concatenate([j, z[inside]])

    # a run reaches up to the next sentence of its text, or the text's end
    a, z = start[upto[i]], np.append(start, len(data))[upto[j]]
    doc = text_of[i]
    z = np.minimum(z, text_at[doc + 1] - 1)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = points[text_at[doc]]
    check = checked(upto[i], upto[j]).astype(np.uint32).view(np.int32)
    return spanned(upto[i], upto[j]).view(np.int64), check, doc, points[a] - base, points[z] - base


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, tuple]]:
    """(ids, hashes of the texts, runs) of blocks of about BLOCK_BYTES, at least a text each. batches: doc, body, text."""
    for batch in batches:
        ids, body = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
        first = size = 0
        for k, t in enumerate(texts):
            size += len(t)
            if size >= BLOCK_BYTES or k == len(texts) - 1:
                yield ids[first : k + 1], body[first : k + 1], block_runs(texts[first : k + 1])
                first, size = k + 1, 0


def _key() -> list[Column]:
    """doc and body: the doc_id, or _LAST, and the hash of the text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("body")]


def _given(docs: DataFrame) -> DataFrame:
    return common.texts(docs).select(*_key(), "text")


def frequent_hashes(docs: DataFrame, heavy: float) -> DataFrame:
    """hash: at most heavy of them, among these all that twice the heavy-th part of all runs have."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, n = np.unique(np.concatenate([np.empty(0, np.int64), *(h for _, _, (h, *_) in blocks(batches))]), return_counts=True)
        much = n * heavy > n.sum()
        yield pa.RecordBatch.from_arrays([pa.array([None, *values[much].tolist()], pa.int64()), pa.array([int(n.sum()), *n[much].tolist()], pa.int64())], names=["hash", "n"])

    counts = common.checkpoint(_given(docs).mapInArrow(listed, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")))
    total = counts.filter("hash is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return counts.filter(F.col("hash").isNotNull() & (F.col("n") * heavy >= total) & (F.col("n") > 1)).select("hash")


def all_runs(docs: DataFrame) -> DataFrame:
    """hash, check, doc, body, place (start << 32 | end) of all runs."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, body, (h, check, doc, a, z) in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(check), pa.array(ids[doc]), pa.array(body[doc]), pa.array(a << 32 | z)], names=["hash", "check", "doc", "body", "place"])

    return _given(docs).mapInArrow(hashed, "hash long, check int, doc long, body long, place long")


def removal_spans(docs: DataFrame) -> DataFrame:
    """doc, body, cut: the merged removal spans (start, end in code points) of each document that has any."""
    frequent = frequent_hashes(docs, HEAVY * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot, none = F.broadcast(frequent), frequent.isEmpty()  # at most heavy rows: their shares add up to one
    run, place = ["hash", "check"], F.struct("doc", "body", "place")

    # no hash of these has more rows than an average partition; equal places (of a repeated row) have one rank
    cold = all_runs(docs) if none else all_runs(docs).join(hot, "hash", "left_anti")
    later = cold.withColumn("nth", F.rank().over(Window.partitionBy(*run).orderBy("doc", "body", "place"))).filter("nth > 1").select("doc", "body", "place")
    if not none:
        often = all_runs(docs).join(hot, "hash", "left_semi")
        firsts = often.groupBy(*run).agg(F.min(place).alias("first"))  # a row for each of the broadcast hashes, but for clashes
        later = later.union(often.join(F.broadcast(firsts), run).filter(place != F.col("first")).select("doc", "body", "place"))
    spans = later.distinct().groupBy("doc", "body").agg(F.sort_array(F.collect_list("place")).alias("places"))
    return spans.select("doc", "body", _merged(F.col("places")).alias("cut"))


def _merged(places: Column) -> Column:
    """Sorted places as disjoint spans."""
    start, end = (lambda p: F.shiftright(p, 32).cast("int")), (lambda p: p.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).cast("int"))
    span = lambda a, z: F.struct(a.alias("start"), z.alias("end"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    step = lambda a, p: F.when(a["end"] >= start(p), F.struct(a["out"].alias("out"), a["start"].alias("start"), F.greatest(a["end"], end(p)).alias("end"))).otherwise(
        F.struct(F.when(a["end"] < 0, a["out"]).otherwise(F.concat(a["out"], F.array(span(a["start"], a["end"])))).alias("out"), start(p).alias("start"), end(p).alias("end"))
    )
    first = F.struct(none.alias("out"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    return F.aggregate(places, first, step, lambda a: F.concat(a["out"], F.array(span(a["start"], a["end"]))))


def _with_cuts(docs: DataFrame) -> DataFrame:
    """row (the document's columns) and cut (null where nothing is removed)."""
    return docs.select(F.struct(*docs.columns).alias("row"), *_key()).join(removal_spans(docs), ["doc", "body"], "left").select("row", "cut")


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, number of removal spans, removed characters, and the spans as start:end."""
    cut = F.coalesce("cut", F.array().cast("array<struct<start:int,end:int>>"))
    return _with_cuts(docs.select("doc_id", "text")).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), F.size(cut).cast("long").alias("n_removed"),
        F.aggregate(cut, F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long").alias("removed_chars"),
        F.array_join(F.transform(cut, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("removed_spans"),
    )


def clean(docs: DataFrame) -> DataFrame:
    """docs without the removal spans; a document that loses everything keeps an empty text."""
    whole, cut = F.col("row.text"), F.col("cut")
    step = lambda a, s: F.struct(F.concat(a["out"], F.array(F.substring(whole, a["at"] + 1, s["start"] - a["at"]))).alias("out"), s["end"].alias("at"))
    left = F.aggregate(cut, F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at")), step, lambda a: F.array_join(F.concat(a["out"], F.array(F.substring(whole, a["at"] + 1, F.length(whole)))), ""))
    text = F.when(cut.isNotNull(), left).otherwise(whole)
    return _with_cuts(docs).select(*((text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
