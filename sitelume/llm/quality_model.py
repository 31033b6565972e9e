"""Operator 9: a quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; unlabelled ones are web text as it comes. The model
minimises the non-negative unbiased risk

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

with the logistic loss, so scores are estimates of P(label 1). The class prior is estimated from
positives and unlabelled text alone: a first classifier tells the two apart, and its odds where
positives are surest bound the positives' share of the unlabelled text.

The model is fitted on the driver on a bounded sample: at most SAMPLE positives and SAMPLE
unlabelled documents, chosen by a hash of doc_id, of several rows of an id the one of the least text
hash; rows of the held-out fold take no part. What reaches the driver are their feature vectors,
at most 2 * SAMPLE, a bounded number of bytes each. Scoring is one pass over all texts, each scored
whole and on its own; nothing is shuffled but the sample's ids and texts.

Features: text statistics (lengths, repetition, symbols, case, lines) in quantile bins, and hashed
words. Labels, language, source and doc_id are never inputs.

Defined cases: null and empty texts have the statistics of nothing and get a score like any text.
Null doc_ids are scored, count as not held out and are never sampled. Repeated rows stay, one
result row per input row, and are fitted once. A document with labels of both kinds is a positive. Without positives or without unlabelled text every score is the prior
(0.5 if nothing is known). An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelume.llm.common import texts

SAMPLE = 6000
HASHED = 2048
BINS = 12
FOLDS = 5
THRESHOLD = 0.3
STATISTICS = 14

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOL = b"#*$%&|<>{}[]\\~^_=+/@"
_PUNCTUATION = b".,;:!?\"'()-"
_WIDE = bytes(range(128, 256))


def statistics(text: str | None) -> tuple[list[float], list[int]]:
    """Statistics of a text, and its distinct words' hashes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    words = raw.translate(_LOWER).split()
    distinct = set(words)
    w = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    of = lambda some: (len(raw) - len(raw.translate(None, some))) / n
    short = sum(len(x) <= 3 for x in words)
    return [
        np.log1p(len(words)), len(raw) / w, len(distinct) / w, of(_SYMBOL), of(_DIGIT), of(_UPPER), of(_PUNCTUATION), of(_WIDE),
        short / w, len(lines) / w, (len(lines) - len(set(lines))) / max(1, len(lines)), max(map(len, words), default=0) / 100,
        sum(x[-1:] in (b".", b"!", b"?") for x in lines) / max(1, len(lines)), len(distinct) / np.sqrt(w),
    ], sorted({zlib.crc32(x) % HASHED for x in distinct})


@dataclass(frozen=True)
class Model:
    edges: np.ndarray  # of the bins, one row per statistic
    weights: np.ndarray  # bins of the statistics, then hashed words
    bias: float
    prior: float

    def scores(self, stats: np.ndarray, hashed: list[list[int]]) -> np.ndarray:
        bins = binned(stats, self.edges)
        word = self.weights[STATISTICS * BINS :]
        z = self.bias + self.weights[bins].sum(axis=1) + np.array([word[h].sum() / np.sqrt(len(h)) if h else 0.0 for h in hashed])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def binned(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Feature number of each statistic's bin."""
    return np.column_stack([k * BINS + np.searchsorted(edges[k], stats[:, k], side="right") for k in range(STATISTICS)])


def _matrix(stats: np.ndarray, hashed: list[list[int]], edges: np.ndarray) -> np.ndarray:
    x = np.zeros((len(stats), STATISTICS * BINS + HASHED), np.float32)
    np.put_along_axis(x, binned(stats, edges), 1, axis=1)
    for row, h in zip(x, hashed, strict=True):
        if h:
            row[STATISTICS * BINS + np.array(h)] = 1 / np.sqrt(len(h))
    return x


def _adam(x: np.ndarray, slope, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Minimise by the slopes of the risk in the margins, slope(z) of each row."""
    w, m, v = (np.zeros(x.shape[1] + 1, np.float64) for _ in range(3))
    penalty = np.full(len(w), decay)
    penalty[-1] = 0
    for t in range(1, steps + 1):
        g = slope(x @ w[:-1].astype(np.float32) + w[-1])
        grad = np.append(x.T @ g.astype(np.float32), g.sum()) + penalty * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def estimate_prior(x: np.ndarray, n_p: int) -> float:
    """Share of positives in the unlabelled rows (those behind the first n_p).

    odds(p : u) = n_p / n_u * p(x | 1) / p(x) is at most n_p / n_u / prior, and reaches it where text
    is surely positive. Unlabelled text surely not positive lowers the odds there and raises them
    elsewhere, so the odds' mean over positives in the upper half is taken for the bound.
    """
    n_u = len(x) - n_p
    label = np.arange(len(x)) < n_p
    weight = np.where(label, 0.5 / n_p, 0.5 / n_u)  # as if both were as many
    w, b = _adam(x, lambda z: weight * (_sigmoid(z) - label), 200, 0.05, 2e-3)
    z = x[:n_p] @ w.astype(np.float32) + b
    ratio = np.exp(np.clip(z, -4, 4))  # p(x | 1) / p(x)
    return float(np.clip(1 / np.median(ratio), 0.05, 0.98))


def fit(positive: tuple[np.ndarray, list], unlabelled: tuple[np.ndarray, list], prior: float | None = None, steps: int = 1000) -> Model:
    """The model of two bounded samples (statistics, hashed words)."""
    n_p, n_u = len(positive[0]), len(unlabelled[0])
    if not n_p or not n_u:
        return Model(np.zeros((STATISTICS, BINS - 1)), np.zeros(STATISTICS * BINS + HASHED), 0.0, 0.5)
    stats = np.concatenate([positive[0], unlabelled[0]])
    edges = np.quantile(unlabelled[0], np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    x = _matrix(stats, [*positive[1], *unlabelled[1]], edges)
    pi = estimate_prior(x, n_p) if prior is None else prior

    def slope(z: np.ndarray) -> np.ndarray:
        s = _sigmoid(z)
        log_neg = np.logaddexp(0, z)  # logistic loss of label 0
        negative = log_neg[n_p:].mean() - pi * log_neg[:n_p].mean()
        up, down = np.zeros_like(z), np.zeros_like(z)
        up[:n_p] = pi / n_p * (s[:n_p] - 1)
        down[n_p:], down[:n_p] = s[n_p:] / n_u, -pi / n_p * s[:n_p]
        return up + down if negative >= 0 else -down  # below zero the negative part is climbed back

    w, b = _adam(x, slope, steps, 0.05, 1e-5)
    return Model(edges, w, b, pi)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _features(docs: DataFrame) -> DataFrame:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in both], pa.list_(pa.float64())), pa.array([h for _, h in both], pa.list_(pa.int32()))], names=["doc_id", "stats", "hashed"])

    return texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counted, "doc_id long, stats array<double>, hashed array<int>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, prior: float | None = None) -> Model:
    """Fit on at most 2 * sample documents outside the held-out fold."""
    order = F.xxhash64("doc_id")
    chosen = lambda ids: [r.doc_id for r in ids.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct().orderBy(order, "doc_id").limit(sample).collect()]
    positive = set(chosen(labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))))
    unlabelled = set(chosen(docs.select(F.col("doc_id").cast("long").alias("doc_id"))))
    wanted = docs.sparkSession.createDataFrame([(i,) for i in sorted(positive | unlabelled)], "doc_id long")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted), "doc_id", "left_semi")  # at most 2 * sample ids
    # of an id's rows one: their hashes are compared first, so that texts aren't kept for each of them
    hashed = given.select("doc_id", "text", F.xxhash64("text").alias("h"), F.xxhash64(F.lit("second"), "text").alias("g"))
    least = hashed.groupBy("doc_id").agg(F.min(F.struct("h", "g")).alias("least"))  # at most 2 * sample rows
    sampled = hashed.join(F.broadcast(least), "doc_id").filter(F.struct("h", "g") == F.col("least")).groupBy("doc_id").agg(F.first("text").alias("text"))
    rows: dict[int, tuple] = {r.doc_id: (r.stats, r.hashed) for r in _features(sampled).collect()}
    part = lambda ids: (np.array([rows[i][0] for i in sorted(ids) if i in rows]).reshape(-1, STATISTICS), [rows[i][1] for i in sorted(ids) if i in rows])
    return fit(part(positive), part(unlabelled), prior)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [statistics(t) for t in batch.column(1).to_pylist()]
            s = model.scores(np.array([x for x, _ in both]).reshape(-1, STATISTICS), [h for _, h in both])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    out = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
