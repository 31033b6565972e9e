"""Operator 4: benchmark decontamination with an FM-index per training shard.

Each task cuts its documents into shards, indexes a shard (fm_index.py), searches all windows of
the benchmark backward through the index, locates the occurrences and merges them into removal
spans. Documents never leave their task: nothing is shuffled and no passage, however often it
occurs, gathers rows anywhere.

Only runs of benchmark words that are long enough for a window get into the index; a window
cannot occur elsewhere. The benchmark side is the query set. Its distinct items are read in blocks of
about BLOCK_BYTES of text, each shipped to the tasks; several blocks mean as many passes over the
documents, in which each row carries what it was found to hold along, so that a large benchmark
costs time but not memory, and no row ever has to be told from its twin.

Words are runs of characters other than ASCII punctuation, space and controls, after lower-casing
A to Z. A window is WINDOW consecutive words of an item; a shorter item is one window.

Defined cases: null and empty texts have no words and no hits. Null doc_ids and repeated rows
stay, one result row per input row. An item without words matches nothing; items with the same
id count once; hits of an item without an id count, but the item can't be listed. Empty tables
give no rows, or no hits. Columns of the documents with other names pass through clean().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelume.llm.common import checkpoint, texts

WINDOW = 10
BLOCK_BYTES = 4 << 20
SHARD_WORDS = 1 << 20  # indexed words
SHARD_BYTES = 32 << 20  # text of the documents in a shard
MOST_HIT = 0.5  # clean() drops documents with a larger share of words hit

_WORD = re.compile(rb"[^ ]+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def folded(text: str | None) -> bytes:
    """UTF-8 with A-Z lowered and a blank for every byte outside words."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


@dataclass(frozen=True)
class Block:
    """A block of the query set. Windows are right-aligned rows of word numbers from 1."""

    words: list[bytes]
    windows: np.ndarray
    lengths: np.ndarray
    owner_at: np.ndarray  # window w is of owners[owner_at[w] : owner_at[w + 1]]
    owners: np.ndarray
    items: list[str | None]


def block(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Block | None:
    number: dict[bytes, int] = {}
    names: dict[str | None, int] = {}
    rows, lengths, owners = [], [], []
    for name, text in items:
        ids = np.array([number.setdefault(w, len(number) + 1) for w in folded(text).split()], np.int32)
        if not len(ids):
            continue
        n = min(window, len(ids))
        views = np.lib.stride_tricks.sliding_window_view(ids, n)
        padded = np.zeros((len(views), window), np.int32)
        padded[:, window - n :] = views
        rows.append(padded)
        lengths.append(np.full(len(views), n))
        owners.append(np.full(len(views), names.setdefault(name, len(names))))
    if not rows:
        return None
    unique, of = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    pairs = np.unique(np.column_stack([of.ravel(), np.concatenate(owners)]), axis=0)
    at = np.searchsorted(pairs[:, 0], np.arange(len(unique) + 1))
    return Block(list(number), unique, (unique > 0).sum(axis=1), at, pairs[:, 1], list(names))


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES, window: int = WINDOW) -> tuple[int, Iterator[Block]]:
    """Number of blocks of about block_bytes, and the blocks one after the other; each is bounded as it is collected.

    Items are dealt by a hash of id and text, repeated ones once: a block holds its share, or one item of any size.
    """
    sized = items.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text <> ''").distinct()
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))

    def each() -> Iterator[Block]:
        for k in range(n):
            part = sized if n == 1 else sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
            if (b := block([(r.item_id, r.text) for r in part.collect()], window)) is not None:
                yield b

    return n, each()


#: A query set that nothing matches.
_NOTHING = Block([b"-"], np.array([[1]], np.int32), np.array([1]), np.array([0, 0]), np.empty(0, np.int64), [])


class _Shard:
    """Runs of the documents' benchmark words that may hold a window."""

    def __init__(self, b: Block) -> None:
        self.b, self.number, self.least = b, {w: i + 1 for i, w in enumerate(b.words)}, int(b.lengths.min())
        self.parts: list[np.ndarray] = []
        self.run_doc: list[np.ndarray] = []
        self.run_word: list[np.ndarray] = []
        self.run_length: list[np.ndarray] = []
        self.n_words: list[int] = []
        self.indexed = 0

    def add(self, text: str | None) -> None:
        words = folded(text).split()
        ids = np.fromiter(map(self.number.get, words, _zeros()), np.int32, len(words))
        known = np.concatenate([[0], (ids > 0).view(np.int8), [0]])
        edge = np.diff(known)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - start >= self.least
        start, end = start[long], end[long]
        for a, z in zip(start.tolist(), end.tolist(), strict=True):
            self.parts.append(ids[a:z])
            self.parts.append(_SEPARATOR)
        self.run_doc.append(np.full(len(start), len(self.n_words)))
        self.run_word.append(start)
        self.run_length.append(end - start)
        self.n_words.append(len(words))
        self.indexed += int((end - start).sum()) + len(start)

    def hits(self) -> tuple[list[list[tuple[int, int]]], list[list[str | None]]]:
        """Per document the merged spans (first word, word behind) and the items found."""
        docs = len(self.n_words)
        spans: list[list[tuple[int, int]]] = [[] for _ in range(docs)]
        items: list[list[str | None]] = [[] for _ in range(docs)]
        if not self.parts:
            return spans, items
        from sitelume.llm.fm_index import FmIndex

        b, text = self.b, np.concatenate(self.parts)
        doc, word, length = (np.concatenate(x) for x in (self.run_doc, self.run_word, self.run_length))
        index = FmIndex(text, len(b.words) + 1)
        low, high = index.search(b.windows, b.lengths)
        found = np.flatnonzero(low < high)
        count = (high - low)[found]
        which = np.repeat(found, count)
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[found], count)
        at = index.locate(rows)
        run_at = np.concatenate([[0], np.cumsum(length + 1)])
        cover = np.zeros(len(text) + 1, np.int32)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + b.lengths[which], -1)
        edge = np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).view(np.int8)]))
        for a, z in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            run = int(np.searchsorted(run_at, a, side="right")) - 1
            first = int(word[run]) + a - int(run_at[run])
            spans[doc[run]].append((first, first + z - a))
        in_doc = doc[np.searchsorted(run_at, at, side="right") - 1]
        pairs = np.unique(in_doc * len(b.windows) + which)
        of, w = pairs // len(b.windows), pairs % len(b.windows)
        owned = np.diff(b.owner_at)[w]
        owner = b.owners[np.arange(owned.sum()) - np.repeat(np.cumsum(owned) - owned, owned) + np.repeat(b.owner_at[w], owned)]
        for x in np.unique(np.repeat(of, owned) * len(b.items) + owner).tolist():
            items[x // len(b.items)].append(b.items[x % len(b.items)])
        return spans, items


_SEPARATOR = np.zeros(1, np.int32)


def _zeros() -> Iterator[int]:
    while True:
        yield 0


def _shards(batches: Iterator[pa.RecordBatch], b: Block, column: int) -> Iterator[tuple[pa.RecordBatch, int, list, list]]:
    """(batch, words of each row, spans, items) for slices of batches, a shard at a time."""
    shard, held, size = _Shard(b), [], 0

    def flush() -> Iterator:
        spans, items = shard.hits()
        k = 0
        for part in held:
            n = part.num_rows
            yield part, shard.n_words[k : k + n], spans[k : k + n], items[k : k + n]
            k += n

    for batch in batches:
        first = 0
        for i, text in enumerate(batch.column(column).to_pylist()):
            shard.add(text)
            size += len(text or "")
            if shard.indexed >= SHARD_WORDS or size >= SHARD_BYTES:
                held.append(batch.slice(first, i + 1 - first))
                yield from flush()
                shard, held, size, first = _Shard(b), [], 0, i + 1
        if first < batch.num_rows:
            held.append(batch.slice(first))
    yield from flush()


_FOUND = "n_words long, spans array<struct<first:int,behind:int>>, items array<string>"
_SPAN = pa.list_(pa.struct([("first", pa.int32()), ("behind", pa.int32())]))


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (merged, in words) and items (ids with occurring windows, sorted as strings)."""
    n, parts = blocks(items, block_bytes, window)
    few = texts(docs).select("doc_id", "text")
    kind = dict(few.dtypes)["doc_id"]

    def listed(n_words: list[int], spans: list[list[tuple[int, int]]], names: list[list[str | None]]) -> list[pa.Array]:
        pairs = pa.array([[{"first": x, "behind": y} for x, y in s] for s in spans], _SPAN)
        return [pa.array(n_words, pa.int64()), pairs, pa.array([sorted({x for x in i if x is not None}) for i in names], pa.list_(pa.string()))]

    if n == 1:
        b = next(parts, _NOTHING)

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, n_words, spans, names in _shards(batches, b, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), *listed(n_words, spans, names)], names=["doc_id", "n_words", "spans", "items"])

        return few.mapInArrow(found, f"doc_id {kind}, {_FOUND}")

    def searched(out: DataFrame, b: Block) -> DataFrame:
        def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, n_words, spans, names in _shards(batches, b, 1):
                both = [merged([*((x["first"], x["behind"]) for x in old), *s]) for old, s in zip(part.column(3).to_pylist(), spans, strict=True)]
                items = [[*old, *i] for old, i in zip(part.column(4).to_pylist(), names, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *listed(n_words, both, items)], names=["doc_id", "text", "n_words", "spans", "items"])

        return out.mapInArrow(more, f"doc_id {kind}, text string, {_FOUND}")

    nothing = (F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<first:int,behind:int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    out, passes = few.select("doc_id", "text", *nothing), 0
    for passes, b in enumerate(parts, 1):
        out = checkpoint(searched(out, b))  # a pass is done with before the next block is read
    return (out if passes else searched(out, _NOTHING)).drop("text")


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0), lambda a, s: a + s["behind"] - s["first"])
    return found.select(
        "doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(folded(text))]
    out, done = [], 0
    for a, z in spans:
        out.append(raw[done : at[a][0]])
        done = at[z - 1][1]
    return b"".join([*out, raw[done:]]).decode("utf-8", "surrogatepass")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(z, out[-1][1])
        else:
            out.append((a, z))
    return out


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, most_hit: float = MOST_HIT) -> DataFrame:
    """docs without the removal spans; documents hit in more than most_hit of their words are dropped.

    n_chars, where there is one, follows a changed text. Every block of the query set searches the
    uncut texts; its spans go along with the row, and the last pass cuts them all and judges most_hit.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = docs.columns
    column = names.index("text")
    schema = to_arrow_schema(docs.schema)
    carried = "spans" + "_" * max(map(len, names))  # no column of the documents is called so
    n, parts = blocks(items, block_bytes, window)

    def searched(out: DataFrame, b: Block) -> DataFrame:
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, _, spans, _ in _shards(batches, b, column):
                both = [merged([*((x["first"], x["behind"]) for x in old), *s]) for old, s in zip(part.column(len(names)).to_pylist(), spans, strict=True)]
                pairs = pa.array([[{"first": x, "behind": y} for x, y in s] for s in both], _SPAN)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pairs], names=[*names, carried])

        return out.mapInArrow(found, out.schema)

    def kept(part: pa.RecordBatch, n_words: list[int], spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        hit = [sum(z - a for a, z in s) for s in spans]
        stay = [k for k, h in enumerate(hit) if h <= most_hit * n_words[k]]
        texts = part.column(column).to_pylist()
        new = pa.array([cut(texts[k], spans[k]) if hit[k] else texts[k] for k in stay], pa.string())
        rest = part.take(pa.array(stay, pa.int64()))
        cols = [new.cast(schema.field(j).type) if j == column else rest.column(j) for j in range(len(names))]
        if "n_chars" in names:
            j = names.index("n_chars")
            old = cols[j].to_pylist()
            cols[j] = pa.array([len(t) if hit[k] else o for k, t, o in zip(stay, new.to_pylist(), old, strict=True)], schema.field(j).type)
        return pa.RecordBatch.from_arrays(cols, names=names)

    if n == 1:
        b = next(parts, _NOTHING)

        def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, n_words, spans, _ in _shards(batches, b, column):
                yield kept(part, n_words, spans)

        return texts(docs).mapInArrow(cleaned, docs.schema)

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            n_words = [len(folded(t).split()) for t in part.column(column).to_pylist()]
            yield kept(part, n_words, [[(x["first"], x["behind"]) for x in s] for s in part.column(len(names)).to_pylist()])

    out = texts(docs).withColumn(carried, F.array().cast("array<struct<first:int,behind:int>>"))
    for b in parts:
        out = checkpoint(searched(out, b))  # a pass is done with before the next block is read
    return out.mapInArrow(cut_all, docs.schema)
