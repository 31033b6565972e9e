"""Operator 1: best-fit packing of tokenised documents into fixed-length sequences.

Bounded-space online best-fit: a fixed number of open bins is kept in a bitset keyed by free
space. A piece goes to the open bin with the least sufficient free space; if none has room a
new bin opens, and when more than ``open_bins`` are open the fullest closes first. Pieces are
placed by CHUNK of them, the longest piece first, so the open bins see a mix of lengths.

Two stages. Tokenising is embarrassingly parallel and dominates the cost. Only the pieces'
lengths (some 50 bytes each) are then dealt by a hash of the piece to packing partitions, each
of which packs on its own: no key, however hot, decides where a piece goes. The hash, the order
within a partition and its chunks depend on the rows alone, not on the size of Arrow batches, so a
lost task packs again to the same rows.

Defined cases: a null or empty text is the end id alone (one piece of length 1). Null doc_ids
are kept. A repeated row is packed as often as it occurs. An empty table gives no rows. Only
documents longer than the capacity are cut; the first piece takes the remainder, so that every
other piece fills a sequence. The string of a special token within a text becomes that token's id,
as tokenizers has it.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelume.llm import common

CAPACITY = 1024
END_ID = 2
OPEN_BINS = 4096
VOCABULARY = "byte_bpe_50k.json"
CHUNK = 1000  # pieces that are placed together
PARTITION_BYTES = 64 << 20  # input bytes a packing partition answers for

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Bounded-space online best-fit over open bins."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.bits = 0  # bit f is set when some open bin has f free places
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.opened = self.open = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of 1 to capacity tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bins = self.by_free[free]
            where = bins.pop()
            if not bins:
                self.bits ^= 1 << free
            self.open -= 1
        else:
            free, where = self.capacity, self.opened
            self.opened += 1
        left = free - length
        if left:
            if self.open == self.open_bins:
                self._close_fullest()
            self.by_free[left].append(where)
            self.bits |= 1 << left
            self.open += 1
        return where, self.capacity - free

    def _close_fullest(self) -> None:
        free = (self.bits & -self.bits).bit_length() - 1
        bins = self.by_free[free]
        bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.open -= 1


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """text -> ids, as tokenizers' encode(text, add_special_tokens=False) gives them.

    The vocabulary and merges of the file are run by tiktoken's engine, some five times as fast
    as the tokenizers library with the same ids. A text on which that engine gives up (white space
    or letters of many megabytes) goes to the tokenizers library itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = public_tokenizers.path(vocabulary)
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocab, added = file["model"]["vocab"], {t["content"]: t["id"] for t in file["added_tokens"]}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte_of[c] for c in k): i for k, i in vocab.items() if k not in added and all(c in byte_of for c in k)}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    between = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
    slow: list = []

    def plain(text: str) -> list[int]:
        try:
            return fast.encode_ordinary(text)
        except Exception:  # tiktoken's regex engine signals its own limits by several types
            if not slow:
                slow.append(Tokenizer.from_file(path))
            return slow[0].encode(text, add_special_tokens=False).ids

    def encode(text: str) -> list[int]:
        if not any(t in text for t in added):
            return plain(text)
        return [i for part in between.split(text) if part for i in ([added[part]] if part in added else plain(part))]

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenised(docs: DataFrame, capacity: int, vocabulary: str, end_id: int) -> DataFrame:
    """One row per piece."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return common.texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(pieces, PIECES)


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    partition_bytes: int = PARTITION_BYTES,
) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset there."""
    order = F.xxhash64("doc_id", "piece", "length", "ids_crc32")
    partitions = common.partitions_for(docs, partition_bytes)
    dealt = (
        tokenised(docs, capacity, vocabulary, end_id)
        .withColumn("_order", order)
        .repartition(partitions, "_order")
        .sortWithinPartitions("_order", "doc_id", "piece")
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fit = BestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        for chunk in chunks(batches):
            lengths = chunk.column(3).to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for i in np.argsort(-lengths, kind="stable").tolist():
                sequence[i], offset[i] = fit.place(int(lengths[i]))
            cols = [*chunk.columns[:5], pa.array(base + sequence), pa.array(offset)]
            yield from pa.Table.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]).combine_chunks().to_batches()

    return dealt.drop("_order").mapInArrow(packed, PIECES + ", sequence_id long, offset long")


def chunks(batches: Iterator[pa.RecordBatch], rows: int = CHUNK) -> Iterator[pa.Table]:
    """The rows of batches, rows at a time, however the batches are cut."""
    held, n = [], 0
    for batch in batches:
        while n + batch.num_rows >= rows:
            yield pa.Table.from_batches([*held, batch.slice(0, rows - n)])
            batch, held, n = batch.slice(rows - n), [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)
