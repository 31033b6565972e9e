"""Operator 11: spelling variants of words, without making pairs of words.

Words are the maximal runs of letters of all texts, A to Z in lower case. Two words are near if one inserted,
deleted or replaced character makes one of the other. A word's form is its most frequent near word, if that
is DOMINANT times as frequent at least; its root is what following forms ends at.

Replacements: a word has a wildcard for each of its positions, known by the length, the position and a
hash of all other characters. Words that share a wildcard differ there alone. A wildcard's group keeps its
size and its two most frequent words; each of its words counts size - 1 near words and takes the first word
or, being the first itself, the second. A group has one word for each letter of the alphabet at most.
Insertions and deletions: a word's distinct deletions (one for each run of equal letters) join the
vocabulary by hash; each hit counts for both of its words. All of these are partial sums and minima by word,
combined in one aggregate.

Characters are hashed with their position (two mixed sums of 64 bits), so the hashes of all wildcards and
deletions of a word come from running sums, in time and space proportional to its length. Words are known by
their place in the vocabulary's order, so ties are decided by a comparison of numbers, and a long word isn't
copied once for each of its letters.

Words are counted text by text and batch by batch in the tasks, then summed by word; a text of any length is
counted in pieces. The hash that spoils a word (contract of the query) is taken once for each distinct word
of a text.

Defined cases: null and empty texts have no words; a null doc_id is written as nothing where words are
spoiled; repeated rows count as often as they stand there. An empty table, or one without words frequent
enough, gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelume.llm.common import Folder, checkpoint, placed, texts

RUNS = "[A-Za-zÀ-ÿ]+"
LEAST_CHARS = 6
LEAST_TIMES = 5
DOMINANT = 5
SPOIL_EVERY = 199
PIECE = 1 << 20  # characters of a text that are counted at once
WORDS_HELD = 200_000  # distinct words after which a task passes on its counts
CHARS_AT_ONCE = 1 << 18  # of words whose variants are made at once

_LOWER = {c: c + 32 for c in range(65, 91)}
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def runs(text: str) -> Counter:
    """How often each run of letters stands in a text, as it is written."""
    run, out, at = re.compile(RUNS), Counter(), 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text) and (cut := run.match(text, end)) and run.match(text, end - 1):
            end = cut.end()  # a run isn't cut
        out.update(run.findall(text, at, end))
        at = end
    return out


def words_of(doc_id: int | None, text: str, every: int = SPOIL_EVERY) -> Counter:
    """The words of a text; where every divides a word's hash in this document, it has lost a letter."""
    lowered: Counter = Counter()
    for run, n in runs(text).items():
        lowered[run.translate(_LOWER)] += n
    out: Counter = Counter()
    head = f"{'' if doc_id is None else doc_id}:"
    for word, n in lowered.items():
        h = zlib.crc32((head + word).encode())
        if every and h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out[word] += n
    return out


def vocabulary(docs: DataFrame, every: int = SPOIL_EVERY) -> DataFrame:
    """word, n of the words that are long and frequent enough."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in words_of(doc_id, text.as_py() or "", every).items():
                    if len(word) >= LEAST_CHARS:
                        held[word] += n
                if len(held) >= WORDS_HELD:
                    yield given()
                    held.clear()
        if held:
            yield given()

    counts = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counted, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TIMES)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _placed_characters(characters: np.ndarray, position: np.ndarray, seed: np.uint64) -> np.ndarray:
    return _mixed(_mixed(position.astype(np.uint64) * np.uint64(2) + seed) ^ characters.astype(np.uint64))


def variants(words: list[str]) -> dict[str, np.ndarray]:
    """Hashes of words, their wildcards and their deletions, as arrays over all characters of the words.

    of: word number of each character; position: in its word; size: of its word; wild0, wild1: the word without
    what stands at the position; less0, less1: the word with it deleted; first: whether it begins a run of equal
    letters; whole0, whole1: by word.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    characters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    of = np.repeat(np.arange(len(words)), sizes)
    position = np.arange(len(characters)) - start[of]
    out = {"of": of, "position": position, "size": sizes[of], "first": (position == 0) | (characters != np.concatenate([characters[:1], characters[:-1]]))}
    end = start + sizes
    for k, seed in enumerate(_SEEDS):
        here = _placed_characters(characters, position, seed)
        moved = _placed_characters(characters, np.maximum(position - 1, 0), seed)  # as it stands once a letter before it is gone
        running, shifted = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (here, moved))
        whole = running[end] - running[start]
        at = np.arange(len(characters))
        out[f"whole{k}"] = whole.view(np.int64)
        out[f"wild{k}"] = (whole[of] - here).view(np.int64)
        out[f"less{k}"] = (running[at] - running[start][of] + shifted[end][of] - shifted[at + 1]).view(np.int64)
    return out


def _pieces(words: list[str]) -> Iterator[slice]:
    """Slices of some words of about CHARS_AT_ONCE characters together."""
    begin, size = 0, 0
    for k, word in enumerate(words):
        size += len(word)
        if size >= CHARS_AT_ONCE:
            yield slice(begin, k + 1)
            begin, size = k + 1, 0
    if begin < len(words):
        yield slice(begin, len(words))


WILDCARD, DELETION, WORD = 0, 1, 2
_VARIANT = "kind tinyint, size int, position int, k0 long, k1 long, id long, n long"


def keyed(words: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
    """A row of each variant, of the given kinds, of words (id, word, n). size: characters of what is hashed; position: of a wildcard, else 0."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, written = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for piece in _pieces(written):
                v, own, n = variants(written[piece]), ids[piece], counts[piece]
                of, first = v["of"], v["first"]
                sizes = np.array([len(w) for w in written[piece]])
                rows = {
                    WILDCARD: (v["size"], v["position"], v["wild0"], v["wild1"], own[of], n[of]),
                    DELETION: (v["size"][first] - 1, np.zeros(first.sum(), np.int64), v["less0"][first], v["less1"][first], own[of][first], n[of][first]),
                    WORD: (sizes, np.zeros(len(sizes), np.int64), v["whole0"], v["whole1"], own, n),
                }
                for kind in kinds:
                    size, position, k0, k1, i, m = rows[kind]
                    columns = [pa.array(np.full(len(i), kind, np.int8)), pa.array(size.astype(np.int32)), pa.array(position.astype(np.int32)), pa.array(k0), pa.array(k1), pa.array(i), pa.array(m)]
                    yield pa.RecordBatch.from_arrays(columns, names=["kind", "size", "position", "k0", "k1", "id", "n"])

    return words.select("id", "n", "word").mapInArrow(made, _VARIANT)


def _near(count: Column, n: Column, id: Column) -> list[Column]:  # noqa: A002
    """count near words, the most frequent of which (of equal ones, the first in the words' order) occurs n times and has this id."""
    return [count.cast("long").alias("n_near"), F.struct((-n).alias("less"), id.alias("id")).alias("best")]


def replaced(words: DataFrame) -> DataFrame:
    """id, n_near, best of the words that a replacement makes others of, for each wildcard that is shared."""
    key = ["size", "position", "k0", "k1"]
    groups = keyed(words, (WILDCARD,)).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "id"))).alias("group")).filter(F.size("group") > 1)
    kept = groups.select(F.size("group").alias("n_words"), F.get("group", F.lit(0)).alias("first"), F.get("group", F.lit(1)).alias("second"), F.explode(F.col("group")["id"]).alias("id"))
    best = F.when(F.col("id") == F.col("first.id"), F.col("second")).otherwise(F.col("first"))
    return kept.select("id", *_near(F.col("n_words") - 1, -best["less"], best["id"]))


def lengthened(words: DataFrame) -> DataFrame:
    """id, n_near, best of the words that an insertion or a deletion makes others of, for each such step."""
    key = ["size", "k0", "k1"]
    whole = keyed(words, (WORD,)).select(*key, F.col("id").alias("short"), F.col("n").alias("short_n"))
    hits = keyed(words, (DELETION,)).select(*key, F.col("id").alias("long"), F.col("n").alias("long_n")).join(whole, key)
    sides = F.array(F.struct(F.col("long").alias("id"), *_near(F.lit(1), F.col("short_n"), F.col("short"))), F.struct(F.col("short").alias("id"), *_near(F.lit(1), F.col("long_n"), F.col("long"))))
    return hits.select(F.inline(sides))


def rooted(forms: DataFrame) -> DataFrame:
    """id, root of each word of forms (id, form: null where there is none): forms followed to the last one.

    Each round replaces what a word points at by what that one points at, so paths halve; only whether any
    pointer moved reaches the driver. A form is more frequent than its word, so there are no circles.
    """
    at = checkpoint(forms.select("id", F.coalesce("form", "id").alias("root")))
    while True:
        further = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = checkpoint(at.join(further, "root").select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        at = moved.select("id", "root")
        if moved.filter("moved").isEmpty():
            return at


def variants_of(docs: DataFrame, every: int = SPOIL_EVERY) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the vocabulary."""
    with Folder(docs.sparkSession, "spelling") as folder:
        words = folder.put(placed(folder, vocabulary(docs, every).withColumn("all", F.lit(0)), "all", ["word"]).select(F.col("place").alias("id"), "word", "n"))
        near = replaced(words).unionByName(lengthened(words)).groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
        enough = -F.col("best.less") >= DOMINANT * F.col("n")
        judged = folder.put(words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.id")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
        pointed = judged.join(rooted(judged), "id")
        named = lambda c: judged.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"))
        out = pointed.join(named("form"), "form", "left").join(named("root"), "root")
        return checkpoint(out.select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n"))
