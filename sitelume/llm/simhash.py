"""Operator 5: SimHash near-duplicates by multi-index hashing.

A document's fingerprint is the bitwise majority over the XXH64 of its three-word shingles.
Documents with one fingerprint collapse to one row of the table, whatever their number, and only
distinct fingerprints are searched for links of up to two differing bits.

The fingerprint's halves are two segments. Two bits can differ as (0, any) or (1, at most 1) in
the high half, or else leave the low half alone: so the high half is looked up in a Hamming ball
of radius one and the low half exactly. For a differing bit one of the pair has it set, so a
probe only clears set bits, about half of the ball. The fetched candidates are verified on the
complete fingerprint.

A bucket (one value of one segment) with more than HOT fingerprints would make all pairs. There
the other segment's ball is enumerated too, clearing and moving up to the bits still allowed, and
the complete fingerprint is looked up: a bounded number of probes per fingerprint, and never more
rows than links. Links are therefore complete at any skew, with no cap.

Links join components (components.py). Each document then takes the component of its fingerprint,
and the component's smallest doc_id.

Defined cases: a null or wordless text has the fingerprint zero, which links like any other; a
text of fewer than three words is one shingle. A null doc_id keeps its row and counts as no
smallest id (component_id null only where all ids are null). Repeated rows stay, one result row
per input row. An empty table gives no rows. Only doc_id and text are read; deduplicated() passes
other columns through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelume.llm import similarity
from sitelume.llm.common import Folder, checkpoint, texts
from sitelume.llm.components import components

SHINGLE = 3
SEED = 42
HOT = 64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: SPACE characters besides the blank become one, so that split() on blanks finds the words.
_SPACES = bytes(32 if 9 <= b <= 13 else _LOWER[b] for b in range(256))
HASHES_AT_ONCE = 1 << 16


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    import xxhash

    words = [w for w in (text or "").encode("utf-8", "surrogatepass").translate(_SPACES).split(b" ") if w]
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [h(b" ".join(words), SEED)]
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    return [h(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """Signed 64-bit pattern: a bit is set if it is set in over half of the hashes."""
    ones, n = np.zeros(64, np.int64), len(hashes)
    for i in range(0, n, HASHES_AT_ONCE):
        part = np.array(hashes[i : i + HASHES_AT_ONCE], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (long) of each row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(hashed, "doc_id long, fp long")


def _high(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def _low(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _cleared(fp: Column, low: int, high: int) -> Column:
    """fp with one of its set bits low to high - 1 cleared, each in turn."""
    bits = F.sequence(F.lit(low), F.lit(high - 1))
    return F.transform(F.filter(bits, lambda i: fp.bitwiseAND(_bit(i)) != 0), lambda i: fp.bitwiseXOR(_bit(i)))


def _moved(fp: Column, low: int, high: int) -> Column:
    """fp with two bits of low to high - 1 flipped of which the higher one was set."""
    bits = F.sequence(F.lit(low), F.lit(high - 1))
    upper = F.filter(bits, lambda i: (fp.bitwiseAND(_bit(i)) != 0) & (i > low))
    return F.flatten(F.transform(upper, lambda i: F.transform(F.sequence(F.lit(low), i - 1), lambda j: fp.bitwiseXOR(_bit(i)).bitwiseXOR(_bit(j)))))


def _flipped(fp: Column, low: int, high: int) -> Column:
    return F.transform(F.sequence(F.lit(low), F.lit(high - 1)), lambda j: fp.bitwiseXOR(_bit(j)))


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that differ in one or two bits. fps: distinct values fp."""
    fp = F.col("fp")
    key = lambda seg, v: F.struct(F.lit(seg).alias("seg"), v.alias("value"))
    table = fps.select("fp", F.explode(F.array(key(0, _high(fp)), key(1, _low(fp)))).alias("key")).select("fp", "key.*")
    heavy = table.groupBy("seg", "value").count().filter(F.col("count") > hot).select("seg", "value", F.lit(True).alias("heavy"))

    # probes into the table: own halves (radius 0), and the high half with a set bit cleared (radius 1)
    exact = F.array(key(0, _high(fp)), key(1, _low(fp)))
    near = F.transform(_cleared(fp, 32, 64), lambda x: key(0, _high(x)))
    probes = fps.select("fp", F.explode(F.concat(exact, near)).alias("key")).select(F.col("fp").alias("a"), "key.*")
    bucket = table.join(heavy, ["seg", "value"], "left")
    light = bucket.filter("heavy is null").select(F.col("fp").alias("b"), "seg", "value")
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    found = probes.join(light, ["seg", "value"]).filter((F.col("a") != F.col("b")) & (distance <= 2)).select("a", "b")

    # heavy buckets: the complete fingerprints within reach, each looked up exactly
    marked = probes.join(heavy, ["seg", "value"], "left_semi").select(F.col("a").alias("fp"), "seg", "value")
    same = (F.col("seg") == 0) & (F.col("value") == _high(fp))
    across = (F.col("seg") == 1)
    high = F.shiftleft(F.col("value"), 32)
    within = F.when(same, F.concat(_cleared(fp, 0, 32), _moved(fp, 0, 32))).when(across, F.concat(_cleared(fp, 32, 64), _moved(fp, 32, 64)))
    moved = high.bitwiseOR(_low(fp))  # one bit of the high half cleared: the low half may differ in one more
    reach = F.coalesce(within, F.concat(F.array(moved), _flipped(moved, 0, 32)))
    wanted = marked.select(F.col("fp").alias("a"), F.explode(reach).alias("fp"))
    dense = wanted.join(fps, "fp").select("a", F.col("fp").alias("b"))
    return found.union(dense).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _components(marked: DataFrame, hot: int, folder: Folder | None = None) -> DataFrame:
    """fp, root of each fingerprint of marked (fp); root is the least fingerprint of its component."""
    distinct = (checkpoint if folder is None else folder.put)(marked.select("fp").distinct())
    roots = components(links(distinct, hot), folder)
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, fp and component_id of each row."""
    marked = checkpoint(fingerprints(docs))
    roots = _components(marked, hot)
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp")
    smallest = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of = roots.join(smallest, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: A text's identity beside its id: two hashes of 64 bits. A null text differs from an empty one.
_TEXT = (F.xxhash64, lambda c: F.xxhash64(F.lit("second"), c))


def five_word_hashes(three: list[int]) -> np.ndarray:
    """A hash for each five-word shingle, of those of the three-word shingles at its ends; of fewer words one for all of them."""
    h = np.array(three, np.uint64)
    if len(h) < 2:
        return h
    first, last = (h[:-2], h[2:]) if len(h) > 2 else (h[:1], ~h[1:])  # two shingles are four words, which aren't five
    mixed = (first ^ (first >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + last
    return mixed ^ (mixed >> np.uint64(29))


def _five_words(text: str | None) -> np.ndarray:
    return five_word_hashes(shingle_hashes(text))


def deduplicated(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row per group of near duplicates, in two steps.

    First, components of fingerprints that differ in at most two bits, as near_duplicates() links
    them: copies and nearly equal texts. Then, of the rows that stay, groups of texts whose five-word
    shingles have a similarity of 0.8 or more (similarity.py), which fingerprints don't tell.

    Of each group the row of the smallest doc_id stays, of several with it the one of the least text
    hash. Rows are told apart by id and text, so a row whose id another row shares, or that has no
    id, goes only if its own text belongs to a group that keeps another row. Rows without an id come
    after all others. Of equal rows (id and text) one stays. Texts without words are one group.
    """
    hashes = lambda: [h("text").alias(f"h{k}") for k, h in enumerate(_TEXT)]
    doc_id = F.col("doc_id").cast("long").alias("doc_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch.column(1).to_pylist()
            three = [shingle_hashes(t) for t in told]
            fps = [fingerprint(h) for h in three]
            sets = [similarity.shingle_set(five_word_hashes(h)) for h in three]
            cols = [batch.column(0), batch.column(2), batch.column(3), pa.array(fps, pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(map(similarity.band_keys, sets), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "h0", "h1", "fp", "n", "bands"])

    key = ["doc_id", "h0", "h1"]
    row = F.struct(F.col("doc_id").isNull().alias("without"), *key)
    equal = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.h0") == F.col(f"{b}.h0")) & (F.col(f"{a}.h1") == F.col(f"{b}.h1"))
    with Folder(docs.sparkSession, "deduplicated") as folder:
        marked = folder.put(texts(docs).select(doc_id, "text", *hashes()).mapInArrow(hashed, "doc_id long, h0 long, h1 long, fp long, n int, bands array<long>"))
        first = marked.groupBy("fp").agg(F.min(row).alias("first")).join(_components(marked, hot, folder), "fp")
        told = first.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.h0", "first.h1")
        counted = marked.groupBy(*key).agg(F.count("*").alias("copies"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
        left = counted.alias("c").join(told.alias("t"), equal("c", "t"), "left_semi")
        alone = folder.put(left.withColumn("node", F.monotonically_increasing_id()))  # of equal texts one is left, so a row's number stands for its text

        banded = alone.filter("n > 0")
        roots = similarity.linked(folder, banded, docs.select(*hashes(), "text"), _five_words, named=banded.select("node", "h0", "h1"))[1]
        rooted = alone.drop("n", "bands").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        best = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), *key, "copies")).alias("first"))
        kept = checkpoint(best.select("first.doc_id", "first.h0", "first.h1", "first.copies"))

    names = docs.columns
    whole = docs.select(F.struct(*names).alias("row"), doc_id, *hashes())
    chosen = whole.alias("w").join(kept.alias("k"), equal("w", "k")).select("row", "w.doc_id", "w.h0", "w.h1", "k.copies")
    single = chosen.filter("copies = 1").select("row.*")
    if kept.filter("copies > 1").isEmpty():
        return single
    # equal rows: one of each, by a partial aggregate, so that a row repeated very often is one row a task
    several = chosen.filter("copies > 1").groupBy(*key).agg(F.first("row").alias("row"))
    return single.unionByName(several.select("row.*"))
