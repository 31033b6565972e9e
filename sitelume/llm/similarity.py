"""Links between texts that share most of their five-word shingles.

Fingerprints of 64 bits tell copies and nearly equal texts, but not a similarity of 0.8: two such
texts differ in 3 to 14 bits, and enumerating balls of that size finds a part of all pairs of texts.
So candidates come from banded min-wise hashes (BANDS bands of ROWS minima each: a pair of similarity
0.8 agrees in some band with a probability of 0.997), and every candidate is verified by the exact
similarity of its two shingle sets.

Within a band, rows are sorted by key, then by the next band's key, over range partitions: a key of
any number of texts is as many tasks as it needs, and each text is compared with the REACH texts
behind it that share its key. The first and last rows of all partitions, a few of each, are compared
once more as one sequence, so the candidates are those of the whole order, wherever it is cut. So
the number of candidates is linear in the texts, and a large group of near copies is linked along
its order.

In a crowded key (more than REACH + 1 texts, as by a common passage) that order leaves pairs out. Its
texts are therefore sorted again, by the key and the key of each band FURTHER on: two texts that agree
in both bands are compared unless more than REACH others agree in both as well. Only texts that the
links so far don't join are candidates there, so a group of near copies costs nothing again.

What is left of the crowded keys is searched by all pairs (rest()): of a key whose texts the links so far
don't all join, each two of different groups are compared by their numbers of shingles and by BITS
parities of their sets. At most as many parities differ as shingles do, so no pair of a similarity of
LEAST is dropped, and nearly all others are before anything is written. A key is dealt as pairs of
blocks, so none is one task's load. So every two texts that agree in a band are told apart, or verified,
or in one group by other links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelume.llm.common import Folder, checkpoint, texts
from sitelume.llm.components import components, joined

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 20, 6
REACH = 3
FURTHER = (3, 5, 7, 9)  # bands on, for the further orders of crowded keys
AT_ONCE = 4096  # shingles
BITS = 4096  # parities of a set, a multiple of 64
BLOCK = 2048  # texts of a crowded key that are compared with as many others at once
FEW = 1_000_000  # texts of candidates that are broadcast (8 bytes each); more are joined by a shuffle

_random = np.random.default_rng(20)
_TIMES = _random.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = _random.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(hashes: list[int]) -> np.ndarray:
    """Distinct shingle hashes, mixed so that a multiplication spreads them."""
    h = np.unique(np.array(hashes, np.uint64))
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def band_keys(shingles: np.ndarray) -> list[int]:
    """A key of each band; none for no shingles."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), AT_ONCE):
        values = shingles[k : k + AT_ONCE, None] * _TIMES + _PLUS
        np.minimum(least, (values ^ (values >> np.uint64(29))).min(axis=0), out=least)
    keys = (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)
    return (keys ^ (keys >> np.uint64(31))).view(np.int64).tolist()


def _window(rows: list[np.ndarray], reach: int, new: int = 0, across: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates a and b, and nodes of crowded keys, among rows in order (order, key, part, node, n, root).

    The later row of a pair is one from `new` on; with across, the two are of different parts.
    """
    order, key, part, node, n, root = rows
    a, b, crowded = [node[:0]], [node[:0]], [node[:0]]
    for s in range(1, min(reach + 1, len(node) - 1) + 1):
        first = np.arange(max(0, new - s), len(node) - s)
        same = (key[first] == key[first + s]) & (order[first] == order[first + s])
        first = first[same & (part[first] != part[first + s])] if across else first[same]
        if s > reach:
            crowded += [node[first + k] for k in range(s + 1)]
            break
        small, large = np.minimum(n[first], n[first + s]), np.maximum(n[first], n[first + s])
        first = first[(small >= LEAST * large) & (root[first] != root[first + s])]  # sets of sizes further apart can't be similar
        a.append(node[first])
        b.append(node[first + s])
    a, b = np.concatenate(a), np.concatenate(b)
    return np.minimum(a, b), np.maximum(a, b), np.unique(np.concatenate(crowded))


_PAIR, _CROWDED, _EDGE = 0, 1, 2
_ROWS = ("at", "key", "part", "node", "n", "root")


def _batch(kind: int, **columns: np.ndarray) -> pa.RecordBatch:
    rows = len(next(iter(columns.values())))
    zero = np.zeros(rows, np.int64)
    names = ("a", "b", "place", *_ROWS)
    return pa.RecordBatch.from_arrays([pa.array(np.full(rows, kind, np.int64)), *(pa.array(columns.get(c, zero).astype(np.int64)) for c in names)], names=["kind", *names])


def neighbours(banded: DataFrame, reach: int = REACH, on: tuple[int, ...] = (1,), folder: Folder | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct candidates (a, b) of different roots, and the nodes of crowded keys. Tables of folder, else checkpoints.

    banded: node, n (distinct shingles), bands, root. on: a row is sorted by its key in each band and, for each
    number of on, by its key so many bands further on.
    """
    key = lambda k: F.get("bands", k)
    orders = F.array(*map(F.lit, on))
    rows = banded.select("node", "n", "root", "bands", F.posexplode("bands").alias("band", "key")).select("node", "n", "root", "bands", "band", "key", F.explode(orders).alias("on"))
    rows = rows.select((F.col("on") * BANDS + F.col("band")).cast("long").alias("at"), "key", key((F.col("band") + F.col("on")) % BANDS).alias("then"), "node", "n", "root")
    order = ["at", "key", "then", "node"]
    kept = reach + 1

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, place = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "key", "node", "n", "root")}
            rows = [np.full(batch.num_rows, part, np.int64) if c == "part" else cols[c] for c in _ROWS]
            head = max(0, kept - place)
            if head:
                yield _batch(_EDGE, place=np.arange(place, place + len(rows[0][:head])), **{c: x[:head] for c, x in zip(_ROWS, rows, strict=True)})
            place += batch.num_rows
            new = 0 if held is None else len(held[0])
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            a, b, crowded = _window(rows, reach, new)
            held = [x[-kept:] for x in rows]
            yield _batch(_PAIR, a=a, b=b)
            yield _batch(_CROWDED, node=crowded)
        if held is not None and place > kept:
            tail = min(kept, place - kept)  # the rows before are the partition's first ones, which went out already
            yield _batch(_EDGE, place=np.arange(place - tail, place), **{c: x[-tail:] for c, x in zip(_ROWS, held, strict=True)})

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = [[batch.column(c).to_numpy(zero_copy_only=False) for c in _ROWS] for batch in batches if batch.num_rows]
        if edges:
            a, b, crowded = _window([np.concatenate(x) for x in zip(*edges, strict=True)], reach, across=True)
            yield _batch(_PAIR, a=a, b=b)
            yield _batch(_CROWDED, node=crowded)

    schema = ", ".join(f"{c} long" for c in ("kind", "a", "b", "place", *_ROWS))
    kept_in = checkpoint if folder is None else folder.put
    with Folder(banded.sparkSession, "neighbours") as own:
        found = own.put(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(searched, schema))
        # 2 x (reach + 1) rows of each partition at most: one task
        edges = found.filter(F.col("kind") == _EDGE).repartition(1).sortWithinPartitions("part", "place").mapInArrow(across, schema)
        of = lambda kind: found.filter(F.col("kind") == kind).union(edges.filter(F.col("kind") == kind))
        return kept_in(of(_PAIR).select("a", "b").distinct()), kept_in(of(_CROWDED).select("node").distinct())


def parities(shingles: np.ndarray) -> bytes:
    """For each of BITS parts of a set, whether its number of shingles is odd."""
    return np.packbits(np.bincount((shingles % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).tobytes()


def _possible(a: list[np.ndarray], b: list[np.ndarray] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes of the pairs of different roots, a row of a with one of b (None: two of a), that may have a similarity of LEAST. Rows: node, n, root, parities."""
    other = a if b is None else b
    for at in range(0, len(a[0]), 256):
        node, n, root, odd = (x[at : at + 256] for x in a)
        pair = (root[:, None] != other[2]) & (np.minimum(n[:, None], other[1]) >= LEAST * np.maximum(n[:, None], other[1]))
        if b is None:
            pair &= np.arange(at, at + len(n))[:, None] < np.arange(len(other[0]))
        first, second = np.nonzero(pair)
        for k in range(0, len(first), 1 << 15):
            i, j = first[k : k + (1 << 15)], second[k : k + (1 << 15)]
            differ = np.bitwise_count(odd[i] ^ other[3][j]).sum(axis=1, dtype=np.int64)
            may = differ <= (n[i] + other[1][j]) * ((1 - LEAST) / (1 + LEAST)) + 1e-6
            yield node[i[may]], other[0][j[may]]


def rest(folder: Folder, rooted: DataFrame, docs: DataFrame, hashed: Callable[[str | None], list[int]], reach: int, few: int, named: DataFrame | None, block: int = BLOCK) -> DataFrame:
    """Candidates (a, b) of different roots in the crowded keys, all that the orders can have left out. rooted: node, n, bands, root."""
    rows = rooted.select("node", "n", "root", F.posexplode("bands").alias("band", "key"))
    open_keys = rows.groupBy("band", "key").agg(F.count("*").alias("texts"), F.min("root").alias("r"), F.max("root").alias("s")).filter((F.col("texts") > reach + 1) & (F.col("r") < F.col("s")))
    blocks = open_keys.select("band", "key", F.ceil(F.col("texts") / block).cast("int").alias("blocks"))

    def compared(key: tuple, table: pa.Table) -> pa.Table:
        block_ = table.column("block").to_numpy()
        bits = np.frombuffer(b"".join(table.column("odd").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        cols = [*(table.column(c).to_numpy() for c in ("node", "n", "root")), bits]
        side = lambda k: [x[block_ == k.as_py()] for x in cols]
        found = list(_possible(side(key[2]), None if key[2] == key[3] else side(key[3])))
        a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    with Folder(rooted.sparkSession, "rest") as own:
        left = own.put(rows.join(blocks, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
        odd = _of_texts(own, left.select("node").distinct(), docs, hashed, few, named, parities, "binary")
        dealt = left.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.join(odd, "node").select("band", "key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", F.col("n").cast("long").alias("n"), "root", F.col("of").alias("odd"))
        return folder.put(dealt.groupBy("band", "key", "i", "j").applyInArrow(compared, "a long, b long").distinct())


def similar(banded: DataFrame, docs: DataFrame, hashed: Callable[[str | None], list[int]], reach: int = REACH, few: int = FEW, named: DataFrame | None = None, further: tuple[int, ...] = FURTHER, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of nodes whose shingle sets have a similarity of LEAST or more.

    docs: node, text; or, with named (node and some key columns, a row for each node), these key columns and text.
    Without further the crowded keys are searched along their first order only.
    """
    with Folder(banded.sparkSession, "similar") as folder:
        return checkpoint(linked(folder, banded, docs, hashed, reach, few, named, further, block)[0])


def linked(folder: Folder, banded: DataFrame, docs: DataFrame, hashed: Callable[[str | None], list[int]], reach: int = REACH, few: int = FEW, named: DataFrame | None = None, further: tuple[int, ...] = FURTHER, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """similar()'s links, and (node, root) of their components, as tables of folder."""
    found, crowded = neighbours(banded.withColumn("root", F.col("node")), reach, folder=folder)
    first = _verified(folder, found, docs, hashed, few, named)
    roots = components(first, folder)
    if not further or crowded.isEmpty():
        return first, roots
    within = folder.put(banded.join(crowded, "node"))
    rooted = lambda roots: within.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = _verified(folder, neighbours(rooted(roots), reach, further, folder)[0], docs, hashed, few, named)
    roots = joined(roots, more, folder)
    left = rest(folder, rooted(roots), docs, hashed, reach, few, named, block)
    last = _verified(folder, left, docs, hashed, few, named)
    return first.union(more).union(last), joined(roots, last, folder)


def _of_texts(folder: Folder, nodes: DataFrame, docs: DataFrame, hashed: Callable[[str | None], list[int]], few: int, named: DataFrame | None, of: Callable[[np.ndarray], object], kind: str) -> DataFrame:
    """node and of its shingle set, read from the nodes' texts again."""
    nodes = folder.put(nodes)
    wanted = nodes if named is None else nodes.join(named, "node")
    key = ["node"] if named is None else [c for c in named.columns if c != "node"]
    wanted = F.broadcast(wanted) if nodes.count() <= few else wanted

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of(shingle_set(hashed(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary() if kind == "binary" else pa.list_(pa.int64()))], names=["node", "of"])

    return folder.put(texts(docs.select(*key, "text").join(wanted, key).select("node", "text")).dropDuplicates(["node"]).mapInArrow(sets, f"node long, of {kind}"))


def _verified(folder: Folder, candidates: DataFrame, docs: DataFrame, hashed: Callable[[str | None], list[int]], few: int, named: DataFrame | None) -> DataFrame:
    """The candidates of a similarity of LEAST or more, a table of folder; the texts' sets go."""
    if candidates.isEmpty():
        return candidates
    nodes = candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    with Folder(candidates.sparkSession, "verified") as own:
        of = _of_texts(own, nodes, docs, hashed, few, named, lambda s: s.view(np.int64), "array<long>")
        both = candidates.join(of.select(F.col("node").alias("a"), F.col("of").alias("s")), "a").join(of.select(F.col("node").alias("b"), F.col("of").alias("t")), "b")
        common = F.size(F.array_intersect("s", "t"))
        judged = both.select("a", "b", common.alias("common"), (F.size("s") + F.size("t")).alias("sizes"))
        return folder.put(judged.filter(F.col("common") >= LEAST * (F.col("sizes") - F.col("common"))).select("a", "b"))
