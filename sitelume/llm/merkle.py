"""Operator 12: a Merkle manifest of a dataset, with a proof for every row.

A row's leaf is the digest of its columns. The leaves of a language ascend by doc_id and form a tree of
FAN_OUT children a node; the languages' subroots form another tree, of which the top is the root.

Bottom-up, every level is a table in the shared folder: nodes are grouped by (tree, place / FAN_OUT), so a
group is FAN_OUT rows at most whatever a language's share of all rows, and a parent keeps its run, the
digests of its children. Top-down, children join their parents by the same key; a child prepends its siblings
to the proof that its parent has inherited, and takes over subroot and root. A level is an eighth of the one
below it, so all proofs above the leaves are a seventh of the leaves' number; a leaf's own proof isn't stored
but hashed, and folded with the leaf, where the last join makes it.

Leaves get their places by ranges of (tree, doc_id, leaf) and the sizes of the ranges before (common.placed);
no window or task sees a language's leaves together. What reaches the driver is the largest number of leaves.

A leaf is found tampered with if folding its changed form with the untampered siblings doesn't give the root.

Defined cases: nulls are `-` in a leaf; a null doc_id comes before all others, and its row isn't tampered
with; equal doc_ids of a language ascend by leaf. Repeated rows are a leaf each. A null text stays null
under tampering. A language of one row is its leaf, and one language's subroot is the root. An empty table
gives no rows. Only the columns of documents are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelume.llm.common import Folder, ascii_lower, checkpoint, placed

FAN_OUT = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 3
#: Siblings to the left and to the right of a node, level by level from below.
PATH = "array<struct<left:string,right:string>>"


def written(value: Column) -> Column:
    """A value as it enters a leaf: its length in bytes, a colon, itself; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(written(columns[c]) for c in COLUMNS)), 256)


def leaves(docs: DataFrame, every: int = TAMPER_EVERY) -> DataFrame:
    """tree (of the row's lang), doc_id, leaf and tampered (null where the row isn't tampered with) of each row."""
    columns = {c: F.col(c) for c in COLUMNS}
    chosen = F.crc32(F.col("doc_id").cast("string")) % every == 0
    tampered = F.when(chosen, leaf(columns | {"text": ascii_lower(F.col("text"))}))
    tree = F.coalesce(F.concat(F.lit(":"), "lang"), F.lit("-"))  # in the languages' order, null first
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(columns).alias("leaf"), tampered.alias("tampered"))


def _parent() -> Column:
    return F.floor(F.col("place") / FAN_OUT)


def build(folder: Folder, nodes: DataFrame) -> list[DataFrame]:
    """The levels above nodes (tree, place, n, digest): tree, place, n, run (the children's digests), digest."""
    levels, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        groups = levels[-1].filter("n > 1").groupBy("tree", _parent().alias("place"))
        runs = groups.agg(F.ceil(F.first("n") / FAN_OUT).alias("n"), F.array_sort(F.collect_list(F.struct("place", "digest")))["digest"].alias("run"))
        levels.append(folder.put(runs.select("*", F.sha2(F.array_join("run", ""), 256).alias("digest"))))
        most = -(-most // FAN_OUT)
    return levels[1:]


def tops(levels: list[DataFrame]) -> DataFrame:
    """tree, digest of each tree's last node; levels: those of nodes and all above."""
    last = [x.filter("n = 1").select("tree", "digest") for x in levels]
    out = last[0]
    for x in last[1:]:
        out = out.unionByName(x)
    return out


def _inherited(children: DataFrame, parents: DataFrame | None, top: DataFrame) -> DataFrame:
    """children with the path, and the further columns of top, of each: a tree's last node has its tree's, another one its parent's with its own siblings before it.

    top: tree, path and further columns; parents: tree, place, run and the same.
    """
    more = [c for c in top.columns if c != "tree"]
    alone = children.filter("n = 1").join(top, "tree")
    if parents is None:
        return alone
    at = (F.col("place") % FAN_OUT).cast("int")
    above = parents.select("tree", F.col("place").alias("_parent"), F.col("run").alias("_run"), *(F.col(c).alias(f"_{c}") for c in more))
    joined = children.filter("n > 1").withColumn("_parent", _parent()).join(above, ["tree", "_parent"])
    siblings = F.struct(F.array_join(F.slice("_run", F.lit(1), at), "").alias("left"), F.array_join(F.slice("_run", at + 2, F.lit(FAN_OUT)), "").alias("right"))
    path = F.concat(F.array(siblings), F.col("_path"))
    pushed = joined.select(*children.columns, *((path if c == "path" else F.col(f"_{c}")).alias(c) for c in more))
    return pushed.unionByName(alone.select(*pushed.columns))


def push(folder: Folder, nodes: DataFrame, levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """nodes with path and the further columns of top (tree, path, …), handed down level by level."""
    above = None
    for level in reversed(levels):
        above = folder.put(_inherited(level, above, top))
    return _inherited(nodes, above, top)


def proof(path: Column) -> Column:
    """The siblings' digests one after the other."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, digest, lambda at, x: F.sha2(F.concat(x["left"], at, x["right"]), 256))


def manifest(docs: DataFrame, every: int = TAMPER_EVERY, paths: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, n_levels, folded_root and verified of each row; paths: the proofs themselves too (path)."""
    with Folder(docs.sparkSession, "merkle") as folder:
        nodes = folder.put(placed(folder, leaves(docs, every), "tree", ["doc_id", "leaf"]).withColumnsRenamed({"leaf": "digest", "n_rows": "n"}))
        levels = build(folder, nodes)
        subroots = folder.put(tops([nodes, *levels]).withColumn("subroot", F.col("digest")).withColumnRenamed("tree", "language").withColumn("tree", F.lit("")))
        languages = folder.put(placed(folder, subroots, "tree", ["language"]).withColumnRenamed("n_rows", "n"))
        joining = build(folder, languages)
        root = tops([languages, *joining]).select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
        told = folder.put(push(folder, languages, joining, root).select(F.col("language").alias("tree"), "path", "subroot", "root"))
        proved = push(folder, nodes, levels, told).withColumn("folded_root", folded(F.coalesce("tampered", "digest"), F.col("path")))
        rows = proved.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), F.size("path").alias("n_levels"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *(["path"] if paths else []))
        return checkpoint(rows)


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
