"""Operator 13: line dedup over all documents. DataFrame functions only.

Every text is split at line breaks and its lines exploded with their position. A line's key is the line
without blanks at both ends, A to Z in lower case; it is known by two 64-bit hashes. Per hash the distinct
documents are counted, and the smallest is kept: a hash in `documents` or more documents loses all its
lines but in the smallest one. Keys of fewer than `chars` code points are never dropped.

Only hashes and positions are shuffled for this. The count is partial before its shuffle, so a line that stands
in a third of all documents is one row a task. Its lines aren't dealt by their hash again: the hashes with more
than one in HEAVY x partitions of all repeated lines, which are fewer than HEAVY x partitions, are broadcast with
their smallest documents; only the others' positions are found by a shuffle by hash. The positions dropped from a text then meet the text once, and it is put together from its other lines in
the order of their positions.

A text is known by its doc_id and two hashes of itself, so repeated rows share one list of positions, and rows of
one id with different texts have each their own, while they count as one document.

Defined cases: a null or empty text is one empty line; rows without doc_id are one document, which comes
after all others. A text that loses all lines is empty. Repeated rows stay, one result row each. An empty
table gives no rows. clean() passes other columns through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelume.llm.common import Folder, ascii_lower, checkpoint

DOCUMENTS = 2  # as many documents with a line make it a repeated one
CHARS = 10  # of a key, at least
HEAVY = 4
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
_LAST = (1 << 63) - 1  # stands for a missing doc_id


def _two_hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def _identified(docs: DataFrame) -> DataFrame:
    """row (the whole row), doc, and the text's hashes t0, t1."""
    t0, t1 = _two_hashes(F.coalesce("text", F.lit("")))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    return docs.select(F.struct(*docs.columns).alias("row"), doc.alias("doc"), t0.alias("t0"), t1.alias("t1"))


def dropped_lines(docs: DataFrame, documents: int = DOCUMENTS, chars: int = CHARS) -> DataFrame:
    """doc, t0, t1, dropped: positions (from 0) of the lines that a text loses; texts that lose none have no row."""
    lowered = ascii_lower(F.coalesce("row.text", F.lit("")))
    lines = _identified(docs.select("doc_id", "text")).select("doc", "t0", "t1", F.posexplode(F.split(lowered, "\n", -1)).alias("pos", "line"))
    bare = lines.select("doc", "t0", "t1", "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).filter(F.length("key") >= chars)
    h0, h1 = _two_hashes(F.col("key"))
    keys = bare.select("doc", "t0", "t1", "pos", h0.alias("h0"), h1.alias("h1"))
    counted = keys.groupBy("h0", "h1").agg(F.min("doc").alias("first"), F.max("doc").alias("other"), F.count("*").alias("n_lines"), *([F.count_distinct("doc").alias("n")] if documents > 2 else []))
    several = F.col("n") >= documents if documents > 2 else F.col("first") < F.col("other")  # two documents are a smallest and another largest one
    with Folder(docs.sparkSession, "lines") as folder:
        repeated = folder.put(counted.filter(several).select("h0", "h1", "first", "n_lines"))
        share = (repeated.agg(F.sum("n_lines")).first()[0] or 0) / (HEAVY * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        heavy = repeated.filter(F.col("n_lines") > share).select("h0", "h1", F.col("first").alias("heavy_first"))
        light = repeated.filter(F.col("n_lines") <= share).select("h0", "h1", F.col("first").alias("light_first"))
        marked = keys.join(F.broadcast(heavy), ["h0", "h1"], "left")
        spread = lambda h: F.when(F.col("heavy_first").isNull(), F.col(h)).otherwise(F.xxhash64(F.lit(h), "doc", "pos")).alias(h)  # noqa: E731  where nothing is to be found
        found = marked.select("doc", "t0", "t1", "pos", "heavy_first", spread("h0"), spread("h1")).join(light, ["h0", "h1"], "left")
        lost = found.filter(F.col("doc") != F.coalesce("heavy_first", "light_first"))
        return checkpoint(lost.groupBy("doc", "t0", "t1").agg(F.collect_set("pos").alias("dropped")))


def find(docs: DataFrame, documents: int = DOCUMENTS, chars: int = CHARS) -> DataFrame:
    """row, n_lines, n_dropped and kept (the text that stays) of each row."""
    lost = dropped_lines(docs, documents, chars)
    text = F.coalesce("row.text", F.lit(""))
    joined = _identified(docs).join(lost, ["doc", "t0", "t1"], "left").select("row", F.split(text, "\n", -1).alias("lines"), "dropped")
    staying = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.array_join(F.transform(staying, lambda i: F.get("lines", i)), "\n")
    return joined.select("row", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("dropped").isNull(), text).otherwise(kept).alias("kept"))


def clean(docs: DataFrame, documents: int = DOCUMENTS, chars: int = CHARS) -> DataFrame:
    """docs with the texts that stay; a null text stays null, and n_chars, where there is one, follows a changed text."""
    changed = F.col("n_dropped") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("row.text"))
    n_chars = lambda: F.when(changed, F.length("kept").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row.n_chars"))
    return find(docs, documents, chars).select(*(text.alias(c) if c == "text" else n_chars().alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def digest(found: DataFrame) -> DataFrame:
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
