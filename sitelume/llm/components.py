"""Connected components of a link table, by minimum labels with pointer jumping.

Every round is a few equi-joins and aggregations over links and labels; nothing but a count
reaches the driver. Round by round each vertex takes the smallest label among itself, its
neighbours' labels and its label's own label, so that chains contract in a logarithmic number
of rounds. Aggregation by vertex is partial before the shuffle, so a hub isn't one task's load.
Each round's labels are a table in the shared folder, which keeps plans short, lets a lost
executor's part be read again, and leaves neither empty files nor shuffle files behind.

A graph that grows is not searched again: joined() takes new links between the groups found so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelume.llm.common import Folder, checkpoint


def components(links: DataFrame, folder: Folder | None = None) -> DataFrame:
    """(node, root) of every node in links (a, b); root is the least node of its component. A table of folder, else a checkpoint."""
    kept = checkpoint if folder is None else folder.put
    with Folder(links.sparkSession, "components") as own:
        both = own.put(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
        labels = own.put(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
        while True:
            known = labels.select(F.col("node").alias("b"), F.col("root").alias("near"))
            offered = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
            hooked = labels.join(offered, "node", "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
            roots = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
            jumped = hooked.join(roots, "root", "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root"))
            stepped = own.put(jumped)
            labels = stepped.drop("old")
            if stepped.filter("root <> old").isEmpty():
                return kept(labels)


def joined(roots: DataFrame, links: DataFrame, folder: Folder | None = None) -> DataFrame:
    """(node, root) of components() of all links, by the roots of those so far and the new ones (a, b)."""
    if links.isEmpty():
        return roots
    kept = checkpoint if folder is None else folder.put
    of = lambda c: F.coalesce(F.col(f"r{c}"), F.col(c)).alias(c)
    end = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    with Folder(links.sparkSession, "joined") as own:
        up = components(links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(of("a"), of("b")), own)
        moved = roots.join(up.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        return kept(moved.union(up.join(roots, "node", "left_anti").select("node", "root")))
