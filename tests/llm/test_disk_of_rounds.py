"""What the near-duplicate stage leaves on disk, and groups that grow."""

import random
import time
from pathlib import Path

from pyspark.sql import functions as F

from sitelume.llm.common import Folder
from sitelume.llm.components import components, joined


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for top in folders for f in Path(top).rglob("shuffle_*")}


def test_a_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    with Folder(spark, "rows") as folder:
        rows = folder.put(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
        made = shuffle_files(spark) - before
        for _ in range(50):  # files go a little after the write
            made = {f for f in made if f.exists()}
            if not made:
                break
            time.sleep(0.1)
        assert not made and rows.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_groups_that_grow(spark):
    """New links between groups, to nodes of none, and within a group; none at all; from no groups."""
    r = random.Random(8)
    pair = lambda most: (r.randrange(most), r.randrange(most))
    frame = lambda links: spark.createDataFrame(links, "a long, b long")
    get = lambda roots: sorted(tuple(x) for x in roots.select("node", "root").collect())
    chain = [(k, k + 1) for k in range(300, 340)]
    old, new = [pair(200) for _ in range(60)] + chain, [pair(300) for _ in range(60)] + [(5, 320), (7, 7)]
    roots = components(frame(old))
    assert get(joined(roots, frame(new))) == get(components(frame(old + new)))
    assert get(joined(roots, frame([]))) == get(roots) and get(joined(components(frame([])), frame(new))) == get(components(frame(new)))
