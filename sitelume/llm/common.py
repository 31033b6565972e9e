"""What several operators of this subpackage need: table reading, checkpoints, partition counts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


ROWS_A_BATCH = 1000
BYTES_A_BATCH = 64 << 20


def texts(docs: DataFrame) -> DataFrame:
    """docs, to be handed to Arrow functions in batches of ROWS_A_BATCH rows and about BYTES_A_BATCH bytes at most.

    Texts are large: ten thousand at once, the default, cost hundreds of MB on both sides of the
    pipe, and a thousand texts of 10 MB would be one batch of 10 GB. The settings are the session's,
    and are read when the plan runs, so they stay lowered; smaller ones stay. No result depends on them.
    """
    conf = docs.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_A_BATCH), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_A_BATCH)):
        now = re.sub("[bB]$", "", conf.get(key))
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(key, str(most))
    return docs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of its own only where the session has none and runs in local mode (tests)."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared)
    return shared


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder by Hadoop's file system; nothing happens where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, a write deletes its shuffle files at its end; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Folder:
    """The tables of one run, in a folder of their own below the shared one; its owner deletes it.

    A with statement deletes the folder at its end, also behind an error; what is returned from it has to be
    a checkpoint by then, which Spark's cleaner deletes once nothing reads it, if
    spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.at = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame) -> DataFrame:
        """df as a table that is written once; what reads it begins from its files, a few of small ones to a task."""
        path = f"{self.at}/{uuid.uuid4().hex}"
        with shuffles_removed(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Folder:
        return self

    def __exit__(self, *error: object) -> None:
        removed(self.spark, self.at)


def placed(folder: Folder, df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """df with each row's place (from 0) among all rows of its value of `by`, ascending by `order`, and their number n_rows.

    The rows are dealt by ranges of (by, order, a number), so that one value of `by`, or many equal rows, are
    as many tasks as they need. A place is the rank in the partition on top of the sizes of the partitions
    before it; of those one task sees a row per partition.
    """
    numbered = folder.put(df.withColumn("_nth", F.monotonically_increasing_id()))
    keys = [by, *order, "_nth"]
    ranked = folder.put(numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_nth").withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33).alias("_part")  # as that function composes its ids
    sizes = ranked.groupBy(part, by).agg(F.count("*").alias("size"), F.min("_row").alias("_least"))
    whole = Window.partitionBy(by)
    before = F.sum("size").over(whole.orderBy("_part")) - F.col("size")
    starts = folder.put(sizes.select("_part", by, (before - F.col("_least")).alias("_shift"), F.sum("size").over(whole).alias("n_rows")))
    return ranked.withColumn("_part", part).join(starts, ["_part", by]).select(*df.columns, (F.col("_row") + F.col("_shift")).alias("place"), "n_rows")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case; a text of ASCII alone takes the short way, which changes nothing else there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame (file sizes for a scan); no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """Partitions of about bytes_each input bytes, never more than the session's shuffle partitions."""
    most = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(1, min(most, -(-input_bytes(df) // bytes_each)))
