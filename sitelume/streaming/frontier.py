"""A crawl's frontier as a stream: the links of crawled pages go in, the pages that they add come out, once each.

Within the stream links get their normal form, and are left out beyond the depth and off the start URL's host; a
keyed state (transformWithState) passes on an URL's first link. That state is bounded: an URL goes out of it
some time after it came. What was admitted is in a stored table, in folders by the URL's bucket and by batch,
and an URL that comes again after that time is found there. A batch joins its new URLs with the buckets they fall in,
asks the robots rules, and adds the first ones by seq up to the crawl's number of pages.

A batch's rows replace those that an earlier try of the same batch has written, and aren't counted among what was
stored before it; so a batch that runs twice gives the same pages.

The pages of a stream are those of graph.admitted_children over the same links and however they are cut into
batches, if a batch's links come before the next one's by seq. Defined cases: an URL without a normal form
is left out; of several links to one URL in a batch the first by seq counts, then the one of least depth.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sitelume.functions import urls
from sitelume.operators import graph
from sitelume.streaming.politeness import with_state_store

LINK = "target_url string, depth int, seq long"
STORED = "url string, depth int, seq long, priority int, bucket int, batch long"
BUCKETS = 256


class _First(StatefulProcessor):
    """An URL's first link; later ones are nothing while the URL is remembered."""

    def __init__(self, remember_ms: int) -> None:
        self.remember_ms = remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if not self.seen.exists():
            seq, depth, came = min((r.seq, r.depth, r.came) for r in rows)
            self.seen.update((seq,))
            self.handle.registerTimer(int(came.timestamp() * 1000) + self.remember_ms)
            yield Row(url=key[0], depth=depth, seq=seq)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def new_urls(links: DataFrame, start_url: str, max_depth: int, remember: float = 3600.0) -> DataFrame:
    """url, depth, seq of a stream of links (target_url, depth of the page, seq): what a crawl may add, each URL once within `remember` seconds."""
    with_state_store(links.sparkSession)
    inner = links.filter(F.col("depth") < max_depth).select(urls.normalize("target_url").alias("url"), (F.col("depth") + 1).cast("int").alias("depth"), F.col("seq").cast("long").alias("seq"), F.current_timestamp().alias("came"))
    own = inner.filter((F.col("url") != "") & (urls.host("url") == urls.host(F.lit(start_url))))
    return own.withWatermark("came", "0 seconds").groupBy("url").transformWithState(_First(round(1000 * remember)), "url string, depth int, seq long", "append", "eventTime")


def _bucket():
    return F.pmod(F.xxhash64("url"), F.lit(BUCKETS)).cast("int").alias("bucket")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The pages of a frontier's table; none where there is no table yet."""
    try:
        return spark.read.schema(STORED).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], STORED)


def admit(batch: DataFrame, number: int, path: str, max_pages: int, robots: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Add a batch's new URLs (url, depth, seq) to the table at path. robots: gives url, allowed of URLs."""
    spark = batch.sparkSession
    before = stored(spark, path).filter(F.col("batch") < number)
    room = max(0, max_pages - before.count())
    rows = batch.select("url", "depth", "seq", _bucket())
    asked = [r.bucket for r in rows.select("bucket").distinct().collect()]  # BUCKETS at most
    fresh = rows.join(before.filter(F.col("bucket").isin(asked)).select("bucket", "url"), ["bucket", "url"], "left_anti")
    if robots is not None:
        fresh = fresh.join(robots(fresh.select("url")).filter(~F.col("allowed")).select("url"), "url", "left_anti")
    added = fresh.orderBy("seq", "url").limit(room).select("url", "depth", "seq", graph.priority(F.col("depth"), "url").cast("int").alias("priority"), "bucket", F.lit(number).cast("long").alias("batch"))
    added.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(path)


def frontier(
    links: DataFrame, path: str, checkpoint: str, start_url: str, max_depth: int, max_pages: int, robots: Callable[[DataFrame], DataFrame] | None = None, remember: float = 3600.0, **trigger: object
) -> StreamingQuery:
    """Run a stream of links into the table at path; the start URL is its first page."""
    spark = links.sparkSession
    if stored(spark, path).isEmpty():
        admit(spark.createDataFrame([(start_url, 0, -1)], "url string, depth int, seq long").withColumn("url", urls.normalize("url")), -1, path, max_pages)
    write = lambda batch, number: admit(batch, number, path, max_pages, robots)
    return new_urls(links, start_url, max_depth, remember).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
