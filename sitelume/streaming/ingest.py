"""Streaming ingest of crawled pages and the crawl's progress, on Structured Streaming.

Page lines arrive as JSON files. They are deduplicated by URL within the crawl, audited by the
single-page rules and appended; a checkpointed file sink makes each page durable once. Progress
is a windowed count with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitelume.operators import rules
from sitelume.sources.readers import PAGE

LINE = "crawl_id long, fetched_at timestamp, " + PAGE


def page_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(LINE).option("maxFilesPerTrigger", files_per_trigger).option("mode", "DROPMALFORMED").json(path)


def first_pages(lines: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each (crawl_id, url) once; the state of a key is dropped when the watermark has passed it."""
    return lines.filter("url is not null").withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["crawl_id", "url"])


def progress(lines: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Pages, failures and bytes per crawl and window."""
    return (
        lines.withWatermark("fetched_at", delay)
        .groupBy("crawl_id", F.window("fetched_at", window).alias("w"))
        .agg(F.count("*").alias("pages"), F.count_if(F.coalesce("status_code", F.lit(0)) >= 400).alias("failed"), F.sum("content_length").alias("bytes"))
        .select("crawl_id", F.col("w.start").alias("start"), "pages", "failed", "bytes")
    )


def audit_stream(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append pages and their technical issues batch by batch; a repeated batch replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{out}/pages/batch={number}")
        rules.technical_issues(batch).write.mode("overwrite").parquet(f"{out}/issues/batch={number}")
        batch.unpersist()

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
