"""Groups of pages with equal content, title or description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def groups(rows: DataFrame, key: Column, id_column: str = "url") -> DataFrame:
    """id, key and group size of rows that share a non-empty key.

    Sizes are counted with a partial aggregate and only keys of several rows are joined back; the
    join's skewed keys are split at run time, so a very common key isn't one task's work.
    """
    keyed = rows.select(id_column, key.alias("key")).filter(F.coalesce(F.col("key"), F.lit("")) != "")
    shared = keyed.groupBy("key").agg(F.count("*").alias("group_size")).filter("group_size > 1")
    return keyed.join(shared, "key").select(id_column, "key", "group_size")


def issues(rows: DataFrame, key: Column, kind: str, severity: str, id_column: str = "url") -> DataFrame:
    return groups(rows, key, id_column).select(F.col(id_column).alias("url"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.col("group_size"))


def content(pages: DataFrame, hash_column: str = "content_hash") -> DataFrame:
    return issues(pages, F.col(hash_column), "duplicate_content", "high")


def titles(pages: DataFrame) -> DataFrame:
    """Raw titles: case and outer blanks count."""
    return issues(pages, F.col("title"), "duplicate_title", "medium")
