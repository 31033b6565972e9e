"""Merging of page records: late rich rows over stored ones, upserts, ordered distinct, first hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelume.functions.text import text, words


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last by order, a null coming first. A maximum with a partial aggregate, so a key of any number of rows is one row a task."""
    names = rows.columns
    best = rows.select(F.struct(*names).alias("row"), F.struct(*order).alias("order")).groupBy(*(F.col(f"row.`{k}`").alias(k) for k in keys)).agg(F.max_by("row", "order").alias("row"))
    return best.select("row.*")


def rich_merge(pages: DataFrame, rich: DataFrame, key: str, order: str, override: set[str]) -> DataFrame:
    """pages with the last rich row of each key laid over it.

    Columns in override take the rich value wherever there is a rich row; columns that only rich
    rows have are added; all others keep the stored value.
    """
    last = latest(rich, [key], [F.col(order)]).drop(order).withColumn("_rich", F.lit(True))
    added = [c for c in rich.columns if c not in pages.columns and c != order]
    joined = pages.alias("p").join(last.alias("r"), key, "left")
    pick = lambda c: F.when(F.col("r._rich"), F.col(f"r.{c}")).otherwise(F.col(f"p.{c}")).alias(c)
    kept = [F.col(key) if c == key else pick(c) if c in override and c in rich.columns else F.col(f"p.{c}").alias(c) for c in pages.columns]
    return joined.select(*kept, *(F.col(f"r.{c}").alias(c) for c in added))


def first_seen(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Distinct keys with the position at which each first occurs."""
    return rows.groupBy(key).agg(F.min(pos).alias(pos))


def overlay(parsed: Column, rendered: Column) -> Column:
    """The rendered value where it isn't empty, else the parsed one."""
    return F.when(F.coalesce(rendered, F.lit("")) != "", rendered).otherwise(parsed)


#: Fields of a rendered page that replace the parsed ones where they aren't empty.
RENDERED = ("title", "meta_description", "canonical", "robots", "language", "viewport")


def overlay_pages(parsed: DataFrame, rendered: DataFrame, key: str = "url") -> DataFrame:
    """Parsed pages under the fields of their rendered form (key, RENDERED fields, body_text, lists such as h1s, images, links).

    Lists of a rendered page replace the parsed ones even when empty; words are counted on its
    body_text where it has one.
    """
    r = rendered.withColumn("_rendered", F.lit(True)).alias("r")
    joined = parsed.alias("p").join(r, key, "left")
    here = F.coalesce(F.col("_rendered"), F.lit(False))

    def column(c: str) -> Column:
        if c == key:
            return F.col(key)
        if c in RENDERED and c in rendered.columns:
            return overlay(F.col(f"p.{c}"), F.col(f"r.{c}")).alias(c)
        if c == "word_count" and "body_text" in rendered.columns:
            return F.when(text("r.body_text") != "", words("r.body_text")).otherwise(F.col("p.word_count")).alias(c)
        if c in rendered.columns:
            return F.when(here, F.col(f"r.{c}")).otherwise(F.col(f"p.{c}")).alias(c)
        return F.col(f"p.{c}").alias(c)

    added = [F.col(f"r.{c}").alias(c) for c in rendered.columns if c not in parsed.columns and c != "body_text"]
    return joined.select(*map(column, parsed.columns), *added)
