"""Roll-ups of a site from its pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelume.functions.signatures import UNKNOWN
from sitelume.functions.text import number, text


def platform_counts(pages: DataFrame) -> DataFrame:
    """platform, n, first_id over pages with a status."""
    name = F.when(text("platform") == "", UNKNOWN).otherwise(F.col("platform"))
    return pages.filter(number("status_code") != 0).groupBy(name.alias("platform")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))


def rollup(pages: DataFrame) -> DataFrame:
    """One row: most frequent platform (the earlier of a tie), tracking names, mean non-zero timings, counts."""
    counts = platform_counts(pages).agg(F.coalesce(F.max_by("platform", F.struct(F.col("n"), -F.col("first_id"))), F.lit(UNKNOWN)).alias("platform"))
    names = pages.select(F.explode("tracking").alias("t")).agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("tracking"))  # as many names as the table of signatures
    mean = lambda c: F.coalesce(F.round(F.avg(F.nullif(F.col(c), F.lit(0.0))), 3), F.lit(0.0)).alias(f"average_{c}")
    numbers = pages.agg(
        mean("dom_loaded_seconds"), mean("fully_loaded_seconds"), F.count("*").alias("pages_crawled"),
        F.count_if(number("status_code") >= 400).alias("n_failed"), F.count_if(F.contains(F.lower(text("robots")), F.lit("noindex"))).alias("n_noindex"),
        F.count_if("is_indexable").alias("pages_indexable"),
    )
    return counts.join(names).join(numbers)  # one row each


def crawl_counters(discovered: DataFrame, crawled: DataFrame, failed: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count_distinct("url").alias(name))
    return n(discovered, "pages_discovered").join(n(crawled, "pages_crawled")).join(n(failed, "pages_failed"))


def mean_timings(pages: DataFrame) -> DataFrame:
    """Means of the timings with zeros counted."""
    return pages.agg(*(F.coalesce(F.round(F.avg(c), 3), F.lit(0.0)).alias(f"average_{c}") for c in ("dom_loaded_seconds", "fully_loaded_seconds")))


def alt_counts(pages: DataFrame) -> DataFrame:
    """url and the numbers of images, of those without alt and of those with a blank one."""
    images = F.coalesce("images", F.array().cast("array<struct<url:string,alt:string,width:string,height:string,loading:string>>"))
    return pages.select(
        "url", F.size(images).alias("n_images"), F.size(F.filter(images, lambda i: i["alt"].isNull())).alias("missing"),
        F.size(F.filter(images, lambda i: F.trim(i["alt"]) == "")).alias("blank"),
    )


def resolved_status(statuses: DataFrame, key: str) -> DataFrame:
    """The overall status per key: confirmed, timeout, error, blocked, else not_found."""
    any_of = lambda s: F.bool_or(F.col("status") == s)
    return statuses.groupBy(key).agg(F.when(any_of("confirmed"), "confirmed").when(any_of("timeout"), "timeout").when(any_of("error"), "error").when(any_of("blocked"), "blocked").otherwise("not_found").alias("status"))
