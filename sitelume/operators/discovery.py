"""Public discovery of backlinks: query templates times search engines, result pages, verification, totals.

Result pages are a table: engine, query_no, page_no (from 0), html, error. ``requests`` says which
to fetch; ``stored`` pages and fetched ones are read alike. A page of very many results may come as several
rows, cut between results and numbered by a column part, as a row is parsed whole in its task.
"""

from __future__ import annotations

from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelume.functions import urls
from sitelume.operators import backlinks

ENGINES = ("bing", "duckduckgo")
#: What is asked for about a target.
TEMPLATES = ('"{target}" -site:{target}', '"https://{target}" -site:{target}', '"www.{target}" -site:{target}', '"{target}/" -site:{target}')
PAGE_RESULTS, MOST_PAGED, MOST_LISTED = 10, 100, 50  # results of a page of the first engine, and the most asked of each


def per_query(most_results: int, templates: tuple[str, ...] = TEMPLATES) -> int:
    return max(1, most_results // len(templates))


def requests(spark: SparkSession, target: str, engines: tuple[str, ...] = ENGINES, most_results: int = 100, templates: tuple[str, ...] = TEMPLATES) -> DataFrame:
    """engine, query_no, page_no, query, url of the result pages to fetch; an unknown engine has no url."""
    limit, rows = per_query(most_results, templates), []
    for engine in engines:
        for n, template in enumerate(templates):
            query = template.format(target=target)
            if engine == "bing":
                pages = [f"https://www.bing.com/search?{urlencode({'q': query, 'count': PAGE_RESULTS, 'first': first})}" for first in range(1, min(limit, MOST_PAGED) + 1, PAGE_RESULTS)]
            elif engine == "duckduckgo":
                pages = [f"https://html.duckduckgo.com/html/?{urlencode({'q': query, 'num': min(limit, MOST_LISTED)})}"]
            else:
                pages = [None]
            rows += [(engine, n, k, query, url) for k, url in enumerate(pages)]
    return spark.createDataFrame(rows, "engine string, query_no int, page_no int, query string, url string")


def results(serps: DataFrame, limit: int) -> DataFrame:
    """engine, query_no, pos, url: at most limit results of a query, up to the first page that isn't full.

    A page of fewer than PAGE_RESULTS results is the last one that counts, a missing or empty one ends
    the query before it.
    """
    parts = serps if "part" in serps.columns else serps.withColumn("part", F.lit(0))
    listed = [backlinks.search_hits(parts.filter(F.col("engine") == e).select(F.struct("engine", "query_no", "page_no", "part").alias("query_no"), "html"), e) for e in ENGINES]
    found = listed[0].unionByName(listed[1]).select("query_no.*", "pos", "url")
    sizes = found.groupBy("engine", "query_no", "page_no").agg(F.count("*").alias("n"))
    query = Window.partitionBy("engine", "query_no").orderBy("page_no")  # a query's pages: ten at most
    full = F.coalesce(F.sum(F.when(F.col("n") >= PAGE_RESULTS, 1).otherwise(0)).over(query.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = sizes.withColumns({"full": full, "nth": F.row_number().over(query) - 1}).filter("full = page_no and nth = page_no").drop("n", "full", "nth")
    place = F.row_number().over(Window.partitionBy("engine", "query_no").orderBy("page_no", "part", "pos"))
    ranked = found.join(counted, ["engine", "query_no", "page_no"]).withColumn("place", place).filter(F.col("place") <= limit)
    return ranked.select("engine", "query_no", (F.col("place") - 1).alias("pos"), "url")


def candidates(serps: DataFrame, target: str, engines: tuple[str, ...] = ENGINES, most_results: int = 100, templates: tuple[str, ...] = TEMPLATES) -> DataFrame:
    """url, engine_no, query_no, pos of the distinct candidates, each at its first place; the target's own URLs are left out."""
    order = F.array_position(F.array(*map(F.lit, engines)), F.col("engine")).cast("int")
    found = results(serps, per_query(most_results, templates)).withColumn("engine_no", order).filter((F.col("engine_no") > 0) & (F.col("url") != "") & ~urls.is_target("url", F.lit(target)))
    return found.groupBy("url").agg(F.min(F.struct("engine_no", "query_no", "pos")).alias("f")).select("url", "f.*")


def engine_errors(serps: DataFrame, engines: tuple[str, ...] = ENGINES) -> DataFrame:
    """engine, errors: the texts of an engine's failed queries in order; an engine that isn't known has unsupported_engine."""
    spark = serps.sparkSession
    asked = spark.createDataFrame([(e, e in ENGINES) for e in engines], "engine string, known boolean")
    failed = serps.filter("error is not null").groupBy("engine").agg(F.array_sort(F.collect_list(F.struct("query_no", "page_no", "error"))).alias("e"))  # a few texts: one per result page asked for
    texts = F.when(F.col("known"), F.array_join(F.transform("e", lambda x: x["error"]), " | ")).otherwise("unsupported_engine")
    return asked.join(failed, "engine", "left").select("engine", texts.alias("errors")).filter("errors is not null and errors <> ''")


def verification_errors(fetched: DataFrame) -> DataFrame:
    """url, error of candidates whose fetch failed or had a bad status. fetched: url, status_code, error."""
    bad = F.when(F.col("status_code").isNull(), F.coalesce("error", F.lit("no response"))).when(F.col("status_code") >= 400, F.concat(F.lit("HTTP "), F.col("status_code").cast("string")))
    return fetched.select("url", bad.alias("error")).filter("error is not null")


def collect(serps: DataFrame, fetched: DataFrame, target: str, engines: tuple[str, ...] = ENGINES, most_results: int = 100) -> tuple[DataFrame, DataFrame]:
    """(backlinks, one row of totals): candidates joined with their fetches, verified and counted.

    fetched: url, final_url, status_code, content_type, html, error. The error maps hold one entry
    per engine, and one per candidate that failed: the candidates are limited by most_results.
    """
    domain = urls.domain_of(F.lit(target))
    asked = candidates(serps, target, engines, most_results)
    pages = fetched.join(asked.select("url"), "url", "left_semi")
    links = backlinks.public_backlinks(pages.filter(F.col("status_code") < 400), target)
    as_map = lambda df, k, v: df.agg(F.map_from_entries(F.collect_list(F.struct(k, v))).alias(v))
    totals = backlinks.backlink_totals(links).join(asked.agg(F.count("*").alias("candidate_pages"))).join(as_map(engine_errors(serps, engines), "engine", "errors")).join(as_map(verification_errors(pages), "url", "error"))
    status = F.when(domain == "", "invalid_target").otherwise("success")
    return links, totals.select(F.lit("Public Web").alias("provider"), domain.alias("target_domain"), status.alias("status"), "candidate_pages", "total_backlinks", "referring_domains", "sponsored", "ugc", "nofollow", "dofollow", F.col("errors").alias("discovery_errors"), F.col("error").alias("verification_errors"))
