"""The site's link graph: distinct normalised edges, degrees, orphans."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelume.functions import urls
from sitelume.functions.text import folded, materialised, strip, text

PAIRS = 500_000  # link pairs of a task


def parts_for(spark: SparkSession, pairs: int) -> int:
    """The session's number of partitions, or more where a task would have more than PAIRS of so many pairs."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS))


def explode_links(pages: DataFrame) -> DataFrame:
    """source_url, pos, url, anchor, rel of the links within pages."""
    return pages.select(F.col("url").alias("source_url"), F.posexplode("links").alias("pos", "l")).select("source_url", "pos", "l.url", "l.anchor", "l.rel")


def edges(links: DataFrame, start_url: str) -> DataFrame:
    """Distinct (source, target) in normal form whose target is on the start URL's host. links: source_url, target_url.

    Repeated pairs go first, as navigation repeats its links; the rest is dealt evenly by them. Pairs are
    dealt by number before they are made distinct: URLs compress so well that a task that is sized by its
    bytes, or that reads a split of the input, would hold millions of pairs at once. The number follows the
    links, which are counted first (a table's from its files' footers): a task's share doesn't grow with them. The URL
    work is then done pair by pair: for most URLs it is one match that finds them in normal form, which
    costs less than joining the pairs with their distinct URLs, and a target of very many pages, such as
    the home page, is no key of a join.
    """
    home = urlsplit(urls.normal_form(start_url)).hostname or ""
    parts = parts_for(links.sparkSession, links.count())
    raw = links.filter(text("target_url") != "").select("source_url", "target_url").repartition(parts, "source_url", "target_url").distinct()
    rows = materialised(raw, source=urls.normalize("source_url"), ref=strip("target_url")).filter("source <> ''")
    both = materialised(rows, "source", target=urls.normalize(urls.resolve("source", "ref")))
    return both.filter((F.col("target") != "") & (urls.host("target") == home)).repartition(parts, "source", "target").distinct()


def degrees(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(url, incoming) and (url, outgoing)."""
    return (
        graph.groupBy(F.col("target").alias("url")).agg(F.count("*").alias("incoming")),
        graph.groupBy(F.col("source").alias("url")).agg(F.count("*").alias("outgoing")),
    )


def with_degrees(pages: DataFrame, graph: DataFrame) -> DataFrame:
    """pages with links_in and links_out of their normal form, zero where it has none."""
    incoming, outgoing = degrees(graph)
    keyed = pages.withColumn("_norm", urls.normalize("url"))
    joined = keyed.join(incoming.withColumnRenamed("url", "_norm"), "_norm", "left").join(outgoing.withColumnRenamed("url", "_norm"), "_norm", "left")
    return joined.select(*pages.columns, F.coalesce("incoming", F.lit(0)).alias("links_in"), F.coalesce("outgoing", F.lit(0)).alias("links_out"))


def crawl_edges(pages: DataFrame, listed: DataFrame, start_url: str) -> DataFrame:
    """edges() of the links within pages; only where no page has any, of the crawl's own list (source_url, target_url)."""
    own = pages.select(F.col("url").alias("source_url"), F.explode("links").alias("l")).select("source_url", F.col("l.url").alias("target_url"))
    return edges(listed.select("source_url", "target_url") if own.isEmpty() else own, start_url)


def flagged_degrees(links: DataFrame, start_url: str) -> DataFrame:
    """url, incoming, outgoing by link rows as they are: flagged internal, or below the start URL."""
    own = links.filter(F.coalesce("internal", F.lit(False)) | F.startswith(text("target_url"), F.lit(start_url)))
    ends = own.select(F.explode(F.array(F.struct(text("target_url").alias("url"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(text("source_url").alias("url"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    return ends.groupBy("e.url").agg(F.sum("e.i").alias("incoming"), F.sum("e.o").alias("outgoing"))


def with_flagged_degrees(pages: DataFrame, links: DataFrame, start_url: str) -> DataFrame:
    """pages with links_in and links_out by flagged_degrees() of their URL as it is written, zero where it has none."""
    counted = flagged_degrees(links, start_url)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return pages.join(counted, "url", "left").select(*pages.columns, zero("incoming").alias("links_in"), zero("outgoing").alias("links_out"))


def orphans(pages: DataFrame, links: DataFrame, start_url: str | None = None) -> DataFrame:
    """Pages that no internal link names; the start page is exempt if given."""
    targets = links.filter("internal").select(F.col("target_url").alias("url")).distinct()
    asked = pages if start_url is None else pages.filter(F.col("url") != start_url)
    return asked.join(targets, "url", "left_anti").select("url", F.lit("orphan_page").alias("type"), F.lit("high").alias("severity"))


def rel_tokens(rel: Column | str) -> Column:
    return F.split(folded(rel), r"\s+")


def rel_flags(rel: Column | str) -> list[Column]:
    tokens = rel_tokens(rel)
    return [F.array_contains(tokens, k).alias(k) for k in ("nofollow", "ugc", "sponsored")]


def classify_rel(rel: Column | str) -> Column:
    tokens = rel_tokens(rel)
    return F.when(F.array_contains(tokens, "sponsored"), "sponsored").when(F.array_contains(tokens, "ugc"), "ugc").when(F.array_contains(tokens, "nofollow"), "nofollow").otherwise("dofollow")
