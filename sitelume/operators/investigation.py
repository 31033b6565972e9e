"""Further forms of the page-level backlink investigation, over a fixed corpus of fetched pages.

pages: url, domain, status_code (null: the fetch failed), content_type. links: source_url, url,
anchor, rel. A fetch of an URL that the corpus doesn't hold has failed. Joins are by sorting: all their
sides grow with the corpus, whatever a plan takes them for, and none is built on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelume.functions import urls
from sitelume.functions.text import materialised, strip
from sitelume.operators import backlinks, graph


def readable(pages: DataFrame) -> Column:
    """Whether a fetched page is HTML with a good status."""
    return F.coalesce(F.col("status_code").between(200, 399) & F.contains(F.lower("content_type"), F.lit("text/html")), F.lit(False))


def investigated_domains(referring: DataFrame, target: str) -> DataFrame:
    """domain: distinct referring domains (referring_domain), lower-case, without the target itself."""
    name = F.lower(strip("referring_domain"))
    return referring.select(name.alias("domain")).filter((F.col("domain") != "") & (F.col("domain") != urls.domain_of(F.lit(target)))).distinct()


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys in as many partitions as the session has, the joins by these keys too: a task sized by its bytes would hold very many URLs, which compress so well."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _own_links(pages: DataFrame, links: DataFrame, relative: bool = False) -> DataFrame:
    """domain, source, target of links from readable pages to their own domain; relative: whatever is written without a host counts too."""
    ok = _dealt(pages.filter(readable(pages)).select(F.col("url").alias("source_url"), "domain"), "source_url")
    to = urls.canonical_or_self(urls.without_fragment(urls.resolve("source_url", strip("url"))))
    inner = _dealt(links.filter(~urls.skipped(strip("url"), backlinks.SKIPPED)), "source_url").join(ok.hint("merge"), "source_url")
    inner = materialised(inner, "domain", "source_url", "url", to=to)
    own = urls.bare_domain("to") == F.col("domain")
    return inner.filter(own | urls.is_relative("url") if relative else own).select("domain", F.col("source_url").alias("source"), F.col("to").alias("target"))


def exhaustive(pages: DataFrame, links: DataFrame, domains: DataFrame, target: str, sitemap_pages: DataFrame | None = None, max_pages: int = 1000, max_depth: int | None = None) -> DataFrame:
    """One row per domain: status, pages_checked, html_pages_checked, failed_fetches, links_found, hit_url.

    A domain's pages are visited one after the other: its http origin, its https origin, its sitemap
    pages (domain, url), then what these link to, by depth; the first page with links to the target
    ends it. More than max_pages (or max_depth links, where that is given) without one is a timeout, a domain
    with no visit is blocked. The limit is in pages, as a fixed corpus has no clock.
    """
    origin = lambda k, scheme: F.struct(F.lit(k).alias("rank"), F.concat(F.lit(f"{scheme}://"), "domain", F.lit("/")).alias("url"))
    starts = domains.select("domain", F.explode(F.array(origin(0, "http"), origin(1, "https"))).alias("s")).select(F.col("domain").alias("grp"), urls.canonical_or_self("s.url").alias("url"), "s.rank", F.lit(0).alias("depth"))
    if sitemap_pages is not None:
        listed = sitemap_pages.join(domains.hint("merge"), "domain").select(F.col("domain").alias("grp"), urls.canonical_or_self("url").alias("url"), F.lit(2).alias("rank"), F.lit(1).alias("depth"))
        starts = starts.unionByName(listed)
    found = backlinks.page_hits(links, urls.domain_of(F.lit(target))).groupBy(F.col("source_url").alias("url")).agg(F.count("*").alias("n"))
    known = pages.select("domain", "url", F.col("status_code").isNotNull().alias("fetched"), readable(pages).alias("html")).dropDuplicates(["domain", "url"])
    hits = known.filter("html").join(found.hint("merge"), "url", "left_semi").select(F.col("domain").alias("grp"), "url")
    reached, cut = graph.search(_own_links(pages, links).withColumnRenamed("domain", "grp"), starts, hits, None, max_pages, max_depth)
    visits = _dealt(reached.withColumnRenamed("grp", "domain"), "domain", "url").join(known.hint("merge"), ["domain", "url"], "left")
    visits = _dealt(_dealt(visits, "url").join(found.hint("merge"), "url", "left"), "domain")  # a domain's are max_pages + 1 at most
    first = visits.filter(F.col("hit") & (F.col("seq") <= max_pages)).groupBy("domain").agg(F.min("seq").alias("hit_seq"), F.min_by(F.struct("url", "n"), "seq").alias("h"))
    until = visits.join(first.select("domain", "hit_seq").hint("merge"), "domain", "left").filter(F.col("seq") <= F.coalesce("hit_seq", F.lit(max_pages)))
    counts = until.groupBy("domain").agg(
        F.count("*").alias("pages_checked"), F.count_if(F.coalesce("html", F.lit(False))).alias("html_pages_checked"), F.count_if(~F.coalesce("fetched", F.lit(False))).alias("failed_fetches")
    )
    size = visits.groupBy("domain").agg(F.max("seq").alias("reached"))
    cut = cut.select(F.col("grp").alias("domain"), F.lit(True).alias("cut"))
    out = _dealt(domains, "domain")
    for part in (size, counts, first, cut):
        out = out.join(part.hint("merge"), "domain", "left")
    status = F.when(F.col("h").isNotNull(), "confirmed").when((F.col("reached") > max_pages) | F.col("cut"), "timeout").when(F.coalesce("pages_checked", F.lit(0)) == 0, "blocked").otherwise("not_found")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("domain", status.alias("status"), *(number(F.col(c)).alias(c) for c in ("pages_checked", "html_pages_checked", "failed_fetches")), number(F.col("h.n")).alias("links_found"), F.col("h.url").alias("hit_url"))


def trace(pages: DataFrame, links: DataFrame, domains: DataFrame, target: str, max_depth: int | None = None) -> DataFrame:
    """A row per fetched page that a traversal without an early stop reaches: domain, url, depth, status_code, content_type, n_links, n_hits and the hits.

    The traversal begins at the https origin, then the http one, and follows links to the own
    domain and all that are written without a host.
    """
    starts = domains.select(F.col("domain").alias("grp"), F.explode(urls.origins("domain")).alias("url")).select("grp", urls.canonical_or_self("url").alias("url"), F.lit(0).alias("rank"), F.lit(0).alias("depth"))
    reached = graph.search(_own_links(pages, links, relative=True).withColumnRenamed("domain", "grp"), starts, max_depth=max_depth)[0].select(F.col("grp").alias("domain"), "url", "depth")
    per = links.groupBy(F.col("source_url").alias("url")).agg(F.count("*").alias("n_links"))
    hits = backlinks.page_hits(links, urls.domain_of(F.lit(target))).groupBy(F.col("source_url").alias("url")).agg(F.count("*").alias("n_hits"), F.array_sort(F.collect_set("target_url")).alias("hits"))  # as many as a page's links
    fetched = pages.filter("status_code is not null").select("domain", "url", "status_code", "content_type")
    out = _dealt(_dealt(reached, "domain", "url").join(fetched.hint("merge"), ["domain", "url"]), "url").join(per.hint("merge"), "url", "left").join(hits.hint("merge"), "url", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("domain", "url", "depth", "status_code", "content_type", zero("n_links"), zero("n_hits"), F.coalesce("hits", F.array().cast("array<string>")).alias("hits"))


def exhaustive_summary(found: DataFrame) -> DataFrame:
    """Status (success, not_found, no_referring_domains) and totals of exhaustive()'s rows."""
    links = F.coalesce(F.sum("links_found"), F.lit(0))
    status = F.when(F.count("*") == 0, "no_referring_domains").when(links > 0, "success").otherwise("not_found")
    return found.agg(status.alias("status"), F.count("*").alias("domains_investigated"), links.alias("links_found"))
