"""Backlinks: referring domains from a domain graph, confirmation on pages, public and historical discovery.

Live fetching is a source's business; these operators work on tables of pages, anchors and hits.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelume.functions import urls
from sitelume.functions.html import html_anchors, result_links
from sitelume.functions.text import materialised, strip
from sitelume.operators import graph
from sitelume.operators.links import classify_rel, rel_flags
from sitelume.sources import files, readers, webgraph

#: Status of the domain-graph lookup.
L1_STATUSES = ("invalid_target", "not_configured", "graph_missing", "not_in_graph", "success", "failed")
#: Fixed value: what counts as a link in an archived page.
ARCHIVED_HREF = r"""(?i)<a\b[^>]*?href\s*=\s*["']([^"']+)["']"""
#: Narrower than for page extraction: data: links aren't skipped.
SKIPPED = ("#", "javascript:", "mailto:", "tel:")


def vertex_id(vertices: DataFrame, target: str) -> DataFrame:
    """id of a domain; vertices: id, rev (reversed name). Several lines of one name: the smallest id."""
    rev = urls.reverse_domain(urls.bare_domain(F.lit(target)))
    return vertices.filter(F.lower(F.trim("rev")) == rev).agg(F.min("id").alias("id")).filter("id is not null")


def referring_domains(vertices: DataFrame, edges_t: DataFrame, target: str) -> DataFrame:
    """Domains with a link to the target. edges_t: node, pred (transposed adjacency).

    The lookup gives one id, a broadcast of one row; the predecessors' names come by an equi-join
    that Catalyst plans by size.
    """
    node = vertex_id(vertices, target).withColumnRenamed("id", "node")
    preds = edges_t.join(F.broadcast(node), "node", "left_semi").select(F.col("pred").alias("id")).distinct()
    domain = urls.reverse_domain(F.lower(F.trim("rev")))
    return vertices.join(preds, "id").select("id", domain.alias("referring_domain"), F.concat(F.lit("https://"), domain, F.lit("/")).alias("source_url"))


def referring_domains_of_file(vertices: DataFrame, graph_path: str, target: str) -> DataFrame:
    """referring_domains() over a transposed graph's own file: the target's id reaches the driver, and only its record is read."""
    spark = vertices.sparkSession
    node = vertex_id(vertices, target).first()
    return referring_domains(vertices, webgraph.predecessors(spark, graph_path, [node.id] if node else []), target)


def many_referring_domains(vertices: DataFrame, edges_t: DataFrame, targets: DataFrame) -> DataFrame:
    """referring_domains of a table of targets (domain), by equi-joins throughout."""
    named = vertices.select("id", F.lower(F.trim("rev")).alias("rev"))
    nodes = targets.select("domain", urls.reverse_domain("domain").alias("rev")).join(named, "rev").select("domain", F.col("id").alias("node"))
    return nodes.join(edges_t, "node").select("domain", F.col("pred").alias("id")).distinct().join(named, "id").select("domain", "id", urls.reverse_domain("rev").alias("referring_domain"))


def page_hits(links: DataFrame, target: Column) -> DataFrame:
    """Links whose host is the target's. links: source_url, url, anchor, rel and any further columns."""
    absolute = urls.without_fragment(urls.resolve("source_url", strip("url")))
    rest = [c for c in links.columns if c != "target_url"]
    kept = materialised(links.filter(~urls.skipped("url", SKIPPED)), *rest, target_url=urls.canonical_or_self(absolute))
    return kept.filter((target != "") & (urls.bare_domain("target_url") == target)).withColumns(dict(zip(("nofollow", "ugc", "sponsored"), rel_flags("rel"), strict=True)))


def first_hits(hits: DataFrame, domain: str, order: list[str]) -> DataFrame:
    """The hits on the first page per domain that has any, by visiting order.

    The first page is a minimum with a partial aggregate; no domain's hits are sorted in one task.
    """
    first = hits.groupBy(domain).agg(F.min(F.struct(*order)).alias("_first"))
    return hits.join(first, domain).filter(F.struct(*order) == F.col("_first")).drop("_first")


def investigate(pages: DataFrame, links: DataFrame, domains: DataFrame, target: str, max_pages: int = 1000, max_depth: int | None = None) -> DataFrame:
    """domain, status, pages_checked and first hit page of each referring domain, on a fixed corpus.

    pages: url, domain, status_code, content_type. links: source_url, url, anchor, rel. A domain's
    crawl starts at its origins, follows links within the domain and stops at the first page with
    a link to the target, or with a timeout: beyond max_pages pages, or max_depth links where that is given. The
    limit is in pages, as a fixed corpus has no clock. Every join is by sorting: all its sides grow with the
    corpus, whatever a plan takes them for, and none is built on the driver.
    """
    ok = pages.filter(F.col("status_code").between(200, 399) & F.contains(F.lower("content_type"), F.lit("text/html"))).select(F.col("domain").alias("grp"), "url")
    inner = links.join(ok.withColumnRenamed("url", "source_url").hint("merge"), "source_url")
    inner = materialised(inner, "grp", "source_url", to=urls.canonical_or_self(urls.resolve("source_url", strip("url"))))
    own = inner.filter(urls.bare_domain("to") == F.col("grp")).select("grp", F.col("source_url").alias("source"), F.col("to").alias("target"))
    plain = F.startswith("url", F.lit("http:")).cast("int")
    starts = domains.select(F.col("domain").alias("grp"), F.explode(F.transform(urls.origins("domain"), urls.canonical_or_self)).alias("url")).select("grp", "url", plain.alias("rank"), F.lit(0).alias("depth"))
    hits = page_hits(links, urls.bare_domain(F.lit(target))).groupBy(F.col("source_url").alias("url")).agg(F.count("*").alias("n"))
    visits, cut = graph.search(own, starts, ok.join(hits.hint("merge"), "url", "left_semi"), ok, max_pages, max_depth, plain)
    hit = visits.filter(F.col("hit") & (F.col("seq") <= max_pages)).groupBy("grp").agg(F.min("seq").alias("hit_seq"), F.min_by("url", "seq").alias("url")).join(hits.hint("merge"), "url", "left")
    reached = visits.groupBy("grp").agg(F.max("seq").alias("reached"))
    found = domains.withColumn("grp", F.col("domain")).join(reached.hint("merge"), "grp", "left").join(hit.hint("merge"), "grp", "left").join(cut.withColumn("cut", F.lit(True)).hint("merge"), "grp", "left")
    limited = F.least(F.coalesce("reached", F.lit(0)), F.lit(max_pages))
    return found.select(
        "domain", F.when(F.col("hit_seq").isNotNull(), "confirmed").when((F.col("reached") > max_pages) | F.col("cut"), "timeout").otherwise("not_found").alias("status"),
        F.coalesce("hit_seq", limited).cast("long").alias("pages_checked"), F.col("url").alias("hit_url"), F.coalesce("n", F.lit(0)).alias("links_found"),
    )


def layer2_summary(found: DataFrame) -> DataFrame:
    """Overall status and totals of investigate()'s rows; no rows mean no_referring_domains."""
    any_of = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    overall = F.when(F.count("*") == 0, "no_referring_domains").when(any_of("confirmed"), "confirmed").when(any_of("timeout"), "timeout").when(any_of("error"), "error").when(any_of("blocked"), "blocked").otherwise("not_found")
    return found.agg(overall.alias("status"), F.count("*").alias("domains_investigated"), F.coalesce(F.sum("links_found"), F.lit(0)).alias("links_found"))


def layer1(vertices: DataFrame | None, edges_t: DataFrame | str | None, target: str, configured: bool = True) -> tuple[str, DataFrame | None]:
    """Status of the domain-graph lookup (one of L1_STATUSES), and its rows if it succeeded. edges_t: a table, or the name of the graph's own file.

    configured: whether a folder of the graph is named at all; the tables are None where it lacks them.
    """
    if not configured:
        return "not_configured", None
    if vertices is None or edges_t is None:
        return "graph_missing", None
    try:
        if vertices.sparkSession.range(1).select(urls.bare_domain(F.lit(target)) == "").first()[0]:
            return "invalid_target", None
        if vertex_id(vertices, target).isEmpty():
            return "not_in_graph", None
        return "success", (referring_domains_of_file if isinstance(edges_t, str) else referring_domains)(vertices, edges_t, target)
    except PySparkException:  # a table that can't be read
        return "failed", None


def layer1_facts(spark: SparkSession, folder: str | None, target: str, most: int) -> dict:
    """What a report says of the lookup in a folder of graph releases: status, release, totals, and the first rows by domain, most at most."""
    release = readers.graph_release(files.names(folder)) if folder else None
    stem = f"{folder}/{release}"
    status, rows = layer1(readers.vertices_tsv(spark, f"{stem}-vertices.txt.gz") if release else None, stem if release else None, target, bool(folder))
    facts = {"status": status, "graph_release": release, "total_backlinks": 0, "referring_domains": 0, "backlinks": []}
    if rows is not None:
        rows = graph.checkpoint(rows)
        n = rows.count()
        shown = rows.orderBy("referring_domain").limit(most).collect()
        facts |= {"total_backlinks": n, "referring_domains": n, "backlinks": [{"referring_domain": r.referring_domain, "source_url": r.source_url, "target_url": target} for r in shown]}
    return facts


def public_backlinks(sources: DataFrame, target: str) -> DataFrame:
    """Distinct anchors to the target on pages outside it. sources: url, final_url, content_type, html."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    t = F.lit(target)
    own = urls.is_target("url", t) | urls.is_target("final_url", t)
    read = sources.filter(~own & ((kind == "") | F.contains(kind, F.lit("html")))).select("final_url", F.explode(html_anchors("html", "final_url")).alias("a"))
    rows = read.select(F.col("final_url").alias("source_url"), urls.domain_of("final_url").alias("source_domain"), F.col("a.url").alias("target_url"), F.col("a.anchor").alias("anchor_text"), F.col("a.rel").alias("rel"))
    kept = rows.filter(urls.is_target("target_url", t)).withColumn("backlink_type", classify_rel("rel"))
    return kept.dropDuplicates(["source_url", "target_url", "anchor_text", "rel"])


def backlink_totals(backlinks: DataFrame) -> DataFrame:
    """Totals, referring domains and counts by type in one row."""
    kinds = ("sponsored", "ugc", "nofollow", "dofollow")
    return backlinks.agg(F.count("*").alias("total_backlinks"), F.count_distinct("source_domain").alias("referring_domains"), *(F.count_if(F.col("backlink_type") == k).alias(k) for k in kinds))


def candidates(found: DataFrame, target: str, per_query: int) -> DataFrame:
    """Distinct candidate URLs in the order they came. found: query_no, pos, url.

    At most per_query results of a query count; URLs of the target itself are left out.
    """
    top = found.filter((F.col("pos") < per_query) & ~urls.is_target("url", F.lit(target)) & (F.col("url") != ""))
    return top.groupBy("url").agg(F.min(F.struct("query_no", "pos")).alias("first")).select("url", "first.query_no", "first.pos")


def search_hits(serps: DataFrame, engine: str) -> DataFrame:
    """query_no, pos, url of stored result pages (query_no, html) of an engine; a redirect's own target is taken out of it."""
    links = serps.select("query_no", F.posexplode(result_links("html", engine)).alias("pos", "href"))
    wrapped = F.regexp_extract("href", r"[?&]uddg=([^&#]*)", 1)
    target = F.when(F.lit(engine == "duckduckgo") & (wrapped != ""), F.coalesce(F.try_url_decode(wrapped), wrapped)).otherwise(F.col("href"))
    return links.select("query_no", "pos", target.alias("url")).filter(F.col("url").rlike("^https?://"))


def historical_first_hits(records: DataFrame, target: str) -> DataFrame:
    """The first record, by crawl and row, of an URL not seen in an earlier crawl of its domain that links to the target.

    records: domain, crawl_no, row_no, url, html.
    """
    unseen = records.groupBy("domain", "url").agg(F.min(F.struct("crawl_no", "row_no")).alias("f"))
    first = records.join(unseen, ["domain", "url"]).filter(F.struct("crawl_no", "row_no") == F.col("f")).drop("f")
    hrefs = F.regexp_extract_all("html", F.lit(ARCHIVED_HREF), F.lit(1))
    h = lambda x: urls.text_host(x)
    t = urls.text_host(F.lit(target))
    hits = F.filter(hrefs, lambda x: (h(x) == t) | F.endswith(h(x), F.concat(F.lit("."), t)))
    found = first.withColumn("hits", hits)
    best = found.filter(F.size("hits") > 0).groupBy("domain").agg(F.min_by(F.struct("crawl_no", "row_no", "url", F.get("hits", F.lit(0)).alias("href")), F.struct("crawl_no", "row_no")).alias("b"))
    checked = found.groupBy("domain").agg(F.count("*").alias("pages_available"))
    return checked.join(best, "domain", "left").select(
        "domain", F.when(F.col("b").isNotNull(), "confirmed_historical").otherwise("not_found").alias("status"), "pages_available", "b.crawl_no", "b.row_no", "b.url", "b.href"
    )
