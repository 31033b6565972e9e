"""python -m sitelume CRAWL.json OUT_DIR [MOST_PAGES [GRAPH_DIR]]: audit a crawl export and write its reports.

Under spark-submit the submitted session is used, otherwise a local one. A crawl that is one JSON
document is read by one task; a folder of one document per line (CRAWL.jsonl) by many. The reports show
the MOST_PAGES worst pages (1000); the table of all pages with issues stands beside them. GRAPH_DIR is a folder
of domain-graph releases (NAME.graph, NAME.properties, NAME-vertices.txt.gz): the last one's referring domains
of the crawled site are in the report, too.
"""

from __future__ import annotations

import os
import sys
from pathlib import PurePosixPath

from pyspark import SparkConf
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sitelume import report
from sitelume.operators import backlinks, links, rules, scoring
from sitelume.session import local_session
from sitelume.sources import readers, sinks


def session() -> SparkSession:
    """The running or submitted session; a local one where no master is set."""
    submitted = SparkSession.getActiveSession() or "spark.master" in dict(SparkConf().getAll()) or "MASTER" in os.environ
    return SparkSession.builder.getOrCreate() if submitted else local_session()


def main(crawl_path: str, out: str, most_pages: str = "1000", graph_dir: str | None = None) -> None:
    spark = session()
    crawl = readers.crawl_json(spark, crawl_path)
    head = crawl.select("crawl_id", "start_url", "site").first()
    pages = readers.crawl_pages(crawl)
    pages = links.with_degrees(pages, links.crawl_edges(pages, readers.crawl_links(crawl), head.start_url))
    findings = rules.audit_findings(pages)
    site = crawl.select(F.col("site.pages_discovered").alias("pages_discovered"), F.col("site.domain.ssl.enabled").alias("ssl_enabled"), F.col("site.domain.hostname").alias("hostname"), F.col("site.platform").alias("platform"))
    summary = scoring.summary(pages, site).first().asDict()
    stem = PurePosixPath(crawl_path).stem
    everything = f"{out}/issues_{stem}"
    report.page_issues(findings, scoring.page_scores(pages, findings)).write.mode("overwrite").json(everything)
    issues = spark.read.schema("url string, score int, issues array<struct<seq:int,severity:string,message:string,detail:string>>").json(everything)
    shown, further = report.worst_pages(issues, int(most_pages))
    facts = {"start_url": head.start_url, **(head.site.asDict(recursive=True) if head.site else {})}
    layer1 = backlinks.layer1_facts(spark, graph_dir, head.start_url, int(most_pages)) if graph_dir else None
    sinks.write_text(spark, f"{out}/audit_{stem}.json", report.json_report(summary, facts, shown, further, everything))
    sinks.write_text(spark, f"{out}/report_{head.crawl_id}.html", report.html_report(head.crawl_id, summary, facts, shown, layer1, further=further, elsewhere=everything))


if __name__ == "__main__":
    main(*sys.argv[1:5])
