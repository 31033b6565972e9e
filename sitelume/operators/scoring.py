"""Scores and roll-ups of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelume.functions.text import banker, clip, number, text
from sitelume.operators import rules

#: Weight of a finding by severity; any other weighs 1.
WEIGHTS = {"critical": 5.0, "high": 4.0, "medium": 2.5, "notice": 1.0}
MOST_WEIGHT = sum(WEIGHTS.values())
#: What is added up over pages.
COUNTED = ("checks", "passed", "n_failed", "n_noindex", "total_issues", *WEIGHTS)


def weight(severity: Column) -> Column:
    out = F.lit(1.0)
    for name, w in WEIGHTS.items():
        out = F.when(severity == name, w).otherwise(out)
    return out


def raw_score(penalty: Column) -> Column:
    """The expression stays as written: its rounding in doubles is part of the average."""
    return clip(100 - (penalty / MOST_WEIGHT * 100))


def page_scores(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """url, raw, score, n_issues per page row. Findings are keyed by URL, so rows of one URL share theirs."""
    per = findings.groupBy("url").agg(F.sum(weight(F.col("severity"))).alias("penalty"), F.count("*").alias("n_issues"))
    raw = raw_score(F.coalesce("penalty", F.lit(0.0)))
    return pages.select("url").join(per, "url", "left").select("url", raw.alias("raw"), banker(raw).alias("score"), F.coalesce("n_issues", F.lit(0)).alias("n_issues"))


def site_health(n_pages: Column, n_failed: Column, n_noindex: Column, ssl: Column, hostname: Column, platform: Column) -> Column:
    """ssl: true, false, or null where unknown (not penalised)."""
    n = F.greatest(n_pages, F.lit(1))
    penalty = (
        F.when(n_failed > 0, F.least(F.lit(35.0), n_failed / n * 35)).otherwise(0.0)
        + F.when(n_noindex > 0, F.least(F.lit(25.0), n_noindex / n * 25)).otherwise(0.0)
        + F.when(F.coalesce(~ssl, F.lit(False)), 25.0).otherwise(0.0)
        + F.when(text(hostname) == "", 10.0).otherwise(0.0)
        + F.when(text(platform) == "", 5.0).otherwise(0.0)
    )
    return banker(clip(100 - penalty))


def coverage_score(crawled: Column, discovered: Column) -> Column:
    share = F.when(discovered > 0, crawled / discovered * 100).otherwise(0.0)
    return F.when(share >= 98, 10).when(share >= 95, 9).otherwise(7)


def score_band(score: Column) -> Column:
    return F.when(score < 50, "score-red").when(score < 90, "score-orange").otherwise("score-green")


def coverage_band(score: Column) -> Column:
    return F.when(score == 10, "score-green").when(score == 9, "score-orange").otherwise("score-red")


def _sums_by_url(pages: DataFrame, plain: DataFrame | None) -> DataFrame:
    """Sums by URL of what the rules find, as rows of one URL share their findings: rows, penalty, and the counters.

    The rules are evaluated once per page row. plain: the same pages where pages come out of joins
    (with degrees) that the duplicate rules don't need.
    """
    status, robots = number("status_code"), F.lower(text("robots"))
    one = lambda c: F.when(c, 1).otherwise(0)
    named = lambda s: F.size(F.filter("findings", lambda f: f["severity"] == s))
    own = rules.evaluated(pages, rules.audit_rules()).select(
        "url", F.lit(1).alias("rows"), "checks", "passed", one(status >= 400).alias("n_failed"), one(F.contains(robots, F.lit("noindex"))).alias("n_noindex"),
        F.aggregate("findings", F.lit(0.0), lambda a, f: a + weight(f["severity"])).alias("penalty"), F.size("findings").alias("total_issues"), *(named(s).alias(s) for s in WEIGHTS),
    )
    severity = F.col("severity")
    shared = rules.duplicate_findings(pages if plain is None else plain).select(
        "url", *(F.lit(0).alias(c) for c in ("rows", "checks", "passed", "n_failed", "n_noindex")), weight(severity).alias("penalty"), F.lit(1).alias("total_issues"), *(one(severity == s).alias(s) for s in WEIGHTS)
    )
    return own.unionByName(shared).groupBy("url").agg(*(F.sum(c).alias(c) for c in ("rows", "penalty", *COUNTED)))


def audited_scores(pages: DataFrame, plain: DataFrame | None = None) -> DataFrame:
    """page_scores() of pages straight from the rules: no findings are written out and gathered again. A URL's row is repeated as often as it has pages; pages without URL have none."""
    raw = raw_score(F.col("penalty"))
    sums = _sums_by_url(pages, plain).filter("url is not null and rows > 0")
    scored = sums.select("url", raw.alias("raw"), banker(raw).alias("score"), F.col("total_issues").alias("n_issues"), "rows")
    return scored.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).select("url", "raw", "score", "n_issues")


def summary(pages: DataFrame, site: DataFrame, plain: DataFrame | None = None) -> DataFrame:
    """One row of totals, from sums by URL. site: one row of pages_discovered, ssl_enabled, hostname, platform."""
    total = _sums_by_url(pages, plain).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("pages_crawled"), (F.sum(F.col("rows") * raw_score(F.col("penalty"))) / F.sum("rows")).alias("mean"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTED)
    )
    both = total.join(site.limit(1))  # one row each
    n = F.col("pages_crawled")
    found = F.greatest(F.coalesce(F.when(F.col("pages_discovered") != 0, F.col("pages_discovered")), n), n)
    return both.select(
        F.coalesce(banker(F.col("mean")), F.lit(0)).alias("seo_score"), site_health(n, F.col("n_failed"), F.col("n_noindex"), F.col("ssl_enabled"), F.col("hostname"), F.col("platform")).alias("site_health"),
        "pages_crawled", found.alias("pages_discovered"), coverage_score(n, found).alias("crawl_coverage_score"),
        *WEIGHTS, "total_issues", "checks", "passed",
    )


def legacy_health(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """errors, warnings, notices, health."""
    n = issues.agg(*(F.count_if(F.col("severity") == s).alias(k) for k, s in (("errors", "ERROR"), ("warnings", "WARNING"), ("notices", "NOTICE"))))
    per = 3 * F.col("errors") + 1.5 * F.col("warnings") + 0.25 * F.col("notices")
    health = F.when(F.col("pages") == 0, 0).otherwise(banker(clip(100 - per / F.greatest("pages", F.lit(1)) * 10)))
    return n.join(pages.agg(F.count("*").alias("pages"))).select("errors", "warnings", "notices", "pages", health.alias("health"))


def category_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("category", "severity").agg(F.count("*").alias("n"))


def pipeline_scores(issues: DataFrame) -> DataFrame:
    """seo_score and health of the short profile. issues: rules.pipeline_issues."""
    status = number("status_code")
    lost = F.when(status >= 500, 20).otherwise(0) + F.when(status >= 400, 5).otherwise(0) + F.when(text("canonical") == "", 2).otherwise(0)
    return issues.agg(
        F.coalesce(banker(clip(F.avg(F.greatest(F.lit(0), 100 - 10 * F.size("issues")).cast("double")))), F.lit(0)).alias("seo_score"),
        F.coalesce(banker(clip((100 - F.sum(lost)).cast("double"))), F.lit(0)).alias("health"),
    )


def template_scores(issues: DataFrame, https: bool = True) -> DataFrame:
    """seo_score and health of the template profile."""
    status = number("status_code")
    total = 10 * F.count("*")
    good, bad = F.sum(F.when(F.size("issues") == 0, 10).otherwise(0)), F.sum(F.size("issues"))
    critical = F.sum(F.when(status >= 500, 2).otherwise(0) + F.when(text("canonical") == "", 1).otherwise(0)) + (0 if https else 3)
    return issues.agg(banker(clip(good / total * 100 - bad / total * 25)).alias("seo_score"), banker(clip((100 - 5 * critical).cast("double"))).alias("health"))
