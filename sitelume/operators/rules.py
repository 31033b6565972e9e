"""Audit rules as data, compiled to one array Column: a single projection tells all findings of a page.

A Rule says when it is evaluated, when it passes and what a failure says. ``findings`` evaluates
all rules of a profile in one pass over the page, without a UDF; only the duplicate rules need
other pages: the folded values are counted, and those of several pages joined back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelume.functions import urls
from sitelume.functions.text import folded, items, number, present, strip, text

IMAGES = "array<struct<url:string,alt:string,width:string,height:string,loading:string>>"
FINDING = "struct<seq:int,severity:string,message:string,detail:string>"


@dataclass(frozen=True)
class Rule:
    seq: int
    passes: Column
    severity: Column
    message: Column
    detail: Column
    when: Column | None = None


def _rule(seq: int, passes: Column, severity, message, detail="", when: Column | None = None) -> Rule:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return Rule(seq, passes, as_col(severity), as_col(message), as_col(detail), when)


def _count(n: Column, what: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {what}"))


def alt_missing(images: Column) -> Column:
    """Images whose alternative text is absent or blank."""
    return F.size(F.filter(images, lambda i: strip(i["alt"]) == ""))


def audit_rules() -> list[Rule]:
    """The checks of the site audit; columns as in the page table, links_out beside them."""
    status, n_words = number("status_code"), number("word_count")
    title, description = strip("title"), strip("meta_description")
    n_title, n_description = F.length(title), F.length(description)
    n_h1 = F.size(items("h1s", "array<string>"))
    images = items("images", IMAGES)
    n, missing = F.size(images), alt_missing(images)
    robots = F.lower(text("robots"))
    return [
        _rule(1, (status >= 200) & (status < 400), F.when(status >= 500, "critical").otherwise("high"), F.concat(F.lit("HTTP "), status.cast("string"))),
        _rule(2, title != "", "critical", "Missing title"),
        _rule(3, n_title.between(30, 60), F.when(n_title > 60, "medium").otherwise("notice"), F.when(n_title > 60, "Long title").otherwise("Short title"), _count(n_title, "characters"), title != ""),
        _rule(4, description != "", "medium", "Missing meta description"),
        _rule(5, n_description.between(70, 160), "notice", F.when(n_description > 160, "Long meta description").otherwise("Short meta description"), _count(n_description, "characters"), description != ""),
        _rule(6, n_h1 == 1, F.when(n_h1 == 0, "critical").otherwise("medium"), F.when(n_h1 == 0, "No H1").otherwise("Multiple H1s"), _count(n_h1, "H1s")),
        _rule(7, n_words >= 300, F.when(n_words < 100, "medium").otherwise("notice"), F.when(n_words < 100, "Very low word count").otherwise("Low word count"), _count(n_words, "words")),
        _rule(8, present("canonical"), "medium", "Missing canonical"),
        _rule(9, missing == 0, F.when(missing > F.greatest(F.lit(2), F.floor(n / 2)), "medium").otherwise("notice"), _count(missing, "images have no alt text"), F.concat_ws("/", missing, n), n > 0),
        _rule(10, F.coalesce(F.col("links_out"), F.lit(0)) > 0, "medium", "No internal links"),
        _rule(11, ~F.contains(robots, F.lit("noindex")), "critical", "Noindex directive"),
        _rule(12, F.size(items("schemas", "array<string>")) > 0, "notice", "No structured data"),
        _rule(13, text("language") != "", "notice", "Missing HTML language"),
        _rule(14, text("viewport") != "", "notice", "Missing viewport"),
    ]


def evaluated(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """pages with checks, passed and findings (array of FINDING)."""
    asked = [F.lit(True) if r.when is None else r.when for r in rules]
    ok = [F.coalesce(r.passes, F.lit(False)) for r in rules]
    one = lambda c: F.when(c, 1).otherwise(0)
    failed = F.array(*(F.when(a & ~o, F.struct(F.lit(r.seq).alias("seq"), r.severity.alias("severity"), r.message.alias("message"), r.detail.alias("detail"))) for r, a, o in zip(rules, asked, ok, strict=True)))
    return pages.withColumns({
        "checks": sum((one(a) for a in asked[1:]), one(asked[0])),
        "passed": sum((one(a & o) for a, o in zip(asked[1:], ok[1:], strict=True)), one(asked[0] & ok[0])),
        "findings": F.filter(failed, lambda x: x.isNotNull()),
    })


def duplicate_findings(pages: DataFrame, labels: tuple[str, str] = ("Duplicate title", "Duplicate meta description")) -> DataFrame:
    """url, seq, severity, message, detail of pages that share a folded title or description."""

    asked = F.array(*(F.struct(F.lit(seq).alias("seq"), F.lit(label).alias("message"), folded(c).alias("key")) for seq, label, c in zip((15, 16), labels, ("title", "meta_description"), strict=True)))
    keyed = pages.select("url", F.explode(asked).alias("f")).select("url", "f.*").filter("key <> ''")
    shared = keyed.groupBy("seq", "key").agg(F.count("*").alias("n")).filter("n > 1")  # counted before the shuffle; a hot title is one row
    return keyed.join(shared, ["seq", "key"]).select("url", "seq", F.lit("medium").alias("severity"), "message", _count(F.col("n"), "pages").alias("detail"))


def own_findings(judged: DataFrame) -> DataFrame:
    """The findings array as rows. The outer form: for the inner one a filter on the array's size would be computed first, from all the rules again."""
    return judged.select("url", F.explode_outer("findings").alias("f")).filter("f is not null").select("url", "f.*")


def audit_findings(pages: DataFrame, plain: DataFrame | None = None) -> DataFrame:
    """All findings of the audit, one row each. plain: the same pages where pages come out of joins (with degrees) that the duplicate rules don't need."""
    return own_findings(evaluated(pages, audit_rules())).unionByName(duplicate_findings(pages if plain is None else plain))


# ---- technical issues of a single page


def technical_issues(pages: DataFrame, headings: str = "h1s") -> DataFrame:
    """url, type, severity; image_missing_alt once per image without an alt attribute."""
    status, title, description = number("status_code"), text("title"), text("meta_description")
    n_h1 = F.size(items(headings, "array<string>"))
    robots = F.lower(text("robots"))
    images = items("images", IMAGES)
    issue = lambda when, kind, severity: F.when(when, F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("type"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity")))
    found = F.array(
        issue(status >= 400, F.concat(F.lit("http_"), status.cast("string")), F.when(status >= 500, "critical").otherwise("high")),
        issue(title == "", "missing_title", "high"),
        issue(F.length(title) > 60, "title_too_long", "medium"),
        issue((title != "") & (F.length(title) < 30), "title_too_short", "low"),
        issue(description == "", "missing_meta_description", "medium"),
        issue(F.length(description) > 160, "meta_description_too_long", "low"),
        issue(n_h1 == 0, "missing_h1", "high"),
        issue(n_h1 > 1, "multiple_h1", "medium"),
        issue(text("canonical") == "", "missing_canonical", "medium"),
        issue(number("word_count") < 200, "thin_content", "medium"),
        issue(F.contains(robots, F.lit("noindex")), "noindex", "info"),
        issue(F.contains(robots, F.lit("nofollow")), "nofollow", "info"),
        issue(text("language") == "", "missing_html_language", "low"),
        issue(text("viewport") == "", "missing_viewport", "low"),
    )
    no_alt = F.transform(F.filter(images, lambda i: i["alt"].isNull()), lambda i: F.struct(F.lit("image_missing_alt").alias("type"), F.lit("low").alias("severity")))
    return pages.select("url", F.explode_outer(F.concat(F.filter(found, lambda x: x.isNotNull()), no_alt)).alias("i")).filter("i is not null").select("url", "i.*")


def fetch_issues(fetches: DataFrame) -> DataFrame:
    """request_error for fetches without a response, redirect for 3xx responses. fetches: url, status_code (null: none)."""
    status = F.col("status_code")
    found = F.when(status.isNull() | (status == 0), F.struct(F.lit("request_error").alias("type"), F.lit("critical").alias("severity"))).when(status.between(300, 399), F.struct(F.lit("redirect").alias("type"), F.lit("info").alias("severity")))
    return fetches.select("url", found.alias("i")).filter("i is not null").select("url", "i.*")


def indexability_issues(pages: DataFrame) -> DataFrame:
    """url, type, severity, target of redirects, blocked pages and foreign canonicals."""
    status, robots = number("status_code"), F.lower(text("robots"))
    canonical = F.trim(text("canonical"))
    ideal = urls.normalize(urls.resolve("url", "canonical"))
    issue = lambda when, kind, severity, target: F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), target.alias("target")))
    none = F.lit("")
    found = F.array(
        issue(F.coalesce(F.col("redirect"), F.lit(False)) & (F.col("url") != F.coalesce("final_url", "url")), "redirect_target", "info", text("final_url")),
        issue((status == 200) & F.contains(robots, F.lit("noindex")), "blocked_by_noindex", "high", none),
        issue((status == 200) & (canonical != "") & (canonical != F.col("url")), "non_self_canonical", "medium", text("canonical")),
        issue((canonical != "") & (ideal != "") & (ideal != F.col("url")), "canonical_to_different_url", "medium", ideal),
    )
    return pages.select("url", F.explode_outer(F.filter(found, lambda x: x.isNotNull())).alias("i")).filter("i is not null").select("url", "i.*")


def hreflang_issues(alternates: DataFrame) -> DataFrame:
    """page_url, pos, type, severity. alternates: page_url, pos, lang, url, one row per alternate.

    An alternate without language is reported and skipped, one without a valid URL likewise; the
    others repeat a language if it stood before among valid ones.
    """
    lang = folded("lang")
    target = urls.normalize(urls.resolve("page_url", "url"))
    rows = alternates.select("page_url", "pos", lang.alias("lang"), (target != "").alias("valid"))
    per = Window.partitionBy("page_url", "lang", "valid").orderBy("pos")
    kind = F.when(F.col("lang") == "", "hreflang_missing_language").when(~F.col("valid"), "hreflang_invalid_url").when(F.row_number().over(per) > 1, "duplicate_hreflang_language")
    return rows.select("page_url", "pos", kind.alias("type"), F.lit("medium").alias("severity")).filter("type is not null")


# ---- the categorised audit


def legacy_issues(pages: DataFrame, links: DataFrame, start_url: str, failed: DataFrame | None = None) -> DataFrame:
    """category, severity, issue, url, details of the categorised profile.

    links: source_url, target_url, internal; counted as they are, without normal form or dedup.
    failed: url of failed fetches.
    """
    title = strip("title")
    description = F.when(text("description") != "", strip("description")).otherwise(strip("meta_description")) if "description" in pages.columns else strip("meta_description")
    n_title, n_description = F.length(title), F.length(description)
    n_h1, n_words, status = F.size(items("h1s", "array<string>")), number("word_count"), number("status_code")
    images = items("images", IMAGES)
    issue = lambda when, category, severity, said, detail="": F.when(when, F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(said).alias("issue"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("details")))
    seo = "On-Page SEO"
    found = F.array(
        issue(title == "", seo, "ERROR", "Missing title tag"),
        issue((title != "") & (n_title < 30), seo, "WARNING", "Title tag too short", _count(n_title, "characters")),
        issue(n_title > 60, seo, "WARNING", "Title tag too long", _count(n_title, "characters")),
        issue(description == "", seo, "ERROR", "Missing meta description"),
        issue((description != "") & (n_description < 70), seo, "NOTICE", "Meta description too short", _count(n_description, "characters")),
        issue(n_description > 160, seo, "WARNING", "Meta description too long", _count(n_description, "characters")),
        issue(n_h1 == 0, seo, "ERROR", "Missing H1"),
        issue(n_h1 > 1, seo, "WARNING", "Multiple H1 headings", _count(n_h1, "H1s")),
        issue(n_words < 100, "Content", "ERROR", "Very thin content", _count(n_words, "words")),
        issue(n_words.between(100, 299), "Content", "WARNING", "Low word count", _count(n_words, "words")),
        issue(text("canonical") == "", "Indexability", "WARNING", "Missing canonical"),
        issue(F.size(items("schemas", "array<string>")) == 0, "Structured Data", "NOTICE", "No JSON-LD structured data detected"),
        issue(status.between(400, 499), "Crawlability", "ERROR", "4xx HTTP status", status.cast("string")),
        issue(status >= 500, "Crawlability", "ERROR", "5xx HTTP status", status.cast("string")),
        issue(status.between(300, 399), "Crawlability", "WARNING", "Redirected URL", status.cast("string")),
    )
    no_alt = F.transform(F.filter(images, lambda i: strip(i["alt"]) == ""), lambda i: F.struct(F.lit("Images").alias("category"), F.lit("WARNING").alias("severity"), F.lit("Image missing ALT text").alias("issue"), text(i["url"]).alias("details")))
    internal = links.filter("internal")
    ends = internal.select(F.explode(F.array(F.struct(F.col("source_url").alias("url"), F.lit(True).alias("is_source")), F.struct(F.col("target_url").alias("url"), F.lit(False).alias("is_source")))).alias("e")).select("e.*")
    linked = ends.groupBy("url").agg(F.bool_or("is_source").alias("links_out"), F.bool_or(~F.col("is_source")).alias("linked_to"))
    unlinked = lambda c: ~F.coalesce(c, F.lit(False))
    graph = F.array(
        issue(unlinked(F.col("links_out")), "Internal Linking", "WARNING", "Page has no internal outgoing links"),
        issue(unlinked(F.col("linked_to")) & (F.col("url") != start_url), "Internal Linking", "ERROR", "Potential orphan page"),
    )
    own = pages.select("url", F.concat(F.filter(found, lambda x: x.isNotNull()), no_alt).alias("own")).join(linked, "url", "left")
    out = own.select("url", F.explode_outer(F.concat("own", F.filter(graph, lambda x: x.isNotNull()))).alias("i")).filter("i is not null").select("i.category", "i.severity", "i.issue", "url", "i.details")
    row = lambda df, category, severity, said, detail: df.select(F.lit(category).alias("category"), F.lit(severity).alias("severity"), said.alias("issue"), "url", detail.alias("details"))
    out = out.unionByName(row(duplicate_findings(pages, ("Duplicate title tag", "Duplicate meta description")), "Duplicates", "WARNING", F.col("message"), F.col("detail")))
    return out if failed is None else out.unionByName(row(failed, "Crawlability", "ERROR", F.lit("Broken URL / failed crawl"), F.lit("")))


def pipeline_issues(pages: DataFrame, status_last: bool = False) -> DataFrame:
    """url and the plain-text issues of the short profile, as an array; fields count as they are, not stripped."""
    title, description = text("title"), text("meta_description")
    n_h1, status = F.size(items("h1s", "array<string>")), number("status_code")
    n_alt, n_links = alt_missing(items("images", IMAGES)), F.coalesce(F.col("links_out"), F.lit(0))
    issue = lambda when, said: F.when(when, said if isinstance(said, Column) else F.lit(said))
    http = issue(status >= 400, F.concat(F.lit("HTTP "), status.cast("string")))
    others = [
        issue(title == "", "Missing title"),
        issue((title != "") & (F.length(title) < 30), "Short title"),
        issue(F.length(title) > 60, "Long title"),
        issue(description == "", "Missing meta description"),
        issue((description != "") & (F.length(description) < 70), "Short meta description"),
        issue(F.length(description) > 160, "Long meta description"),
        issue(n_h1 == 0, "No H1"),
        issue(n_h1 > 1, _count(n_h1, "H1s")),
        issue(number("word_count") < 300, "Low word count"),
        issue(n_alt > 0, _count(n_alt, "images without ALT")),
        issue(n_links == 0, "No internal links"),
        issue(n_links.between(1, 2), "Low internal links"),
        issue(text("canonical") == "", "Missing canonical"),
        issue(F.size(items("schemas", "array<string>")) == 0, "No structured data"),
    ]
    found = F.array(*([*others, http] if status_last else [http, *others]))
    return pages.select("url", "status_code", "canonical", F.filter(found, lambda x: x.isNotNull()).alias("issues"))
