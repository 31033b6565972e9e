"""HTML and JSON reports of an audit. A report shows a summary row and the worst pages, a stated number of them;
it says how many further ones there are and where the table of all stands."""

from __future__ import annotations

import json
import re
from html import escape
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse;width:100%}td,th{border:1px solid #ccc;padding:.4em;text-align:left}.score-red{color:#b00020}.score-orange{color:#c77700}.score-green{color:#1b7f3b}"
_URL = re.compile(r"https?://[^\s<>\"']+")


def band(score: float) -> str:
    return "score-red" if score < 50 else "score-orange" if score < 90 else "score-green"


def coverage_band(score: float) -> str:
    return {10: "score-green", 9: "score-orange"}.get(score, "score-red")


def page_issues(findings: DataFrame, scores: DataFrame) -> DataFrame:
    """url, score, issues (in order) of every page that has any, for a sink that tasks write."""
    issue = F.sort_array(F.collect_list(F.struct("seq", "severity", "message", "detail"))).alias("issues")  # a page's findings: as many as rules
    per = scores.filter("n_issues > 0").select("url", "score").dropDuplicates(["url"])
    return findings.join(per, "url").groupBy("url", "score").agg(issue)


def worst_pages(issues: DataFrame, most_pages: int) -> tuple[list[dict], int]:
    """The pages (of page_issues) with the lowest scores, at most most_pages, and how many further ones there are."""
    rows = [r.asDict(recursive=True) for r in issues.orderBy("score", "url").limit(most_pages).collect()]
    return rows, issues.count() - len(rows) if len(rows) == most_pages else 0


def linkified(text: str) -> str:
    """Escaped text with bare URLs as links; text that already holds a link stays."""
    if "<a " in text:
        return text
    out, at = [], 0
    for m in _URL.finditer(text):
        out += [escape(text[at : m.start()]), f'<a href="{escape(m[0])}">{escape(m[0])}</a>']
        at = m.end()
    return "".join([*out, escape(text[at:])])


def table(head: list[str], rows: list[list[Any]], empty: str = "") -> str:
    body = "".join("<tr>" + "".join(f"<td>{linkified('' if c is None else str(c))}</td>" for c in r) + "</tr>" for r in rows)
    if not rows and empty:
        body = f'<tr><td colspan="{len(head)}">{escape(empty)}</td></tr>'
    return "<table><tr>" + "".join(f"<th>{escape(h)}</th>" for h in head) + f"</tr>{body}</table>"


def _metric(name: str, value: object, kind: str) -> str:
    return f'<div>{escape(name)}: <b class="{kind}">{escape(str(value))}</b></div>'


def _document(title: str, body: list[str]) -> str:
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title><style>{STYLE}</style></head><body><h1>{escape(title)}</h1>{''.join(body)}</body></html>"


def _listed(values: Any, none: str) -> str:
    return ", ".join(map(str, values or ())) or none


def site_section(site: dict) -> str:
    """What is known of the site as a whole."""
    domain = site.get("domain") or {}
    ssl = domain.get("ssl") or {}
    rows = [
        ["Platform", site.get("platform") or "Custom / Unknown"], ["Tracking", _listed(site.get("tracking"), "None detected")],
        ["Average DOM load (s)", site.get("average_dom_loaded_seconds", 0)], ["Average full load (s)", site.get("average_fully_loaded_seconds", 0)],
        ["Hostname", domain.get("hostname")], ["IP addresses", _listed(domain.get("ip_addresses"), "")], ["Server", domain.get("server")], ["TLS", {True: "enabled", False: "disabled"}.get(ssl.get("enabled"), "unknown")],
    ]
    return "<h2>Site</h2>" + table(["Field", "Value"], rows)


def backlink_section(layer1: dict | None, layer2: dict | None, show_total: bool = True) -> str:
    """Referring domains and page-level backlinks with their statuses. Without layer-2 rows that block is left out."""
    if layer1 is None and layer2 is None:
        return ""
    one, two = layer1 or {}, layer2 or {}
    rows = one.get("backlinks") or []
    facts = [["Status", one.get("status", "unknown")], *([["Backlinks", one.get("total_backlinks", len(rows))]] if show_total else []), ["Referring domains", one.get("referring_domains", len({r.get("referring_domain") for r in rows}))]]
    out = "<h2>Backlinks</h2>" + table(["Measure", "Value"], facts)
    out += "<h3>Referring domains</h3>" + table(["Domain", "Source", "Target"], [[r.get("referring_domain"), r.get("source_url"), r.get("target_url")] for r in rows], "No referring domains available.")
    if two.get("backlinks"):
        out += f"<h3>Confirmed on pages ({escape(str(two.get('status', 'unknown')))})</h3>" + table(["Source", "Target", "Anchor", "Rel"], [[r.get("source_url"), r.get("target_url"), r.get("anchor_text"), r.get("rel")] for r in two["backlinks"]])
    return out


def pages_section(pages: list[dict], further: int = 0, elsewhere: str = "") -> str:
    """Issues grouped by page; further: how many pages with issues aren't shown, elsewhere: where all of them are."""
    said = lambda i: i["message"] + (f" ({i['detail']})" if i.get("detail") else "")
    rows = [[p["url"], p["score"], ", ".join(map(said, p["issues"]))] for p in pages if p["issues"]]
    more = f"<p>{further} more pages have issues; all are in {escape(elsewhere)}.</p>" if further else ""
    return "<h2>Issues by page</h2>" + table(["Page", "Score", "Issues"], rows, "No issues detected.") + more


def html_report(crawl_id: Any, summary: dict, site: dict, pages: list[dict], layer1: dict | None = None, layer2: dict | None = None, further: int = 0, elsewhere: str = "", show_total: bool = True) -> str:
    """The audit's report: scores, totals, site, backlinks, issues by page."""
    return _document(f"Audit {crawl_id}", [
        _metric("SEO score", f"{summary['seo_score']}/100", band(summary["seo_score"])),
        _metric("Site health", f"{summary['site_health']}/100", band(summary["site_health"])),
        _metric("Crawl coverage", f"{summary['crawl_coverage_score']}/10", coverage_band(summary["crawl_coverage_score"])),
        "<h2>Totals</h2>", table(["Measure", "Value"], [[k, v] for k, v in summary.items()]),
        site_section(site), backlink_section(layer1, layer2, show_total), pages_section(pages, further, elsewhere),
    ])


def category_report(counts: list[dict], health: int, issues: list[dict] | None = None) -> str:
    """The categorised profile: categories by number of issues, most first, and the issues themselves where given."""
    totals: dict[str, int] = {}
    for r in counts:
        totals[r["category"]] = totals.get(r["category"], 0) + r["n"]
    rows = sorted(totals.items(), key=lambda x: -x[1])
    body = [_metric("Health", f"{health}/100", band(health)), "<h2>Issue distribution</h2>", table(["Category", "Issues"], [list(r) for r in rows], "No issues detected.")]
    if issues is not None:
        names = ("severity", "category", "issue", "url", "details")
        body += ["<h2>All issues</h2>", table([n.title() for n in names], [[i[n] for n in names] for i in issues], "No issues detected.")]
    return _document("SEO audit by category", body)


def pipeline_report(scores: dict, site: dict, pages: list[dict]) -> str:
    """The short profile: scores, site, and the plain-text issues (url, issues) of each page."""
    rows = [[p["url"], ", ".join(p["issues"])] for p in pages if p["issues"]]
    return _document("SEO audit", [
        _metric("SEO score", f"{scores['seo_score']}/100", band(scores["seo_score"])), _metric("Health", f"{scores['health']}/100", band(scores["health"])), _metric("Pages", len(pages), ""),
        site_section(site), "<h2>Issues by page</h2>", table(["Page", "Problems"], rows, "No issues detected."),
    ])


def details_report(pages: list[dict]) -> str:
    """A few pages in full: a summary row for each, then every field of every page."""
    names = ("status_code", "url", "title", "word_count", "fully_loaded_seconds", "platform", "tracking", "schemas")
    shown = lambda v: _listed(v, "None") if isinstance(v, list | tuple) else v
    body = ["<h2>Summary</h2>", table([n.replace("_", " ").title() for n in names], [[shown(p.get(n)) for n in names] for p in pages], "No pages."), "<h2>Details</h2>"]
    for k, p in enumerate(pages, 1):
        body += [f"<h3>{k}. {linkified(str(p.get('url', '')))}</h3>", table(["Field", "Value"], [[name, shown(v)] for name, v in p.items()])]
    return _document("Page details", body)


def json_report(summary: dict, site: dict, pages: list[dict], further: int = 0, elsewhere: str = "") -> str:
    """The report as JSON; further pages with issues, if any, are counted and said to be elsewhere."""
    rest = {"further_pages": further, "all_pages": elsewhere} if further else {}
    return json.dumps({"summary": summary, "site": site, "pages": pages, **rest}, ensure_ascii=False, indent=2, default=str)


def patched(report: str, **fields: Any) -> str:
    """A JSON report with fields laid over it; a mapping is merged into the one that stands there."""
    data = json.loads(report)
    for name, value in fields.items():
        data[name] = data[name] | value if isinstance(value, dict) and isinstance(data.get(name), dict) else value
    return json.dumps(data, ensure_ascii=False, indent=2, default=str)
