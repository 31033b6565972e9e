"""Signature tables and their matching: which vendors' marks does a page carry.

Tables are data: name -> patterns. All plain marks of a page are found by one automaton in one pass
(marks(), an Arrow function); what they say of the page are Columns over the marks found, so the
page's length is paid once and not for each mark.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelume.functions.text import text

UNKNOWN = "Custom / Unknown"

#: Marks of tracking vendors.
TRACKING = {
    "Google Analytics": ["google-analytics.com", "googletagmanager.com/gtag", "gtag("],
    "Google Tag Manager": ["googletagmanager.com", "gtm.js"],
    "Google Ads": ["googleadservices.com", "googlesyndication.com", "google_conversion", "AW-"],
    "Meta Pixel": ["connect.facebook.net", "fbq(", "facebook pixel"],
    "TikTok Pixel": ["analytics.tiktok.com", "ttq."],
    "Snapchat Pixel": ["sc-static.net", "snaptr(", "snap pixel"],
    "Microsoft Clarity": ["clarity.ms", "clarity("],
    "Microsoft Advertising": ["bat.bing.com", "uetq"],
    "LinkedIn Insight": ["snap.licdn.com", "linkedin insight"],
    "Pinterest Tag": ["pintrk(", "pinimg.com/ct"],
    "Twitter/X Pixel": ["static.ads-twitter.com", "twq("],
    "Reddit Pixel": ["alb.reddit.com", "rdt("],
}
#: Marks of site platforms.
PLATFORMS = {
    "WordPress": ["wp-content/", "wp-includes/", "wp-json", "wordpress"],
    "Shopify": ["cdn.shopify.com", "shopify.theme", "shopify.routes", "myshopify.com"],
    "Wix": ["wixstatic.com", "wix.com", "wixsite.com"],
    "Squarespace": ["squarespace.com", "static1.squarespace.com", "squarespace-cdn.com"],
    "Webflow": ["webflow.css", "webflow.js", "assets.website-files.com", "webflow.io"],
    "Drupal": ["drupalsettings", "drupal-settings-json", "sites/default/files", "drupal.js"],
    "Joomla": ["/media/system/js/", "/media/jui/", "joomla"],
    "Laravel": ["laravel_session", "laravel"],
    "Next.js": ["/_next/", "next/static", "__next_data__"],
    "Nuxt": ["/_nuxt/", "__nuxt__"],
    "React": ["react", "react-dom"],
    "Vue.js": ["vue", "__vue__"],
    "Angular": ["ng-version", "angular"],
}
#: Regular expressions of trackers whose surroundings are kept as evidence.
TRACKER_PATTERNS = {
    "Google Tag Manager": [r"googletagmanager\.com/gtm\.js", r"gtm-[a-z0-9]+"],
    "Google Analytics / Google tag": [r"google-analytics\.com", r"googletagmanager\.com", r"gtag\(", r"googletag\."],
    "Meta Pixel": [r"connect\.facebook\.net", r"fbq\(", r"facebook\.com/tr"],
    "TikTok Pixel": [r"analytics\.tiktok\.com", r"ttq\.", r"tiktok-pixel"],
    "Snapchat Pixel": [r"sc-static\.net", r"snaptr\(", r"snapchat"],
    "LinkedIn Insight": [r"snap\.licdn\.com", r"_linkedin_partner_id", r"linkedin\.com/insight"],
    "Microsoft Clarity": [r"clarity\.ms", r"clarity\("],
    "Hotjar": [r"static\.hotjar\.com", r"hj\("],
    "Google Ads": [r"googleadservices\.com", r"doubleclick\.net", r"conversion\.js"],
}
#: Regular expressions of platforms.
PLATFORM_PATTERNS = {
    "WordPress": [r"/wp-content/", r"/wp-includes/", r"wp-json", r"""name=["']generator["'][^>]+wordpress"""],
    "Shopify": [r"cdn\.shopify\.com", r"shopify", r"myshopify\.com"],
    "Wix": [r"wixstatic\.com", r"wix\.com"],
    "Joomla": [r"/media/system/", r"joomla"],
    "Drupal": [r"drupal-settings-json", r"/sites/default/files/"],
    "Laravel": [r"laravel", r"laravel_session"],
    "Next.js": [r"__next_data__", r"/_next/"],
    "Nuxt": [r"__nuxt__", r"/_nuxt/"],
    "React": [r"react", r"react-dom"],
    "Vue.js": [r"vue", r"vuejs"],
}


def searched(html: Column | str, scripts: Column | None = None) -> Column:
    """The lower-case text that signatures are looked for in."""
    both = text(html) if scripts is None else F.concat(text(html), F.lit("\n"), F.array_join(scripts, "\n"))
    return F.lower(both)


@lru_cache(maxsize=64)
def _finder(wanted: tuple[str, ...]) -> Callable[[Column], Column]:
    """Function of a text: the wanted marks that it has, each once. One automaton is built by each task."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(low: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for mark in filter(None, wanted):
            automaton.add_word(mark, mark)
        automaton.make_automaton()
        always = {m for m in wanted if not m}  # every text has the empty mark
        for texts in low:
            yield texts.map(lambda t: list(always.union(mark for _, mark in automaton.iter(t or ""))))

    return found


def marks(low: Column, *tables: dict[str, list[str]]) -> Column:
    """The marks of all tables, in lower case, that occur in low: one pass over the text, whatever their number."""
    wanted = tuple(sorted({p.lower() for table in tables for patterns in table.values() for p in patterns}))
    if not any(wanted):
        return F.array(*map(F.lit, wanted)).cast("array<string>")
    return _finder(wanted)(low)


def hits(low: Column, table: dict[str, list[str]], found: Column | None = None) -> Column:
    """Array of (name, evidence) of the names with a hit, by name. found: marks() of several tables, this one among them."""
    seen = marks(low, table) if found is None else found
    rows = [F.struct(F.lit(name).alias("name"), F.array_compact(F.array(*(F.when(F.array_contains(seen, p.lower()), F.lit(p)) for p in patterns)).cast("array<string>")).alias("evidence")) for name, patterns in sorted(table.items())]
    return F.filter(F.array(*rows).cast("array<struct<name:string,evidence:array<string>>>"), lambda x: F.size(x["evidence"]) > 0)


def names(found: Column) -> Column:
    return F.transform(found, lambda x: x["name"])


def evidence(found: Column) -> Column:
    return F.map_from_entries(found)


def first_name(found: Column) -> Column:
    """The alphabetically first name, or UNKNOWN."""
    return F.coalesce(F.get(found, F.lit(0))["name"], F.lit(UNKNOWN))


def best_name(low: Column, headers: Column, table: dict[str, list[str]]) -> Column:
    """The name with the most patterns found in text or headers; the table's order decides ties."""
    seen = F.array_union(marks(low, table), marks(headers, table))
    count = lambda ps: sum((F.when(F.array_contains(seen, p.lower()), 1).otherwise(0) for p in ps), F.lit(0))
    scored = F.array(*(F.struct(count(ps).alias("n"), F.lit(-k).alias("o"), F.lit(name).alias("name")) for k, (name, ps) in enumerate(table.items())))
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["name"]).otherwise(UNKNOWN)


def _literal(pattern: str) -> str | None:
    """The ASCII text that a regular expression stands for, if it is nothing else."""
    return re.sub(r"\\(.)", r"\1", pattern).lower() if pattern.isascii() and re.fullmatch(r"(?:[^\\.^$*+?{}\[\]|()]|\\\W)+", pattern) else None


def regex_names(html: Column | str, table: dict[str, list[str]]) -> Column:
    """Sorted names of which any regular expression matches. Those that are plain text are found in one pass, the others by themselves."""
    low = F.lower(text(html))
    plain = {name: [_literal(p) for p in ps if _literal(p)] for name, ps in table.items()}
    seen = marks(low, plain)

    def matches(name: str) -> Column:
        others = [p for p in table[name] if not _literal(p)]
        either = F.arrays_overlap(seen, F.array(*map(F.lit, plain[name]))) if plain[name] else F.lit(False)
        return either | low.rlike("(?i)" + "|".join(f"(?:{p})" for p in others)) if others else either

    return F.array_compact(F.array(*(F.when(matches(n), F.lit(n)) for n in sorted(table))).cast("array<string>"))


def platform_report(html: Column | str, headers: Column | str, table: dict[str, list[str]] | None = None) -> Column:
    """Struct of all platforms that match, and what the response headers (a map with lower-case names) say of the server."""
    said = F.col(headers) if isinstance(headers, str) else headers
    header = lambda name: F.coalesce(F.element_at(said, F.lit(name)), F.lit(""))
    return F.struct(regex_names(html, PLATFORM_PATTERNS if table is None else table).alias("platforms"), header("server").alias("server"), header("x-powered-by").alias("powered_by"))


def _snippets(html: str | None) -> list[dict]:
    out = []
    for name, patterns in TRACKER_PATTERNS.items():
        seen: dict[str, None] = {}
        for p in patterns:
            for m in re.finditer(p, html or "", re.I):
                seen.setdefault(re.sub(r"\s+", " ", html[max(0, m.start() - 100) : m.end() + 100])[:250])
        if seen:
            out.append({"name": name, "evidence": list(seen)[:3]})
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("evidence", T.ArrayType(T.StringType()))])))
def tracker_snippets(html: pd.Series) -> pd.Series:
    """Trackers with up to three surroundings each; built-in functions give no offsets of all matches."""
    return html.map(_snippets)
