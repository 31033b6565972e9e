"""One pass over a page's HTML: every extracted field in one struct, so that a page is parsed once.

An Arrow UDF around the standard library's tokenizer. The struct isn't pruned by the optimizer:
parse once, write the columns, read the columns.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelume.functions.urls import SKIPPED_HREFS

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(("script", "style", "noscript", "svg"))
ANCHOR_CHARS = 1000

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()
_row = lambda **f: T.StructType([T.StructField(k, v) for k, v in f.items()])
LINK = _row(url=_S, anchor=_S, rel=_S, nofollow=_B, ugc=_B, sponsored=_B)
IMAGE = _row(url=_S, alt=_S, width=_S, height=_S, loading=_S)
PAGE = _row(
    title=_S, meta_description=_S, canonical=_S, robots=_S, language=_S, viewport=_S,
    links=T.ArrayType(LINK), images=T.ArrayType(IMAGE), scripts=T.ArrayType(_S), stylesheets=T.ArrayType(_S),
    hreflang=T.ArrayType(_row(lang=_S, url=_S)), schemas=T.ArrayType(_S), schema_types=T.ArrayType(_S),
    headings=T.MapType(_S, T.ArrayType(_S)), open_graph=T.MapType(_S, _S), twitter=T.MapType(_S, _S),
    iframes=_I, forms=_I, text=_S, word_count=_I, content_hash=_S, raw_html_size=T.LongType(),
)


class _Page(HTMLParser):
    def __init__(self, base: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base = base
        self.out: dict = {k: "" for k in ("title", "meta_description", "canonical", "robots", "language", "viewport")}
        self.out |= {k: [] for k in ("links", "images", "scripts", "stylesheets", "hreflang", "schemas")}
        self.out |= {"iframes": 0, "forms": 0, "open_graph": {}, "twitter": {}}
        self.headings: dict[str, list[str]] = {f"h{k}": [] for k in range(1, 7)}
        self.seen: set[str] = set()
        self.texts: list[str] = []
        self.open: list[tuple[str, list[str], dict | None]] = []  # elements whose text is collected
        self.hidden: list[str] = []
        self.raw: list[str] | None = None

    def join(self, ref: str) -> str:
        try:
            return urljoin(self.base, ref)
        except ValueError:
            return ref

    def once(self, key: str, value: str) -> None:
        if key not in self.seen:
            self.seen.add(key)
            self.out[key] = value

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a: dict[str, str | None] = {}
        for k, v in attrs:
            a.setdefault(k, v)
        get = lambda k: a.get(k) or ""
        rel = get("rel").split()
        if tag == "html":
            self.once("language", get("lang"))
        elif tag == "meta":
            self._meta(get("name"), get("property"), get("content"))
        elif tag == "link":
            if "canonical" in rel:
                self.once("canonical", self.join(get("href")))
            if get("href") and "stylesheet" in (x.lower() for x in rel):
                self.out["stylesheets"].append(self.join(get("href")))
            if get("href") and get("hreflang"):
                self.out["hreflang"].append({"lang": get("hreflang"), "url": self.join(get("href"))})
        elif tag == "a" and "href" in a:
            href = get("href").strip()
            if href and not href.startswith(SKIPPED_HREFS):
                low = {x.lower() for x in rel}
                link = {"url": self.join(href), "anchor": "", "rel": " ".join(rel), **{k: k in low for k in ("nofollow", "ugc", "sponsored")}}
                self.out["links"].append(link)
                self.open.append((tag, [], link))
        elif tag == "img":
            src = get("src") or get("data-src")
            if src:
                self.out["images"].append({"url": self.join(src), "alt": a.get("alt") if "alt" in a else None, "width": a.get("width"), "height": a.get("height"), "loading": a.get("loading")})
        elif tag in ("iframe", "form"):
            self.out[tag + "s"] += 1
        elif tag == "script":
            if get("src"):
                self.out["scripts"].append(self.join(get("src")))
            if get("type").lower().endswith("ld+json"):
                self.raw = []
        elif tag == "title" and "title" not in self.seen or tag in self.headings:
            self.open.append((tag, [], None))
        if tag in UNSEEN:
            self.hidden.append(tag)

    def _meta(self, name: str, prop: str, content: str) -> None:
        key = {"description": "meta_description", "robots": "robots", "viewport": "viewport"}.get(name.lower())
        if key:
            self.once(key, content.strip())
        if prop.lower().startswith("og:"):
            self.out["open_graph"].setdefault(prop, content)
        if name.lower().startswith("twitter:"):
            self.out["twitter"].setdefault(name, content)

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self.raw is not None:
            self.out["schemas"].append("".join(self.raw))
            self.raw = None
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                _, parts, link = self.open.pop(k)
                self._closed(tag, " ".join(parts), link)
                break

    def _closed(self, tag: str, said: str, link: dict | None) -> None:
        if link is not None:
            link["anchor"] = said[:ANCHOR_CHARS]
        elif tag == "title":
            self.once("title", said)
        elif said:
            self.headings[tag].append(said)

    def handle_data(self, data: str) -> None:
        if self.raw is not None:
            self.raw.append(data)
        said = data.strip()
        if said and not self.hidden:
            self.texts.append(said)
            for _, parts, _ in self.open:
                parts.append(said)

    def result(self) -> dict:
        self.close()
        while self.open:
            tag, parts, link = self.open.pop()
            self._closed(tag, " ".join(parts), link)
        text = " ".join(self.texts)
        types: set[str] = set()
        for raw in self.out["schemas"]:
            types |= json_ld_types(raw)
        return self.out | {"headings": self.headings, "schema_types": sorted(types), "text": text, "word_count": len(text.split()), "content_hash": hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()}


def json_ld_types(raw: str) -> set[str]:
    """All @type values of a JSON-LD text at any depth; nothing for invalid JSON."""
    try:
        todo = [json.loads(raw.strip())]
    except ValueError:
        return set()
    found: set[str] = set()
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            kind = x.get("@type")
            found |= {str(k) for k in kind} if isinstance(kind, list) else {str(kind)} if kind else set()
            todo += x.values()
        elif isinstance(x, list):
            todo += x
    return found


def parse(html: str | None, base: str | None) -> dict:
    page = _Page(base or "")
    page.feed(html or "")
    return page.result() | {"raw_html_size": len((html or "").encode("utf-8", "replace"))}


@F.pandas_udf(PAGE)
def parse_html(html: pd.Series, base: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(h, b) for h, b in zip(html, base, strict=True)], columns=PAGE.names)


class _JsonLd(HTMLParser):
    """Texts of the JSON-LD scripts that are closed."""

    def __init__(self) -> None:
        super().__init__()
        self.texts: list[str] = []
        self.current: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "script":
            kind = next((v for k, v in attrs if k == "type"), None)
            self.current = [] if (kind or "").lower() == "application/ld+json" else None

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self.current is not None:
            self.texts.append("".join(self.current))
            self.current = None

    def handle_data(self, data: str) -> None:
        if self.current is not None:
            self.current.append(data)


def json_ld(html: str | None) -> list[str]:
    if "ld+json" not in (html or "").lower():
        return []
    page = _JsonLd()
    page.feed(html)
    page.close()
    return page.texts


@F.pandas_udf(T.ArrayType(_S))
def schema_types(html: pd.Series) -> pd.Series:
    """Sorted distinct @type values of a page's JSON-LD blocks."""
    return html.map(lambda h: sorted(set().union(*map(json_ld_types, json_ld(h)))))


@F.pandas_udf(_S)
def unescape_html(text: pd.Series) -> pd.Series:
    """All named and numeric character references."""
    return text.map(lambda t: entities.unescape(t or ""))


class _Anchors(HTMLParser):
    """Closed anchors with an href: (href, rel, pieces of text)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, list[str]]] = []
        self.current: tuple[str, str, list[str]] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            named = {k: v or "" for k, v in reversed(attrs)}  # the first of a repeated attribute counts
            self.current = (named["href"], named.get("rel", ""), []) if "href" in named else None

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.current:
            self.found.append(self.current)
            self.current = None

    def handle_data(self, data: str) -> None:
        if self.current:
            self.current[2].append(data)


def anchors(html: str | None, base: str | None) -> list[dict]:
    """url (resolved), anchor (text with single blanks) and rel of a page's anchors, in order; one without a valid URL is left out."""
    if "<a" not in (html or "").lower():
        return []
    page = _Anchors()
    page.feed(html)
    page.close()
    out = []
    for href, rel, pieces in page.found:
        try:
            out.append({"url": urljoin(base or "", href), "anchor": " ".join(" ".join(pieces).split()), "rel": rel.strip()})
        except ValueError:
            continue
    return out


@F.pandas_udf(T.ArrayType(_row(url=_S, anchor=_S, rel=_S)))
def html_anchors(html: pd.Series, base: pd.Series) -> pd.Series:
    """anchors() of each page."""
    return pd.Series([anchors(h, b) for h, b in zip(html, base, strict=True)])


class _Results(HTMLParser):
    """Links of a search engine's result page: anchors of a class, or the first anchor within each element of a class."""

    def __init__(self, tag: str, mark: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.mark = tag, mark
        self.hrefs: list[str] = []
        self.waiting = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = dict(attrs)
        marked = tag == self.tag and self.mark in (named.get("class") or "").split()
        self.waiting |= marked
        if tag == "a" and self.waiting and named.get("href"):
            self.hrefs.append(named["href"])
            self.waiting = False


#: Element and class of a result on each engine's pages.
RESULTS = {"bing": ("li", "b_algo"), "duckduckgo": ("a", "result__a")}


def result_hrefs(html: str | None, engine: str) -> list[str]:
    page = _Results(*RESULTS[engine])
    page.feed(html or "")
    page.close()
    return page.hrefs


def result_links(html: Column | str, engine: str) -> Column:
    """Links of a stored result page in order."""

    @F.pandas_udf(T.ArrayType(_S))
    def links(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: result_hrefs(h, engine))

    return links(html)
