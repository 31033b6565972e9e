"""URL algebra as Columns, with an Arrow UDF beside each part whose exact form needs a URL library.

The Columns run in the JVM. Their fast paths (an URL that is already in normal form) are generated
code; what needs ``let`` is a higher-order function and is interpreted, a plain Project in the plan.
They cover every URL without a bad port, an IPv6 host or invalid UTF-8 in its escapes;
``normalize_exact`` and ``resolve_exact`` cover all. An URL that has no normal form gives an empty string.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import SplitResult, parse_qsl, unquote, urlencode, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sitelume.functions.text import col, strip, text

#: Query keys that only track a visit.
TRACKING_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid", "dclid", "gbraid", "wbraid")
#: Href prefixes that lead nowhere; a narrower list serves backlink extraction.
SKIPPED_HREFS = ("#", "javascript:", "mailto:", "tel:", "data:")
#: Suffixes of more than one label that may be registered under, for use without a list; suffix_list() reads a full one.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "com.br", "co.in", "com.mx", "co.za", "com.tr")
#: Where systems keep the public suffix list; a parameter.
SUFFIX_FILE = "/usr/share/publicsuffix/public_suffix_list.dat"

#: Some of the URLs that are their own normal form: most of a crawl, told by one match.
_NORMAL = r"^https?://[a-z0-9-]+(?:\.[a-z0-9-]+)*(?:(?:/[A-Za-z0-9_.~-]+)+|/)$"
_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column | str, k: int) -> Column:
    return F.regexp_extract(text(url), _PARTS, k)


def scheme(url: Column | str) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column | str) -> Column:
    """Host with user and port as they are written, also of a reference without a scheme (//host/path)."""
    return F.regexp_extract(text(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def host(url: Column | str) -> Column:
    """Lower-case host without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(text(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#@:]*)", 1))


def port(url: Column | str) -> Column:
    return F.regexp_extract(netloc(url), r":([0-9]+)$", 1).try_cast("int")


def origin(url: Column | str) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def path(url: Column | str) -> Column:
    return _part(url, 3)


def same_host(a: Column | str, b: Column | str) -> Column:
    """Two URLs without a host are of one host."""
    return host(a) == host(b)


def bare_domain(url: Column | str) -> Column:
    """Host without trailing dots and one leading www."""
    return F.regexp_replace(F.regexp_replace(host(url), r"\.+$", ""), r"^www\.", "")


def domain_of(value: Column | str) -> Column:
    """bare_domain of a URL, or of a bare host name."""
    named = F.when(host(value) != "", host(value)).otherwise(F.lower(strip(value)))
    return F.regexp_replace(F.regexp_replace(named, r"\.+$", ""), r"^www\.", "")


def text_host(value: Column | str) -> Column:
    """Host of a URL or bare host by cutting text: scheme, path, port, trailing dots, leading www."""
    bare = F.regexp_replace(F.lower(strip(value)), r"^https?://", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^([^/:]*)", 1), r"\.+$", ""), r"^www\.", "")


def reverse_domain(domain: Column | str) -> Column:
    """a.b.c as c.b.a; empty labels are dropped."""
    return F.array_join(F.reverse(F.filter(F.split(text(domain), r"\."), lambda x: x != "")), ".")


def registered_domain(url: Column | str, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Host's last label before its public suffix, with the suffix."""
    labels = F.split(F.regexp_replace(host(url), r"\.+$", ""), r"\.")
    two = F.concat_ws(".", F.slice(labels, -2, 2))
    return F.when(F.size(labels) < 2, F.array_join(labels, ".")).when(two.isin(*suffixes) & (F.size(labels) > 2), F.concat_ws(".", F.slice(labels, -3, 3))).otherwise(two)


class SuffixList:
    """Rules of a public suffix list: names, *.names and !names (exceptions)."""

    def __init__(self, lines: Iterator[str]) -> None:
        named = (x.split()[0].lower().strip(".") for x in lines if x.strip() and not x.startswith("//"))
        self.rules = frozenset(x if x.isascii() else _ascii(x) for x in named)

    def registered(self, host_: str) -> str:
        """The public suffix of a host with one label more, or the host itself where it is a suffix; an address stays."""
        labels = [x for x in host_.lower().split(".") if x]
        if not labels or labels[-1].isdigit() or ":" in host_:
            return host_
        tails = [".".join(labels[k:]) for k in range(len(labels))]
        for k, tail in enumerate(tails):  # the longest rule first; an exception's suffix is a label shorter
            if "!" + tail in self.rules:
                return tail
            if tail in self.rules or (k + 1 < len(tails) and "*." + tails[k + 1] in self.rules):
                return tails[max(k - 1, 0)]
        return ".".join(labels[-2:])


def _ascii(name: str) -> str:
    try:
        return name.encode("idna").decode()
    except UnicodeError:
        return name


@lru_cache(maxsize=4)
def suffix_list(path_: str = SUFFIX_FILE) -> SuffixList:
    """The list of a file that the driver can read; the rules (some 10,000 names) go to the tasks with the function."""
    with open(path_, encoding="utf-8") as f:
        return SuffixList(iter(f))


def registered_domain_of(url: Column | str, suffixes: SuffixList) -> Column:
    """registered_domain() by a full list, whose rules may be of any length."""

    @F.pandas_udf(StringType())
    def registered(hosts: pd.Series) -> pd.Series:
        return hosts.map(suffixes.registered)

    return registered(host(url))


def same_registered_domain(a: Column | str, b: Column | str, suffixes: SuffixList | None = None) -> Column:
    of = registered_domain if suffixes is None else lambda x: registered_domain_of(x, suffixes)
    return of(a) == of(b)


def same_domain(a: Column | str, b: Column | str) -> Column:
    """Equal bare domains that aren't empty."""
    return (bare_domain(a) != "") & (bare_domain(a) == bare_domain(b))


def is_relative(ref: Column | str) -> Column:
    return ~strip(ref).rlike(r"(?i)^(?:https?:)?//")


def is_target(value: Column | str, target: Column | str) -> Column:
    """The target's domain or one below it."""
    h, t = domain_of(value), domain_of(target)
    return (h == t) | F.endswith(h, F.concat(F.lit("."), t))


def host_suffixes(value: Column | str) -> Column:
    """A host and all its parent domains, for equi-joins against many targets."""
    labels = F.split(domain_of(value), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def origins(domain: Column | str) -> Column:
    return F.array(F.concat(F.lit("https://"), col(domain), F.lit("/")), F.concat(F.lit("http://"), col(domain), F.lit("/")))


def skipped(href: Column | str, prefixes: tuple[str, ...] = SKIPPED_HREFS) -> Column:
    h = text(href)
    out = h == ""
    for p in prefixes:
        out = out | F.startswith(h, F.lit(p))
    return out


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: without it, nested forms would multiply the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(url: Column | str) -> Column:
    """Normal form of an http(s) URL, empty for any other.

    Lower-case scheme and host, no user, no default port, decoded path without repeated or
    trailing slashes and without parameters, query without tracking keys sorted by key and value,
    no fragment.
    """

    def parts(u: Column) -> Column:
        raw = F.regexp_replace(path(u), r";[^/]*$", "")
        return F.struct(scheme(u).alias("scheme"), host(u).alias("host"), port(u).alias("port"), raw.alias("raw"), _part(u, 4).alias("query"))

    def formed(p: Column) -> Column:
        keep_port = p["port"].isNotNull() & (p["port"] != 0) & ~((p["scheme"] == "http") & (p["port"] == 80)) & ~((p["scheme"] == "https") & (p["port"] == 443))
        where = F.concat(p["host"], F.when(keep_port, F.concat(F.lit(":"), p["port"].cast("string"))).otherwise(""))
        decoded = let(F.replace(F.when(p["raw"] == "", "/").otherwise(p["raw"]), F.lit("+"), F.lit("%2B")), _decoded)
        trimmed = let(F.regexp_replace(decoded, r"/{2,}", "/"), lambda x: F.when(x == "/", x).otherwise(F.regexp_replace(x, r"/+$", "")))
        rooted = let(trimmed, lambda x: F.when((x != "") & ~F.startswith(x, F.lit("/")), F.concat(F.lit("/"), x)).otherwise(x))
        pairs = F.transform(
            F.filter(F.split(p["query"], "&"), lambda x: x != ""),
            lambda x: F.struct(_decoded(F.substring_index(x, "=", 1)).alias("k"), F.when(F.contains(x, F.lit("=")), _decoded(F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1))).otherwise("").alias("v")),
        )
        kept = F.array_sort(F.filter(pairs, lambda x: ~F.lower(x["k"]).isin(*TRACKING_KEYS)))
        query = F.array_join(F.transform(kept, lambda x: F.concat(_encoded(x["k"]), F.lit("="), _encoded(x["v"]))), "&")
        asked = let(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
        return F.when(p["scheme"].isin("http", "https") & (p["host"] != ""), F.concat(p["scheme"], F.lit("://"), where, rooted, asked)).otherwise("")

    whole = let(let(F.regexp_replace(strip(url), r"[\t\r\n]", ""), parts), formed)
    ready = F.when(text(url).rlike(_NORMAL), col(url)).when(text(url).rlike(_NORMAL[:-1] + "#"), F.substring_index(col(url), "#", 1))
    return ready.when(~F.contains(text(url), F.lit("/")), "").otherwise(whole)


def canonical_or_self(url: Column | str) -> Column:
    """The normal form, or the text itself where there is none; the URL, often one that is resolved, is computed once."""
    return let(text(url), lambda u: let(normalize(u), lambda n: F.when(n != "", n).otherwise(u)))


def _without_dots(p: Column) -> Column:
    """A path with . and .. segments resolved."""

    def resolved(x: Column) -> Column:
        kept = F.aggregate(
            F.split(x, "/"),
            F.array().cast("array<string>"),
            lambda a, s: F.when(s == "..", F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(a)).when(s == ".", a).otherwise(F.concat(a, F.array(s))),
        )
        ended = lambda k: F.concat(F.array_join(k, "/"), F.when(x.rlike(r"(?:^|/)\.{1,2}$"), "/").otherwise(""))
        return F.when(x.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), let(kept, ended)).otherwise(x)

    return let(p, resolved)


def resolve(base: Column | str, ref: Column | str) -> Column:
    """The reference seen from the base URL (RFC 3986)."""

    def seen(x: Column) -> Column:
        b, r = x["b"], x["r"]
        root = F.concat(_part(b, 1), F.lit("://"), netloc(b))
        no_fragment = F.regexp_replace(b, r"#.*$", "")
        folder = let(F.regexp_replace(path(b), r"[^/]*$", ""), lambda f: F.when(f == "", "/").otherwise(f))
        own_path, rest = F.regexp_extract(r, r"(?s)^([^?#]*)", 1), F.regexp_extract(r, r"(?s)^[^?#]*(.*)$", 1)
        return (
            F.when(r == "", b)
            .when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), r)
            .when(F.startswith(r, F.lit("//")), F.concat(_part(b, 1), F.lit(":"), r))
            .when(F.startswith(r, F.lit("/")), F.concat(root, _without_dots(own_path), rest))
            .when(F.startswith(r, F.lit("?")), F.concat(F.regexp_replace(no_fragment, r"\?.*$", ""), r))
            .when(F.startswith(r, F.lit("#")), F.concat(no_fragment, r))
            .otherwise(F.concat(root, _without_dots(F.concat(folder, own_path)), rest))
        )

    whole = let(F.struct(text(base).alias("b"), text(ref).alias("r")), seen)
    return F.when(text(ref).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), col(ref)).otherwise(whole)


def without_fragment(url: Column | str) -> Column:
    return F.regexp_replace(text(url), r"(?s)#.*$", "")


# ---- exact forms


_STANDARD_PORTS = {"http": 80, "https": 443}
_SLASHES = re.compile("/+")


def _site(u: SplitResult) -> str:
    """scheme://host[:port], empty for what isn't a web address."""
    standard = _STANDARD_PORTS.get(u.scheme)
    if standard is None or not u.hostname:
        return ""
    return f"{u.scheme}://{u.hostname}" + ("" if u.port in (None, 0, standard) else f":{u.port}")


def _place(path_: str) -> str:
    """Decoded path without parameters of its last segment, with single slashes, none of them last but the root."""
    folder, slash, last = path_.rpartition("/")
    place = _SLASHES.sub("/", unquote(folder + slash + last.partition(";")[0] or "/"))
    return place.rstrip("/") if place != "/" else place


def _asked(query: str) -> str:
    """?query of the sorted pairs that don't track a visit, empty without any."""
    pairs = [(k, v) for k, v in parse_qsl(query, keep_blank_values=True) if k.lower() not in TRACKING_KEYS]
    return "?" + urlencode(sorted(pairs)) if pairs else ""


def normal_form(url: str | None) -> str:
    """normalize() by the standard library, for one URL."""
    try:
        u = urlsplit((url or "").strip())
        site = _site(u)
    except ValueError:  # a port or a host that isn't one
        return ""
    return site and site + _place(u.path) + _asked(u.query)


@F.pandas_udf(StringType())
def normalize_exact(url: pd.Series) -> pd.Series:
    return url.map(normal_form)


def _joined(base: str | None, ref: str | None) -> str:
    try:
        return urljoin(base or "", ref or "")
    except ValueError:
        return ""


@F.pandas_udf(StringType())
def resolve_exact(base: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([_joined(b, r) for b, r in zip(base, ref, strict=True)])
