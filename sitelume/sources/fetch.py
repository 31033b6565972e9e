"""Fetching pages as a Python data source, with retries, decoding and a rate limit.

``spark.read.format("web_pages").options(urls="https://a/|https://b/", ...)`` or, for a table of
URLs, ``fetch(urls)``. A partition is one client: its rate limit is the total rate over the
partitions. Tests hand in their own ``opener``; nothing here needs the network to be imported.
"""

from __future__ import annotations

import re
import socket
import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any
from urllib.parse import urlencode

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sitelume.functions import urls

RESULT = "url string, final_url string, status_code int, content_type string, content_length long, elapsed double, attempts int, error string, html string, headers map<string,string>"


@dataclass(frozen=True)
class FetchOptions:
    """Limits of a crawl and of its client."""

    user_agent: str = "sitelume/1.0"
    timeout: float = 30.0
    retries: int = 3
    requests_per_second: float = 5.0
    max_pages: int = 100_000
    max_depth: int = 50
    concurrency: int = 20
    follow_redirects: bool = True
    max_body_bytes: int = 16 << 20  # of a body no more are read
    textual_only: bool = False  # bodies of other content types aren't read
    headers: tuple[tuple[str, str], ...] = ()  # further request headers

    def __post_init__(self) -> None:
        for name, low, high in (("max_pages", 1, 5_000_000), ("max_depth", 1, 500), ("concurrency", 1, 200), ("requests_per_second", 0.001, 1000)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be between {low} and {high}")

    @classmethod
    def of(cls, options: dict[str, str]) -> FetchOptions:
        out = cls()
        for name in ("user_agent", "timeout", "retries", "requests_per_second", "max_pages", "max_depth", "concurrency", "follow_redirects", "max_body_bytes", "textual_only"):
            if name in options:
                kind = type(getattr(out, name))
                out = replace(out, **{name: options[name].lower() == "true" if kind is bool else kind(options[name])})
        return out


Opener = Callable[[str, FetchOptions], tuple[int, str, dict[str, str], bytes]]


class _NoRedirects(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *asked: Any) -> None:
        return None


def _body(r: Any, options: FetchOptions) -> bytes:
    """A response's body up to the limit, or nothing of a kind that isn't wanted."""
    if options.textual_only and not textual(r.headers.get("content-type") or ""):
        return b""
    return r.read(options.max_body_bytes)


def open_url(url: str, options: FetchOptions) -> tuple[int, str, dict[str, str], bytes]:
    """(status, final URL, lower-case headers, body); raises on transport errors only."""
    request = urllib.request.Request(url, headers={"User-Agent": options.user_agent, "Accept": "text/html,*/*", **dict(options.headers)})
    try:
        opener = urllib.request.build_opener(*([] if options.follow_redirects else [_NoRedirects]))
        with opener.open(request, timeout=options.timeout) as r:
            return r.status, r.url, {k.lower(): v for k, v in r.headers.items()}, _body(r, options)
    except urllib.error.HTTPError as e:
        return e.code, e.url or url, {k.lower(): v for k, v in e.headers.items()}, _body(e, options)


def textual(content_type: str) -> bool:
    return not content_type or any(k in content_type.lower() for k in ("text", "html", "xml"))


def decode(body: bytes, content_type: str) -> str | None:
    """Text of a textual body by its declared encoding, else UTF-8; None for any other."""
    kind = content_type.lower()
    if not textual(kind):
        return None
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind)
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


class Client:
    """Fetches one URL after the other, at most requests_per_second of them; nothing once it is closed."""

    def __init__(self, options: FetchOptions, opener: Opener = open_url, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> None:
        self.options, self.opener, self.sleep, self.clock = options, opener, sleep, clock
        self.next, self.closed = clock(), False

    def close(self) -> None:
        self.closed = True

    def fetch(self, url: str) -> dict[str, Any] | None:
        """get(), or None of a closed client."""
        return None if self.closed else self.get(url)

    def get(self, url: str, **more: Any) -> dict[str, Any]:
        """The result of an URL; more: options of this request alone."""
        error, options = None, replace(self.options, **more) if more else self.options
        for attempt in range(self.options.retries + 1):
            now = self.clock()
            if now < self.next:
                self.sleep(self.next - now)
            self.next = max(now, self.next) + 1 / self.options.requests_per_second
            began = self.clock()
            try:
                status, final, headers, body = self.opener(url, options)
            except Exception as e:  # any transport error is a result, after the retries
                error = f"{type(e).__name__}: {e}"
                if attempt < self.options.retries:
                    self.sleep(2.0**attempt)
                continue
            kind = headers.get("content-type", "")
            return {"url": url, "final_url": final, "status_code": status, "content_type": kind, "content_length": len(body), "elapsed": self.clock() - began, "attempts": attempt + 1, "error": None, "html": decode(body, kind), "headers": headers, "body": body}
        return {"url": url, "final_url": None, "status_code": None, "content_type": None, "content_length": None, "elapsed": None, "attempts": self.options.retries + 1, "error": error, "html": None, "headers": None, "body": None}


_NAMES = [c.split(" ", 1)[0] for c in RESULT.split(", ")]


def _frame(results: list[dict[str, Any]], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(results, columns=names).astype({"status_code": "Int64", "content_length": "Int64"})


def fetch(asked: DataFrame, options: FetchOptions = FetchOptions(), opener: Opener = open_url, partitions: int | None = None) -> DataFrame:
    """Results of a table of URLs (url), each fetched once; partitions share the rate."""
    n = partitions or options.concurrency
    each = replace(options, requests_per_second=max(0.001, options.requests_per_second / n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = Client(each, opener)
        for rows in batches:
            for url in rows["url"]:
                yield _frame([client.get(url)], _NAMES)

    return asked.select("url").distinct().repartition(n, "url").mapInPandas(run, RESULT)


def with_other_scheme(url: str) -> str:
    return re.sub(r"^http(s?):", lambda m: "http:" if m[1] else "https:", url)


def fetch_either_scheme(asked: DataFrame, options: FetchOptions = FetchOptions(), opener: Opener = open_url, partitions: int | None = None) -> DataFrame:
    """asked_url and the result of each URL (url): its own if that is usable (200 to 399), else the other scheme's, usable or not."""
    n = partitions or options.concurrency
    each = replace(options, requests_per_second=max(0.001, options.requests_per_second / n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = Client(each, opener)
        for rows in batches:
            for url in rows["url"]:
                result = client.get(url)
                if not 200 <= (result["status_code"] or 0) < 400 and with_other_scheme(url) != url:
                    result = client.get(with_other_scheme(url))
                yield _frame([{"asked_url": url, **result}], ["asked_url", *_NAMES])

    return asked.select("url").distinct().repartition(n, "url").mapInPandas(run, f"asked_url string, {RESULT}")


def fetch_ranges(records: DataFrame, base: str, options: FetchOptions = FetchOptions(), opener: Opener = open_url, partitions: int | None = None) -> DataFrame:
    """url, filename, offset, content of archived records (url, filename, offset, length) below a base URL, by range requests; content is null where one fails."""
    n = partitions or options.concurrency
    each = replace(options, requests_per_second=max(0.001, options.requests_per_second / n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = Client(each, opener)
        for rows in batches:
            for r in rows.itertuples(index=False):
                got = client.get(base + r.filename, headers=(("Range", f"bytes={r.offset}-{r.offset + r.length - 1}"),))
                sound = 200 <= (got["status_code"] or 0) < 400
                yield pd.DataFrame({"url": [r.url], "filename": [r.filename], "offset": [r.offset], "content": [got["body"] if sound else None]})

    whole = records.select("url", "filename", F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"))
    return whole.repartition(n, "filename", "offset").mapInPandas(run, "url string, filename string, offset long, content binary")


def index_requests(spark: SparkSession, base: str, crawls: list[str], domain: str, limit: int) -> DataFrame:
    """crawl_no, url of the index queries for a domain's captured pages, the first of each crawl's url keys, limit at most."""
    asked = urlencode({"url": f"{domain}/*", "output": "json", "filter": "status:200", "collapse": "urlkey", "limit": limit})
    return spark.createDataFrame([(k, f"{base}/{crawl}-index?{asked}") for k, crawl in enumerate(crawls)], "crawl_no int, url string")


def index_lines(requests: DataFrame, options: FetchOptions = FetchOptions(), opener: Opener = open_url) -> DataFrame:
    """crawl_no, row_no, value: the lines of the index queries' answers, as readers.cdx_records reads them; a failed query has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = Client(options, opener)
        for rows in batches:
            for r in rows.itertuples(index=False):
                got = client.get(r.url)
                text = got["body"].decode("utf-8", "replace") if got["body"] and (got["status_code"] or 0) == 200 else ""
                lines = [x.strip() for x in text.splitlines() if x.strip()]
                yield pd.DataFrame({"crawl_no": r.crawl_no, "row_no": range(len(lines)), "value": lines}).astype({"crawl_no": "int32", "row_no": "int32", "value": "object"})

    return requests.select("crawl_no", "url").repartition("crawl_no").mapInPandas(run, "crawl_no int, row_no int, value string")


def scheme_fallback(asked: DataFrame, fetched: DataFrame) -> DataFrame:
    """asked (url) with the result of a fetched corpus: its own if usable, else the other scheme's if usable, else the last one there is."""
    swapped = F.when(F.startswith("url", F.lit("https:")), F.concat(F.lit("http:"), F.substring("url", 7, 1 << 20))).otherwise(F.concat(F.lit("https:"), F.substring("url", 6, 1 << 20)))
    tries = asked.select("url", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.col("url").alias("u")), F.struct(F.lit(1).alias("n"), swapped.alias("u")))).alias("t")).select("url", "t.*")
    usable = F.coalesce(F.col("status_code").between(200, 399), F.lit(False))
    place = F.when(usable, F.col("n")).otherwise(3 - F.col("n"))  # 0 and 1 usable, 2 the last of two that aren't, 3 the first
    found = tries.join(fetched.select(F.col("url").alias("u"), "status_code", "html"), "u").withColumn("place", place).groupBy("url").agg(F.min_by(F.struct("u", "status_code", "html"), "place").alias("r"))
    return asked.join(found, "url", "left").select("url", F.col("r.u").alias("fetched_url"), "r.status_code", "r.html")


class WebPages(DataSource):
    """Format web_pages: option urls (separated by |), and those of FetchOptions."""

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return RESULT

    def reader(self, schema) -> DataSourceReader:
        return _WebReader(self.options)


class _Part(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        super().__init__(0)
        self.urls = urls


class _WebReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.urls = [u for u in options.get("urls", "").split("|") if u]
        self.options = FetchOptions.of({k: v for k, v in options.items()})

    def partitions(self) -> list[InputPartition]:
        n = max(1, min(self.options.concurrency, len(self.urls)))
        return [_Part(self.urls[k::n]) for k in range(n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        n = max(1, min(self.options.concurrency, len(self.urls)))
        client = Client(replace(self.options, requests_per_second=max(0.001, self.options.requests_per_second / n)))
        for url in partition.urls:
            got = client.get(url)
            yield tuple(got[name] for name in _NAMES)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebPages)


def rdap_created(documents: DataFrame) -> DataFrame:
    """domain, created of RDAP documents (domain, value: JSON): the registration event, else the creation."""
    events = F.from_json("value", "events array<struct<eventAction:string,eventDate:string>>")["events"]
    of = lambda kind: F.get(F.filter(events, lambda e: e["eventAction"] == kind), F.lit(0))["eventDate"]
    return documents.select("domain", F.coalesce(of("registration"), of("creation")).alias("created"))


def probe_resources(resources: DataFrame, fetched: DataFrame) -> DataFrame:
    """page_url, url, status, content_type, elapsed, error of resources (page_url, resource_url) by a fetched corpus.

    A resource that wasn't fetched, or has no response, has status 0.
    """
    asked = resources.select("page_url", urls.normalize(urls.resolve("page_url", "resource_url")).alias("url")).filter("url <> ''")
    found = fetched.select("url", "status_code", "content_type", "elapsed", "error").withColumn("_found", F.lit(True))
    return asked.join(found, "url", "left").select(
        "page_url", "url", F.coalesce("status_code", F.lit(0)).alias("status"), "content_type", "elapsed", F.coalesce("error", F.when(F.col("_found").isNull(), "not_fetched")).alias("error")
    )


def fetch_resources(resources: DataFrame, options: FetchOptions = FetchOptions(), opener: Opener = open_url) -> DataFrame:
    """probe_resources() of resources (page_url, resource_url) that are fetched now, each URL once."""
    asked = resources.select(urls.normalize(urls.resolve("page_url", "resource_url")).alias("url")).filter("url <> ''")
    return probe_resources(resources, fetch(asked, options, opener))


def resolve_host(host: str) -> list[str]:
    return socket.gethostbyname_ex(host)[2]


def read_certificate(host: str) -> dict[str, Any]:
    with socket.create_connection((host, 443), timeout=5) as plain, ssl.create_default_context().wrap_socket(plain, server_hostname=host) as secure:
        return secure.getpeercert()


def site_metadata(host: str, server: str | None = None, resolver: Callable[[str], list[str]] = resolve_host, certificate: Callable[[str], dict[str, Any]] = read_certificate) -> dict[str, Any]:
    """Addresses, server and certificate of a host; what fails is left out, a failed handshake disables ssl."""
    out: dict[str, Any] = {"hostname": host, "ip_addresses": [], "server": server}
    try:
        out["ip_addresses"] = sorted(set(resolver(host)))
    except OSError:
        pass
    try:
        c = certificate(host)
        names = lambda k: {key: value for part in c.get(k, ()) for key, value in part}
        out["ssl"] = {"enabled": True, "subject": names("subject"), "issuer": names("issuer"), "valid_from": c.get("notBefore"), "valid_until": c.get("notAfter")}
    except OSError as e:
        out["ssl"] = {"enabled": False, "error": str(e)}
    return out
