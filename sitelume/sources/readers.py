"""Readers: crawl exports, JSON lines, domain graph files, sitemaps, robots files, archives."""

from __future__ import annotations

import gzip
import io
import os
import zlib
from collections.abc import Callable, Iterator
from urllib.robotparser import RobotFileParser
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelume.functions import urls

LINKS = "array<struct<url:string,anchor:string,rel:string,nofollow:boolean,ugc:boolean,sponsored:boolean>>"
IMAGES = "array<struct<url:string,alt:string,width:string,height:string,loading:string>>"
#: A page as the crawler stores it.
PAGE = (
    "url string, final_url string, status_code int, depth int, content_type string, response_time double, content_length long, title string, title_length int, "
    "meta_description string, meta_description_length int, canonical string, robots string, language string, viewport string, word_count int, content_hash string, "
    f"is_indexable boolean, redirect boolean, error string, h1s array<string>, h2s array<string>, h3s array<string>, images {IMAGES}, links {LINKS}, "
    "scripts array<string>, stylesheets array<string>, hreflang array<struct<lang:string,url:string>>, schemas array<string>, schema_objects string, tracking array<string>, "
    "tracking_evidence map<string,array<string>>, platform string, platform_evidence map<string,array<string>>, "
    "performance struct<dom_loaded_seconds:double,fully_loaded_seconds:double>, http_headers map<string,string>, raw_html_size long"
)
LINK = "crawl_id long, source_url string, target_url string, anchor_text string, rel string, nofollow boolean, ugc boolean, sponsored boolean, internal boolean"


def _fields(ddl: str) -> str:
    """A column list as the fields of a struct."""
    out, depth = [], 0
    for part in ddl.split(", "):
        if depth == 0:
            name, kind = part.split(" ", 1)
            out.append(f"{name}:{kind}")
        else:
            out[-1] += ", " + part
        depth += part.count("<") - part.count(">")
    return ",".join(out)


CRAWL = (
    "crawl_id long, start_url string, site struct<platform:string,tracking:array<string>,pages_crawled:long,pages_discovered:long,"
    "domain:struct<hostname:string,ip_addresses:array<string>,server:string,ssl:struct<enabled:boolean,error:string>>>, "
    f"pages array<struct<{_fields(PAGE)}>>, links array<struct<{_fields(LINK)}>>, failed_urls array<string>"
)


def crawl_json(spark: SparkSession, path: str) -> DataFrame:
    """A crawl export: one document, read by one task, or (a path that ends in .jsonl) one document per line, read by many."""
    return spark.read.schema(CRAWL).option("multiLine", not path.rstrip("/").endswith(".jsonl")).json(path)


def crawl_pages(crawl: DataFrame) -> DataFrame:
    return crawl.select("crawl_id", "start_url", F.posexplode("pages").alias("page_id", "p")).select("crawl_id", "start_url", "page_id", "p.*")


def crawl_links(crawl: DataFrame) -> DataFrame:
    return crawl.select(F.explode("links").alias("l")).select("l.*")


def pages_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Page lines; lines that don't parse are skipped."""
    return spark.read.schema(PAGE).option("mode", "DROPMALFORMED").json(path)


def links_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINK + ", anchor string").option("mode", "DROPMALFORMED").json(path).withColumn("anchor_text", F.coalesce("anchor_text", "anchor")).drop("anchor")


def crawl_table(spark: SparkSession, path: str, crawl_id: int, columns: list[str] | None = None) -> DataFrame:
    """A stored table's rows of a crawl; partition and column pruning reach the scan. Missing columns are null."""
    rows = spark.read.parquet(path).filter(F.col("crawl_id") == crawl_id)
    return rows if columns is None else rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns))


def vertices_tsv(spark: SparkSession, path: str) -> DataFrame:
    """id, rev of a (gzipped) vertex list; comment and malformed lines are skipped. Convert it to Parquet once: gzip can't be split."""
    rows = spark.read.schema("id string, rev string").option("sep", "\t").option("comment", "#").csv(path)
    return rows.select(F.col("id").try_cast("long").alias("id"), F.trim("rev").alias("rev")).filter("id is not null and rev is not null")


def graph_dir(options: dict[str, str], exists: Callable[[str], bool]) -> str | None:
    """The first existing folder of the domain graph: option graph.dir, environment, ./commoncrawl."""
    named = (options.get("graph.dir"), os.environ.get("COMMON_CRAWL_GRAPH_DIR"), "commoncrawl")
    return next((d for d in named if d and exists(d)), None)


def graph_release(names: list[str]) -> str | None:
    """The last release by name among those with all three files. names: file names."""
    ends = (".graph", ".properties", "-vertices.txt.gz")
    stems = [{n[: -len(e)] for n in names if n.endswith(e)} for e in ends]
    return max(set.intersection(*stems), default=None)


_SITEMAPS = {"sitemapindex": ("index", "sitemap"), "urlset": ("urlset", "url")}
_ROWS = 10_000  # of a sitemap's locations are handed on at once
_CHUNK = 1 << 16


class _Locations:
    """Pulls a sitemap's kind and locations out of a stream of bytes; it holds one location, and the names that are open."""

    def __init__(self) -> None:
        self.kind, self.entry, self.open, self.text, self.found = "", "", [], None, []
        self.parser = expat.ParserCreate("utf-8", " ")
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self._start, self._end, self._said
        self.parser.EntityDeclHandler = self._entity  # documents that declare entities aren't read

    def _entity(self, *declared: object) -> None:
        raise expat.ExpatError("a sitemap declares an entity")

    def _start(self, name: str, attributes: dict) -> None:
        local = name.rpartition(" ")[2]
        self.open.append(local)
        if len(self.open) == 1:
            self.kind, self.entry = _SITEMAPS.get(local.lower(), ("", ""))
        elif self.text is not None:
            self.text_ended = True
        elif self.entry and self.open[1:] == [self.entry, "loc"]:
            self.text, self.text_ended = [], False

    def _said(self, text: str) -> None:
        if self.text is not None and not self.text_ended:
            self.text.append(text)

    def _end(self, name: str) -> None:
        if self.text is not None and len(self.open) == 3:
            if loc := "".join(self.text).strip():
                self.found.append(loc)
            self.text = None
        self.open.pop()

    def of(self, chunks: Iterator[bytes]) -> Iterator[list[str]]:
        for chunk in chunks:
            self.parser.Parse(chunk, False)
            if len(self.found) >= _ROWS:
                yield self.found
                self.found = []
        self.parser.Parse(b"", True)
        yield self.found


def _chunks(content: str | bytes) -> Iterator[bytes]:
    """A document piece by piece, decompressed if it begins like gzip; a text without its blanks at both ends."""
    if isinstance(content, str):
        content = content.strip().encode("utf-8", "replace")
    source = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while chunk := source.read(_CHUNK):
        yield chunk


def sitemap_batches(content: str | bytes | None) -> Iterator[tuple[str, list[str]]]:
    """(index or urlset, some of the locations) of a sitemap, in order; bad XML and other documents have none.

    The document, a text or (gzipped) bytes, is read twice, piece by piece: once to see that it is sound,
    which is enough if all its locations are one batch.
    """
    sound, held, n = _Locations(), [], 0
    try:
        for held in sound.of(_chunks(content or "")):
            sound.found = []
            n += 1
    except (expat.ExpatError, OSError, EOFError, zlib.error):
        return
    if n == 1:
        yield sound.kind, held
        return
    pulled = _Locations()
    for locs in pulled.of(_chunks(content or "")):
        yield pulled.kind, locs


def sitemap_entries(xml: str | bytes | None) -> tuple[str, list[str]]:
    """(index or urlset, locations) of a sitemap; bad XML and other documents have none. Namespaces don't matter."""
    kind, out = "", []
    for kind, locs in sitemap_batches(xml):
        out += locs
    return kind, out


def sitemap_locations(files: DataFrame) -> DataFrame:
    """sitemap_url, kind (index or urlset), pos, loc. files: url, status_code, xml (a text, or bytes, gzipped or not); a sitemap of any size comes out in batches."""

    def frame(found: list[tuple[str, str, int, str]]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=["sitemap_url", "kind", "pos", "loc"]).astype({"pos": "int32"})

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[str, str, int, str]] = []  # of many small sitemaps, or a part of a large one
        for rows in batches:
            for url, xml in zip(rows["url"], rows["xml"], strict=True):
                at = 0
                for kind, locs in sitemap_batches(xml):
                    found += ((url, kind, at + k, loc) for k, loc in enumerate(locs))
                    at += len(locs)
                    if len(found) >= _ROWS:
                        yield frame(found)
                        found = []
        if found:
            yield frame(found)

    return files.filter("status_code = 200").select("url", "xml").mapInPandas(parsed, "sitemap_url string, kind string, pos int, loc string")


def expand_sitemaps(files: DataFrame, seeds: DataFrame, max_levels: int = 10) -> DataFrame:
    """sitemap_url, pos, loc of all page locations reachable from seeds (url) through index files."""
    from sitelume.operators import graph

    locs = graph.checkpoint(sitemap_locations(files))
    index = locs.filter("kind = 'index'").select(F.col("sitemap_url").alias("source"), F.col("loc").alias("target"))
    reached = graph.bfs(index, seeds, max_levels).select(F.col("url").alias("sitemap_url"))
    return locs.filter("kind = 'urlset'").join(reached, "sitemap_url", "left_semi").select("sitemap_url", "pos", "loc")


def domain_seeds(domains: DataFrame) -> DataFrame:
    """domain, url of the files of a domain that may lead to its sitemaps."""
    names = F.array(*map(F.lit, ("robots.txt", "sitemap.xml", "sitemap_index.xml")))
    of = F.flatten(F.transform(urls.origins("domain"), lambda o: F.transform(names, lambda n: F.concat(o, n))))
    return domains.select("domain", F.explode(of).alias("url"))


def domain_sitemap_pages(domains: DataFrame, files: DataFrame, max_levels: int = 10) -> DataFrame:
    """domain, url (normal form) of the pages of its own that each domain's sitemaps list.

    files: url, status_code, xml (robots files' text likewise). Sitemaps are found under their usual
    names and through robots files; index files lead on, of whatever host.
    """
    from sitelume.operators import graph

    seeds = domain_seeds(domains)
    robots = files.select(F.col("url").alias("host"), "status_code", F.col("xml").alias("body"))
    named = seeds.withColumnRenamed("url", "host").join(robots_sitemaps(robots).hint("merge"), "host").select("domain", F.col("sitemap").alias("url"))
    locs = graph.checkpoint(sitemap_locations(files))
    index = locs.filter("kind = 'index'").select("sitemap_url", "loc").hint("merge")  # its plan's size is a guess: no driver builds it
    level = graph.checkpoint(seeds.unionByName(named).distinct())
    seen = level
    for _ in range(max_levels):
        level = graph.checkpoint(level.join(index, level["url"] == index["sitemap_url"]).select("domain", F.col("loc").alias("url")).distinct().join(seen.hint("merge"), ["domain", "url"], "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    listed = seen.join(locs.filter("kind = 'urlset'").hint("merge"), F.col("url") == F.col("sitemap_url")).select("domain", urls.canonical_or_self("loc").alias("url"))
    return listed.filter(urls.bare_domain("url") == urls.domain_of("domain")).distinct()


def sitemap_counts(locations: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """url_count of each sitemap that lists something; with files (url, status_code) a row of each of these, and its status."""
    counts = locations.groupBy("sitemap_url").agg(F.count("*").alias("url_count"))
    if files is None:
        return counts
    return files.select(F.col("url").alias("sitemap_url"), "status_code").join(counts, "sitemap_url", "left").select("sitemap_url", "status_code", F.coalesce("url_count", F.lit(0)).alias("url_count"))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """host, sitemap lines of robots files (host, status_code, body)."""
    found = F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1))
    return robots.filter("status_code = 200").select("host", F.explode(found).alias("sitemap"))


def robots_allowed(asked: DataFrame, robots: DataFrame, agent: str, missing_allows: bool = True) -> DataFrame:
    """asked (host, url) with allowed and crawl_delay by the host's robots file (host, status_code, body).

    Without a readable file everything is allowed, or nothing if missing_allows is off.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files: dict[str, RobotFileParser] = {}
        for rows in batches:
            allowed, delay = [], []
            for url, body in zip(rows["url"], rows["body"], strict=True):
                if not isinstance(body, str):
                    allowed.append(missing_allows)
                    delay.append(None)
                    continue
                if body not in files:
                    if len(files) > 1000:
                        files.clear()
                    files[body] = RobotFileParser()
                    files[body].parse(body.splitlines())
                allowed.append(files[body].can_fetch(agent, url))
                wait = files[body].crawl_delay(agent)
                delay.append(None if wait is None else float(wait))
            yield pd.DataFrame({"host": rows["host"], "url": rows["url"], "allowed": allowed, "crawl_delay": pd.Series(delay, dtype="float64")})

    body = robots.filter("status_code = 200").select("host", "body")
    return asked.select("host", "url").join(body, "host", "left").mapInPandas(judge, "host string, url string, allowed boolean, crawl_delay double")


def warc_html(records: DataFrame) -> DataFrame:
    """url, html of gzipped archive records (url, content): the body behind the archive's and the response's headers."""

    def bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"url": rows["url"], "html": [warc_body(c) for c in rows["content"]]})

    return records.select("url", "content").mapInPandas(bodies, "url string, html string")


def warc_body(content: bytes | None) -> str | None:
    if not content:
        return None
    try:
        raw = gzip.decompress(bytes(content))
    except (OSError, EOFError):
        return None
    for _ in range(2):
        head, mark, rest = raw.partition(b"\r\n\r\n")
        if not mark or not head.startswith((b"WARC/", b"HTTP/")):
            break
        raw = rest
    return raw.decode("utf-8", "replace")


def cdx_records(lines: DataFrame, limit: int) -> DataFrame:
    """Index lines (crawl_no, row_no, value: JSON) as records of status 200, the first of each urlkey, at most limit per crawl."""
    from pyspark.sql import Window

    kind = "struct<urlkey:string,url:string,timestamp:string,status:string,filename:string,offset:string,length:string>"
    rows = lines.select("crawl_no", "row_no", F.from_json("value", kind).alias("r")).select("crawl_no", "row_no", "r.*").filter("url is not null and coalesce(status, '200') = '200'")
    first = rows.groupBy("crawl_no", F.coalesce("urlkey", "url").alias("k")).agg(F.min_by(F.struct(*[c for c in rows.columns if c != "crawl_no"]), "row_no").alias("r")).select("crawl_no", "r.*")
    place = F.row_number().over(Window.partitionBy("crawl_no").orderBy("row_no"))
    return first.withColumn("_n", place).filter(F.col("_n") <= limit).drop("_n")
