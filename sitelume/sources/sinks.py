"""Sinks: crawl tables, JSON lines, exports and the crawl's metadata."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from sitelume.operators import graph
from sitelume.operators.merge import latest
from sitelume.sources import files

#: The stored tables and their columns.
TABLES = {
    "crawls": "crawl_id long, start_url string, status string, max_pages long, max_depth int, concurrency int, pages_discovered long, pages_crawled long, pages_indexable long, started_at timestamp, finished_at timestamp, updated_at timestamp",
    "pages": "crawl_id long, url string, final_url string, status_code int, depth int, content_type string, response_time double, content_length long, title string, title_length int, meta_description string, meta_description_length int, canonical string, robots string, language string, viewport string, word_count int, content_hash string, is_indexable boolean, redirect boolean, error string, pagerank double",
    "links": "crawl_id long, source_url string, target_url string, anchor_text string, nofollow boolean, sponsored boolean, ugc boolean, internal boolean",
    "images": "crawl_id long, page_url string, image_url string, alt string, width string, height string, loading string",
    "resources": "crawl_id long, page_url string, resource_url string, resource_type string",
    "hreflang": "crawl_id long, page_url string, lang string, url string",
    "schemas": "crawl_id long, page_url string, schema_type string, raw_json string",
    "issues": "crawl_id long, url string, issue_type string, severity string, message string, details string",
    "discovered_urls": "crawl_id long, url string, source_url string, source_type string, depth int, crawled boolean",
    "sitemaps": "crawl_id long, sitemap_url string, url string, status_code int, url_count long",
}
STATUSES = ("queued", "running", "crawling", "completed", "failed", "cancelled")
UPDATABLE = ("status", "pages_discovered", "pages_crawled", "pages_indexable", "started_at", "finished_at")


def create_tables(spark: SparkSession, database: str = "default") -> None:
    for name, columns in TABLES.items():
        partition = "" if name == "crawls" else " PARTITIONED BY (crawl_id)"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet{partition}")


def append(rows: DataFrame, root: str, table: str) -> None:
    """Append to a table's folder, with its columns (missing ones null), one folder per crawl."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([], TABLES[table]).schema
    out = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted))
    writer = out.write.mode("append")
    (writer if table == "crawls" else writer.partitionBy("crawl_id")).parquet(f"{root}/{table}")


def create_crawl(spark: SparkSession, root: str, crawl_id: int, start_url: str, **options: Any) -> None:
    now = datetime.now(timezone.utc)
    row = {"crawl_id": crawl_id, "start_url": start_url, "status": "queued", "max_pages": 100_000, "max_depth": 50, "concurrency": 20} | options
    append(spark.createDataFrame([row], ", ".join(f"{k} {_kind('crawls', k)}" for k in row)).withColumn("updated_at", F.lit(now)), root, "crawls")


def update_crawl(spark: SparkSession, root: str, crawl_id: int, **changes: Any) -> bool:
    """Append a version of the crawl's row with the allowed changes; false if nothing is left to change."""
    changes = {k: v for k, v in changes.items() if k in UPDATABLE}
    if not changes:
        return False
    row = crawl(spark, root, crawl_id).first()
    if row is None:
        return False
    new = row.asDict() | changes | {"updated_at": datetime.now(timezone.utc)}
    append(spark.createDataFrame([new], TABLES["crawls"]), root, "crawls")
    return True


def crawl(spark: SparkSession, root: str, crawl_id: int) -> DataFrame:
    """The last version of a crawl's row."""
    return latest(spark.read.schema(TABLES["crawls"]).parquet(f"{root}/crawls").filter(F.col("crawl_id") == crawl_id), ["crawl_id"], [F.col("updated_at")])


def crawl_status(spark: SparkSession, root: str, crawl_id: int) -> dict:
    row = crawl(spark, root, crawl_id).first()
    return row.asDict() if row else {"error": "crawl_not_found"}


def _kind(table: str, column: str) -> str:
    return dict(c.split(" ", 1) for c in TABLES[table].split(", "))[column]


def issue_row(crawl_id: int, url: str, issue: Any) -> dict[str, Any]:
    """A row of the issues table from a mapping (its kind under type or issue_type, all of it as details) or from a bare kind."""
    if not isinstance(issue, dict):
        issue = {"type": str(issue)}
        return {"crawl_id": crawl_id, "url": url, "issue_type": issue["type"], "severity": None, "message": None, "details": None}
    return {"crawl_id": crawl_id, "url": url, "issue_type": issue.get("type") or issue.get("issue_type"), "severity": issue.get("severity"), "message": issue.get("message"), "details": str(issue)}


def child_tables(pages: DataFrame) -> dict[str, DataFrame]:
    """images, resources, hreflang, schemas and links of nested pages (crawl_id, url, …)."""
    base = ["crawl_id", F.col("url").alias("page_url")]
    part = lambda c: pages.select(*base, F.explode(c).alias("x"))
    resources = [part(c).select("crawl_id", "page_url", F.col("x").alias("resource_url"), F.lit(kind).alias("resource_type")) for c, kind in (("scripts", "javascript"), ("stylesheets", "stylesheet"))]
    return {
        "images": part("images").select("crawl_id", "page_url", F.col("x.url").alias("image_url"), "x.alt", "x.width", "x.height", "x.loading"),
        "resources": resources[0].unionByName(resources[1]),
        "hreflang": part("hreflang").select("crawl_id", "page_url", "x.lang", "x.url"),
        "schemas": part("schemas").select("crawl_id", "page_url", F.col("x").alias("schema_type")),
        "links": part("links").select("crawl_id", F.col("page_url").alias("source_url"), F.col("x.url").alias("target_url"), F.col("x.anchor").alias("anchor_text"), "x.nofollow", "x.sponsored", "x.ugc"),
    }


def upsert_pages(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored pages with new ones in place of those of the same crawl and URL; the last of several new rows counts."""
    both = stored.withColumn("_v", F.struct(F.lit(0).alias("v"), F.lit(0).cast("long").alias("n"))).unionByName(
        new.withColumn("_v", F.struct(F.lit(1).alias("v"), F.monotonically_increasing_id().alias("n"))), allowMissingColumns=True
    )
    return latest(both, ["crawl_id", "url"], [F.col("_v")]).drop("_v")


def new_urls(discovered: DataFrame, stored: DataFrame) -> DataFrame:
    """Discovered URLs that aren't stored yet, once each."""
    return discovered.dropDuplicates(["crawl_id", "url"]).join(stored, ["crawl_id", "url"], "left_anti")


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def export_crawl(crawl_id: int, start_url: str, site: dict, pages: DataFrame, links: DataFrame, issues: DataFrame) -> DataFrame:
    """One line of JSON per page, link and failed URL, with the crawl's head first: a document of any size."""
    head = pages.sparkSession.createDataFrame([(0, 0, json.dumps({"crawl_id": crawl_id, "start_url": start_url, "site": site}, ensure_ascii=False, default=str))], "part int, pos long, value string")
    part = lambda k, df: df.select(F.lit(k).alias("part"), F.monotonically_increasing_id().alias("pos"), F.to_json(F.struct("*")).alias("value"))
    failed = issues.filter(F.col("severity").isin("high", "critical")).select("url")
    return head.unionByName(part(1, pages)).unionByName(part(2, links)).unionByName(part(3, failed))


def export_nested(spark: SparkSession, path: str, crawl_id: int, start_url: str, site: dict, pages: DataFrame, links: DataFrame, issues: DataFrame) -> None:
    """The crawl as one nested, indented JSON document: crawl_id, start_url, site, pages, links, failed_urls.

    Rows are written as they come, a partition at a time through the driver, by Hadoop's file system: the form for
    small crawls. export_document() writes the same bytes by tasks, export_crawl() lines of any number.
    """
    plain = lambda x: json.dumps(x, ensure_ascii=False, indent=2, default=str)
    shifted = lambda text, by: text.replace("\n", "\n" + " " * by)
    rows = lambda df: (json.loads(r.value) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).toLocalIterator())
    failed = issues.filter(F.col("severity").isin("high", "critical")).select("url").distinct().orderBy("url")

    def parts() -> Iterator[str]:
        head = [f'"{k}": {shifted(plain(v), 2)}' for k, v in (("crawl_id", crawl_id), ("start_url", start_url), ("site", site))]
        yield "{\n  " + ",\n  ".join(head)
        for name, items in (("pages", rows(pages)), ("links", rows(links)), ("failed_urls", (r.url for r in failed.toLocalIterator()))):
            yield f',\n  "{name}": ['
            for k, item in enumerate(items):
                yield ("," if k else "") + "\n    " + shifted(plain(item), 4)
            yield "\n  ]"
        yield "\n}\n"

    write_parts(spark, path, parts())


def document_rows(pages: DataFrame, links: DataFrame, issues: DataFrame) -> DataFrame:
    """section, value (JSON) of a nested document's items, in its order."""
    failed = issues.filter(F.col("severity").isin("high", "critical")).select("url").distinct().orderBy("url")
    part = lambda k, df, value: df.select(F.lit(k).alias("section"), value.alias("value"))
    whole = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    quoted = F.regexp_extract(F.to_json(F.struct("url")), r"(?s)^\{\"url\":(.*)\}$", 1)
    return part(0, pages, whole).unionByName(part(1, links, whole)).unionByName(part(2, failed, quoted))


class _Item(WriterCommitMessage):
    """What a task has written: its number, and the number of items and the file of each section."""

    def __init__(self, task: int, parts: dict[int, tuple[int, str]]) -> None:
        self.task, self.parts = task, parts


class _DocumentWriter(DataSourceArrowWriter):
    """Tasks write their items into files of their own; the end joins those of the tasks that count, and moves the document into its place."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.head, self.sections = options["path"], options["head"], options["sections"].split(",")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        name, parts, out = f"{self.path}.parts/{uuid.uuid4().hex}", {}, {}
        for batch in iterator:
            for section, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, file = parts.get(section, (0, f"{name}-{section}"))
                if section not in out:
                    out[section] = files.writing(file)
                item = json.dumps(json.loads(value), ensure_ascii=False, indent=2).replace("\n", "\n    ")
                out[section].write(f"{',' if n else ''}\n    {item}".encode())
                parts[section] = n + 1, file
        for f in out.values():
            f.close()
        return _Item(TaskContext.get().partitionId(), parts)

    def commit(self, messages: list[_Item | None]) -> None:
        done = sorted((m for m in messages if m), key=lambda m: m.task)
        at = f"{self.path}.{uuid.uuid4().hex}.tmp"
        with files.writing(at) as out:
            out.write(("{\n  " + self.head).encode())
            for k, section in enumerate(self.sections):
                out.write(f',\n  "{section}": ['.encode())
                written = 0
                for n, file in (m.parts[k] for m in done if k in m.parts):
                    out.write(b"," if written else b"")
                    for start in range(0, files.size(file), 1 << 20):
                        out.write(files.read(file, start, 1 << 20))
                    written += n
                out.write(b"\n  ]")
            out.write(b"\n}\n")
        files.move(at, self.path)
        files.remove_folder(f"{self.path}.parts")

    def abort(self, messages: list[_Item | None]) -> None:
        files.remove_folder(f"{self.path}.parts")


class NestedDocument(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nested_document"

    def schema(self) -> str:
        return "section int, value string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _DocumentWriter(self.options)


def export_document(spark: SparkSession, path: str, crawl_id: int, start_url: str, site: dict, pages: DataFrame, links: DataFrame, issues: DataFrame) -> None:
    """export_nested()'s document, written by tasks.

    No row passes through the driver: every task writes its items beside the document, and at the end the
    files are joined in the order of the tasks, a MB at a time, and the document is moved into its place. Files
    of failed or repeated tasks aren't joined. path is one that files.py reaches from all executors.
    """
    spark.dataSource.register(NestedDocument)
    shifted = lambda x: json.dumps(x, ensure_ascii=False, indent=2, default=str).replace("\n", "\n  ")
    head = ",\n  ".join(f'"{k}": {shifted(v)}' for k, v in (("crawl_id", crawl_id), ("start_url", start_url), ("site", site)))
    document_rows(pages, links, issues).write.format("nested_document").options(head=head, sections="pages,links,failed_urls").mode("append").save(path)


BUCKETS = 64


class StaleTable(RuntimeError):
    """Another writer has begun to change the table."""


def _version_file(spark: SparkSession, table: str, number: int, ending: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/_versions/{number:012d}{ending}")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def version(spark: SparkSession, table: str) -> int:
    """The number of the last change of a table that was begun; 0 before the first one."""
    fs, at = _version_file(spark, table, 0, "")
    folder = at.getParent()
    if not fs.exists(folder):
        return 0
    return max((int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(folder)), default=0)


def upsert(new: DataFrame, table: str, seen_version: int | None = None, buckets: int = BUCKETS, again: bool = False) -> int:
    """Put pages into a stored table in place of those of the same crawl and URL; gives the table's new version.

    The table lies in folders by crawl and bucket of the URL. Only folders that new rows fall in are read and
    rewritten, all at once by the writer's commit (dynamic partition overwrite). A change begins with a file
    of its version's number that only one writer can create: one that has seen an older version (seen_version)
    or comes second fails with StaleTable before anything is written, and so does any writer behind a change
    that was never finished, until one with again=True does that change anew. new: rows of a few crawls.
    """
    spark = new.sparkSession
    now = version(spark, table)
    if seen_version is not None and seen_version != now:
        raise StaleTable(f"{table} is at version {now}, not {seen_version}")
    fs, finished = _version_file(spark, table, now, ".done")
    open_change = now > 0 and not fs.exists(finished)
    if open_change and not again:
        raise StaleTable(f"version {now} of {table} was begun and isn't finished")
    number = now if open_change else now + 1
    if not open_change:
        fs, begun = _version_file(spark, table, number, ".begun")
        try:
            fs.create(begun, False).close()
        except Py4JJavaError as e:
            raise StaleTable(f"version {number} of {table} has another writer") from e
    bucket = F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int")
    marked = new.withColumn("bucket", bucket)
    touched = marked.select("crawl_id", "bucket").distinct().collect()  # folders
    here = F.col("crawl_id").isin(sorted({r.crawl_id for r in touched})) & F.col("bucket").isin(sorted({r.bucket for r in touched}))
    try:
        stored = spark.read.parquet(table).filter(here)
    except AnalysisException:  # no folder yet
        stored = marked.limit(0)
    known = stored.join(F.broadcast(marked.select("crawl_id", "bucket").distinct()), ["crawl_id", "bucket"], "left_semi")  # as many rows as folders
    merged = graph.checkpoint(upsert_pages(known.drop("bucket"), new).withColumn("bucket", bucket))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("crawl_id", "bucket").parquet(table)
    fs, finished = _version_file(spark, table, number, ".done")
    fs.create(finished, True).close()
    return number


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file by Hadoop's file system: under another name first, then renamed into place."""
    write_parts(spark, path, iter((text,)))


def write_parts(spark: SparkSession, path: str, parts: Iterator[str]) -> None:
    """write_text() of a text that comes in parts."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = target.getFileSystem(conf)
    out = fs.create(part, True)
    held, size = [], 0
    for text in parts:
        held.append(text)
        size += len(text)
        if size >= 1 << 20:
            out.write(bytearray("".join(held), "utf-8"))
            held, size = [], 0
    out.write(bytearray("".join(held), "utf-8"))
    out.close()
    fs.delete(target, False)
    fs.rename(part, target)


def merge_meta(spark: SparkSession, path: str, **changes: Any) -> dict:
    """Read, merge and replace the crawl's metadata document."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    known = {}
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        known = json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
    meta = known | changes | {"updated_at": datetime.now(timezone.utc).isoformat()}
    write_text(spark, path, json.dumps(meta, ensure_ascii=False, indent=2, default=str))
    return meta


def persistence_summary(pages: DataFrame, links: DataFrame, failed: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(pages, "pages_saved").join(n(links, "links_saved")).join(n(failed, "failed_saved"))


def with_pagerank(pages: DataFrame, ranks: DataFrame) -> DataFrame:
    """pages with the pagerank column of ranks (url, pagerank)."""
    return pages.drop("pagerank").join(ranks.select("url", "pagerank"), "url", "left")
