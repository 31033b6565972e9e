"""Web archives and their capture index as Spark data sources: formats web_archive and archive_index.

An archive file is a row of gzip members, one for each record. ``records(spark, path)`` cuts every file into
splits of split_bytes; a record belongs to the split in which its member begins. A task finds its first member
by the member's magic number, and by what it decompresses to beginning like a record, then goes on from
member to member; it holds one record.

An index is gzip files of blocks, each of them a member with some thousand lines ``URLKEY TIMESTAMP {JSON}`` in
the keys' order, and a table of the blocks, ``cluster.idx``: the block's first key and timestamp, its file, offset
and length. ``captures(spark, path, domain)`` asks for the keys of one domain: their place in the table is found by
halving, with a few reads, and only the blocks that can have them are read. For a whole index every task takes
a range of the table's bytes. What is asked for (keys, statuses, record types) are options of the source, so
they hold for every use of the frame.

``write_records`` and ``write_index`` make such files, one or more a task; what the tasks have written is listed in
shards.json at the end, so that failed and repeated tasks leave nothing that is read.

Defined cases: a damaged or cut off member, and a record that isn't one, has no row, and reading goes on behind
it; lines of the index that don't parse are skipped; a folder without files gives no rows.
"""

from __future__ import annotations

import gzip
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sitelume.functions import urls
from sitelume.sources import files
from sitelume.sources.fetch import decode

SPLIT_BYTES = 32 << 20
CHUNK = 1 << 18
LINES_A_BLOCK = 3000
INDEX_BYTES_A_TASK = 1 << 16  # of the table of blocks
MAGIC = b"\x1f\x8b\x08"
RECORDS = "filename string, offset long, length long, record_type string, url string, date string, status_code int, content_type string, payload_bytes long, html string"
CAPTURES = "filename string, offset long, length long, urlkey string, timestamp string, url string, status string, mime string, digest string, block string, line int"


def _listed(path: str, ending: str) -> list[str]:
    """The files of a path: itself, or those of a folder, by its list of shards if it has one."""
    if files.size(path) >= 0:
        return [path]
    if files.size(f"{path}/shards.json") >= 0:
        return [f"{path}/{name}{ending}" for name in json.loads(files.read(f"{path}/shards.json"))]
    return [f"{path}/{name}" for name in files.names(path) if name.endswith(ending)]


# ---- records


class Members:
    """The gzip members of a file that begin within a range of it."""

    def __init__(self, source: pa.NativeFile, begin: int, end: int) -> None:
        self.source, self.begin, self.end, self.size = source, begin, end, source.size()

    def _is_record(self, at: int) -> bool:
        try:
            return zlib.decompressobj(31).decompress(self.source.read_at(4096, at), 5) == b"WARC/"
        except zlib.error:
            return False

    def _next(self, at: int) -> int:
        """The first place from at on where a record's member begins; the file's end if there is none."""
        while at < self.size:
            window = self.source.read_at(min(CHUNK, self.size - at), at)
            found = window.find(MAGIC)
            while found >= 0:
                if self._is_record(at + found):
                    return at + found
                found = window.find(MAGIC, found + 1)
            if len(window) < CHUNK:
                break
            at += CHUNK - len(MAGIC) + 1
        return self.size

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        """(offset, length, content) of each."""
        at = self._next(self.begin)
        while at < self.end:
            unpacking, read, parts = zlib.decompressobj(31), at, []
            try:
                while not unpacking.eof and read < self.size:
                    chunk = self.source.read_at(min(CHUNK, self.size - read), read)
                    parts.append(unpacking.decompress(chunk))
                    read += len(chunk)
            except zlib.error:
                parts = []
            if not unpacking.eof:
                at = self._next(at + 1)
                continue
            behind = read - len(unpacking.unused_data)
            yield at, behind - at, b"".join(parts)
            at = behind if self.source.read_at(3, behind) == MAGIC else self._next(behind)


def _headers(head: bytes) -> tuple[str, dict[str, str]]:
    """First line and lower-case headers."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, mark, v in (x.partition(":") for x in lines) if mark}


def record(content: bytes) -> dict | None:
    """A record's kind, url, date, status, content type and payload; None if it isn't one."""
    head, mark, block = content.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/"):
        return None
    _, archived = _headers(head)
    length = archived.get("content-length", "")
    block = block[: int(length)] if length.isdigit() else block
    out = {"record_type": archived.get("warc-type"), "url": archived.get("warc-target-uri"), "date": archived.get("warc-date"), "status_code": None, "content_type": archived.get("content-type"), "payload": block}
    if block.startswith(b"HTTP/"):
        head, _, payload = block.partition(b"\r\n\r\n")
        status, said = _headers(head)
        code = status.split(" ")[1:2]
        out |= {"status_code": int(code[0]) if code and code[0].isdigit() and len(code[0]) < 9 else None, "content_type": said.get("content-type", ""), "payload": payload}
    return out


@dataclass
class _Split(InputPartition):
    path: str
    begin: int
    end: int


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


class _Records(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.each = options["path"], int(options.get("split_bytes", SPLIT_BYTES))
        listed = lambda name: set(options[name].split(",")) if name in options else None
        self.types, self.statuses = listed("types"), listed("statuses")

    def partitions(self) -> list[InputPartition]:
        sized = ((p, files.size(p)) for p in _listed(self.path, ".warc.gz"))
        return [_Split(p, k, min(n, k + self.each)) for p, n in sized for k in range(0, n, self.each)] or [_Split("", 0, 0)]

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, at = files.filesystem(partition.path)
        name, rows, held, schema = partition.path.rpartition("/")[2], [], 0, _schema(RECORDS)
        with system.open_input_file(at) as source:
            for offset, length, content in Members(source, partition.begin, partition.end):
                r = record(content)
                if r is None or self.types and r["record_type"] not in self.types or self.statuses and str(r["status_code"]) not in self.statuses:
                    continue
                rows.append((name, offset, length, r["record_type"], r["url"], r["date"], r["status_code"], r["content_type"], len(r["payload"]), decode(r["payload"], r["content_type"] or "")))
                held += len(content)
                if held >= 8 << 20:
                    yield _arrow(rows, schema)
                    rows, held = [], 0
        yield _arrow(rows, schema)


@dataclass
class _Written(WriterCommitMessage):
    name: str | None
    first: str = ""


class _ShardWriter(DataSourceArrowWriter):
    """One shard a task; the names of those that count are written at the end, in the order of what they begin with."""

    endings: tuple[str, ...]

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.options = options["path"], dict(options)

    def commit(self, messages: list[_Written | None]) -> None:
        done = sorted((m for m in messages if m and m.name), key=lambda m: (m.first, m.name))
        files.write(f"{self.path}/shards.json", json.dumps([m.name for m in done]).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            for ending in self.endings if m and m.name else ():
                files.remove(f"{self.path}/{m.name}{ending}")


class _RecordWriter(_ShardWriter):
    """Rows of url, status_code, content_type, html as response records."""

    endings = (".warc.gz",)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        name, date = f"shard-{uuid.uuid4().hex}", self.options.get("date", "2024-01-01T00:00:00Z")
        with files.writing(f"{self.path}/{name}.warc.gz") as out:
            for batch in iterator:
                for url, status, kind, html in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    body = (html or "").encode("utf-8", "replace")
                    block = f"HTTP/1.1 {status or 200} OK\r\nContent-Type: {kind or 'text/html; charset=utf-8'}\r\n\r\n".encode() + body
                    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {re.sub('[\r\n]', '', url or '')}\r\nWARC-Date: {date}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
                    out.write(gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0))
        return _Written(name)


class WebArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "web_archive"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> DataSourceReader:
        return _Records(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _RecordWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebArchive)
    spark.dataSource.register(ArchiveIndex)


def records(spark: SparkSession, path: str, types: Iterable[str] = ("response",), statuses: Iterable[int] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of an archive file or of a folder of them (.warc.gz), of some types and statuses."""
    register(spark)
    reader = spark.read.format("web_archive").options(types=",".join(types), split_bytes=split_bytes)
    return (reader if statuses is None else reader.option("statuses", ",".join(map(str, statuses)))).load(path)


def write_records(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """pages (url, html; status_code and content_type where there are such columns) as archive files, one a task."""
    register(pages.sparkSession)
    given = lambda c, kind: (F.col(c) if c in pages.columns else F.lit(None)).cast(kind).alias(c)
    rows = pages.select("url", given("status_code", "int"), given("content_type", "string"), "html")
    rows.write.format("web_archive").option("date", date).mode("append").save(path)


def content_at(captured: DataFrame, folder: str) -> DataFrame:
    """captured (filename, offset, length and further columns) with content: the record's member, from an archive's folder; null where it can't be read. The bytes are as readers.warc_html takes them."""
    names = captured.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [batch.column(names.index(c)).to_pylist() for c in ("filename", "offset", "length")]
            for k, (name, offset, length) in enumerate(zip(*at, strict=True)):
                try:
                    content = files.read(f"{folder}/{name}", offset, length)
                except OSError:
                    content = None
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([content], pa.binary())], names=[*names, "content"])

    return captured.mapInArrow(run, ", ".join([*(f"`{c}` {kind}" for c, kind in captured.dtypes), "content binary"]))


# ---- capture index


def urlkey(url: Column | str) -> Column:
    """An URL as index keys have it: the host's labels from the last one, without www, then path and query in lower case."""
    c = F.col(url) if isinstance(url, str) else url
    host = F.concat_ws(",", F.reverse(F.split(urls.bare_domain(c), r"\.")))
    rest = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.lower(F.concat(host, F.lit(")"), F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))))


def domain_prefix(domain: str) -> str:
    """What the keys of a domain's pages begin with."""
    return ",".join(reversed(domain.strip().lower().removeprefix("www.").rstrip(".").split("."))) + ")/"


def _line_at(source: pa.NativeFile, at: int) -> tuple[int, bytes]:
    """Beginning and text of the first line that begins at or behind a place."""
    size, begin = source.size(), at
    if at:
        begin = at - 1  # the line break before it
    text, read = b"", begin
    while True:
        first = 0 if not at else text.find(b"\n") + 1
        if at == 0 or first:
            end = text.find(b"\n", first)
            if end >= 0 or read >= size:
                return begin + first, text[first : end if end >= 0 else None]
        elif read >= size:
            return size, b""
        chunk = source.read_at(min(1 << 12, size - read), read)
        text += chunk
        read += len(chunk)


def place_of(source: pa.NativeFile, key: bytes) -> int:
    """Where the first line that isn't below key begins, in a file of sorted lines, found by halving it."""
    low, high = 0, source.size()  # all lines that begin before low are below key; none from high on
    while low < high:
        middle = (low + high) // 2
        begin, line = _line_at(source, middle)
        if begin >= high or line >= key:
            high = middle
        else:
            low = begin + len(line) + 1
    return min(low, source.size())


def _line_before(source: pa.NativeFile, at: int) -> int:
    """Beginning of the line before the one that begins at a place; 0 for the first one."""
    step = 256
    while at:
        window = source.read_at(min(at, step), max(0, at - step))
        found = window.rfind(b"\n", 0, len(window) - 1)
        if found >= 0:
            return max(0, at - step) + found + 1
        if step >= at:
            return 0
        step *= 4
    return 0


class _Captures(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.each = options["path"], int(options.get("index_bytes", INDEX_BYTES_A_TASK))
        self.prefix = options.get("prefix", "").encode()
        self.statuses = set(options["statuses"].split(",")) if "statuses" in options else None

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in _listed(self.path, ".idx"):
            system, at = files.filesystem(path)
            with system.open_input_file(at) as source:
                begin, end = 0, source.size()
                if self.prefix:  # a block that begins before the prefix may reach into it
                    begin, end = _line_before(source, place_of(source, self.prefix)), place_of(source, self.prefix + b"\xff")
            out += [_Split(path, k, min(end, k + self.each)) for k in range(begin, end, self.each)]
        return out or [_Split("", 0, 0)]

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        folder, schema = partition.path.rpartition("/")[0], _schema(CAPTURES)
        system, path = files.filesystem(partition.path)
        with system.open_input_file(path) as source:
            at = partition.begin
            while True:
                at, line = _line_at(source, at)
                if at >= partition.end:
                    return
                yield _arrow(list(self._block(folder, line.decode())), schema)
                at += len(line) + 1

    def _block(self, folder: str, line: str) -> Iterator[tuple]:
        key, name, offset, length, *_ = line.split("\t")
        text = zlib.decompressobj(31).decompress(files.read(f"{folder}/{name}", int(offset), int(length)))
        for k, found in enumerate(text.split(b"\n")):
            if not found.startswith(self.prefix):
                continue
            try:
                own, stamp, said = found.decode("utf-8", "replace").split(" ", 2)
                r = json.loads(said)
                where = str(r["filename"]), int(r["offset"]), int(r["length"])
            except (ValueError, KeyError, TypeError):
                continue
            status = None if r.get("status") is None else str(r["status"])
            if self.statuses is None or status in self.statuses:
                text_of = lambda c: None if r.get(c) is None else str(r[c])  # noqa: B023, E731
                yield (*where, own, stamp, text_of("url"), status, text_of("mime"), text_of("digest"), f"{key} {name}", k)


class _IndexWriter(_ShardWriter):
    """Rows of urlkey, timestamp and JSON, sorted, as blocks and a table of them."""

    endings = (".gz", ".idx")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        name, most = f"shard-{uuid.uuid4().hex}", int(self.options.get("lines", LINES_A_BLOCK))
        held: list[str] = []
        table: list[str] = []
        at, first = 0, ""
        with files.writing(f"{self.path}/{name}.gz") as out:

            def put() -> int:
                block = gzip.compress("".join(held).encode("utf-8", "replace"), 6, mtime=0)
                out.write(block)
                table.append(f"{' '.join(held[0].split(' ', 2)[:2])}\t{name}.gz\t{at}\t{len(block)}\t{len(table) + 1}\n")
                held.clear()
                return at + len(block)

            for batch in iterator:
                for key, stamp, said in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    first = first or key
                    held.append(f"{key} {stamp} {said}\n")
                    if len(held) >= most:
                        at = put()
            if held:
                at = put()
        if not table:
            files.remove(f"{self.path}/{name}.gz")
            return _Written(None)
        files.write(f"{self.path}/{name}.idx", "".join(table).encode())
        return _Written(name, first)


class ArchiveIndex(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_index"

    def schema(self) -> str:
        return CAPTURES

    def reader(self, schema) -> DataSourceReader:
        return _Captures(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _IndexWriter(self.options)


def captures(spark: SparkSession, path: str, domain: str | None = None, statuses: Iterable[int] | None = None, index_bytes: int = INDEX_BYTES_A_TASK) -> DataFrame:
    """The captures that an index lists (a folder, or its cluster.idx): of one domain, of some statuses."""
    register(spark)
    reader = spark.read.format("archive_index").options(index_bytes=index_bytes, prefix="" if domain is None else domain_prefix(domain))
    return (reader if statuses is None else reader.option("statuses", ",".join(map(str, statuses)))).load(path)


def write_index(captured: DataFrame, path: str, lines: int = LINES_A_BLOCK) -> None:
    """An index of captured records (url, date, status_code, content_type, filename, offset, length): a shard for each range of keys."""
    register(captured.sparkSession)
    said = F.struct("url", F.col("content_type").alias("mime"), F.col("status_code").cast("string").alias("status"), F.col("length").cast("string").alias("length"), F.col("offset").cast("string").alias("offset"), "filename")
    rows = captured.filter("url is not null").select(F.regexp_replace(urlkey("url"), r"\s", "%20").alias("urlkey"), F.regexp_replace(F.coalesce("date", F.lit("0")), "[^0-9]", "").alias("timestamp"), F.to_json(said).alias("said"))
    rows.repartitionByRange("urlkey", "timestamp", "said").sortWithinPartitions("urlkey", "timestamp", "said").write.format("archive_index").option("lines", lines).mode("append").save(path)


def first_captures(captured: DataFrame, limit: int) -> DataFrame:
    """Of each crawl (crawl_no) the first capture of every key, by timestamp and place, limit at most, in the keys' order."""
    order = ["timestamp", "filename", "offset"]
    first = captured.groupBy("crawl_no", "urlkey").agg(F.min_by(F.struct(*(c for c in captured.columns if c not in ("crawl_no", "urlkey"))), F.struct(*order)).alias("r")).select("crawl_no", "urlkey", "r.*")
    place = F.row_number().over(Window.partitionBy("crawl_no").orderBy("urlkey"))
    return first.withColumn("row_no", place - 1).filter(F.col("row_no") < limit)


def domain_captures(spark: SparkSession, indexes: list[str], domain: str, limit: int) -> DataFrame:
    """first_captures() with a good status of a domain in several crawls' indexes."""
    out = None
    for k, path in enumerate(indexes):
        found = captures(spark, path, domain, [200]).withColumn("crawl_no", F.lit(k))
        out = found if out is None else out.unionByName(found)
    return first_captures(out, limit)
