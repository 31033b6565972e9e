"""The domain graph's own compressed file as a Spark data source: format webgraph.

A graph is three files, NAME.graph, NAME.properties and NAME.offsets. NAME.graph is a stream of bits with one
record for each node: its outdegree, a reference to one of the nodes just before it, blocks of that one's
neighbours that are taken over or skipped, intervals of consecutive neighbours, and the gaps between the
rest, in codes that the properties name. NAME.offsets has the bit lengths of the records.

``graph(spark, path)`` gives (node, neighbour). Asked for some nodes, the source reads their records alone (and
those they refer to), asked for a range its part of the file. A whole graph is cut into partitions of about partition_bytes of records by the sparse table NAME.index, which one task
writes once (``ensure_index``, 16 bytes for every EVERY nodes; NAME.offsets too, if it is missing). Without that
table a graph is one partition. A task holds its own part of the records and of their lengths.

``write(edges, path)`` makes a folder of such graphs, one a task, each of a range of nodes (firstnode in its
properties; its ids count from there) and all listed in shards.json, which is written last, so that a failed
or repeated task leaves nothing that is read. One shard from node 0 is the plain format.

With ``pushdown`` the conditions of a query do the asking. It is off unless asked for: Spark 4.1 keeps what was
pushed with the loaded relation, so a frame that is used twice, with other conditions, gives wrong rows
Load the graph anew for each use then.

Defined cases: a node beyond the graph, or without neighbours, has no row; an empty graph gives none; repeated
edges are written once, edges without an end not at all.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from sitelume.sources import files

EVERY = 1024  # nodes for each row of the sparse table
PARTITION_BYTES = 8 << 20
NODES_A_TASK = 256  # looked up one by one
ROWS_A_BATCH = 1 << 16
SCHEMA = "node long, neighbour long"
_WIDE = 32  # bytes looked at for one code: enough for any number below 2 ** 63


class Bits:
    """Codes from a piece of a file, the bytes from `first` on; positions are bits of the file."""

    def __init__(self, data: bytes, first: int, position: int) -> None:
        self.data, self.first, self.at = data, first, position

    def _window(self) -> tuple[int, int]:
        """The bits from here on as a number, and how many they are."""
        byte, bit = divmod(self.at, 8)
        part = self.data[byte - self.first : byte - self.first + _WIDE]
        n = 8 * len(part) - bit
        return int.from_bytes(part, "big") & ((1 << n) - 1) if n > 0 else 0, n

    def unary(self) -> int:
        zeros = 0
        while True:
            window, n = self._window()
            if window:
                here = n - window.bit_length()
                self.at += here + 1
                return zeros + here
            if n <= 0:
                raise EOFError("the graph ends within a code")
            zeros += n
            self.at += n

    def bits(self, k: int) -> int:
        window, n = self._window()
        if k > n:
            raise EOFError("the graph ends within a code")
        self.at += k
        return window >> (n - k)

    def gamma(self) -> int:
        k = self.unary()
        return (1 << k | self.bits(k)) - 1

    def delta(self) -> int:
        k = self.gamma()
        return (1 << k | self.bits(k)) - 1

    def zeta(self, k: int) -> int:
        h = self.unary()
        n = h * k + k - 1
        low, short = 1 << (h * k), self.bits(n)
        return short + low - 1 if short < low else (short << 1 | self.bits(1)) - 1


class Written:
    """Codes as a string of bits."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0

    def _add(self, bits: str) -> None:
        self.parts.append(bits)
        self.length += len(bits)

    def unary(self, x: int) -> None:
        self._add("0" * x + "1")

    def gamma(self, x: int) -> None:
        b = bin(x + 1)[2:]
        self._add("0" * (len(b) - 1) + b)

    def zeta(self, x: int, k: int) -> None:
        h = ((x + 1).bit_length() - 1) // k
        low = 1 << (h * k)
        self.unary(h)
        short = x + 1 - low
        self._add(f"{short:0{h * k + k - 1}b}" if short < low and h * k + k > 1 else "" if short < low else f"{x + 1:0{h * k + k}b}")

    def bytes(self) -> bytes:
        text = "".join(self.parts)
        return int(text + "0" * (-len(text) % 8) or "0", 2).to_bytes(-(-len(text) // 8), "big")


def signed(x: int) -> int:
    """0, -1, 1, -2, 2 … for 0, 1, 2, 3, 4 …"""
    return -(x + 1) // 2 if x % 2 else x // 2


def unsigned(x: int) -> int:
    return 2 * x if x >= 0 else -2 * x - 1


_CODES = {"GAMMA": Bits.gamma, "DELTA": Bits.delta, "UNARY": Bits.unary}


@dataclass
class Shape:
    """A graph's properties. Codes are those that the format's compressionflags name."""

    nodes: int
    first: int = 0
    window: int = 7
    references: int = 3
    least_interval: int = 4
    zeta: int = 3
    flags: str = ""

    @classmethod
    def read(cls, text: str) -> Shape:
        p = dict(m.groups() for m in re.finditer(r"(?m)^\s*([^#!=:\s]+)\s*[=:]\s*(.*?)\s*$", text))
        number = lambda name, default: int(p.get(name) or default)
        return cls(number("nodes", 0), number("firstnode", 0), number("windowsize", 7), number("maxrefcount", 3), number("minintervallength", 4), number("zetak", 3), p.get("compressionflags", ""))

    def write(self, arcs: int) -> str:
        kept = {"nodes": self.nodes, "arcs": arcs, "firstnode": self.first, "windowsize": self.window, "maxrefcount": self.references, "minintervallength": self.least_interval, "zetak": self.zeta, "compressionflags": self.flags}
        return "#BVGraph properties\ngraphclass=it.unimi.dsi.webgraph.BVGraph\nversion=0\n" + "".join(f"{k}={v}\n" for k, v in kept.items())

    def code(self, of: str, default: str) -> Callable[[Bits], int]:
        named = next((x.strip().removeprefix(of + "_") for x in self.flags.split("|") if x.strip().startswith(of + "_")), default)
        if named == "ZETA":
            return lambda bits: bits.zeta(self.zeta)
        if named not in _CODES:
            raise ValueError(f"unknown code {named} of {of}")
        return _CODES[named]


class Decoder:
    """Records of a graph of some shape."""

    def __init__(self, shape: Shape) -> None:
        self.shape = shape
        self.outdegree, self.reference = shape.code("OUTDEGREES", "GAMMA"), shape.code("REFERENCES", "UNARY")
        self.block_count, self.block, self.residual = shape.code("BLOCK_COUNT", "GAMMA"), shape.code("BLOCKS", "GAMMA"), shape.code("RESIDUALS", "ZETA")

    def record(self, bits: Bits, x: int, other: Callable[[int], list[int]]) -> list[int]:
        """The neighbours of x, in order; other: those of a node before it."""
        degree = self.outdegree(bits)
        if not degree:
            return []
        back = self.reference(bits) if self.shape.window else 0
        out: list[int] = []
        if back:
            theirs, at, taken = other(x - back), 0, True
            for k in range(self.block_count(bits)):
                n = self.block(bits) + (k > 0)
                if taken:
                    out += theirs[at : at + n]
                at, taken = at + n, not taken
            if taken:
                out += theirs[at:]
        rest = degree - len(out)
        if rest and self.shape.least_interval:
            last = x
            for k in range(bits.gamma()):
                left = x + signed(bits.gamma()) if k == 0 else last + 1 + bits.gamma()
                last = left + bits.gamma() + self.shape.least_interval
                out += range(left, last)
                rest -= last - left
        at = 0
        for k in range(rest):
            at = x + signed(self.residual(bits)) if k == 0 else at + 1 + self.residual(bits)
            out.append(at)
        out.sort()  # of a few ascending runs
        return out


class Graph:
    """A graph's files, read by byte ranges."""

    def __init__(self, path: str) -> None:
        self.path, self.shape = path, Shape.read(files.read(path + ".properties").decode("latin-1"))
        self.decoder = Decoder(self.shape)
        self._index: np.ndarray | None = None
        self._positions: dict[int, list[int]] = {}

    @property
    def index(self) -> np.ndarray:
        """Bit positions in NAME.graph and NAME.offsets of every EVERY-th node; empty if there is no such table."""
        if self._index is None:
            known = files.size(self.path + ".index") > 0
            self._index = np.load(io.BytesIO(files.read(self.path + ".index"))) if known else np.empty((0, 2), np.int64)
        return self._index

    def positions(self, block: int) -> list[int]:
        """Bit positions of the nodes of one row of the sparse table, and of the end of the last one."""
        if block not in self._positions:
            if len(self._positions) > 64:
                self._positions.clear()
            start, begin = map(int, self.index[block])
            end = int(self.index[block + 1][1]) if block + 1 < len(self.index) else 8 * files.size(self.path + ".offsets")
            bits = Bits(files.read(self.path + ".offsets", begin // 8, end // 8 - begin // 8 + _WIDE), begin // 8, begin)
            out = [start]
            for _ in range(min(EVERY, self.shape.nodes - block * EVERY)):
                out.append(out[-1] + bits.gamma())
            self._positions[block] = out
        return self._positions[block]

    def bits(self, begin: int, end: int) -> Bits:
        return Bits(files.read(self.path + ".graph", begin // 8, -(-end // 8) - begin // 8), begin // 8, begin)

    def neighbours(self, x: int) -> list[int]:
        """Of one node; what it refers to is read as well."""
        chain, known = {x}, {}
        todo = [x]
        while todo:  # in place of a recursion: a chain of references may be long
            node = todo[-1]
            at = self.positions(node // EVERY)
            missing: list[int] = []

            def other(y: int) -> list[int]:
                if y not in known:
                    missing.append(y)
                    raise KeyError(y)
                return known[y]

            try:
                known[node] = self.decoder.record(self.bits(at[node % EVERY], at[node % EVERY + 1]), node, other)
                todo.pop()
            except KeyError:
                if missing[0] in chain:
                    raise ValueError("a record refers to itself") from None
                chain.add(missing[0])
                todo.append(missing[0])
        return known[x]

    def scan(self, first: int, behind: int) -> Iterator[tuple[int, list[int]]]:
        """The nodes from first to before behind, in order, each with its neighbours."""
        if first >= behind:
            return
        if len(self.index):
            end = self.positions((behind - 1) // EVERY)[(behind - 1) % EVERY + 1]
            bits = self.bits(self.positions(first // EVERY)[first % EVERY], end)
        else:
            bits = self.bits(0, 8 * files.size(self.path + ".graph"))  # from the first record on
            first = 0
        recent: dict[int, list[int]] = {}
        for x in range(first, behind):
            found = self.decoder.record(bits, x, lambda y: recent[y] if y in recent else self.neighbours(y))
            recent[x] = found
            recent.pop(x - self.shape.window, None)
            yield x, found


def _lengths(graph: Graph) -> Iterator[int]:
    """Bit lengths of the records, from the records themselves where there are no offsets yet."""
    if files.size(graph.path + ".offsets") >= 0:
        bits = Bits(files.read(graph.path + ".offsets"), 0, 0)
        bits.gamma()  # of the first record's position
        for _ in range(graph.shape.nodes):
            yield bits.gamma()
        return
    bits, recent = graph.bits(0, 8 * files.size(graph.path + ".graph")), {}
    for x in range(graph.shape.nodes):
        before = bits.at
        recent[x] = graph.decoder.record(bits, x, recent.__getitem__)
        recent.pop(x - graph.shape.window, None)
        yield bits.at - before


def _indexed(path: str) -> None:
    """Write NAME.index, and NAME.offsets if it is missing."""
    graph = Graph(path)
    rows, offsets, written = [], Written(), files.size(path + ".offsets") >= 0
    at, place = 0, 1  # gamma of the first position, 0, is a bit
    offsets.gamma(0)
    for x, n in enumerate(_lengths(graph)):
        if x % EVERY == 0:
            rows.append((at, place))
        at, place = at + n, place + 2 * (n + 1).bit_length() - 1
        if not written:
            offsets.gamma(n)
    if not written:
        files.write(path + ".offsets", offsets.bytes())
    out = io.BytesIO()
    np.save(out, np.array(rows, np.int64).reshape(-1, 2))
    files.write(path + ".index", out.getvalue())


def shards(path: str) -> list[str]:
    """The graphs of a path: itself, or those of a written folder."""
    if files.size(f"{path}/shards.json") >= 0:
        return [f"{path}/{name}" for name in json.loads(files.read(f"{path}/shards.json"))]
    return [path]


def ensure_index(spark: SparkSession, path: str) -> None:
    """Write the sparse table of every graph of a path that has none, each by one task."""
    missing = [(p,) for p in shards(path) if files.size(p + ".index") < 0]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                _indexed(p)
            yield batch

    if missing:
        spark.createDataFrame(missing, "path string").repartition(len(missing), "path").mapInArrow(made, "path string").count()


@dataclass
class _Part(InputPartition):
    path: str
    first: int
    behind: int
    nodes: list[int] | None = None  # in place of the range


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.each = options["path"], int(options.get("partition_bytes", PARTITION_BYTES))
        self.low, self.high = int(options.get("low", 0)), int(options.get("high", 1 << 62))
        self.nodes = {int(x) for x in options["nodes"].split(",") if x} if "nodes" in options else None

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in shards(self.path):
            graph = Graph(path)
            base, index = graph.shape.first, graph.index
            low, high = max(0, self.low - base), min(graph.shape.nodes, self.high - base)
            if self.nodes is not None:
                asked = sorted(x - base for x in self.nodes if low <= x - base < high)
                if len(index):
                    out += [_Part(path, 0, 0, asked[k : k + NODES_A_TASK]) for k in range(0, len(asked), NODES_A_TASK)]
                elif asked:
                    out.append(_Part(path, 0, asked[-1] + 1, asked))
                continue
            while low < high:
                behind = high
                if len(index):
                    begin = int(index[low // EVERY][0]) + 8 * self.each
                    behind = min(high, max(low // EVERY + 1, bisect_right(index[:, 0], begin)) * EVERY)
                out.append(_Part(path, low, behind))
                low = behind
        return out or [_Part("", 0, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        graph = Graph(partition.path)
        base = graph.shape.first
        if partition.nodes is None:
            found = (row for row in graph.scan(partition.first, partition.behind) if row[0] >= partition.first)
        elif len(graph.index):
            found = ((x, graph.neighbours(x)) for x in partition.nodes)
        else:
            asked = set(partition.nodes)
            found = (row for row in graph.scan(0, partition.behind) if row[0] in asked)
        nodes: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes) + base), pa.array(np.concatenate(ends) + base)], names=["node", "neighbour"])

        for x, neighbours in found:
            nodes.append(np.full(len(neighbours), x, np.int64))
            ends.append(np.array(neighbours, np.int64))
            held += len(neighbours)
            if held >= ROWS_A_BATCH:
                yield batch()
                nodes, ends, held = [], [], 0
        if held:
            yield batch()


class _PushingReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("node",):
                yield f
            elif isinstance(f, In) or isinstance(f, (EqualTo, EqualNullSafe)):
                asked = {x for x in (value if isinstance(f, In) else [value]) if x is not None}
                self.nodes = asked if self.nodes is None else self.nodes & asked
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, value + isinstance(f, LessThanOrEqual))
            elif not isinstance(f, IsNotNull):  # a node is never null
                yield f


def record(shape: Shape, x: int, neighbours: list[int], recent: dict[int, tuple[list[int], int]]) -> tuple[Written, int]:
    """A node's record and the length of its chain of references: the shortest of all references within the window. recent: neighbours and chain of the nodes before."""
    best = None
    for back in range(shape.window + 1 if neighbours else 1):
        theirs, chain = recent.get(x - back, ([], 0)) if back else ([], -1)
        if back and (not theirs or chain >= shape.references):
            continue
        w = Written()
        w.gamma(len(neighbours))
        rest = neighbours
        if neighbours and shape.window:
            w.unary(back)
        if back:
            own, blocks, taken = set(neighbours), [0], True
            for y in theirs:
                if (y in own) != taken:
                    blocks.append(0)
                    taken = not taken
                blocks[-1] += 1
            blocks.pop()  # whether the last run is taken over follows from the number of blocks
            w.gamma(len(blocks))
            for k, n in enumerate(blocks):
                w.gamma(n - (k > 0))
            shared = own.intersection(theirs)
            rest = [y for y in neighbours if y not in shared]
        if rest and shape.least_interval:
            cuts = [0, *(k for k in range(1, len(rest)) if rest[k] != rest[k - 1] + 1), len(rest)]
            intervals = [(rest[a], z - a) for a, z in zip(cuts, cuts[1:]) if z - a >= shape.least_interval]
            w.gamma(len(intervals))
            last = x
            for k, (left, n) in enumerate(intervals):
                w.gamma(unsigned(left - x) if k == 0 else left - last - 1)
                w.gamma(n - shape.least_interval)
                last = left + n
            rest = [y for a, z in zip(cuts, cuts[1:]) if z - a < shape.least_interval for y in rest[a:z]]
        for k, y in enumerate(rest):
            w.zeta(unsigned(y - x) if k == 0 else y - rest[k - 1] - 1, shape.zeta)
        if best is None or w.length < best[0].length:
            best = w, chain + 1
    return best


@dataclass
class _Shard(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceArrowWriter):
    """A shard of each task's rows, which have to be sorted, with all rows of a node in one task."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.given = {k: int(options[k]) for k in ("window", "references", "least_interval", "zeta") if k in options}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        name = f"shard-{uuid.uuid4().hex}"
        graph, offsets, recent = Written(), Written(), {}
        shape, arcs, node, held = None, 0, 0, []
        offsets.gamma(0)

        def put(x: int, neighbours: list[int]) -> None:
            made, chain = record(shape, x, neighbours, recent)
            recent[x] = neighbours, chain
            recent.pop(x - shape.window, None)
            graph.parts += made.parts
            offsets.gamma(made.length)

        for batch in iterator:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shape is None:
                    shape, node = Shape(0, x, **self.given), 0
                if x - shape.first < node:
                    raise ValueError("the edges have to come sorted by node")
                while node < x - shape.first:
                    put(node, held)
                    node, held = node + 1, []
                if not held or held[-1] != y - shape.first:
                    held.append(y - shape.first)
                    arcs += 1
        if shape is None:
            return _Shard(None)
        put(node, held)
        shape.nodes = node + 1
        for end, data in ((".graph", graph.bytes()), (".offsets", offsets.bytes()), (".properties", shape.write(arcs).encode())):
            files.write(f"{self.path}/{name}{end}", data)
        _indexed(f"{self.path}/{name}")
        return _Shard(name)

    def commit(self, messages: list[_Shard | None]) -> None:
        files.write(f"{self.path}/shards.json", json.dumps([m.name for m in messages if m and m.name]).encode())

    def abort(self, messages: list[_Shard | None]) -> None:
        for m in messages:
            for end in (".graph", ".offsets", ".properties", ".index") if m and m.name else ():
                files.remove(f"{self.path}/{m.name}{end}")


class WebGraph(DataSource):
    @classmethod
    def name(cls) -> str:
        return "webgraph"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (_PushingReader if self.options.get("pushdown") == "true" else _Reader)(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebGraph)


def graph(spark: SparkSession, path: str, nodes: Iterable[int] | None = None, low: int = 0, high: int = 1 << 62, partition_bytes: int = PARTITION_BYTES, pushdown: bool = False) -> DataFrame:
    """node, neighbour of a graph (its name without an ending) or of a folder that write() made: of all nodes from low to before high, or of some."""
    register(spark)
    ensure_index(spark, path)
    reader = spark.read.format("webgraph").options(partition_bytes=partition_bytes, low=low, high=high, pushdown=pushdown)
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return (reader if nodes is None else reader.option("nodes", ",".join(map(str, nodes)))).load(path)


def write(edges: DataFrame, path: str, partitions: int | None = None, **shape: int) -> None:
    """Write edges (node, neighbour) as a folder of graphs. A task holds the neighbours of a few nodes, and its shard's bits."""
    register(edges.sparkSession)
    whole = edges.select(F.col("node").cast("long").alias("node"), F.col("neighbour").cast("long").alias("neighbour")).dropna()
    dealt = whole.repartitionByRange(partitions, "node") if partitions else whole.repartitionByRange("node")
    dealt.sortWithinPartitions("node", "neighbour").write.format("webgraph").options(**shape).mode("append").save(path)


def predecessors(spark: SparkSession, path: str, nodes: Iterable[int] | None = None) -> DataFrame:
    """node, pred of a transposed graph's file, as operators.backlinks reads it."""
    return graph(spark, path, nodes).select("node", F.col("neighbour").alias("pred"))
