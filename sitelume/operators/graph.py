"""Iterative graph operators: PageRank, breadth-first traversal and the crawl frontier.

Loops run on the driver over lazy plans; every few rounds the state is checkpointed in the shared
folder, which cuts the lineage and survives lost executors. Only counts reach the driver.

Rounds run in a session of their own, whose plans aren't adaptive: there a checkpoint keeps the
partitioning it was dealt by, so that edges are shuffled once and not in every round. The caller's
session stays as it is; tables pass between the two as Parquet in the shared folder. A source with
more than HUB edges is dealt as several keys, as many as it has HUBs of edges.
"""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelume.functions import urls
from sitelume.operators.links import parts_for

DAMPING = 0.85
CHECKPOINT_EVERY = 5
HUB = 100_000  # edges of a source that are dealt by one key


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of its own only in local mode without a setting."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared)
    return shared


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder by Hadoop's file system; nothing happens where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Rounds:
    """A session for the rounds of a loop, and the tables that pass into and out of it.

    A with statement deletes its tables, also behind an error. What it returns is a checkpoint: like the
    rounds' own ones Spark's cleaner deletes it once no plan reads it, if the session was started with
    spark.cleaner.referenceTracking.cleanCheckpoints.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.caller, self.own = spark, spark.newSession()
        self.partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.own.conf.set("spark.sql.shuffle.partitions", self.partitions)
        self.own.conf.set("spark.sql.adaptive.enabled", "false")
        self.own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a file's bytes say little of its rows, which the driver would have to hold
        self.at = f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"

    def __enter__(self) -> "Rounds":
        return self

    def __exit__(self, *error: object) -> None:
        removed(self.caller, self.at)

    def _path(self, df: DataFrame) -> str:
        path = f"{self.at}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def sized(self, pairs: int) -> None:
        """Deal what follows to as many partitions as so many pairs need."""
        self.partitions = parts_for(self.caller, pairs)
        self.own.conf.set("spark.sql.shuffle.partitions", self.partitions)

    def stored(self, df: DataFrame) -> DataFrame:
        """A table of the caller's, computed once and read again where it is used more than once."""
        return self.caller.read.schema(df.schema).parquet(self._path(df))

    def passed(self, df: DataFrame) -> DataFrame:
        """A table of the caller's, as the rounds read it."""
        return self.own.read.schema(df.schema).parquet(self._path(df))

    def given(self, df: DataFrame, *keys: str) -> DataFrame:
        """A table of the caller's, dealt by keys; rounds that use it by these keys don't shuffle it."""
        return checkpoint(self.passed(df).repartition(self.partitions, *keys).sortWithinPartitions(*keys).select("*"))

    def result(self, df: DataFrame) -> DataFrame:
        """A table of a round, back in the caller's session."""
        return checkpoint(self.stored(df))


def _keys(n: Column) -> Column:
    """As how many keys a source of n edges is dealt."""
    return F.greatest(F.lit(1), F.ceil(n / HUB)).cast("int")


def _salts(keys: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), keys - 1))


def pagerank(pages: DataFrame, links: DataFrame, iterations: int = 20, damping: float = DAMPING) -> DataFrame:
    """url, pagerank after synchronous rounds. links: source_url, target_url, internal.

    A page divides its score by its number of internal link rows, repeats and foreign targets
    included; a target receives once from each distinct source. Mass of pages without links is
    lost. Sources that are no pages have no score. Pages are numbered first: every round reads all edges,
    which are a fraction as numbers of what they are as URLs.
    """
    with Rounds(pages.sparkSession) as rounds:
        named = rounds.stored(pages.select("url").distinct().withColumn("id", F.monotonically_increasing_id()))
        internal = links.filter("internal").select(F.col("source_url").alias("from"), F.col("target_url").alias("to"))
        pairs = rounds.stored(internal.groupBy("from", "to").agg(F.count("*").alias("n")))
        sources = pairs.groupBy(F.col("from").alias("url")).agg(F.sum("n").alias("n")).join(named.hint("merge"), "url")
        out = rounds.stored(sources.select(F.col("url").alias("from"), F.col("id").alias("src"), "n", _keys(F.col("n")).alias("keys")))
        edge = pairs.select("from", "to").join(named.select(F.col("url").alias("to"), F.col("id").alias("dst")).hint("merge"), "to").join(out.hint("merge"), "from")
        salt = F.pmod(F.xxhash64("dst"), F.col("keys")).cast("int")
        edge = rounds.given(edge.select("src", salt.alias("salt"), "dst", (F.lit(damping) / F.col("n")).alias("w")), "src", "salt")
        nodes = rounds.given(named.select("id").join(out.select(F.col("src").alias("id"), "keys").hint("merge"), "id", "left").select("id", F.coalesce("keys", F.lit(1)).alias("keys")), "id")
        total = nodes.count()
        rank = nodes.withColumn("pagerank", F.lit(1.0 / max(1, total)))
        for k in range(1, (iterations if total else 0) + 1):
            score = rank.select(F.col("id").alias("src"), _salts(F.col("keys")).alias("salt"), "pagerank")
            given = edge.join(score, ["src", "salt"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("pagerank") * F.col("w")).alias("got"))
            rank = nodes.join(given, "id", "left").select("id", "keys", ((1 - damping) / total + F.coalesce("got", F.lit(0.0))).alias("pagerank"))
            if k % CHECKPOINT_EVERY == 0 and k < iterations:
                rank = checkpoint(rank)
        return checkpoint(named.join(rounds.stored(rank.select("id", "pagerank")).hint("merge"), "id").select("url", "pagerank"))


def bfs(graph: DataFrame, starts: DataFrame, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """url, depth of what is reached from starts (url) over graph (source, target).

    Depth is the distance. max_pages keeps the first ones by (depth, url), as a crawl's cap does.
    """
    with Rounds(graph.sparkSession) as rounds:
        pairs = rounds.stored(graph.select("source", "target").distinct())
        rounds.sized(pairs.count())  # from the files' footers
        hubs = checkpoint(pairs.groupBy("source").agg(F.count("*").alias("n")).filter(F.col("n") > HUB).select("source", _keys(F.col("n")).alias("keys")))
        any_hub = not hubs.isEmpty()
        if any_hub:
            pairs = pairs.join(hubs, "source", "left").select("source", F.pmod(F.xxhash64("target"), F.coalesce("keys", F.lit(1))).cast("int").alias("salt"), "target")
            hubs = rounds.given(hubs, "source")
        key = ["source", "salt"] if any_hub else ["source"]
        edge = rounds.given(pairs.select(*key, "target"), *key)

        def asked(frontier: DataFrame) -> DataFrame:
            sources = frontier.select(F.col("url").alias("source"))
            return sources.join(hubs, "source", "left").select("source", _salts(F.coalesce("keys", F.lit(1))).alias("salt")) if any_hub else sources

        frontier = rounds.given(starts.select("url").distinct().withColumn("depth", F.lit(0)), "url")
        seen = frontier
        for depth in range(1, max_depth + 1):
            reached = edge.join(asked(frontier), key, "left_semi").select(F.col("target").alias("url")).distinct()
            frontier = checkpoint(reached.join(seen, "url", "left_anti").select("url", F.lit(depth).alias("depth")))
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
            if depth % CHECKPOINT_EVERY == 0:
                seen = checkpoint(seen)
            if max_pages is not None and seen.count() >= max_pages:
                break
        return rounds.result(seen if max_pages is None else seen.orderBy("depth", "url").limit(max_pages))


def search(edges: DataFrame, starts: DataFrame, hits: DataFrame | None = None, within: DataFrame | None = None, max_pages: int | None = None, max_depth: int | None = None, later: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """A breadth-first traversal of every group of pages at once, each of which ends at its first hit or with its budget.

    edges: grp, source, target; starts: grp, url, rank, depth (the level in which it is visited); hits: grp, url;
    within: grp, url of the pages that count (None: all). Pages of a level are visited by rank, then URL; later
    is the rank of those that links lead to (of url; 9 by default). A group whose hit is found, or that has
    more than max_pages pages, leaves the frontier, and the loop ends with the last group.

    Gives visits (grp, url, depth, seq, hit) and the groups (grp) that max_depth has cut off. With max_pages
    a group's visits are numbered from 1, and one with number max_pages + 1 says that there were more; a level
    is cut to what the budget can still use before it is sorted, so a task sees max_pages rows of a group from
    every other task. Without it seq is null. Visits of a hit's own level behind the hit are included.
    """
    deep = starts.agg(F.max("depth")).first()[0]
    with Rounds(starts.sparkSession) as rounds:
        edge = rounds.given(edges.select("grp", "source", "target").distinct(), "grp", "source")
        begun = rounds.passed(starts.groupBy("grp", "url").agg(F.min(F.struct("depth", "rank")).alias("s")).select("grp", "url", F.col("s.rank").cast("int").alias("rank"), F.col("s.depth").cast("int").alias("depth")))
        hit = None if hits is None else rounds.given(hits.select("grp", "url").distinct().withColumn("hit", F.lit(True)), "grp", "url")
        counted = None if within is None else rounds.given(within.select("grp", "url").distinct(), "grp", "url")
        most = F.lit((1 << 31) - 1 if max_pages is None else max_pages)
        frontier, seen, state, active, depth = None, None, None, None, 0
        rank = F.lit(9) if later is None else later
        while deep is not None:
            level = begun.filter(F.col("depth") == depth).select("grp", "url", "rank") if depth <= deep else None
            if frontier is not None:
                found = edge.join(frontier.select("grp", F.col("url").alias("source")), ["grp", "source"], "left_semi").select("grp", F.col("target").alias("url")).distinct().withColumn("rank", rank.cast("int"))
                level = found if level is None else level.unionByName(found).groupBy("grp", "url").agg(F.min("rank").alias("rank"))
            if counted is not None:
                level = level.join(counted, ["grp", "url"], "left_semi")
            if seen is not None:
                level = level.join(seen, ["grp", "url"], "left_anti")
            if active is not None:
                level = level.join(active, "grp", "left").filter(F.coalesce("goes_on", F.lit(True)))
            if max_pages is not None:
                place = F.row_number().over(Window.partitionBy("grp").orderBy("rank", "url"))
                level = level.withColumn("place", place).filter(F.col("place") <= max_pages + 1).withColumn("seq", (F.coalesce("visited", F.lit(0)) if active is not None else F.lit(0)) + F.col("place")).filter(F.col("seq") <= max_pages + 1)
            else:
                level = level.withColumn("seq", F.lit(None).cast("int"))
            told = level.join(hit, ["grp", "url"], "left") if hit is not None else level.withColumn("hit", F.lit(None).cast("boolean"))
            new = checkpoint(told.select("grp", "url", F.lit(depth).alias("depth"), "seq", F.coalesce("hit", F.lit(False)).alias("hit")))
            seen = new if seen is None else seen.unionByName(new)
            if (depth + 1) % CHECKPOINT_EVERY == 0:
                seen = checkpoint(seen)
            if hits is not None or max_pages is not None:  # the groups so far, and which of them go on
                here = new.select("grp", F.coalesce("seq", F.lit(0)).alias("visited"), (F.col("hit") & (F.coalesce("seq", F.lit(0)) <= most)).alias("found"))
                here = here if state is None else here.unionByName(state)
                state = checkpoint(here.groupBy("grp").agg(F.max("visited").alias("visited"), F.bool_or("found").alias("found")))  # else each use would aggregate all levels again
                active = state.select("grp", "visited", (~F.col("found") & (F.col("visited") <= most)).alias("goes_on"))
                frontier = checkpoint(new.join(active.filter("goes_on"), "grp", "left_semi").select("grp", "url").repartition(rounds.partitions, "grp", "url"))
            else:
                frontier = new
            depth += 1
            if depth > deep and frontier.isEmpty() or max_depth is not None and depth > max_depth:
                break
        if seen is None:  # no start
            empty = starts.sparkSession.createDataFrame([], "grp string, url string, depth int, seq int, hit boolean")
            return empty, empty.select("grp")
        more = edge.join(frontier.select("grp", F.col("url").alias("source")), ["grp", "source"], "left_semi").select("grp", F.col("target").alias("url"))
        if counted is not None:
            more = more.join(counted, ["grp", "url"], "left_semi")
        return rounds.result(seen), rounds.result(more.join(seen, ["grp", "url"], "left_anti").select("grp").distinct())


#: Path parts that raise a page's priority.
FAVOURED = ("product", "service", "category", "blog", "article")


def priority(depth: Column, url: Column | str, redirected: Column | None = None) -> Column:
    """Lower is sooner: by depth, home page first, favoured sections before others, redirect targets before both."""
    place = F.lower(urls.path(url))
    favoured = F.lit(False)
    for x in FAVOURED:
        favoured = favoured | F.contains(place, F.lit(x))
    own = depth * 10 - F.when(place.isin("", "/"), 100).otherwise(0) - F.when(favoured, 5).otherwise(0)
    return own if redirected is None else F.when(redirected, F.lit(-50)).otherwise(own)


def frontier_order(frontier: DataFrame) -> DataFrame:
    """frontier (url, depth, seq) with priority and its place in the queue.

    The rows are range-partitioned by (priority, seq, url), so that one priority, such as a level's
    many plain pages, is as many tasks as it needs. A place is the rank within the partition on top of
    the sizes of the partitions before it: a row per partition is all that one task sees.
    """
    order = ["priority", "seq", "url"]
    ranked = checkpoint(frontier.withColumn("priority", priority(F.col("depth"), "url")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()))
    part, nth = F.shiftright("_row", 33), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))  # as that function composes its ids
    sizes = ranked.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("before"))
    return ranked.withColumn("_part", part).join(F.broadcast(before), "_part").select("url", "depth", "seq", "priority", (F.col("before") + nth + 1).alias("visit"))


def admitted(candidates: DataFrame, seen: DataFrame, start_url: str, max_depth: int, max_pages: int, allowed: DataFrame | None = None) -> DataFrame:
    """Candidates (url, depth, seq) a crawl would add, the first ones by seq up to the cap.

    In this order: it has a normal form, isn't seen yet, its depth is below the limit, there is room,
    it is on the start URL's host, and robots rules allow it. allowed: url, allowed (of
    readers.robots_allowed; null or absent: allowed), asked only of what the other tests leave.
    """
    normal = candidates.select(urls.normalize("url").alias("url"), "depth", "seq").filter("url <> ''").filter(F.col("depth") <= max_depth)
    own = normal.filter(urls.host("url") == urls.host(F.lit(start_url)))
    first = own.groupBy("url").agg(F.min(F.struct("seq", "depth")).alias("f")).select("url", "f.depth", "f.seq").join(seen.select("url"), "url", "left_anti")
    if allowed is not None:
        first = first.join(allowed.filter(~F.col("allowed")).select("url"), "url", "left_anti")
    return first.orderBy("seq", "url").limit(max(0, max_pages - seen.count()))


def admitted_children(links: DataFrame, seen: DataFrame, start_url: str, max_depth: int, max_pages: int, allowed: DataFrame | None = None) -> DataFrame:
    """url, depth, seq of the pages that crawled pages' links (target_url, depth of the page, seq) add: a page at max_depth adds none."""
    inner = links.filter(F.col("depth") < max_depth).select(F.col("target_url").alias("url"), (F.col("depth") + 1).alias("depth"), "seq")
    return admitted(inner, seen, start_url, max_depth, max_pages, allowed)


def internal_link(target: Column | str, start_url: str) -> Column:
    """Whether a crawl follows a link: no host and port, or exactly the start URL's (case and port count, unlike for same_host)."""
    return urls.netloc(target).isin("", urlsplit(start_url).netloc)


def redirect_targets(fetches: DataFrame) -> DataFrame:
    """url, depth, priority of the pages that 3xx fetches (url, status_code, location, depth) lead to."""
    to = urls.normalize(urls.resolve("url", "location"))
    moved = fetches.filter(F.col("status_code").between(300, 399) & (F.coalesce("location", F.lit("")) != ""))
    return moved.select(to.alias("url"), (F.col("depth") + 1).alias("depth"), F.lit(-50).alias("priority")).filter("url <> ''")
