"""A rate for each host, across all partitions of a stream: URLs are let go when their host may be asked.

``paced`` keeps a queue for every host as keyed state (transformWithState), so whatever partitions or batches a
host's URLs come in, one state knows when the host may be asked next. An URL gets a time (due) that is its
host's interval, or the crawl delay of its robots file where that is longer, behind the one before. URLs due
within the lookahead are let go at once, with their times; for the others a timer of the host fires when the
next one is due. So a fetching task waits for a lookahead at most, and a slow host holds up no other.

A host's queue is rows of the state store on disk, taken from its front one by one; none is in memory whole. State and
timers are part of the stream's checkpoint: after a restart what was let go isn't let go again, and hosts keep
their times. A host without waiting URLs keeps one row, until `forget` has passed since its last time.

The clock is that of the batches, and timers need batches, so the query runs by a processing-time trigger until
it is stopped; it doesn't end by itself.

Defined cases: rows without a host or URL are left out; an interval that is null or negative is the default one;
repeated URLs are repeated requests (make them distinct before).
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sitelume.sources.fetch import RESULT, Client, FetchOptions, Opener, open_url

PACED = "host string, url string, due timestamp, waited_ms long"


def with_state_store(spark: SparkSession) -> None:
    """Keyed state with timers needs the store that keeps it on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Host(StatefulProcessor):
    """host: next (when it may be asked), first and behind (ends of the queue's numbers), timer (0: none)."""

    def __init__(self, lookahead_ms: int, forget_ms: int) -> None:
        self.lookahead_ms, self.forget_ms = lookahead_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.host = handle.getValueState("host", "next long, first long, behind long, timer long")
        self.queue = handle.getMapState("queue", "number long", "url string, came long, interval long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        at, first, behind, timer = self.host.get() if self.host.exists() else (0, 0, 0, 0)
        for r in rows:
            self.queue.updateValue((behind,), (r.url, now, r.interval))
            behind += 1
        yield from self._let_go(key[0], now, at, first, behind, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.host.exists():
            at, first, behind, _ = self.host.get()
            if first == behind and now >= at + self.forget_ms:
                self.host.clear()
            else:
                yield from self._let_go(key[0], now, at, first, behind, 0)

    def _let_go(self, host: str, now: int, at: int, first: int, behind: int, timer: int) -> Iterator[Row]:
        while first < behind and max(now, at) <= now + self.lookahead_ms:
            url, came, interval = self.queue.getValue((first,))
            due = max(now, at)
            self.queue.removeKey((first,))
            first, at = first + 1, due + interval
            yield Row(host=host, url=url, due=_timestamp(due), waited_ms=due - came)
        wanted = at if first < behind else at + self.forget_ms
        if timer and timer != wanted:
            self.handle.deleteTimer(timer)
        if timer != wanted:
            self.handle.registerTimer(wanted)
        self.host.update((at, first, behind, wanted))

    def close(self) -> None:
        pass


def _timestamp(ms: int):
    from datetime import datetime

    return datetime.fromtimestamp(ms / 1000)


def paced(asked: DataFrame, interval: float = 1.0, lookahead: float = 0.0, forget: float = 3600.0) -> DataFrame:
    """host, url, due, waited_ms of a stream of host, url and, where there is one, crawl_delay (seconds).

    interval: seconds between two requests to a host; lookahead, forget: seconds, too.
    """
    with_state_store(asked.sparkSession)
    delay = F.coalesce(F.col("crawl_delay").cast("double"), F.lit(0.0)) if "crawl_delay" in asked.columns else F.lit(0.0)
    rows = asked.filter("host is not null and url is not null").select("host", "url", F.ceil(F.greatest(delay, F.lit(float(interval))) * 1000).cast("long").alias("interval"))
    return rows.groupBy("host").transformWithState(_Host(round(1000 * lookahead), round(1000 * forget)), PACED, "append", "processingTime")


def fetched(due: DataFrame, options: FetchOptions = FetchOptions(), opener: Opener = open_url) -> DataFrame:
    """Results of paced()'s URLs. A host's URLs of a batch are one task's, in their order, and each waits for its time."""
    names = [c.split(" ", 1)[0] for c in RESULT.split(", ")]

    def run(batches):
        from sitelume.sources.fetch import _frame

        client = Client(options, opener)
        for rows in batches:
            for url, at in zip(rows["url"], rows["due"], strict=True):
                wait = at.timestamp() - time.time()
                if wait > 0:
                    time.sleep(wait)
                yield _frame([client.get(url)], names)

    return due.repartition("host").sortWithinPartitions("due").select("url", F.to_timestamp("due").alias("due")).mapInPandas(run, RESULT)
