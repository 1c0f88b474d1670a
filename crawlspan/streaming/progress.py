"""Progress and recent URLs of running crawls as keyed state of a stream.

For each crawl a value state holds the counters and when progress was last told, a list state the last URLs, and a timer
tells what is left once a crawl falls silent. A row comes each ``every`` crawled pages, or at the first event that lies
``interval_ms`` or more after the last row; both are counted in event time, so a run gives the same rows whenever it
happens. A crawl's events of one batch are taken in the order of their stamp and id; bound a batch by the source's
``maxFilesPerTrigger``. After a restart from the checkpoint the counters go on where the last committed batch left them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State store that keyed state with timers needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROGRESS = "crawl_id string, reason string, crawled long, errored long, elapsed_ms long, rate double, recent array<struct<url:string,status_code:int,response_time_ms:long>>"
_RECENT = "url string, status_code int, response_time_ms long"
#: What the counters hold: pages that came, pages that failed, first stamp, last stamp, stamp of the last row, pages and
#: events at the last row.
_COUNTS = "crawled long, errored long, first_ms long, last_ms long, told_ms long, told_crawled long, told_events long"


class _Progress(StatefulProcessor):
    def __init__(self, every: int, interval_ms: int, keep: int) -> None:
        self.every, self.interval_ms, self.keep = every, interval_ms, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", _COUNTS)
        self.recent = handle.getListState("recent", _RECENT)

    def _row(self, key: tuple, reason: str, c: list[int], now: int, recent: list[tuple]) -> dict:
        span = now - c[2]
        return {
            "crawl_id": key[0], "reason": reason, "crawled": c[0], "errored": c[1], "elapsed_ms": span, "rate": 1000.0 * (c[0] + c[1]) / span if span > 0 else 0.0,
            "recent": [dict(zip(("url", "status_code", "response_time_ms"), r, strict=True)) for r in recent],
        }

    def _table(self, rows: list[dict]):
        import pandas as pd

        return pd.DataFrame(rows, columns=["crawl_id", "reason", "crawled", "errored", "elapsed_ms", "rate", "recent"])

    def handleInputRows(self, key: tuple, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        events = pd.concat(list(rows)).sort_values(["stamp_ms", "event_id"], kind="stable", ignore_index=True)
        stamps, failed = events["stamp_ms"].to_numpy(np.int64), events["failed"].to_numpy(bool)
        if self.counts.exists():
            c = list(self.counts.get())
        else:
            c = [0, 0, int(stamps[0]), int(stamps[0]), int(stamps[0]), 0, 0]
        old = [tuple(r) for r in self.recent.get()]
        crawled = c[0] + np.cumsum(~failed)
        errored = c[1] + np.cumsum(failed)
        some = lambda x: None if pd.isna(x) else x
        cols = [events[n].tolist() for n in ("url", "status_code", "response_time_ms")]

        def latest(n: int) -> list[tuple]:
            """The last URLs after the first n events of the batch."""
            new = [(u, None if some(s) is None else int(s), None if some(t) is None else int(t)) for u, s, t in zip(*(x[max(0, n - self.keep) : n] for x in cols), strict=True)]
            return [*old, *new][-self.keep :]

        out, at = [], 0
        while at < len(stamps):
            # Next event that fills the count, or the first that lies far enough after the last row, whichever comes first.
            full, late = (max(at, int(np.searchsorted(x, least))) for x, least in ((crawled, c[5] + self.every), (stamps, c[4] + self.interval_ms)))
            n = min(full, late)
            if n >= len(stamps):
                break
            c = [int(crawled[n]), int(errored[n]), c[2], int(stamps[n]), int(stamps[n]), int(crawled[n]), int(crawled[n] + errored[n])]
            out.append(self._row(key, "count" if n == full else "interval", c, c[3], latest(n + 1)))
            at = n + 1
        c[0], c[1], c[3] = int(crawled[-1]), int(errored[-1]), int(stamps[-1])
        self.counts.update(tuple(c))
        self.recent.put(latest(len(stamps)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(c[3] + self.interval_ms)
        yield self._table(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator:
        c, out = list(self.counts.get()), []
        if c[0] + c[1] > c[6]:  # not all is told yet
            c[4], c[5], c[6] = c[3], c[0], c[0] + c[1]
            out.append(self._row(key, "silence", c, c[3], [tuple(r) for r in self.recent.get()]))
            self.counts.update(tuple(c))
        yield self._table(out)

    def close(self) -> None:
        pass


def crawl_progress(events: DataFrame, every: int = 50, interval_ms: int = 250, keep: int = 20, watermark: str = "10 minutes") -> DataFrame:
    """Progress rows of a stream of fetches: crawl_id, event_id, ts, url, status_code, response_time_ms, failed.

    ``recent`` has the last ``keep`` URLs of the crawl at that moment, oldest first.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    rows = rows.select("crawl_id", F.col("event_id").cast("long"), "ts", F.unix_millis("ts").alias("stamp_ms"), "url", F.col("status_code").cast("int"), F.col("response_time_ms").cast("long"), F.coalesce("failed", F.lit(False)).alias("failed"))
    return rows.groupBy("crawl_id").transformWithStateInPandas(_Progress(every, interval_ms, keep), PROGRESS, "append", "eventTime")


def drained_progress(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a progress stream over all there is and reads back what it told; a second run with the same folders goes on."""
    spark, key = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, PROVIDER)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(out)
