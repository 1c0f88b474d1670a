"""The audit as a stream of fetch results, and streaming counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crawlspan.operators.parse import links_table, parse_pages
from crawlspan.operators.rules import evaluate_rules
from crawlspan.sources.scratch import scratch_dir


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table as a stream of its files; the table may be one file or a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", "200").parquet(f"{sf_dir}/{name}.parquet*")


def ingest_stream(stream: DataFrame, out: str, config: dict | None = None, bare_references: bool = True) -> StreamingQuery:
    """Parses each batch once and writes pages, links and issues below ``out``, a folder for each batch.

    A batch that is run again after a failure overwrites its own folders, so results stay exact.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = f"{out}/pages/batch={batch_id}"
        parse_pages(batch, bare_references=bare_references).write.mode("overwrite").parquet(parsed)
        pages = batch.sparkSession.read.parquet(parsed)
        links_table(pages).write.mode("overwrite").parquet(f"{out}/links/batch={batch_id}")
        evaluate_rules(pages, config=config).write.mode("overwrite").parquet(f"{out}/issues/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()


def drain_then_analyse(query: StreamingQuery, analyse: Callable[[], DataFrame]) -> DataFrame:
    """Cross-page analysis starts only after all that was streamed is committed."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return analyse()


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives on the data there is, as a table (for aggregates in complete mode, the last state)."""
    out = scratch_dir(stream.sparkSession)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    else:
        def write(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/data")

        q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/data")


def stream_dedup(stream: DataFrame, keys: list[str], watermark: tuple[str, str] | None = None) -> DataFrame:
    """First sighting of each key; with a watermark (column, delay) the state is bounded."""
    return stream.dropDuplicates(keys) if watermark is None else stream.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys)


def external_dedup_stream(links: DataFrame) -> DataFrame:
    return stream_dedup(links, ["crawl_id", "target_url"])


def progress(stream: DataFrame, key: str, stamp: str, errored: F.Column) -> DataFrame:
    """Running counts by crawl; the rate is that since the first event."""
    out = stream.groupBy(key).agg(F.count_if(~errored).alias("crawled"), F.count_if(errored).alias("errored"), F.min(stamp).alias("first"), F.max(stamp).alias("last"))
    span = F.unix_timestamp("last") - F.unix_timestamp("first")
    return out.withColumn("elapsed_s", span).withColumn("rate", F.when(span > 0, (F.col("crawled") + F.col("errored")) / span).otherwise(F.lit(0.0)))


def windowed_rate(stream: DataFrame, stamp: str, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Events in each tumbling window of event time."""
    return stream.withWatermark(stamp, watermark).groupBy(F.window(stamp, window)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def recent_urls(pages: DataFrame, n: int = 20) -> DataFrame:
    """The latest pages with status and time."""
    return pages.select("url", "status_code", "response_time_ms", "fetched_at", "page_id").orderBy(F.col("fetched_at").desc(), F.col("page_id").desc()).limit(n)
