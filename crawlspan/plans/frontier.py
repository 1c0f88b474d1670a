"""A crawl over a corpus of pages: the frontier is a table that grows by joins, wave by wave."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlspan.functions.urls import hash_url, normalize_url, rewrite_url, url_allowed, url_host
from crawlspan.model import CrawlConfig
from crawlspan.sources.robots import robots_allowed
from crawlspan.sources.layout import buckets, colocated
from crawlspan.sources.scratch import cut

FRONTIER = "url string, url_hash string, depth int, priority int, source_page long"


def _entries(df: DataFrame, depth: F.Column, priority: F.Column, source: F.Column, rewritten: bool = False) -> DataFrame:
    """Frontier rows of a table whose ``url`` is normalised; rewriting may have undone that."""
    key = hash_url("url") if rewritten else F.sha2("url", 256)
    return df.select("url", key.alias("url_hash"), depth.cast("int").alias("depth"), priority.cast("int").alias("priority"), source.cast("long").alias("source_page"))


def seed(urls: DataFrame, cfg: CrawlConfig = CrawlConfig()) -> DataFrame:
    """Start URLs: depth 0, priority 100."""
    return _entries(urls.select(normalize_url("url", cfg.strip_slash).alias("url")), F.lit(0), F.lit(100), F.lit(None))


def seed_sitemaps(entries: DataFrame, cfg: CrawlConfig = CrawlConfig()) -> DataFrame:
    """Sitemap URLs that the filters keep: depth 0, priority 150."""
    urls = entries.select(rewrite_url(normalize_url("url", cfg.strip_slash), list(cfg.rewrite)).alias("url")).filter(url_allowed(F.col("url"), cfg.include, cfg.exclude))
    return _entries(urls, F.lit(0), F.lit(150), F.lit(None), bool(cfg.rewrite))


def expand(parsed: DataFrame, cfg: CrawlConfig = CrawlConfig()) -> DataFrame:
    """Targets of internal, followed links of pages above the depth limit; a level deeper, a little less urgent."""
    links = parsed.filter(F.col("depth") < cfg.max_depth).select("page_id", "depth", F.inline("links")).filter("is_internal and not is_nofollow")
    urls = links.select("page_id", "depth", rewrite_url(normalize_url("href", cfg.strip_slash), list(cfg.rewrite)).alias("url")).filter(url_allowed(F.col("url"), cfg.include, cfg.exclude))
    return _entries(urls, F.col("depth") + 1, F.lit(100) - (F.col("depth") + 1), F.col("page_id"), bool(cfg.rewrite))


def dedup(new: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The first sighting of each URL that was not seen before; the most urgent, then the shallowest, counts as first."""
    fresh = new if seen is None else new.join(seen.select("url_hash"), "url_hash", "left_anti")
    first = F.min_by(F.struct("url", "depth", "priority", "source_page"), F.struct(-F.col("priority"), F.col("depth"), F.coalesce("source_page", F.lit(-1)), F.col("url"))).alias("x")
    return fresh.groupBy("url_hash").agg(first).select("x.url", "url_hash", "x.depth", "x.priority", "x.source_page")


def next_wave(frontier: DataFrame, k: int = 0) -> DataFrame:
    """The k most urgent entries, shallow ones first; 0 takes all."""
    return frontier.orderBy(F.col("priority").desc(), "depth", "url").limit(k) if k else frontier


def fetch_schedule(urls: DataFrame, delay_ms: int = 500, delays: DataFrame | None = None, per_host: int = 2, tie: tuple[str, ...] = ()) -> DataFrame:
    """Earliest start (ms) and wave of each URL: hosts keep their distance and their number of open requests.

    ``delays``: (host, crawl_delay in seconds) replaces the gap of a host. Places are counted inside ranges of the order and
    moved on by the sizes of a host's ranges before, so that no task reads all URLs of a large host. Equal URLs follow the
    columns ``tie``.
    """
    out = urls.withColumn("host", url_host(F.col("url")))
    out = out.join(delays.select("host", "crawl_delay"), "host", "left") if delays is not None else out.withColumn("crawl_delay", F.lit(None).cast("double"))
    order = [F.col("priority").desc(), F.col("depth").asc(), F.col("url").asc(), *(F.col(c).asc() for c in tie)]
    blocks = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(out.repartitionByRange(blocks, F.col("host").asc(), *order).withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("host", "range").agg(F.count(F.lit(1)).alias("own"))
    before = sizes.select(F.col("host").alias("range_host"), F.col("range").alias("of_range"), (F.sum("own").over(Window.partitionBy("host").orderBy("range")) - F.col("own")).alias("before"))
    inside = ranged.withColumn("inside", F.row_number().over(Window.partitionBy("host", "range").orderBy(*order)) - 1)
    out = inside.join(before, F.col("host").eqNullSafe(F.col("range_host")) & (F.col("range") == F.col("of_range"))).drop("range_host", "of_range", "range")
    place = F.col("before") + F.col("inside")
    gap = F.coalesce((F.col("crawl_delay") * 1000).cast("long"), F.lit(delay_ms).cast("long"))
    return out.withColumn("place", place).withColumn("start_ms", F.col("place") * gap).withColumn("wave", F.floor(F.col("place") / per_host)).drop("crawl_delay", "before", "inside")


def save_frontier(frontier: DataFrame, path: str) -> None:
    frontier.write.parquet(path)


def load_frontier(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRONTIER).parquet(path).orderBy("depth", "url")


def crawl(corpus: DataFrame, seeds: DataFrame, cfg: CrawlConfig = CrawlConfig(), rules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, frontier): what a crawl from ``seeds`` reaches in ``corpus`` (parsed pages with url, links, page_id).

    Each wave joins the open entries to the corpus, follows their links and drops what was seen. Corpus and waves lie in
    buckets of the URL's hash, so of a wave only its new entries are shuffled, once, after each task has made its own
    distinct; what was seen stays where it is. The number of waves is the depth limit at most. ``max_pages`` counts pages
    that came, exactly.
    """
    keyed = corpus.drop("depth").withColumn("url_hash", F.sha2(normalize_url("url", cfg.strip_slash), 256))
    first = Window.partitionBy("url_hash").orderBy("page_id")
    keyed = keyed.repartition(buckets(corpus.sparkSession), "url_hash").withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
    keyed = colocated(keyed, "url_hash", aligned=True)
    waves, pages, crawled = [colocated(dedup(seeds), "url_hash", aligned=True)], [], 0
    for depth in range(cfg.max_depth + 1):
        wave = waves[-1]
        if rules is not None and cfg.respect_robots:
            wave = robots_allowed(wave, rules, cfg.agent).filter("allowed").drop("allowed")
        got = wave.select("url_hash", "depth", "priority").join(keyed, "url_hash")
        if cfg.max_pages:
            got = cut(got.orderBy(F.col("priority").desc(), "depth", "url").limit(cfg.max_pages - crawled))
            crawled += got.count()
        pages.append(got)
        if depth == cfg.max_depth or cfg.max_pages and crawled >= cfg.max_pages:
            break
        front = colocated(reduce(lambda new, seen: new.join(seen.select("url_hash"), "url_hash", "left_anti"), waves, dedup(expand(got, cfg))), "url_hash", aligned=True)
        if front.isEmpty():
            break
        waves.append(front)
    return reduce(DataFrame.unionByName, pages), reduce(DataFrame.unionByName, waves).select("url", "url_hash", "depth", "priority", "source_page")


def frontier_stats(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """discovered, dequeued (found in the corpus), queued, crawled, errored."""
    got = pages.select("url_hash", F.coalesce(F.col("status_code"), F.lit(0)).alias("s"), F.lit(1).alias("got"))
    j = frontier.join(got, "url_hash", "left")
    return j.agg(F.count(F.lit(1)).alias("discovered"), F.count("got").alias("dequeued"), F.count_if(F.col("got").isNull()).alias("queued"), F.count_if(F.col("s") > 0).alias("crawled"), F.count_if(F.col("s") == 0).alias("errored"))
