"""Tables laid out so that joins on URLs move no rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlspan.sources.scratch import cut, scratch_dir


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def colocated(df: DataFrame, key: str, aligned: bool = False) -> DataFrame:
    """``df`` written to the shared folder in sorted buckets of ``key`` and read back: joins and groupings on the key, or on
    more columns beside it, need no exchange. ``aligned``: the rows are partitioned by the key already.

    The session is told that a part of a join's keys is enough to place rows, and that a union of such tables is in no order of
    its own (it would plan joins on their buckets, but run with the partitions of all); that holds for all its later plans.
    """
    spark, n = df.sparkSession, buckets(df.sparkSession)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    name = f"crawlspan_{uuid.uuid4().hex}"
    rows = df if aligned else df.repartition(n, key)
    rows.write.format("parquet").bucketBy(n, key).sortBy(key).option("path", scratch_dir(spark)).saveAsTable(name)
    return spark.table(name)


@dataclass
class LinkLayout:
    """Pages in buckets of their URL and links in buckets of their target.

    A target that more than a bucket's even share of all links aim at (a home page) would make one bucket hold them all. The
    links to such targets, which are no more than there are buckets, lie apart and spread out; they meet the few pages with
    those URLs in a join that Spark plans by size.
    """

    pages: DataFrame
    links: DataFrame
    hot_pages: DataFrame
    hot_links: DataFrame

    def on_targets(self, find: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """``find(links, pages)`` for a function that looks at each link and the pages of its target alone."""
        return find(self.links, self.pages).unionByName(find(self.hot_links, self.hot_pages))


def link_layout(pages: DataFrame, links: DataFrame) -> LinkLayout:
    """Lays out pages (crawl_id, url, ...) and links (crawl_id, target_url, ...)."""
    spark = links.sparkSession
    links = cut(links)
    n = links.count()
    hot = cut(links.groupBy("target_url").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(1, n // buckets(spark))).select("target_url"))
    laid = colocated(pages, "url")
    cold = links.join(hot, "target_url", "left_anti")
    apart = cut(links.join(hot, "target_url", "left_semi"))
    return LinkLayout(laid, colocated(cold.select(*links.columns), "target_url"), cut(laid.join(hot.withColumnRenamed("target_url", "url"), "url", "left_semi")), apart.select(*links.columns))
