"""Joins and crawl waves that leave laid-out tables where they are, with a target that a third of all links share."""

import re

import pytest
from pyspark.sql import functions as F

from crawlspan import overlay
from crawlspan.model import CrawlConfig
from crawlspan.operators import crosspage, results
from crawlspan.plans import frontier
from crawlspan.sources.layout import buckets, colocated, link_layout
from tests.conftest import DATA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def tables(spark):
    pages = spark.range(300).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("crawl_id"), F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), (F.col("id") % 3).alias("depth"), F.when(F.col("id") % 7 == 0, 404).otherwise(200).alias("status_code"))
    target = F.when(F.col("id") % 3 == 0, "u0").otherwise(F.concat(F.lit("u"), F.pmod(F.col("id") * 7, F.lit(200))))
    links = spark.range(6000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("crawl_id"), F.pmod("id", F.lit(300)).alias("source_page"), target.alias("target_url"), F.lit("t").alias("anchor_text"), F.lit("a").alias("link_type"), F.lit(True).alias("is_internal"), F.lit(False).alias("nofollow"))
    return pages, links


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_joins_on_targets_move_nothing(tables, no_broadcast):
    pages, links = tables
    laid = link_layout(pages, links)
    assert {r[0] for r in laid.hot_links.select("target_url").distinct().collect()} == {"u0"} and laid.hot_links.count() == 2020
    assert laid.links.count() == 3980 and laid.hot_pages.count() == 2
    for find in (crosspage.broken_internal, lambda x, p: results.inbound_links(p, x), lambda x, p: results.links_filter(x, p, broken=True), lambda x, p: results.links_filter(x, p, broken=False)):
        assert "Exchange" not in plan(find(laid.links, laid.pages))
        assert rows(laid.on_targets(find)) == rows(find(links, pages))
    orphans = crosspage.orphan_pages(laid.pages, laid.links, laid.hot_links)
    assert "Exchange" not in plan(crosspage.orphan_pages(laid.pages, laid.links)) and rows(orphans) == rows(crosspage.orphan_pages(pages, links)) != []
    both = laid.pages.filter("crawl_id = 'a'").select("url", "page_id").join(laid.pages.filter("crawl_id = 'b'").select("url", "depth"), "url", "full_outer")
    assert "Exchange" not in plan(both) and both.count() == 300


def test_empty_tables(tables):
    pages, links = tables
    laid = link_layout(pages.limit(0), links.limit(0))
    assert laid.on_targets(crosspage.broken_internal).collect() == []


def test_a_wave_shuffles_its_new_entries_only(spark, no_broadcast):
    corpus = overlay.pages(spark, DATA).filter("crawl_id = 'base'").select("page_id", "url", "links")
    keyed = colocated(corpus.withColumn("url_hash", frontier.hash_url("url")), "url_hash")
    waves = [colocated(frontier.dedup(frontier.seed(corpus.filter(f"page_id % 3 = {k}").select("url"))), "url_hash", aligned=True) for k in range(2)]
    got = waves[1].select("url_hash", "depth", "priority").join(keyed, "url_hash")
    assert "Exchange" not in plan(got)
    new = frontier.dedup(frontier.expand(got, CrawlConfig()))
    for w in waves:
        new = new.join(w.select("url_hash"), "url_hash", "left_anti")
    shown = plan(new)
    assert len(re.findall(r"Exchange hashpartitioning", shown)) == 1 and shown.count("Bucketed: true") == 4 and buckets(spark) == 4
