"""Pages with one URL, and pages whose URLs differ but normalise alike."""

import duckdb
import pytest
from pyspark.sql import functions as F

from crawlspan import registry
from crawlspan.operators import results
from crawlspan.plans import frontier

#: Page 20 is not in the base crawl; page 21, which is, has its URL but for the fragment. Others have one URL twice.
URLS = {i: f"http://a.example.net/en/{i}" for i in range(24)} | {7: "http://a.example.net/en/6", 12: "http://a.example.net/en/11", 10: "http://a.example.net/en/x#top", 5: "http://a.example.net/en/x"}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, u, f"<html><head><title>Page {i}</title></head><body><h1>Page {i}</h1> some words</body></html>") for i, u in URLS.items()]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{path}/pages.parquet/*.parquet'")
    return path, con


@pytest.mark.parametrize("name", ["frt2_sitemap_rows", "frt11_crawl", "frt14_audit_links", "frt14_audit_issues", "frt14_audit_pages"])
def test_as_the_sql(spark, odd, name):
    path, con = odd
    df, want = registry.QUERIES[name](spark, path), con.sql(registry.ORACLES[name])
    got = sorted(tuple(map(str, r)) for r in df.select(*want.columns).collect())
    assert got == sorted(tuple(map(str, r)) for r in want.fetchall()) and got


def test_the_smallest_id_comes_first(spark):
    rows = [(i, "http://a.example/p/q", 200, 1, 0) for i in (3, 9, 1, 5, 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, status_code int, priority int, depth int").withColumn("crawl_id", F.lit("base"))
    assert [r["page_id"] for r in results.site_tree(df.repartition(4)).filter("url is not null").collect()] == [1]
    got = frontier.fetch_schedule(df.repartition(4), tie=("page_id",)).orderBy("place").collect()
    assert [(r["page_id"], r["place"]) for r in got] == [(1, 0), (3, 1), (5, 2), (7, 3), (9, 4)]
