"""Stored crawls: changes that die half way, readers beside a change, and two changes at once."""

import pytest
from pyspark.sql import functions as F

from crawlspan.sources.store import Conflict, CrawlStore

PAGES = "crawl_id string, url_hash string, url string, depth int, title string"


def pages(spark, *rows):
    return spark.createDataFrame([(c, h, f"https://{h}/", d, t) for c, h, d, t in rows], PAGES)


@pytest.fixture()
def store(spark, tmp_path):
    store = CrawlStore(spark, f"file://{tmp_path}/store")
    first = pages(spark, ("a", "x", 0, "ax"), ("a", "y", 1, "ay"), ("b/ä=1", "x", 0, "bx"), ("12", "z", 0, "z"))
    assert store.put({"pages": first, "links": first.select("crawl_id", F.col("url").alias("target_url"))}) == 1
    return store


def titles(df):
    return sorted((r["crawl_id"], r["url_hash"], r["depth"], r["title"]) for r in df.collect())


def test_upsert_and_delete(spark, store):
    before = titles(store.read("pages"))
    updates = pages(spark, ("a", "x", 9, "new"), ("a", "x", 8, "newer"), ("c", "q", 2, "cq")).withColumn("seq", F.when(F.col("title") == "newer", 2).otherwise(1))
    assert store.upsert(updates) == 2
    want = [("12", "z", 0, "z"), ("a", "x", 0, "newer"), ("a", "y", 1, "ay"), ("b/ä=1", "x", 0, "bx"), ("c", "q", 2, "cq")]
    assert titles(store.read("pages")) == want and titles(store.read("pages", state=store.state(1))) == before
    old, new = store.state(1)["parts"]["pages"], store.state(2)["parts"]["pages"]
    assert {c for c in new if new[c] != old.get(c)} == {"a", "c"}  # other crawls keep their files
    assert store.delete("a") == 3 and titles(store.read("pages")) == [w for w in want if w[0] != "a"]
    assert "a" not in {r["crawl_id"] for r in store.read("links").collect()}
    with pytest.raises(KeyError):
        store.delete("a")
    left = store.vacuum()
    assert any(f.endswith("crawl_id=a") for f in left) and titles(store.read("pages")) == [w for w in want if w[0] != "a"] and store.vacuum() == []


def test_a_change_that_dies_is_not_seen(spark, store, monkeypatch):
    before = titles(store.read("pages"))
    writes = []

    def dies(self, table, rows):
        if writes:
            raise RuntimeError("killed")
        writes.append(write(self, table, rows))
        return writes[0]

    write = CrawlStore.write
    monkeypatch.setattr(CrawlStore, "write", dies)
    with pytest.raises(RuntimeError):  # the first table is written, the second is not
        store.put({"pages": pages(spark, ("a", "x", 0, "half")), "links": store.read("links")})
    monkeypatch.setattr(CrawlStore, "write", write)
    monkeypatch.setattr(CrawlStore, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):  # all is written, the pointer is not
        store.put({"pages": pages(spark, ("a", "x", 0, "whole"))})
    assert store.version() == 1 and titles(store.read("pages")) == before
    assert len([f for f in store.vacuum() if f.startswith("pages/")]) == 2


def test_a_reader_keeps_its_state(spark, store):
    seen = store.tables()
    before = titles(seen["pages"])
    store.put({"pages": pages(spark, ("a", "x", 0, "later"))})
    store.delete("12")
    assert titles(seen["pages"]) == before


def test_of_two_changes_the_later_is_refused(spark, store):
    state = store.state(1)
    store.put({"pages": pages(spark, ("d", "x", 0, "first"))})
    with pytest.raises(Conflict):
        store.commit(state, 1)
    assert ("d", "x", 0, "first") in titles(store.read("pages")) and store.version() == 2


def test_an_empty_store(spark, tmp_path):
    store = CrawlStore(spark, f"file://{tmp_path}/none")
    assert store.version() == 0 and store.tables() == {}
    assert store.put({"pages": pages(spark, ("a", "x", 0, "t")).limit(0)}) == 1 and store.read("pages").count() == 0
    assert store.upsert(pages(spark).withColumn("seq", F.lit(1))) == 1
