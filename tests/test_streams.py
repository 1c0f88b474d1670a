"""Keyed state of streams against a plain recomputation in the order of arrival."""

import datetime
import random

import pytest

from crawlspan.streaming import progress as pg

SCHEMA = "crawl_id string, event_id long, ts timestamp, url string, status_code int, response_time_ms long, failed boolean"
START = datetime.datetime(2024, 1, 1)


def batch(rng, first, crawls, n, start, gap):
    return [(rng.choice(crawls), first + k, start + datetime.timedelta(milliseconds=k * gap + rng.randrange(gap)), f"u{first + k}", 200 if k % 3 else None, k, rng.random() < 0.2) for k in range(n)]


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def sequential(batches, every, interval, keep):
    """The reference's loop: one event after the other."""
    state, out = {}, []
    for rows in batches:
        for crawl, i, ts, url, status, took, failed in sorted(rows, key=lambda r: (r[2], r[1])):
            ms = int((ts - datetime.datetime(1970, 1, 1)) / datetime.timedelta(milliseconds=1))
            s = state.setdefault(crawl, {"ok": 0, "bad": 0, "first": ms, "told": ms, "told_ok": 0, "recent": []})
            s["ok"], s["bad"] = s["ok"] + (not failed), s["bad"] + failed
            s["recent"] = [*s["recent"], (url, status, took)][-keep:]
            if s["ok"] >= s["told_ok"] + every or ms >= s["told"] + interval:
                out.append((crawl, "count" if s["ok"] >= s["told_ok"] + every else "interval", s["ok"], s["bad"], ms - s["first"], s["recent"]))
                s["told"], s["told_ok"] = ms, s["ok"]
    return out


def rows_of(df):
    return sorted((r["crawl_id"], r["reason"], r["crawled"], r["errored"], r["elapsed_ms"], [tuple(x) for x in r["recent"]]) for r in df.collect())


@pytest.fixture(scope="module")
def batches():
    rng = random.Random(2)
    return [batch(rng, 1000 * k, ["a", "a", "b", f"c{k}"], 300, START + datetime.timedelta(seconds=30 * k), 80) for k in range(3)]


def test_progress_over_batches_and_a_restart(spark, tmp_path, batches):
    """Three runs on one checkpoint tell each row once, and what one endless run would tell."""
    source, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    for b in batches:
        write(spark, b, source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        got = pg.drained_progress(pg.crawl_progress(stream, every=25, interval_ms=2000, keep=3, watermark="10 minutes"), out, check)
    assert rows_of(got) == sorted(sequential(batches, 25, 2000, 3))


def test_silence_is_told_by_a_timer(spark, tmp_path):
    """A crawl that stops is told once its interval has passed in the stream's time, although no event of it comes."""
    source, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    write(spark, [("quiet", k, START + datetime.timedelta(milliseconds=k), f"u{k}", 200, 1, k == 0) for k in range(7)], source)
    run = lambda: pg.drained_progress(pg.crawl_progress(spark.readStream.schema(SCHEMA).parquet(source), 50, 1000, 2, "1 second"), out, check)
    run()
    write(spark, [("busy", 100, START + datetime.timedelta(minutes=5), "b", 200, 1, False)], source)
    run()
    write(spark, [("busy", 101, START + datetime.timedelta(minutes=9), "b", 200, 1, False)], source)
    got = [r for r in rows_of(run()) if r[0] == "quiet"]
    assert got == [("quiet", "silence", 6, 1, 6, [("u5", 200, 1), ("u6", 200, 1)])]
