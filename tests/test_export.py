"""The line exporter's commit protocol: tasks that fail once, jobs that fail, and the order of lines."""

import os

import pytest
from pyspark.sql import functions as F

from crawlspan.sources import sinks


def files(path):
    return sorted(f for f in os.listdir(path) if not f.endswith(".crc")) if os.path.isdir(path) else []


def lines_of(path):
    return [line for f in files(path) for line in open(f"{path}/{f}").read().splitlines()]


def flaky(flags, last):
    """A column function that writes its rows and then fails, the first time that a task sees place ``last``."""

    def check(places):
        for p in places:
            if p == last and not os.path.exists(f"{flags}/{p}"):
                open(f"{flags}/{p}", "w").close()
                raise RuntimeError("lost")
        return places

    return F.pandas_udf(check, "long")


def test_lines_come_in_order(spark, tmp_path):
    df = spark.range(5000).select((F.lit(4999) - F.col("id")).alias("place"), F.concat(F.lit("line "), (F.lit(4999) - F.col("id")).cast("string")).alias("line")).repartition(7)
    sinks.export_lines(df, f"file://{tmp_path}/x")
    assert lines_of(f"{tmp_path}/x") == [f"line {i}" for i in range(5000)] and not any("staging" in f for f in files(f"{tmp_path}/x"))
    sinks.export_lines(df.filter("place < 3"), f"file://{tmp_path}/x", overwrite=True)
    assert lines_of(f"{tmp_path}/x") == ["line 0", "line 1", "line 2"]
    sinks.export_lines(df.limit(0), f"file://{tmp_path}/y")
    assert lines_of(f"{tmp_path}/y") == []


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    bad = F.pandas_udf(lambda s: s.map(lambda p: 1 // (900 - p) * 0 + p), "long")
    df = spark.range(1000).select(F.col("id").alias("place"), F.concat(F.lit("l"), bad(F.col("id")).cast("string")).alias("line"))
    spark.dataSource.register(sinks.MarkdownExport)
    with pytest.raises(Exception):
        df.repartition(4).write.format("crawlspan_markdown").mode("append").option("path", f"file://{tmp_path}/x").save()
    assert files(f"{tmp_path}/x") == []


RETRY = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
from crawlspan.sources import sinks
from tests.test_export import flaky
spark = SparkSession.builder.master("local[2,3]").config(map={{"spark.ui.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "10"}}).getOrCreate()
spark.dataSource.register(sinks.MarkdownExport)
df = spark.range(0, 1000, 1, 4).select(F.col("id").alias("place"), F.col("id").cast("string").alias("line"))
df.select(flaky({flags!r}, 700)("place").alias("place"), "line").write.format("crawlspan_markdown").mode("append").option("path", "file://" + {out!r}).save()
"""


def test_a_task_that_fails_once_gives_each_line_once(tmp_path):
    """Run with retries in a session of its own: the failed attempt had written part of its lines already."""
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.makedirs(f"{tmp_path}/flags")
    code = RETRY.format(repo=repo, flags=f"{tmp_path}/flags", out=f"{tmp_path}/x")
    done = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": repo}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert os.path.exists(f"{tmp_path}/flags/700")  # it did fail
    assert lines_of(f"{tmp_path}/x") == [str(i) for i in range(1000)] and len(files(f"{tmp_path}/x")) == 4
