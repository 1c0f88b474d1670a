"""Fetched pages as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BODY = 10 * 1024 * 1024
FETCH_COLUMNS = {
    "crawl_id": "string", "page_id": "long", "url": "string", "final_url": "string", "status_code": "int", "headers": "map<string,string>", "html": "string", "content_type": "string",
    "response_time_ms": "long", "redirect_chain": "array<struct<url:string,status_code:int>>", "error_message": "string", "depth": "int", "fetched_at": "timestamp",
}


def load_pages(spark: SparkSession, path: str, crawl_id: str = "base") -> DataFrame:
    """A corpus of fetched documents; columns that it lacks get their defaults."""
    df = spark.read.parquet(path)
    default = {"crawl_id": F.lit(crawl_id), "final_url": F.col("url"), "status_code": F.lit(200), "content_type": F.lit("text/html"), "depth": F.lit(0)}
    return df.select(*[(F.col(c) if c in df.columns else default.get(c, F.lit(None))).cast(t).alias(c) for c, t in FETCH_COLUMNS.items()])


def with_body_hash(df: DataFrame, body: str = "html") -> DataFrame:
    """Caps the body, records its size before that, and hashes what is kept."""
    raw = F.col(body).cast("binary")
    return df.withColumn("body_size", F.octet_length(raw).cast("long")).withColumn("body_hash", F.sha2(F.substring(raw, 1, MOST_BODY), 256))


def is_html_page(status: str = "status_code", kind: str = "content_type") -> F.Column:
    """What rules run on: 2xx and HTML."""
    return F.coalesce(F.col(status).between(200, 299) & F.contains(F.col(kind), F.lit("text/html")), F.lit(False))


def page_state(df: DataFrame) -> DataFrame:
    """``state``: errored without status, analyzed for HTML pages that came, fetched for all else."""
    return df.withColumn("state", F.when(F.col("status_code").isNull(), "errored").when(is_html_page(), "analyzed").otherwise("fetched"))
