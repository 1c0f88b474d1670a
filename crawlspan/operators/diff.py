"""Differences of two crawls: one full outer join on the URL serves all page comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _side(pages: DataFrame, crawl: str, tag: str) -> DataFrame:
    cols = ("page_id", "status_code", "title", "meta_desc")
    return pages.filter(F.col("crawl_id") == crawl).select("url", *[F.col(c).alias(f"{tag}_{c}") for c in cols], F.lit(True).alias(f"in_{tag}"))


def _differs(c: str, none) -> Column:
    return F.coalesce(F.col(f"base_{c}"), F.lit(none)) != F.coalesce(F.col(f"compare_{c}"), F.lit(none))


def compared(pages: DataFrame, base: str, compare: str) -> DataFrame:
    """Both sides of each URL; a missing text equals an empty one, a missing status -1."""
    both = _side(pages, base, "base").join(_side(pages, compare, "compare"), "url", "full_outer")
    here = F.col("in_base").isNotNull() & F.col("in_compare").isNotNull()
    return both.select(
        "*", (here & _differs("status_code", -1)).alias("status_differs"), (here & _differs("title", "")).alias("title_differs"), (here & _differs("meta_desc", "")).alias("meta_differs")
    )


def page_diffs(pages: DataFrame, base: str, compare: str, kind: str | None = None, search: str | None = None) -> DataFrame:
    """url, diff_type (new, removed, status_code_changed) and both sides; the kind metadata_changed has no rows here."""
    label = F.when(F.col("in_base").isNull(), "new").when(F.col("in_compare").isNull(), "removed").when(F.col("status_differs"), "status_code_changed")
    out = compared(pages, base, compare).withColumn("diff_type", label).filter("diff_type is not null")
    if kind:
        out = out.filter(F.col("diff_type") == kind)
    if search:
        out = out.filter(F.contains(F.lower("url"), F.lit(search.lower())))
    return out.select("url", "diff_type", "base_status_code", "compare_status_code", "base_title", "compare_title", "base_meta_desc", "compare_meta_desc")


def metadata_diffs(pages: DataFrame, base: str, compare: str, search: str | None = None) -> DataFrame:
    out = compared(pages, base, compare).filter("title_differs or meta_differs")
    if search:
        out = out.filter(F.contains(F.lower("url"), F.lit(search.lower())))
    return out.select("url", "base_title", "compare_title", "base_meta_desc", "compare_meta_desc")


def issue_diffs(issues: DataFrame, base: str, compare: str, kind: str | None = None) -> DataFrame:
    """Issue rows of one crawl whose (rule, URL) the other lacks: new or resolved. Repeated rows stay repeated."""
    a, b = issues.filter(F.col("crawl_id") == base), issues.filter(F.col("crawl_id") == compare)
    key = ["rule_id", "url"]
    new = b.join(a.select(*key), key, "left_anti").withColumn("diff_type", F.lit("new"))
    gone = a.join(b.select(*key), key, "left_anti").withColumn("diff_type", F.lit("resolved"))
    out = new.unionByName(gone).select("url", "rule_id", "severity", "category", "message", "diff_type")
    return out.filter(F.col("diff_type") == kind) if kind else out


def comparison_summary(pages: DataFrame, issues: DataFrame, base: str, compare: str) -> DataFrame:
    n = lambda c: F.count_if(c)
    p = compared(pages, base, compare).agg(
        n(F.col("in_base").isNull()).alias("new_pages"), n(F.col("in_compare").isNull()).alias("removed_pages"), n(F.col("status_differs")).alias("changed_status"), n(F.col("title_differs")).alias("changed_title"), n(F.col("meta_differs")).alias("changed_meta")
    )
    sides = issues.groupBy("rule_id", "url").agg(F.max(F.col("crawl_id") == base).alias("a"), F.max(F.col("crawl_id") == compare).alias("b"))
    i = sides.agg(n(F.col("b") & ~F.col("a")).alias("new_issues"), n(F.col("a") & ~F.col("b")).alias("resolved_issues"))
    return p.crossJoin(i)  # one row each
