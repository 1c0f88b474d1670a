"""Analyses across the pages of a crawl: duplicates, broken links, orphans, sitemap gaps.

Joins are on (crawl_id, url). Duplicate groups are counted with map-side sums and joined back, so a title that most pages
share is a skewed join side that can be split, not a list in one row; the ids listed in an issue are capped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlspan.functions.text import truncate_label

#: Ids that an issue lists at most; the count is always whole.
LISTED = 100
FIELDS = {"title": ("meta.title_duplicate", "meta", "title"), "meta_desc": ("meta.desc_duplicate", "meta", "description"), "h1": ("content.h1_duplicate", "content", "H1")}


def duplicates(pages: DataFrame, field: str) -> DataFrame:
    """crawl_id, value, count, first_ids of each non-empty value on more than one page."""
    return pages.filter(F.coalesce(field, F.lit("")) != "").groupBy("crawl_id", F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("count")).filter("count > 1")


def dup_titles(pages: DataFrame) -> DataFrame:
    return duplicates(pages, "title")


def dup_descriptions(pages: DataFrame) -> DataFrame:
    return duplicates(pages, "meta_desc")


def dup_h1s(pages: DataFrame) -> DataFrame:
    return duplicates(pages, "h1")


def duplicate_members(pages: DataFrame, field: str) -> DataFrame:
    """crawl_id, value, page_id: every page of every duplicate group, as rows, however large the group is."""
    return pages.select("crawl_id", F.col(field).alias("value"), "page_id").join(duplicates(pages, field).select("crawl_id", "value"), ["crawl_id", "value"])


def duplicate_issues(pages: DataFrame, field: str, cap: int | None = LISTED) -> DataFrame:
    """One issue for each page of a duplicate group. An issue lists ``cap`` ids of its group; :func:`duplicate_members` has
    all of them as rows, ``None`` lists all in every issue (the square of a group's size)."""
    rule, category, name = FIELDS[field]
    groups = duplicates(pages, field)
    members = pages.select("crawl_id", "page_id", "url", F.col(field).alias("value")).join(groups, ["crawl_id", "value"])
    ids = members.select("crawl_id", "value", "page_id")
    if cap is not None:  # the smallest ids, found with bounded state on both sides of the shuffle
        salted = ids.withColumn("salt", F.pmod("page_id", F.lit(64)))
        top = Window.partitionBy("crawl_id", "value", "salt").orderBy("page_id")
        ids = salted.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= cap)
    lists = ids.groupBy("crawl_id", "value").agg(F.sort_array(F.collect_list("page_id")).alias("ids"))
    lists = lists.withColumn("ids", F.slice("ids", 1, cap)) if cap is not None else lists
    out = members.join(lists, ["crawl_id", "value"])
    return out.select(
        "crawl_id", "page_id", "url", F.lit(rule).alias("rule_id"), F.lit("warning").alias("severity"), F.lit(category).alias("category"),
        F.concat(F.lit(f'Duplicate {name}: "'), truncate_label(F.col("value")), F.lit('" is shared by '), F.col("count").cast("string"), F.lit(" page(s).")).alias("message"),
        F.to_json(F.struct(F.col("count"), F.col("ids").alias("duplicate_page_ids"), F.col("value"))).alias("detail_json"),
    )


def broken_internal(links: DataFrame, pages: DataFrame) -> DataFrame:
    """An error on the source page for each internal link whose target answered 400 or more."""
    bad = pages.filter("status_code >= 400").select("crawl_id", F.col("url").alias("target_url"), "status_code")
    hit = links.filter("is_internal").join(bad, ["crawl_id", "target_url"])
    return hit.select(
        "crawl_id", F.col("source_page").alias("page_id"), "target_url", F.lit("links.broken_internal").alias("rule_id"), F.lit("error").alias("severity"), F.lit("links").alias("category"),
        F.concat(F.lit("Broken internal link to "), F.col("target_url"), F.lit(" (status "), F.col("status_code").cast("string"), F.lit(").")).alias("message"),
        F.to_json(F.struct("anchor_text", "status_code", "target_url"), {"ignoreNullFields": "false"}).alias("detail_json"),
    )


def orphan_pages(pages: DataFrame, *links: DataFrame, exclude_seed_only: bool = False) -> DataFrame:
    """Pages below the start that no internal link reaches; the links may come in several parts."""
    deep = pages if exclude_seed_only else pages.filter("depth > 0")
    for part in links:
        deep = deep.join(part.filter("is_internal").select("crawl_id", F.col("target_url").alias("url")).distinct(), ["crawl_id", "url"], "left_anti")
    return deep.select("crawl_id", "page_id", "url", F.lit("links.orphan_page").alias("rule_id"), F.lit("warning").alias("severity"), F.lit("links").alias("category"), F.lit("Page has no internal links pointing to it.").alias("message"))


def sitemap_not_crawled(sitemap: DataFrame, pages: DataFrame) -> DataFrame:
    """Sitemap URLs without a page (reported on the crawl's first page) or whose page did not answer 200.

    A page without status is not reported. Crawls without sitemap rows give nothing.
    """
    first = pages.groupBy("crawl_id").agg(F.min("page_id").alias("first_page"))
    p = pages.select("crawl_id", "url", "page_id", "status_code", F.lit(True).alias("known"))
    gaps = sitemap.select("crawl_id", "url").join(p, ["crawl_id", "url"], "left").filter("known is null or status_code <> 200").join(first, "crawl_id")
    how = F.when(F.col("known").isNull(), F.lit(" was not found during crawl.")).otherwise(F.lit(" returned a non-200 status."))
    return gaps.select(
        "crawl_id", F.coalesce("page_id", "first_page").alias("page_id"), "url", F.lit("sitemap.url_not_crawled").alias("rule_id"), F.lit("warning").alias("severity"), F.lit("indexability").alias("category"),
        F.concat(F.lit("Sitemap URL "), F.col("url"), how).alias("message"), "status_code",
    )


def page_not_in_sitemap(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Pages that answered 200 and that the crawl's sitemap lacks."""
    having = sitemap.select("crawl_id").distinct()
    gaps = pages.filter("status_code = 200").join(having, "crawl_id", "left_semi").join(sitemap.select("crawl_id", "url"), ["crawl_id", "url"], "left_anti")
    return gaps.select("crawl_id", "page_id", "url", F.lit("sitemap.page_not_in_sitemap").alias("rule_id"), F.lit("info").alias("severity"), F.lit("indexability").alias("category"), F.lit("Page is not in the sitemap.").alias("message"))


def broken_external(checks: DataFrame) -> DataFrame:
    """Checked external links with an error or a status of 400 or more."""
    message = F.when(F.col("error_message").isNotNull(), F.concat(F.lit("External link "), F.col("target_url"), F.lit(" failed: "), F.col("error_message"))).otherwise(F.concat(F.lit("External link "), F.col("target_url"), F.lit(" returned status "), F.col("status_code").cast("string")))
    return checks.filter("error_message is not null or status_code >= 400").select(
        "crawl_id", F.col("source_page").alias("page_id"), "target_url", F.lit("links.broken_external").alias("rule_id"), F.lit("warning").alias("severity"), message.alias("message"),
        F.to_json(F.struct(F.col("error_message").alias("error"), F.col("status_code"), F.col("target_url")), {"ignoreNullFields": "false"}).alias("detail_json"),
    )


def external_targets(links: DataFrame, pages: DataFrame) -> DataFrame:
    """External targets of a crawl, each with the first page that links to it; sources without a page drop out."""
    known = links.filter("not is_internal").join(pages.select("crawl_id", F.col("page_id").alias("source_page")), ["crawl_id", "source_page"], "left_semi")
    return known.groupBy("crawl_id", "target_url").agg(F.min("source_page").alias("source_page"))


def post_crawl_issues(pages: DataFrame, links: DataFrame, sitemap: DataFrame | None = None, cap: int | None = LISTED) -> DataFrame:
    """The findings of all finders as issues with their details, in one table."""
    none = F.lit(None).cast("string").alias("detail_json")
    parts = [*(duplicate_issues(pages, f, cap) for f in FIELDS), broken_internal(links, pages), orphan_pages(pages, links)]
    if sitemap is not None:
        parts += [sitemap_not_crawled(sitemap, pages), page_not_in_sitemap(pages, sitemap)]
    keep = ["crawl_id", "page_id", "rule_id", "severity", "category", "message"]
    return reduce(DataFrame.unionByName, (p.select(*keep, "detail_json" if "detail_json" in p.columns else none) for p in parts))
