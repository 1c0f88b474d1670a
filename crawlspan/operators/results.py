"""Result queries over the tables of a crawl. Every order ends in an id, so paging is stable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlspan.functions.urls import path_segments, url_host
from crawlspan.model import CONTENT_CLASSES, STATUS_CLASSES
from crawlspan.operators.crosspage import page_not_in_sitemap, sitemap_not_crawled

#: Columns that lists may be sorted by.
SORTS = {
    "pages": {"url": "url", "statusCode": "status_code", "title": "title", "responseTimeMs": "response_time_ms", "bodySize": "body_size", "depth": "depth", "state": "state"},
    "issues": {"severity": "severity", "category": "category", "ruleId": "rule_id", "message": "message", "pageId": "page_id"},
    "links": {"sourcePage": "source_page", "targetUrl": "target_url", "linkType": "link_type", "anchorText": "anchor_text"},
}
MOST_ROWS = 1000


def severity_rank(c: str = "severity") -> Column:
    return F.when(F.col(c) == "error", 0).when(F.col(c) == "warning", 1).when(F.col(c) == "info", 2).otherwise(3)


def paged(df: DataFrame, kind: str, sort_by: str | None = None, desc: bool = False, offset: int = 0, limit: int = 100, tie: list[str] | None = None) -> DataFrame:
    """A page of a list: an allowed sort column, or the ids alone; at most MOST_ROWS rows."""
    column = SORTS.get(kind, {}).get(sort_by or "")
    order = [] if column is None else [F.col(column).desc_nulls_last() if desc else F.col(column).asc_nulls_first()]
    return df.orderBy(*order, *(tie or [{"pages": "page_id", "issues": "issue_id", "links": "link_id"}[kind]])).offset(max(0, offset)).limit(min(MOST_ROWS, max(1, limit)))


def pages_filter(pages: DataFrame, search: str | None = None, statuses: list[int] | None = None, content_type: str | None = None) -> DataFrame:
    tests = []
    if search:
        tests.append(F.contains(F.lower("url"), F.lit(search.lower())))
    if statuses:
        tests.append(F.col("status_code").isin(list(statuses)))
    if content_type:
        tests.append(F.startswith(F.lower("content_type"), F.lit(content_type.lower())))
    return reduce(lambda df, t: df.filter(t), tests, pages)


def status_class(pages: DataFrame, name: str) -> DataFrame:
    return pages_filter(pages, statuses=list(STATUS_CLASSES[name]))


def content_class(pages: DataFrame, name: str) -> DataFrame:
    return pages_filter(pages, content_type=CONTENT_CLASSES[name])


def issues_filter(issues: DataFrame, severity: str | None = None, category: str | None = None, rule_id: str | None = None) -> DataFrame:
    wanted = {"severity": severity, "category": category, "rule_id": rule_id}
    return reduce(lambda df, kv: df.filter(F.col(kv[0]) == kv[1]), ((k, v) for k, v in wanted.items() if v is not None), issues)


def _bad_targets(pages: DataFrame) -> DataFrame:
    return pages.filter("status_code >= 400").select("crawl_id", F.col("url").alias("target_url"))


def links_filter(links: DataFrame, pages: DataFrame | None = None, link_type: str | None = None, internal: bool | None = None, no_anchor: bool | None = None, broken: bool | None = None) -> DataFrame:
    out = links
    if link_type is not None:
        out = out.filter(F.col("link_type") == link_type)
    if internal is not None:
        out = out.filter(F.col("is_internal") == internal)
    if no_anchor is not None:
        lacks = F.coalesce("anchor_text", F.lit("")) == ""
        out = out.filter(lacks if no_anchor else ~lacks)
    if broken is True:
        out = out.filter("is_internal").join(_bad_targets(pages), ["crawl_id", "target_url"], "left_semi")
    if broken is False:
        out = out.filter("not is_internal").unionByName(out.filter("is_internal").join(_bad_targets(pages), ["crawl_id", "target_url"], "left_anti").select(out.columns))
    return out


def external_filter(checks: DataFrame, broken: bool | None = None) -> DataFrame:
    """A check without status and error is neither broken nor sound."""
    if broken is None:
        return checks
    return checks.filter("status_code >= 400 or error_message is not null" if broken else "status_code < 400 and error_message is null")


def inbound_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    p = pages.select("crawl_id", F.col("url").alias("target_url"), "page_id")
    return links.join(p, ["crawl_id", "target_url"])


def outbound_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    return links.join(pages.select("crawl_id", F.col("page_id").alias("source_page"), F.col("url").alias("source_url")), ["crawl_id", "source_page"])


def page_detail(pages: DataFrame, issues: DataFrame, links: DataFrame, page_id: int) -> DataFrame:
    """One page with its issues and its links in and out, as rows told apart by ``kind`` (page, issue, inbound, outbound): a
    page that all others link to has as many rows, not one row with as long a list."""
    page = pages.filter(F.col("page_id") == page_id)
    none = F.lit(None).cast("string")
    text = lambda *names: [F.col(n).cast("string").alias(n) if n in names else none.alias(n) for n in ("url", "anchor_text", "rule_id", "severity", "category", "message")]
    link = lambda df, kind: df.select("crawl_id", F.lit(kind).alias("kind"), F.col("source_page"), F.col("target_url").alias("url"), "anchor_text").select("crawl_id", "kind", "source_page", *text("url", "anchor_text"))
    rows = [
        page.select("crawl_id", F.lit("page").alias("kind"), F.col("page_id").alias("source_page"), *text("url")),
        issues.filter(F.col("page_id") == page_id).select("crawl_id", F.lit("issue").alias("kind"), F.col("page_id").alias("source_page"), *text("rule_id", "severity", "category", "message")),
        link(inbound_links(page, links).select("crawl_id", "source_page", "target_url", "anchor_text"), "inbound"),
        link(links.filter(F.col("source_page") == page_id), "outbound"),
    ]
    return reduce(DataFrame.unionByName, rows)


def order_by_severity(issues: DataFrame) -> DataFrame:
    return issues.orderBy(severity_rank(), "category", "issue_id")


def sitemap_report(sitemap: DataFrame, pages: DataFrame, with_ok: bool = False) -> DataFrame:
    """Sitemap URLs not crawled and crawled pages not in the sitemap, labelled; sound ones only on demand."""
    out = sitemap_not_crawled(sitemap, pages).select("crawl_id", "url", F.lit("in_sitemap_not_crawled").alias("status"), "status_code")
    out = out.unionByName(page_not_in_sitemap(pages, sitemap).select("crawl_id", "url", F.lit("crawled_not_in_sitemap").alias("status"), F.lit(200).alias("status_code")))
    if with_ok:
        sound = sitemap.select("crawl_id", "url").join(pages.filter("status_code = 200").select("crawl_id", "url"), ["crawl_id", "url"], "left_semi")
        out = out.unionByName(sound.select("crawl_id", "url", F.lit("ok").alias("status"), F.lit(200).alias("status_code")))
    return out


def sitemap_report_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("crawl_id", "status").count()


def issue_counts(issues: DataFrame) -> DataFrame:
    """errors, warnings and infos of each crawl."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return issues.groupBy("crawl_id").agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"))


def recent_crawls(crawls: DataFrame, issues: DataFrame, n: int = 20) -> DataFrame:
    """The newest crawls with their issue counts."""
    newest = crawls.orderBy(F.col("started_at").desc(), "crawl_id").limit(n)
    return crawl_summary(newest, issues)


def crawl_summary(crawls: DataFrame, issues: DataFrame) -> DataFrame:
    counts = issue_counts(issues)
    return crawls.join(counts, "crawl_id", "left").na.fill(0, ["errors", "warnings", "infos"])


def status_groups(pages: DataFrame) -> DataFrame:
    """Pages by class of status; 600 and more count as 5xx, none and less than 200 as other."""
    s = F.col("status_code")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return pages.groupBy("crawl_id").agg(
        n(s.between(200, 299)).alias("s2xx"), n(s.between(300, 399)).alias("s3xx"), n(s.between(400, 499)).alias("s4xx"), n(s >= 500).alias("s5xx"), n(s.isNull() | (s < 200)).alias("other")
    )


def top_issues(issues: DataFrame, n: int = 15) -> DataFrame:
    """Rules of a crawl by worst severity, then by count."""
    per_rule = issues.groupBy("crawl_id", "rule_id").agg(F.min_by("severity", severity_rank()).alias("severity"), F.min_by("category", severity_rank()).alias("category"), F.count(F.lit(1)).alias("issue_count"))
    place = F.row_number().over(Window.partitionBy("crawl_id").orderBy(severity_rank(), F.col("issue_count").desc(), "rule_id"))
    return per_rule.withColumn("place", place).filter(F.col("place") <= n)


def avg_response(pages: DataFrame) -> DataFrame:
    return pages.groupBy("crawl_id").agg(F.avg("response_time_ms").alias("avg_response_ms"))


def report_summary(crawls: DataFrame, pages: DataFrame, issues: DataFrame) -> DataFrame:
    """One row for each crawl with everything that a report starts with; the mean rounds half to even."""
    top = top_issues(issues).groupBy("crawl_id").agg(F.sort_array(F.collect_list(F.struct("place", "rule_id", "severity", "issue_count"))).alias("top_issues"))
    total = pages.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("pages"), F.bround(F.avg("response_time_ms"), 0).cast("long").alias("avg_response_ms"))
    return crawl_summary(crawls, issues).join(total, "crawl_id", "left").join(status_groups(pages), "crawl_id", "left").join(top, "crawl_id", "left")


def site_tree(pages: DataFrame) -> DataFrame:
    """One row for each node: crawl_id, host, level, path, label, its own page if it is one, pages at or below it.

    Of pages with one path the last by URL takes the node, of pages with one URL the first by id. A URL without host is below "unknown".
    """
    host = url_host(F.col("url"))
    leaves = pages.select("crawl_id", F.when(host == "", F.lit("unknown")).otherwise(host).alias("host"), path_segments(F.col("url")).alias("path"), "url", "page_id", "status_code")
    key = ["crawl_id", "host", "path"]
    leaves = leaves.groupBy(*key).agg(F.max_by(F.struct("url", "page_id", "status_code"), F.struct(F.col("url"), -F.col("page_id"))).alias("own"))
    # Pages are summed by folder first, so that only folders, not pages, become a row for each folder above them.
    folders = leaves.filter(F.size("path") > 0).groupBy("crawl_id", "host", F.slice("path", F.lit(1), F.size("path") - 1).alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    above = folders.select("crawl_id", "host", F.explode(F.transform(F.sequence(F.lit(0), F.size("folder")), lambda k: F.slice("folder", F.lit(1), k))).alias("path"), "n")
    nodes = leaves.withColumn("n", F.lit(1).cast("long")).unionByName(above, allowMissingColumns=True)
    out = nodes.groupBy(*key).agg(F.sum("n").alias("page_count"), F.max("own").alias("own"))
    return out.select(
        "crawl_id", "host", F.size("path").alias("level"), F.concat(F.lit("/"), F.array_join("path", "/")).alias("path"), F.coalesce(F.try_element_at("path", F.lit(-1)), F.col("host")).alias("label"),
        F.col("own.url").alias("url"), F.col("own.page_id").alias("page_id"), F.col("own.status_code").alias("status_code"), "page_count",
    )


def dashboard(crawls: DataFrame, issues: DataFrame, n: int = 20, last: int = 10) -> DataFrame:
    """Sums over the newest crawls, and the sizes of the last ones, oldest first."""
    recent = recent_crawls(crawls, issues, n)
    sums = recent.agg(F.sum("urls_crawled").alias("urls"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"), F.sum("infos").alias("infos"))
    sizes = crawls.orderBy(F.col("started_at").desc(), "crawl_id").limit(last).agg(F.transform(F.sort_array(F.collect_list(F.struct("started_at", "urls_crawled"))), lambda x: x["urls_crawled"]).alias("sizes"))
    return sums.crossJoin(sizes)  # one row each


def crawl_status(crawls: DataFrame, pages: DataFrame, frontier: DataFrame | None = None) -> DataFrame:
    """State, pages crawled and errored, URLs queued, seconds so far and pages a second."""
    n = pages.groupBy("crawl_id").agg(F.count_if(F.col("state") != "errored").alias("crawled"), F.count_if(F.col("state") == "errored").alias("errored"), (F.unix_timestamp(F.max("fetched_at")) - F.unix_timestamp(F.min("fetched_at"))).alias("elapsed_s"))
    out = crawls.select("crawl_id", "status").join(n, "crawl_id", "left")
    if frontier is not None:
        out = out.join(frontier.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("queued")), "crawl_id", "left")
    else:
        out = out.withColumn("queued", F.lit(0).cast("long"))
    return out.na.fill(0, ["crawled", "errored", "queued"]).withColumn("rate", F.when(F.col("elapsed_s") > 0, F.col("crawled") / F.col("elapsed_s")).otherwise(F.lit(0.0)))
