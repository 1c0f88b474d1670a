"""The whole audit in one call: parse, crawl, links, rule findings and findings across pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspan.functions.urls import normalize_url
from crawlspan.model import CrawlConfig
from crawlspan.operators.crosspage import LISTED, post_crawl_issues
from crawlspan.operators.parse import h1_first, links_table, parse_pages
from crawlspan.operators.rules import evaluate_rules
from crawlspan.plans.frontier import crawl
from crawlspan.sources.pages import is_html_page, page_state
from crawlspan.sources.scratch import cut


@dataclass
class Audit:
    """pages, links and issues of one crawl, and its frontier; every table carries crawl_id."""

    pages: DataFrame
    links: DataFrame
    issues: DataFrame
    frontier: DataFrame


def audit(
    fetches: DataFrame, seeds: DataFrame, crawl_id: str, cfg: CrawlConfig = CrawlConfig(), root_domain: str | None = None, robots: DataFrame | None = None, sitemap: DataFrame | None = None, cap: int | None = LISTED, bare_references: bool = True
) -> Audit:
    """Audits what a crawl from ``seeds`` (frontier entries) reaches among ``fetches`` (page_id, url, html, status_code,
    content_type and the other fetch columns).

    Only HTML pages that answered 2xx are parsed for texts and links, as only those have a document. Pages carry their
    normalised URL and links their normalised target, on which all joins across pages run; ``sitemap`` has a column url.
    ``cfg.rules`` configures the rules; ``cap`` bounds the page ids that an issue on duplicates lists.
    """
    blank = fetches.withColumn("html", F.when(is_html_page(), F.col("html")).otherwise(F.lit("")))
    corpus = cut(parse_pages(blank, root_domain=root_domain, bare_references=bare_references))
    got, frontier = crawl(corpus, seeds, cfg, robots)
    pages = got.withColumns({"crawl_id": F.lit(crawl_id), "url": normalize_url("url", cfg.strip_slash), "meta_desc": F.col("meta_description"), "h1": h1_first()})
    pages = cut(page_state(pages))
    links = links_table(pages).withColumn("href", F.col("target_url")).withColumn("target_url", normalize_url("target_url", cfg.strip_slash))
    links = cut(links)
    stored = pages.select("crawl_id", "page_id", "url", "depth", "status_code", "title", "meta_desc", "h1")
    entries = None if sitemap is None else sitemap.select(F.lit(crawl_id).alias("crawl_id"), normalize_url("url", cfg.strip_slash).alias("url")).distinct()
    own = evaluate_rules(pages, config={"rules": cfg.rules}, html_only=True)
    across = post_crawl_issues(stored, links, entries, cap)
    return Audit(pages, links, own.select(*across.columns).unionByName(across), frontier.withColumn("crawl_id", F.lit(crawl_id)))
