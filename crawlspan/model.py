"""Fixed vocabularies and run settings of an audit."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Severities from worst to mildest, link types, crawl tables.
SEVERITIES = ("error", "warning", "info")
LINK_TYPES = ("a", "img", "script", "link", "canonical", "redirect")
CATEGORIES = ("meta", "content", "links", "images", "performance", "security", "indexability", "structured", "accessibility")
TABLES = ("crawls", "pages", "links", "issues", "sitemap_urls", "external_links", "ai_analyses", "ai_usage", "ai_crawl_summaries")
#: Status codes of the named classes of the page filter, and content type beginnings.
STATUS_CLASSES = {
    "2xx": (200, 201, 202, 203, 204),
    "3xx": (300, 301, 302, 303, 304, 307, 308),
    "4xx": (400, 401, 403, 404, 405, 410, 429, 451),
    "5xx": (500, 502, 503, 504),
}
CONTENT_CLASSES = {"html": "text/html", "css": "text/css", "javascript": "application/javascript", "image": "image/"}


@dataclass(frozen=True)
class CrawlConfig:
    """Settings of a crawl over a page corpus."""

    max_depth: int = 10
    max_pages: int = 0
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    rewrite: tuple[tuple[str, str], ...] = ()
    strip_slash: bool = True
    respect_robots: bool = True
    agent: str = "*"
    delay_ms: int = 500
    per_host: int = 2
    wave: int = 0
    rules: dict = field(default_factory=dict)
