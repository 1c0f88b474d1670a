"""Expectations on small inputs."""

import time

import pytest
from pyspark.sql import functions as F

from crawlspan import registry
from crawlspan.functions import text as tx
from crawlspan.functions import urls as ur
from crawlspan.model import CrawlConfig
from crawlspan.operators import analysis, crosspage, diff, dom, extend, parse, rules, selectors
from crawlspan.plans import frontier
from crawlspan.sources import pages as sp
from crawlspan.sources import robots, sitemaps, sinks
from tests.conftest import DATA

HOME = """<!DOCTYPE html><html><head><title>Test Page - Home</title><meta name="Description" content="A page"><meta name="robots" content="index, follow">
<meta name="viewport" content="width=device-width"><link rel="canonical" href="https://test.local/"><script src="/a.js" defer></script><link rel="stylesheet" href="/s.css"></head>
<body><h1>Home</h1><h2>One</h2><h2>Two <b>b</b></h2><h3>x</h3><a href="/about">About Us</a><a href="/p">P</a><a href="https://other.org/" rel="nofollow">O</a>
<img src="a.png" alt="text"><img src="b.png" alt=""><img src="c.png"></body></html>"""


def record(html, url="https://test.local/", root="test.local"):
    return dict(zip(parse.NAMES, parse.parse_html(html, url, root), strict=True))


def test_parse_home():
    r = record(HOME)
    assert (r["title"], r["meta_robots"], r["canonical"]) == ("Test Page - Home", "index, follow", "https://test.local/")
    assert [len(r[f"h{i}s"]) for i in (1, 2, 3)] == [1, 2, 1] and r["h2s"][1] == "Two b"
    assert [x["is_internal"] for x in r["links"]] == [True, True, False] and r["links"][2]["is_nofollow"]
    assert [x["alt"] for x in r["images"]] == ["text", "", None]
    assert (len(r["scripts"]), r["render_blocking_scripts"], len(r["stylesheets"]), r["render_blocking_stylesheets"]) == (1, 0, 1, 1)


def test_parse_edges():
    assert record("")["title"] is None and record("")["parse_ok"]
    assert record("<title>Hello</title><body>World</body>")["word_count"] == 1
    assert record('<base href="https://cdn.example/x/"><a href="/page">p</a>')["links"][0]["href"] == "https://cdn.example/page"
    assert parse.cut_text("  ") is None and len(parse.cut_text("é" * 4001).encode()) == 8000
    assert parse.cut_text("a" * 8000) == "a" * 8000 and len(parse.cut_text("word " * 3000).encode()) <= 8000


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("https://example.com/page#section", "https://example.com/page"),
        ("https://example.com:443/page", "https://example.com/page"),
        ("HTTP://Example.com:8080", "http://example.com:8080/"),
        ("https://example.com/?z=1&a=2&m=3", "https://example.com/?a=2&m=3&z=1"),
        ("https://example.com/?b=&a", "https://example.com/?a&b"),
        ("https://example.com/page/", "https://example.com/page"),
        ("https://example.com/", "https://example.com/"),
        ("https://example.com/a/../b/./c", "https://example.com/b/c"),
        ("https://example.com/a/%2E%2e/b/%2e/c", "https://example.com/b/c"),
        ("https://Me@Example.com/ä b?q=%61&p=a+b&r=x%26y#f", "https://Me@example.com/%C3%A4%20b?p=a%20b&q=a&r=x&y"),
        ("https://example.com/?q=%C3%A9é'%3D", "https://example.com/?q=%C3%A9%C3%A9%27="),
        ("https://example.com/%3D%25?x=100%", "https://example.com/%3D%25?x=100%"),
        ("https://Bücher.example:443/", "https://xn--bcher-kva.example/"),
        ("https://example.com/a/?x=1", "https://example.com/a/?x=1"),
        ("https://example.com/a?x=b/", "https://example.com/a?x=b"),
        ("https://example.com/a?", "https://example.com/a?"),
        ("not a url", "not a url"),
    ],
)
def test_normalize(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "u string").select(ur.normalize_url(F.col("u")).alias("n"))
    once = df.first()[0]
    assert once == want
    assert spark.createDataFrame([(once,)], "u string").select(ur.normalize_url(F.col("u"))).first()[0] == once


def test_resolve():
    assert ur.resolve("https://example.com/page", "/about") == "https://example.com/about"
    assert ur.resolve("https://example.com/page", "https://x.org/é") == "https://x.org/%C3%A9"
    assert ur.resolve("", "x") is None


def test_internal(spark):
    df = spark.createDataFrame([("https://a.com/x",), ("https://blog.a.com",), ("https://b.com",), ("junk",), (None,)], "u string")
    assert [r[0] for r in df.select(ur.is_internal(F.col("u"), F.lit("a.com"))).collect()] == [True, True, False, False, False]


def test_words(spark):
    df = spark.createDataFrame([("hello world foo bar",), ("",), ("   spaced   out   ",), ("a b",)], "t string")
    assert [r[0] for r in df.select(tx.word_count(F.col("t"))).collect()] == [4, 0, 2, 2]


def issues_of(spark, html, config=None, **fetch):
    df = spark.createDataFrame([(1, "https://test.local/", html)], "page_id long, url string, html string")
    for k, v in fetch.items():
        df = df.withColumn(k, F.lit(v).cast("long"))
    return [r["rule_id"] for r in rules.evaluate_rules(parse.parse_pages(df), config=config).collect()]


def test_rules(spark):
    found = issues_of(spark, HOME)
    assert {"meta.title_length", "meta.desc_length", "images.alt_missing", "images.alt_empty", "content.thin_content"} <= set(found)
    assert "meta.canonical_mismatch" not in found and "content.h1_missing" not in found
    assert issues_of(spark, HOME, body_size=5_000_000).count("perf.large_page") == 1
    assert issues_of(spark, HOME, body_size=100_000).count("perf.large_page") == 0
    assert issues_of(spark, HOME, response_time_ms=5000).count("perf.slow_response") == 1
    busy = "<title>t</title>" + '<script src="/x.js"></script>' * 5 + '<link rel="stylesheet" href="http://c/s.css">' * 5 + "<h1>a</h1><h1>b</h1><h4>c</h4>"
    found = issues_of(spark, busy)
    assert found.count("perf.render_blocking") == 2 and {"security.mixed_content", "content.h1_multiple", "content.heading_hierarchy"} <= set(found)
    off = {"rules": {"perf.render_blocking": {"enabled": False}, "perf.slow_response": {"params": {"max_ms": 500}}}}
    found = issues_of(spark, busy, off, response_time_ms=1000)
    assert "perf.render_blocking" not in found and "perf.slow_response" in found


def pages_frame(spark, rows):
    return spark.createDataFrame(rows, "crawl_id string, page_id long, url string, depth int, status_code int, title string, meta_desc string, h1 string")


def test_crosspage(spark):
    p = pages_frame(spark, [("c", 1, "https://t/", 0, 200, "Same", None, "a"), ("c", 2, "https://t/b", 1, 410, "Same", "", "b"), ("c", 3, "https://t/c", 1, 200, "Other", "x", "c"), ("c", 4, "https://t/n", 1, None, None, "y", None)])
    ln = spark.createDataFrame([("c", 1, "https://t/b", "b", "a", True, False), ("c", 1, "https://e/", None, "a", False, False)], "crawl_id string, source_page long, target_url string, anchor_text string, link_type string, is_internal boolean, nofollow boolean")
    assert crosspage.duplicate_issues(p, "title").count() == 2 and crosspage.duplicate_issues(p, "meta_desc").count() == 0
    assert [r["page_id"] for r in crosspage.broken_internal(ln, p).collect()] == [1]
    assert sorted(r["page_id"] for r in crosspage.orphan_pages(p, ln).collect()) == [3, 4]
    sm = spark.createDataFrame([("c", "https://t/"), ("c", "https://t/gone"), ("c", "https://t/n"), ("c", "https://t/b")], "crawl_id string, url string")
    assert sorted((r["page_id"], r["url"]) for r in crosspage.sitemap_not_crawled(sm, p).collect()) == [(1, "https://t/gone"), (2, "https://t/b")]
    assert [r["page_id"] for r in crosspage.page_not_in_sitemap(p, sm).collect()] == [3]
    assert crosspage.page_not_in_sitemap(p, sm.filter("false")).count() == 0


def test_duplicate_ids_are_capped(spark):
    p = spark.range(500).selectExpr("'c' as crawl_id", "id as page_id", "concat('https://t/', id) as url", "'T' as title")
    row = crosspage.duplicate_issues(p, "title", cap=100).first()
    assert '"count":500' in row["detail_json"] and row["detail_json"].count(",") < 110


def test_sitemaps(spark):
    body = "<urlset><url><loc>https://t/</loc><lastmod>2026-01-01</lastmod><priority>1.0</priority></url><url><loc> https://t/a?x=1&amp;y=2 </loc><priority>high</priority></url><url><lastmod>no location</lastmod></url><url><loc>https://t/cut"
    docs = spark.createDataFrame([("https://t/s.xml", body)], "url string, body string")
    got = [(r["url"], r["priority"]) for r in sitemaps.sitemap_entries(docs).collect()]
    assert got == [("https://t/", 1.0), ("https://t/a?x=1&y=2", None)]


def test_robots(spark):
    text = "User-agent: *\nDisallow: /admin/\nDisallow: /private/\nAllow: /admin/open\nCrawl-delay: 1\n\nUser-agent: Bot\nDisallow: /admin/\nCrawl-delay: 0.5\nSitemap: https://t/s.xml\n"
    docs = spark.createDataFrame([("t", 200, text), ("u", 404, text)], "host string, status_code int, body string")
    urls = spark.createDataFrame([(u,) for u in ("https://t/", "https://t/admin/x", "https://t/admin/open", "https://t/private/x", "https://u/admin/", "https://none/")], "url string")
    of = lambda agent: {r["url"]: r["allowed"] for r in robots.robots_allowed(urls, robots.robots_rules(docs), agent).collect()}
    assert of("someone") == {"https://t/": True, "https://t/admin/x": False, "https://t/admin/open": True, "https://t/private/x": False, "https://u/admin/": True, "https://none/": True}
    assert of("bot")["https://t/private/x"] and not of("bot")["https://t/admin/open"]
    assert {(r["agent"], r["crawl_delay"]) for r in robots.robots_extras(docs).collect()} == {("*", 1.0), ("bot", 0.5)}


def corpus(spark):
    link = lambda u, nf=False: (u, "x", None, True, nf)
    rows = [(1, "https://t/", 200, [link("https://t/a"), link("https://t/b#f"), link("https://t/no", True)]), (2, "https://t/a", 200, [link("https://t/c/")]), (3, "https://t/b", 200, []), (4, "https://t/c", 200, [link("https://t/d")]), (5, "https://t/d", 404, []), (6, "https://t/no", 200, [])]
    return spark.createDataFrame(rows, f"page_id long, url string, status_code int, links array<{parse.LINK}>")


def test_crawl(spark):
    start = spark.createDataFrame([("https://t/#x",)], "url string")
    go = lambda **kw: sorted((r["page_id"], r["depth"]) for r in frontier.crawl(corpus(spark), frontier.seed(start), CrawlConfig(**kw))[0].collect())
    assert go(max_depth=2) == [(1, 0), (2, 1), (3, 1), (4, 2)]
    assert go() == [(1, 0), (2, 1), (3, 1), (4, 2), (5, 3)]
    assert len(go(max_pages=3)) == 3
    assert go(include=("/a",)) == [(1, 0), (2, 1)]
    assert go(max_depth=1, rewrite=(("/b", "/a"),)) == [(1, 0), (2, 1)]
    rule = spark.createDataFrame([("t", "*", False, "/a", 2)], "host string, agent string, allow boolean, pattern string, pattern_len int")
    assert sorted(r["page_id"] for r in frontier.crawl(corpus(spark), frontier.seed(start), CrawlConfig(), rule)[0].collect()) == [1, 3]


def test_schedule_of_a_large_host(spark):
    """Places equal those of a sort by host, and the rows of one host lie in several tasks."""
    rows = [(f"https://big/{i * 7919 % 3000:04}", 100 - i % 3, i % 2) for i in range(3000)] + [("https://small/b", 100, 0), ("https://small/a", 100, 0), (None, 100, 0)]
    urls = spark.createDataFrame(rows, "url string, priority int, depth int")
    delays = spark.createDataFrame([("small", 2.0)], "host string, crawl_delay double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = frontier.fetch_schedule(urls, 500, delays).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for host, gap in (("big", 500), ("small", 2000), (None, 500)):
        own = sorted((r for r in rows if (r[0] and r[0].split("/")[2]) == host), key=lambda r: (-r[1], r[2], r[0]))
        want |= {r[0]: (k, k * gap, k // 2) for k, r in enumerate(own)}
    assert {r["url"]: (r["place"], r["start_ms"], r["wave"]) for r in out} == want and len(out) == len(rows)
    assert len({r["task"] for r in out if r["host"] == "big"}) > 1


def test_whole_crawl(spark):
    """The crawl from all pages of depth 0 against breadth-first search over the same links."""
    pages = {r["url"]: (r["page_id"], r["depth"], r["links"] or [], r["normal"]) for r in registry._corpus(spark, DATA).withColumn("normal", ur.normalize_url(F.col("url"), True)).collect()}
    own = {}
    for page, _, links, normal in sorted(pages.values(), key=lambda x: x[0]):
        own.setdefault(normal, (page, links))
    allowed = lambda u: "?page=" not in u and ((p := "/" + u.split("/", 3)[-1]).startswith("/en/9") or not p.startswith("/en/"))
    wave, seen, want = {p[3] for p in pages.values() if p[1] == 0}, set(), {}
    for depth in range(11):
        seen |= wave
        got = [u for u in wave if allowed(u) and u in own]
        want |= {own[u][0]: depth for u in got}
        wave = {pages[x["href"]][3] if x["href"] in pages else x["href"] for u in got for x in own[u][1] if x["is_internal"] and not x["is_nofollow"]} - seen
    assert {r["page_id"]: r["depth"] for r in registry.QUERIES["frt13_whole_crawl"](spark, DATA).collect()} == want
    assert registry.QUERIES["frt12_stats"](spark, DATA).first()["dequeued"] == len(want) > 0 and len(set(want.values())) > 1


def test_diff_is_symmetric(spark):
    p = pages_frame(spark, [("a", 1, "u1", 0, 200, "t", None, ""), ("a", 2, "u2", 0, None, "t", "", ""), ("b", 1, "u1", 0, 404, "t2", "", ""), ("b", 3, "u3", 0, 200, "t", "", "")])
    kinds = lambda x, y: sorted((r["url"], r["diff_type"]) for r in diff.page_diffs(p, x, y).collect())
    assert kinds("a", "a") == [] and kinds("a", "b") == [("u1", "status_code_changed"), ("u2", "removed"), ("u3", "new")]
    assert [u for u, k in kinds("a", "b") if k == "new"] == [u for u, k in kinds("b", "a") if k == "removed"]
    assert [r["url"] for r in diff.metadata_diffs(p, "a", "b").collect()] == ["u1"]


def test_fetch_states(spark):
    df = spark.createDataFrame([(None, None), (200, "text/html; charset=utf-8"), (200, "image/png"), (404, "text/html")], "status_code int, content_type string")
    assert [r["state"] for r in sp.page_state(df).collect()] == ["errored", "analyzed", "fetched", "fetched"]


def test_read_only_analyses(spark):
    t = {"some_pages": spark.range(3)}
    assert extend.run_analysis("WITH x AS (SELECT * FROM some_pages) SELECT count(*) AS n FROM x", t).first()["n"] == 3
    for bad in ("DROP TABLE some_pages", "SELECT 1; SELECT 2", "INSERT INTO some_pages VALUES (1)"):
        with pytest.raises(Exception):
            extend.run_analysis(bad, t)


def test_plugin_issue_mapping(spark):
    df = spark.createDataFrame([("r", "fatal", "odd", "m", "{bad"), ("r", "info", "meta", "m", '{"a":1}')], "rule_id string, severity string, category string, message string, detail_json string")
    assert [tuple(r) for r in extend.map_plugin_issues(df, "p").collect()] == [("plugin.p.r", "warning", "structured", "m", None), ("plugin.p.r", "info", "meta", "m", '{"a":1}')]


def test_jsonld(spark):
    tag = lambda x: f'<script type="application/ld+json">{x}</script>'
    df = spark.createDataFrame([(1, "<p>"), (2, tag('{"@context":"c","@type":"t"}')), (3, tag('{"@type":"t"}')), (4, tag('{"@context":"c"}')), (5, tag("{oops"))], "page_id long, html string")
    got = {(r["page_id"], r["rule_id"]) for r in rules.jsonld_rules(df, parse.jsonld_blocks(df)).collect()}
    assert got == {(1, "jsonld.missing_schema"), (3, "jsonld.missing_context"), (4, "jsonld.missing_type"), (5, "jsonld.invalid_json")}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 'a,"b"\n', None, "a", True, False)], "link_id long, source_page long, target_url string, anchor_text string, link_type string, is_internal boolean, nofollow boolean")
    sinks.export_csv(df, "links", f"{tmp_path}/x")
    back = spark.read.csv(f"{tmp_path}/x", header=True, multiLine=True, escape='"').first()
    assert back["targetUrl"].strip() == 'a,"b"' and back["anchorText"] is None


def test_budget(spark):
    df = spark.range(100).selectExpr("'c' as crawl_id", "id as page_id")
    got = sorted(r["page_id"] for r in analysis.budget_cut(df, F.lit(10), 100).collect())
    assert got == list(range(9))


PICKED = """<html><body><div id=top class="a b"><p lang=en-GB>one</p><p class=b>two</p></div><div><ul><li>1</li><li>2</li><li data-x="Hello World">3</li><li>4</li></ul>
<h2>h</h2><span>s</span><p>three</p><p title=y>four</p></div></body></html>"""


@pytest.mark.parametrize(
    ("css", "want"),
    [
        ("div > p", ["one", "two", "three", "four"]), ("#top.a > p", ["one", "two"]), ("div.b p + .b", ["two"]), ("h2 + span", ["s"]), ("h2 ~ p", ["three", "four"]), ("h2 + p", []), ("html > p", []),
        ("li:nth-child(2n+1)", ["1", "3"]), ("li:nth-child(even), h2", ["2", "4", "h"]), ("li:nth-child(-n+2)", ["1", "2"]), ("li:first-child", ["1"]), ("ul li:nth-of-type(4)", ["4"]), ("p:nth-of-type(1)", ["one", "three"]),
        ("[data-x^=hello i]", ["3"]), ("[data-x$='World']", ["3"]), ("[data-x~=World][data-x*='o W']", ["3"]), ("[data-x=World]", []), ("[lang|=en]", ["one"]), ("[title]", ["four"]),
        ("li:not([data-x]):not(:first-child)", ["2", "4"]), (":is(h2, span)", ["h", "s"]), (":root > body > div:nth-child(1) .b", ["two"]),
        ("body *|x", None), ("p >", None), ("> p", None), ("p..b", None), ("li:nth-child(x)", None), ("", None), ("[a", None), ("p:nonsense", None),
    ],
)
def test_selectors(css, want):
    got = parse.parse_html(PICKED, "https://x.example/", "x.example", {"k": selectors.parse(css)})
    assert dict(dict(zip(parse.NAMES, got, strict=True))["custom_extractions"])["k"] == want


@pytest.mark.parametrize(
    ("css", "want"),
    [
        ("li:last-child", ["4"]), ("li:nth-last-child(2)", ["3"]), ("li:nth-last-child(odd)", ["2", "4"]), ("div > :last-child", ["two", "four"]), ("p:last-of-type", ["two", "four"]), ("p:nth-last-of-type(2)", ["one", "three"]),
        ("ul:only-of-type > li:first-child", ["1"]), ("body > :only-child", []), ("div:has(ul) > p", ["three", "four"]), ("div:has(> p.b) > p", ["one", "two"]), ("h2:has(+ span)", ["h"]), ("h2:has(+ p)", []), ("h2:has(~ p[title])", ["h"]),
        ("div:has(h2 ~ p) li:last-child", ["4"]), ("div:not(:has(li)) p", ["one", "two"]), ("div:has(li:nth-last-child(2)[data-x], .zzz) h2", ["h"]), ("li:not(:empty):last-child", ["4"]), (":scope > body > div:last-child > h2", ["h"]),
        ("a:hover", None), ("div:has()", None), ("li:nth-last-child(x)", None), ("li:has(> )", None),
    ],
)
def test_selectors_that_need_later_elements(css, want):
    test_selectors(css, want)


def outline(html):
    """The body as text: an element is its tag and what it holds."""
    page = dom.Tree()
    page.feed(html)
    page.finish()

    def show(node):
        out, at = "", node.start
        for kid in node.kids:
            out += "".join(page.texts[at : kid.start]) + show(kid)
            at = kid.end
        return f"<{node.tag}>{out}{''.join(page.texts[at : node.end])}</>"

    return show(page.body).removeprefix("<body>").removesuffix("</>")


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<h1>A<h2>B</h2>", "<h1>A</><h2>B</>"), ("<h1>A</h3>b", "<h1>A</>b"), ("<a href=1>x<a href=2>y", "<a>x</><a>y</>"), ("<b>1<p>2</b>3</p>4", "<b>1</><p><b>2</>3</>4"),
        ("<b><i>1<p>2</b>3</i>4</p>5", "<b><i>1</></><i></><p><i><b>2</>3</>4</>5"), ("<b>1<div>2<div>3</b>4</div>5</div>6", "<b>1</><div><b>2</><div><b>3</>4</>5</>6"),
        ("<p>a<p>b<div>c</p>d", "<p>a</><p>b</><div>c<p></>d</>"), ("<p><i>a<p>b</i>c", "<p><i>a</></><p><i>b</>c</>"), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "<ul><li>a</><li>b<ul><li>c</></></><li>d</></>"),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", "<table><tbody><tr><td>a</><td>b</></><tr><td>c</></></></>d"), ("<table><td><b>a<td>b</table>", "<table><tbody><tr><td><b>a</></><td>b</></></></>"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</><dd>b</><dt>c</></>"), ("<select><option>1<option>2</select>3", "<select><option>1</><option>2</></>3"), ("<div/>a<br/>b</br>c", "<div>a<br></>b<br></>c</>"),
        ("x</b></i></td>y<body class=q>z</body>w", "xyzw"), ("<svg><path/><g/>t</svg>u", "<svg><path></><g></>t</>u"), ("<svg><g><p>out", "<svg><g></></><p>out</>"), ("<textarea><b>x</b></textarea>y", "<textarea><b>x</b></>y"),
        ("<button>a<button>b", "<button>a</><button>b</>"), ("<form>a<form>b</form>c", "<form>ab</>c"), ("<p><a href=1>t</p><p>u</p>", "<p><a>t</></><p><a>u</></>"), ("<object><b>1</object>2</b>3", "<object><b>1</></>23"),
    ],
)
def test_tree(html, want):
    assert outline(html) == want


@pytest.mark.parametrize(
    "html",
    [
        "<a href=1>x" * 20_000, "<b>" * 20_000 + "x" + "</i>" * 20_000, "<p><b>" * 10_000, "<b><div>" * 10_000 + "</b>" * 10_000, "<ul><li>" * 10_000 + "</div>" * 10_000, "<div>" * 10_000 + "<table><p><td>" * 3_000, "<h1>" * 20_000,
    ],
    ids=["links", "stray ends", "paragraphs", "crossed", "lists", "cells", "headings"],
)
def test_pages_with_many_unclosed_tags(html):
    """Work grows with the page: each takes well under a second here, and would take minutes if every tag walked the stack."""
    began = time.process_time()
    got = dict(zip(parse.NAMES, parse.parse_html(html, "https://x.example/", "x.example", {"k": selectors.parse("div div > p:not(:has(> b))")}), strict=True))
    assert got["parse_ok"] and time.process_time() - began < 6
    if html.startswith("<a"):
        assert len(got["links"]) == 20_000 and {x["anchor_text"] for x in got["links"]} == {"x"}

def test_changed_pages_are_parsed_anew(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    titles = lambda: registry.QUERIES["ext1_7_14_titles"](spark, str(tmp_path)).select("page_id", "title").collect()
    pages.filter("page_id < 20").write.parquet(f"{tmp_path}/pages.parquet")
    assert len(titles()) == 20
    pages.filter("page_id < 7").withColumn("html", F.lit("<title>New</title>")).write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    assert {r["title"] for r in titles()} == {"New"} and len(titles()) == 7


def test_rule_parameters_one_by_one(spark):
    """Known parameters count beside unknown ones; an error inside a rule is not taken for an unknown parameter."""
    html = "<title>t</title><body>" + "word " * 100
    config = lambda **p: {"rules": {"content.thin_content": {"params": p}}}
    assert "content.thin_content" in issues_of(spark, html)
    assert "content.thin_content" not in issues_of(spark, html, config(min_words=50))
    assert "content.thin_content" not in issues_of(spark, html, config(min_words=50, unknown=1))
    assert "content.thin_content" in issues_of(spark, html, config(unknown=1))

    def broken(min_words=1):
        raise TypeError("inside")

    df = spark.createDataFrame([(1, "https://test.local/", html)], "page_id long, url string, html string")
    with pytest.raises(TypeError, match="inside"):
        rules.evaluate_rules(parse.parse_pages(df), (rules.Rule("x.y", "n", "content", "info", broken),), {"rules": {"x.y": {"params": {"min_words": 2}}}})


def test_text_cut_at_a_word_that_ends_the_limit():
    """A word that ends at the last byte stays only if nothing follows it."""
    assert parse.cut_text("a" * 7990 + " " + "b" * 9) == "a" * 7990 + " " + "b" * 9
    assert parse.cut_text("a" * 7990 + " " + "b" * 9 + " c") == "a" * 7990
    assert parse.cut_text("a" * 7990 + " " + "b" * 8 + " c") == "a" * 7990 + " " + "b" * 8


class Counting(extend.GroupRule):
    def __init__(self):
        self.seen, self.batches = [], 0

    def pages(self, batch):
        self.seen += batch.column("page_id").to_pylist()
        self.batches += 1
        return [(i, "odd", "info", "content", "m", None) for i in batch.column("page_id").to_pylist() if i % 2]

    def end(self):
        yield len(self.seen), "end", "info", "content", f"{self.seen == sorted(self.seen)} {self.batches}", None


def test_rules_over_groups(spark):
    """A group passes in batches and in order; tables without the columns are refused when the plan is made."""
    df = spark.range(1000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("host")).repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = extend.run_group_rule(df, Counting, ["host"], ["page_id"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    ends = {r["page_id"]: r["message"] for r in got if r["rule_id"] == "end"}
    assert set(ends) == {334, 666} and all(m.startswith("True") for m in ends.values()) and sum(r["rule_id"] == "odd" for r in got) == 500
    assert extend.run_group_rule(df.limit(0), Counting, ["host"], ["page_id"]).collect() == []
    with pytest.raises(Exception, match="needs a table with host"):
        extend.run_group_rule(df.drop("host"), Counting, ["host"], ["page_id"]).collect()
