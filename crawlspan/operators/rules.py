"""Audit rules as columns over the parsed page: each gives an array of issues, all are inlined in one pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from inspect import signature

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlspan.model import SEVERITIES
from crawlspan.sources.pages import is_html_page

ISSUE = "struct<rule_id:string,severity:string,category:string,message:string,detail_json:string>"


@dataclass(frozen=True)
class Rule:
    """A rule: ``fn(**params)`` gives a list of (condition, message, detail or None)."""

    id: str
    name: str
    category: str
    severity: str
    fn: Callable[..., list[tuple[Column, Column | str, Column | None]]]


def _json(**cols: Column) -> Column:
    return F.to_json(F.struct(*[cols[k].alias(k) for k in sorted(cols)]))


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def _c(n: str) -> Column:
    return F.col(n)


def _empty(c: str) -> Column:
    return F.coalesce(_c(c), F.lit("")) == ""


def _length(c: str, what: str, low: int, high: int):
    n = F.char_length(c)
    detail = _json(length=n, min=F.lit(low), max=F.lit(high))
    return [
        (n < low, _say(what, " is too short (", n.cast("string"), f" chars, minimum {low} recommended)."), detail),
        (n > high, _say(what, " is too long (", n.cast("string"), f" chars, maximum {high} recommended)."), detail),
    ]


def _hierarchy():
    levels = F.filter(F.array(*[F.when(F.size(f"h{i}s") > 0, F.lit(i)) for i in range(1, 7)]), lambda x: x.isNotNull())
    before = F.concat(F.array(F.lit(1)), F.slice(levels, F.lit(1), F.greatest(F.size(levels) - 1, F.lit(0))))
    steps = F.filter(F.zip_with(before, levels, lambda a, b: F.when(b - a > 1, F.concat(F.lit("H"), a.cast("string"), F.lit(" to H"), b.cast("string")))), lambda x: x.isNotNull())
    return [(F.size(steps) > 0, _say("Heading levels skipped: ", F.array_join(steps, ", "), "."), None)]


def _some(items: Column, say: Callable[[Column], Column], **detail: Column):
    return [(F.size(items) > 0, say(F.size(items).cast("string")), _json(**detail))]


def _nofollow():
    hit = F.filter("links", lambda x: x["is_internal"] & x["is_nofollow"])
    return _some(hit, lambda n: _say(n, ' internal link(s) have rel="nofollow".'), links=F.transform(hit, lambda x: x["href"]))


def _alt_missing():
    hit = F.filter("images", lambda x: x["alt"].isNull())
    return _some(hit, lambda n: _say(n, " image(s) missing alt attribute."), images=F.transform(hit, lambda x: x["src"]))


def _alt_empty():
    hit = F.filter("images", lambda x: x["alt"] == "")
    return _some(hit, lambda n: _say(n, " image(s) have empty alt attribute (may be decorative)."), images=F.transform(hit, lambda x: x["src"]))


def _blocking(max_blocking_scripts: int = 2, max_blocking_stylesheets: int = 3):
    out = []
    for col, kind, what, most in (
        ("render_blocking_scripts", "scripts", "render-blocking scripts (without async/defer)", max_blocking_scripts),
        ("render_blocking_stylesheets", "stylesheets", "render-blocking stylesheets (without media query)", max_blocking_stylesheets),
    ):
        out.append((_c(col) > most, _say("Page has ", _c(col).cast("string"), f" {what}, exceeds {most} threshold."), _json(count=_c(col), threshold=F.lit(most), type=F.lit(kind))))
    return out


def _large(max_bytes: int = 3_000_000):
    mb = F.bround(_c("body_size") / 1_000_000, 1).cast("decimal(20,1)").cast("string")
    return [(_c("body_size") > max_bytes, _say("Page size is ", _c("body_size").cast("string"), " bytes (", mb, f" MB), exceeds {max_bytes} byte threshold."), _json(body_size=_c("body_size"), threshold=F.lit(max_bytes)))]


def _slow(max_ms: int = 3000):
    return [(_c("response_time_ms") > max_ms, _say("Response time is ", _c("response_time_ms").cast("string"), f"ms, exceeds {max_ms}ms threshold."), _json(response_time_ms=_c("response_time_ms"), threshold_ms=F.lit(max_ms)))]


def _mixed():
    hit = F.filter(F.concat("scripts", "stylesheets", F.transform("images", lambda x: x["src"])), lambda x: x.startswith("http://"))
    say = _say("HTTPS page loads ", F.size(hit).cast("string"), " HTTP resource(s).")
    return [(_final().startswith("https://") & (F.size(hit) > 0), say, _json(http_resources=hit))]


def _thin(min_words: int = 200):
    return [(_c("word_count").between(1, min_words - 1), _say("Page has thin content (", _c("word_count").cast("string"), f" words, minimum {min_words} recommended)."), _json(word_count=_c("word_count"), min_words=F.lit(min_words)))]


def _final() -> Column:
    return F.coalesce(_c("final_url"), _c("url"))


def _chain(min_hops: int | None = None):
    if min_hops is None:
        return []
    n = F.size(F.coalesce("redirect_chain", F.array().cast("array<struct<url:string,status_code:int>>")))
    return [(n >= min_hops, _say("Page was reached over ", n.cast("string"), " redirects."), _json(hops=n))]


#: In the order in which issues of a page come.
BUILTIN = (
    Rule("meta.title_missing", "Missing title", "meta", "error", lambda: [(_empty("title"), "Page is missing a <title> tag.", None)]),
    Rule("meta.title_length", "Title length", "meta", "warning", lambda min=30, max=60: _length("title", "Title", min, max)),
    Rule("meta.desc_missing", "Missing description", "meta", "warning", lambda: [(_empty("meta_description"), "Page is missing a meta description.", None)]),
    Rule("meta.desc_length", "Description length", "meta", "warning", lambda min=50, max=160: _length("meta_description", "Meta description", min, max)),
    Rule("meta.canonical_missing", "Missing canonical", "meta", "warning", lambda: [(~F.contains(F.lower(F.coalesce("meta_robots", F.lit(""))), F.lit("noindex")) & _c("canonical").isNull(), "Indexable page is missing a canonical tag.", None)]),
    Rule("meta.canonical_mismatch", "Canonical mismatch", "meta", "info", lambda: [(_c("canonical") != _final(), _say("Canonical URL (", F.coalesce("canonical", F.lit("")), ") differs from page URL."), _json(canonical=_c("canonical"), page_url=_final()))]),
    Rule("meta.viewport_missing", "Missing viewport", "meta", "warning", lambda: [(_c("viewport").isNull(), "Page is missing a viewport meta tag (affects mobile rendering).", None)]),
    Rule("content.h1_missing", "Missing H1", "content", "warning", lambda: [(F.size("h1s") == 0, "Page has no H1 tag.", None)]),
    Rule("content.h1_multiple", "Multiple H1", "content", "warning", lambda: [(F.size("h1s") > 1, _say("Page has ", F.size("h1s").cast("string"), " H1 tags (expected 1)."), _json(h1s=_c("h1s")))]),
    Rule("content.heading_hierarchy", "Heading hierarchy", "content", "info", _hierarchy),
    Rule("content.thin_content", "Thin content", "content", "warning", _thin),
    Rule("links.broken_internal", "Broken internal link", "links", "error", lambda: []),  # found across pages
    Rule("links.redirect_chain", "Redirect chain", "links", "warning", _chain),
    Rule("links.nofollow_internal", "Internal nofollow", "links", "info", _nofollow),
    Rule("images.alt_missing", "Missing alt", "images", "warning", _alt_missing),
    Rule("images.alt_empty", "Empty alt", "images", "info", _alt_empty),
    Rule("perf.large_page", "Large page", "performance", "warning", _large),
    Rule("perf.slow_response", "Slow response", "performance", "warning", _slow),
    Rule("perf.render_blocking", "Render blocking", "performance", "warning", _blocking),
    Rule("security.mixed_content", "Mixed content", "security", "error", _mixed),
    Rule("security.http_page", "HTTP page", "security", "warning", lambda: [(_final().startswith("http://"), "Page is served over HTTP instead of HTTPS.", None)]),
)
_custom: dict[str, Rule] = {}


def register_rule(id: str, name: str, category: str, severity: str, fn: Callable[..., list]) -> Rule:
    """Adds a user's rule to those that :func:`evaluate_rules` runs."""
    if severity not in SEVERITIES:
        raise ValueError(f"unknown severity {severity}")
    _custom[id] = rule = Rule(id, name, category, severity, fn)
    return rule


def all_rules() -> tuple[Rule, ...]:
    return (*BUILTIN, *_custom.values())


def evaluate_rules(parsed: DataFrame, rules: tuple[Rule, ...] | None = None, config: dict | None = None, html_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each issue: the page's keys, the columns ``keep`` of it, rule_order, ordinal and the issue.

    ``config``: {"rules": {id: {"enabled", "severity", "params"}}}; unknown parameters are ignored.
    """
    settings = (config or {}).get("rules", {})
    for name, kind in (("final_url", "string"), ("body_size", "long"), ("response_time_ms", "long"), ("redirect_chain", "array<struct<url:string,status_code:int>>")):
        if name not in parsed.columns:
            parsed = parsed.withColumn(name, F.lit(None).cast(kind))
    if html_only:
        parsed = parsed.filter(is_html_page())
    found = []
    for order, rule in enumerate(rules or all_rules()):
        own = settings.get(rule.id, {})
        if own.get("enabled") is False:
            continue
        known = signature(rule.fn).parameters
        open_ended = any(p.kind is p.VAR_KEYWORD for p in known.values())
        issues = rule.fn(**{k: v for k, v in (own.get("params") or {}).items() if open_ended or k in known})
        severity = own.get("severity") or rule.severity
        for cond, message, detail in issues:
            issue = F.struct(
                F.lit(rule.id).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(rule.category).alias("category"), (message if isinstance(message, Column) else F.lit(message)).alias("message"),
                (F.lit(None).cast("string") if detail is None else detail).alias("detail_json"), F.lit(order).alias("rule_order"),
            )
            found.append(F.when(F.coalesce(cond, F.lit(False)), issue))
    keys = [c for c in ("crawl_id", "page_id", "url") if c in parsed.columns]
    return parsed.select(*keys, *keep, F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


def rule_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r.id, r.name, r.category, r.severity) for r in all_rules()], "rule_id string, name string, category string, default_severity string")


def jsonld_rules(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Structured data issues: none at all, not JSON, no @context, no @type."""
    checked = blocks.withColumn("ok", F.try_parse_json("block").isNotNull())
    has = lambda k: F.get_json_object("block", f"$['{k}']").isNotNull()
    bad = checked.select(
        "page_id",
        F.when(~F.col("ok"), F.array(F.struct(F.lit("jsonld.invalid_json").alias("rule_id"), F.lit("error").alias("severity"), F.lit("JSON-LD block is not valid JSON.").alias("message"))))
        .otherwise(
            F.filter(
                F.array(
                    F.when(~has("@context"), F.struct(F.lit("jsonld.missing_context").alias("rule_id"), F.lit("warning").alias("severity"), F.lit("JSON-LD block has no @context.").alias("message"))),
                    F.when(~has("@type"), F.struct(F.lit("jsonld.missing_type").alias("rule_id"), F.lit("warning").alias("severity"), F.lit("JSON-LD block has no @type.").alias("message"))),
                ),
                lambda x: x.isNotNull(),
            )
        )
        .alias("issues"),
    ).select("page_id", F.inline("issues"))
    none = pages.join(blocks.select("page_id").distinct(), "page_id", "left_anti").select("page_id", F.lit("jsonld.missing_schema").alias("rule_id"), F.lit("info").alias("severity"), F.lit("Page has no JSON-LD structured data.").alias("message"))
    return bad.unionByName(none)
