"""The one pass over HTML: each page becomes a wide nested record."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlspan.functions.urls import resolve
from crawlspan.operators import selectors as css
from crawlspan.operators.dom import HEADINGS, Node, Tree
from crawlspan.operators.selectors import Matcher

#: Bytes of body text that are kept.
BODY_BYTES = 8000
#: Pages and bytes of an Arrow batch that a task reads at most, and pages whose records it holds at once.
ARROW_ROWS, ARROW_BYTES, HELD = 256, 4 << 20, 64
LINK = "struct<href:string,anchor_text:string,rel:string,is_internal:boolean,is_nofollow:boolean>"
IMAGE = "struct<src:string,alt:string,has_srcset:boolean>"
PARSED = (
    "title string, meta_description string, meta_robots string, canonical string, viewport string, base_url string, "
    + ", ".join(f"h{i}s array<string>" for i in range(1, 7))
    + f", links array<{LINK}>, images array<{IMAGE}>, scripts array<string>, stylesheets array<string>, "
    "render_blocking_scripts int, render_blocking_stylesheets int, word_count int, body_text string, jsonld array<string>, custom_extractions map<string,array<string>>, parse_ok boolean"
)
NAMES = [x.strip().split(" ")[0] for x in PARSED.replace(LINK, "x").replace(IMAGE, "x").replace("map<string,array<string>>", "x").split(",")]


def cut_text(text: str, most: int = BODY_BYTES) -> str | None:
    """White space made single; at most ``most`` bytes, cut before the word that goes over, or inside a lone long one."""
    t = " ".join(text.split())
    data = t.encode("utf-8", "surrogatepass")
    if len(data) > most:
        t = data[:most].decode("utf-8", "ignore")
        t = t.rsplit(" ", 1)[0] if " " in t else t
    return t or None


class _Page(Tree):
    """Collects what tags alone tell while they go by, and reads titles, headings, links and texts off the whole tree."""

    def __init__(self, url: str, root: str) -> None:
        super().__init__()
        self.url, self.domain, self.base = url, root, None
        self.meta: dict[str, str | None] = {}
        self.images, self.scripts, self.styles = [], [], []
        self.canonical, self.block_scripts, self.block_styles = None, 0, 0

    def resolved(self, href: str | None) -> str | None:
        return resolve(resolve(self.url, self.base) if self.base else self.url, href)

    def seen(self, tag, attrs):
        rel = attrs.get("rel", "").lower()
        if tag == "meta" and "name" in attrs and "content" in attrs:
            self.meta[attrs["name"].lower()] = attrs["content"]
        elif tag == "base" and attrs.get("href"):
            self.base = attrs["href"]
        elif tag == "link" and "href" in attrs:
            if rel == "canonical":
                self.canonical = self.resolved(attrs["href"]) or self.canonical
            if "stylesheet" in rel:
                if u := self.resolved(attrs["href"]):
                    self.styles.append(u)
                self.block_styles += attrs.get("media", "").lower() in ("", "all")
        elif tag == "script" and attrs.get("src"):
            if u := self.resolved(attrs["src"]):
                self.scripts.append(u)
            self.block_scripts += not ("async" in attrs or "defer" in attrs or attrs.get("type", "").lower() == "module")
        elif tag == "img" and "src" in attrs:
            self.images.append((self.resolved(attrs["src"]) or attrs["src"], attrs.get("alt"), "srcset" in attrs))

    def _link(self, node: Node) -> tuple | None:
        u = self.resolved(node.attrs["href"])
        if not u:
            return None
        host, rel = (urlsplit(u).hostname or "").lower(), node.attrs.get("rel")
        return u, self.text(node).strip() or None, rel, bool(host) and (host == self.domain or host.endswith("." + self.domain)), "nofollow" in (rel or "").lower()

    def record(self, selectors: dict) -> tuple:
        title, heads, links, jsonld = None, {h: [] for h in HEADINGS}, [], []
        for node in self.walk():
            if node.tag in heads and (text := self.text(node).strip()):
                heads[node.tag].append(text)
            elif node.tag == "a" and "href" in node.attrs and (link := self._link(node)):
                links.append(link)
            elif node.tag == "title" and title is None:
                title = self.text(node).strip()
            elif node.tag == "script" and node.attrs.get("type", "").lower() == "application/ld+json":
                jsonld.append(self.text(node).strip())
        matcher = Matcher(self) if any(selectors.values()) else None
        picked = [(k, None if v is None else [t for n in matcher.select(v) if (t := self.text(n).strip())]) for k, v in selectors.items()]
        body = self.text(self.body)
        return (
            title or None, self.meta.get("description"), self.meta.get("robots"), self.canonical, self.meta.get("viewport"), self.base, *heads.values(),
            [dict(zip(("href", "anchor_text", "rel", "is_internal", "is_nofollow"), x, strict=True)) for x in links],
            [dict(zip(("src", "alt", "has_srcset"), x, strict=True)) for x in self.images],
            self.scripts, self.styles, self.block_scripts, self.block_styles, len(body.split()), cut_text(body), jsonld, picked, True,
        )


_BARE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1|\Z)|&(?=#?[0-9a-z]+(?![0-9a-z;]))", re.I | re.S)


def bare_as_text(html: str) -> str:
    """``html`` with the ampersands of character references that no semicolon ends as plain text."""
    return _BARE.sub(lambda m: "&amp;" if m[0] == "&" else m[0], html)


def parse_html(html: str | None, url: str, root: str, selectors: dict | None = None, bare_references: bool = True) -> tuple:
    page = _Page(url or "", root or "")
    try:
        page.feed((html or "") if bare_references else bare_as_text(html or ""))
        page.finish()
        return page.record(selectors or {})
    except (AssertionError, ValueError):  # what the tokenizer raises for broken declarations: a row with parse_ok = false
        return (None,) * 6 + ([],) * 10 + (0, 0, 0, None, [], [], False)


def _parse(batches: Iterator[pa.RecordBatch], schema: pa.Schema, keep: int, root: str | None, selectors: dict, bare_references: bool = True) -> Iterator[pa.RecordBatch]:
    chosen = {k: css.parse(v) for k, v in selectors.items()}

    def host(u):
        try:
            return (urlsplit(u or "").hostname or "").lower()
        except ValueError:
            return ""

    for b in (batch.slice(i, HELD) for batch in batches for i in range(0, batch.num_rows, HELD)):
        rows = [parse_html(h, u, root or host(u), chosen, bare_references) for h, u in zip(b.column(keep).to_pylist(), b.column(keep + 1).to_pylist(), strict=True)]
        cols = list(zip(*rows, strict=True)) or [()] * (len(schema) - keep)
        yield pa.RecordBatch.from_arrays([*b.columns[:keep], *(pa.array(c, schema.field(keep + i).type) for i, c in enumerate(cols))], schema=schema)


def _small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, so that a task's memory doesn't grow with its partition; smaller bounds stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        own = spark.conf.get(key).rstrip("b")
        if not own.isdigit() or not 0 < int(own) < most:
            spark.conf.set(key, str(most))


def parse_pages(pages: DataFrame, root_domain: str | None = None, selectors: dict[str, str] | None = None, html: str = "html", url: str = "url", bare_references: bool = True) -> DataFrame:
    """``pages`` without the HTML, with the parsed record; links are internal to ``root_domain`` or to the page's own host.

    ``selectors`` picks texts by label (see :mod:`crawlspan.operators.selectors`): one that is no selector gives NULL.
    ``bare_references``: a character reference that no semicolon ends (``&amp`` at a cut) is read as the HTML standard reads
    it; else it stays as it is written.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = pages.sparkSession
    _small_batches(spark)
    keep = [c for c in pages.columns if c != html]
    final = F.coalesce(F.col("final_url"), F.col(url)) if "final_url" in pages.columns else F.col(url)
    source = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(html).alias("__html"), final.alias("__url"))
    out = spark.createDataFrame([], PARSED).schema
    schema = type(out)([*pages.select(*[F.col(f"`{c}`") for c in keep]).schema.fields, *out.fields])
    return source.mapInArrow(partial(_parse, schema=to_arrow_schema(schema), keep=len(keep), root=root_domain, selectors=selectors or {}, bare_references=bare_references), schema)


def links_table(parsed: DataFrame) -> DataFrame:
    """One row for each reference of a page: anchors, images, scripts, stylesheets, the canonical, redirect hops."""
    none = F.lit(None).cast("string")
    no, row = F.lit(False), lambda target, kind, text, internal, nofollow: F.struct(target.alias("target_url"), F.lit(kind).alias("link_type"), text.alias("anchor_text"), internal.alias("is_internal"), nofollow.alias("nofollow"))
    refs = [
        F.transform("links", lambda x: row(x["href"], "a", x["anchor_text"], x["is_internal"], x["is_nofollow"])),
        F.transform("images", lambda x: row(x["src"], "img", x["alt"], no, no)),
        F.transform("scripts", lambda x: row(x, "script", none, no, no)),
        F.transform("stylesheets", lambda x: row(x, "link", none, no, no)),
        F.when(F.col("canonical").isNotNull(), F.array(row(F.col("canonical"), "canonical", none, no, no))).otherwise(F.array()),
    ]
    if "redirect_chain" in parsed.columns:
        refs.append(F.transform(F.coalesce("redirect_chain", F.array()), lambda x: row(x["url"], "redirect", none, no, no)))
    keys = [c for c in ("crawl_id", "page_id", "url") if c in parsed.columns]
    return parsed.select(*keys, F.inline(F.concat(*refs))).withColumnRenamed("page_id", "source_page")


def images_table(links: DataFrame) -> DataFrame:
    return links.filter("link_type = 'img'")


def headings_table(parsed: DataFrame) -> DataFrame:
    """(page_id, level, place, text) of all headings."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"h{i}s").alias("texts")) for i in range(1, 7)]))
    return parsed.select("page_id", each.alias("h")).select("page_id", "h.level", F.posexplode("h.texts").alias("place", "heading"))


def h1_first() -> F.Column:
    return F.try_element_at("h1s", F.lit(1))


def js_candidates(parsed: DataFrame, always: list[str] | None = None, never: list[str] | None = None, few_words: int = 50, scripts: int = 2) -> DataFrame:
    """``js_candidate``: a never pattern vetoes, an always pattern forces, else fewer than ``few_words`` words and ``scripts``
    scripts or more."""
    hit = lambda ps: F.lit(False) if not ps else F.col("url").rlike("|".join(f"(?:{p})" for p in ps))
    return parsed.withColumn("js_candidate", ~hit(never) & (hit(always) | ((F.col("word_count") < few_words) & (F.size("scripts") >= scripts))))


def jsonld_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, block) of structured data scripts, straight from the source."""
    pattern = r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
    return pages.select("page_id", F.explode(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))).alias("block"))
