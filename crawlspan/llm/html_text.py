"""Main text of HTML pages by a tree-structured graphical model over the DOM.

Every element is a binary variable, content or not. A logistic potential looks at the element itself (kind of tag, words in
its class, id and role, amounts of text and links), a pair potential ties each element to its parent. Sum-product messages go
from the leaves to the root and back, which gives each element's exact marginal; text directly inside elements of marginal
one half or more is the page's text.

Both potentials are trained from labelled pages: a bounded, hash-ordered sample (MOST_PAGES of less than LONGEST_PAGE characters)
of pages that mark their main text themselves with one ``article`` or ``main`` element. What lies inside it, but for navigation, forms, notices and the
like, is labelled content. Scripts, styles and other parts that hold no page text never enter the tree.

Defined cases: a null or empty page gives an empty text; unclosed, wrongly nested and cut-off markup is repaired as it
comes; without labelled pages fixed starting weights are used; a null id stays null; repeated rows each give a row; an empty
table gives none; other columns, whatever their names, are ignored. Work grows with the page, whatever stays unclosed.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspan.llm.common import small_batches

#: The bound of the training sample: pages, and characters of a page (longer pages are extracted, not learnt from).
MOST_PAGES, LONGEST_PAGE = 1500, 1_000_000
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style noscript template iframe svg annotation annotation-xml select datalist head title textarea".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Open elements that a start tag ends.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: How far up an implied end may reach.
WALLS = frozenset("table ul ol dl div article section aside main body html nav header footer form blockquote td th".split())
FURNITURE = frozenset("nav aside footer header form button dialog menu search label input fieldset".split())
MAIN = frozenset(("article", "main"))
PROSE = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 td".split())
BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|foot\w*|head(?:er)?|login|masthead|menu|modal|nav\w*|newsletter|notice|pagers?|pagination|popup|promo\w*|recommend\w*|related|replies|reply|respond|search|share|sharing|side\w*|signup|skip|social|sponsor\w*|subscribe|tags?|toolbar|topbar|widget|warning|alert|gdpr|overlay)(?=$|[\s_-]|\d)",
    re.I,
)
GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content|entry|main|page|post|story|text|prose|blog)(?=$|[\s_-]|\d)", re.I)
ROLES_BAD = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar alert status".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|rel|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: The end tags of SKIPPED; a longer name (``header``) is another tag.
_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I | re.A) for name in SKIPPED}
_SPACE = re.compile(r"\s+")
_HEADER_WORD = re.compile(r"(?i)(?<![^\s_-])head(?:er)?(?![^\s_-])")
#: Pair potential and weights before training: like follows like.
START_PAIR = (0.93, 0.80)
#: Features of furniture; what they hold is furniture too, unless it is the main element.
BADS = frozenset((3, 4, 6, 7))
FEATURES = ("bias", "main tag", "prose tag", "furniture tag", "bad name", "good name", "bad role", "hidden", "inline", "list", "div", "text", "long text", "longer text", "much linked", "some linked", "no text", "stops", "above main", "is link", "inside furniture")
START = (-0.5, 3.0, 1.5, -4.0, -3.5, 0.8, -4.0, -4.0, 0.0, -0.3, -0.3, 0.0, 0.6, 1.0, -2.0, -0.5, -0.2, 0.4, -1.5, -0.3, -6.0)


class Dom:
    """Elements in page order: parent, tag, attributes; and the text pieces with their elements."""

    def __init__(self, html: str | None) -> None:
        self.parent, self.tag, self.attrs = [-1], ["#root"], [""]
        self.pieces: list[tuple[int, str]] = []  # (element, text); a negative element -1 - e is a break at block e
        self.stack = [0]
        self.places: dict[str, list[int]] = defaultdict(list)  # where open elements stand on the stack, by tag
        self.walls: list[int] = []
        text, at = html or "", 0
        endless: set[str] = set()  # names with no end tag in the rest
        for m in iter(lambda: _TOKEN.search(text, at), None):
            if m.start() > at:
                self.pieces.append((self.stack[-1], text[at : m.start()]))
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, closing = name.lower(), m[1] or m[4]
            if closing:
                if self.places.get(name):
                    self._cut(self.places[name][-1])
                if name in BLOCKS:
                    self.pieces.append((-1, ""))
                continue
            if name in SKIPPED:
                found = None if name in endless else _END[name].search(text, at)
                end = found.start() if found else -1
                if end < 0:
                    endless.add(name)
                if name == "head" and end < 0:
                    continue
                at = len(text) if end < 0 and name in ("script", "style") else at if end < 0 else (text.find(">", end) + 1 or len(text))
                continue
            if name == "p" or name in BLOCKS and name not in ENDS:
                self._end(("p",))
            elif name in ENDS:
                self._end(ENDS[name])
            if name in BLOCKS:
                self.pieces.append((-1, ""))
            if name in VOID:
                if name in ("br", "hr"):
                    self.pieces.append((self.stack[-1], " "))
                continue
            self.parent.append(self.stack[-1])
            self.tag.append(name)
            self.attrs.append(m[3] or m[6] or "")
            if not (m[0].endswith("/>") and name not in BLOCKS):
                self.places[name].append(len(self.stack))
                if name in WALLS:
                    self.walls.append(len(self.stack))
                self.stack.append(len(self.tag) - 1)
        if at < len(text):
            self.pieces.append((self.stack[-1], text[at:]))
        self.in_main = [False] * len(self.tag)  # below an article or main element
        for i in range(1, len(self.tag)):
            self.in_main[i] = self.in_main[self.parent[i]] or self.tag[self.parent[i]] in MAIN

    def _cut(self, place: int) -> None:
        """Ends the element at ``place`` of the stack and all above it."""
        while len(self.stack) > place:
            name = self.tag[self.stack.pop()]
            self.places[name].pop()
            if name in WALLS:
                self.walls.pop()

    def _end(self, names: tuple[str, ...]) -> None:
        """Ends the nearest open element of these names, unless a wall stands before it."""
        place = max((self.places[n][-1] for n in names if self.places.get(n)), default=0)
        if place and place >= (self.walls[-1] if self.walls else 0):
            self._cut(place)

    def measures(self) -> list[list[int]]:
        """Active feature numbers of each element."""
        n = len(self.tag)
        own, linked, stops = [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[self.parent[i]] or self.tag[i] in ("a", "button")
        for e, t in self.pieces:
            if e >= 0 and (k := len(t.strip())):
                own[e] += k
                linked[e] += k * in_link[e]
                stops[e] += t.count(".") + t.count(",")
        whole, whole_linked, has_main = own[:], linked[:], [t in MAIN for t in self.tag]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            whole[p] += whole[i]
            whole_linked[p] += whole_linked[i]
            has_main[p] = has_main[p] or has_main[i]
        out: list[list[int]] = []
        inside = [False] * n
        for i, t in enumerate(self.tag):
            f = [0]
            if i and (inside[self.parent[i]] or not has_main[self.parent[i]] and not BADS.isdisjoint(out[self.parent[i]])):
                inside[i] = True
                f.append(20)
            if t in MAIN:
                f.append(1)
            elif has_main[i]:
                f.append(18)
            if t in PROSE:
                f.append(2)
            elif t in FURNITURE and not self._own_header(i):
                f.append(3)
            elif t in ("ul", "ol", "li", "dl", "table", "tr", "tbody"):
                f.append(9)
            elif t in ("div", "section", "header", "#root", "html", "body"):
                f.append(10)
            elif t not in BLOCKS:
                f.append(8)
            if t == "a":
                f.append(19)
            if self.attrs[i]:
                found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(self.attrs[i])}
                names = self._names(i, f"{found.get('class', '')} {found.get('id', '')}")
                role = found.get("role", "").lower()
                if BAD.search(names):
                    f.append(4)
                if GOOD.search(names) or role in MAIN or "articleBody" in found.get("itemprop", ""):
                    f.append(5)
                if role in ROLES_BAD:
                    f.append(6)
                if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
                    f.append(7)
            if whole[i]:
                share = whole_linked[i] / whole[i]
                f += [15] * (0.1 < share <= 0.5) + [14] * (share > 0.5)
                f += [11] * (own[i] > 0) + [12] * (own[i] > 80) + [13] * (own[i] > 300) + [17] * (stops[i] > 1)
            else:
                f.append(16)
            out.append(f)
        return out

    def labels(self) -> list[int] | None:
        """Content as the page itself marks it, if it does so once."""
        tops = [i for i, t in enumerate(self.tag) if t in MAIN and not self.in_main[i]]
        if len(tops) != 1:
            return None
        y = [0] * len(self.tag)
        y[tops[0]] = 1
        for i in range(tops[0] + 1, len(self.tag)):
            names = " ".join(x or y or z for n, x, y, z in _ATTR.findall(self.attrs[i]) if n.lower() in ("class", "id")) if self.attrs[i] else ""
            bad = self.tag[i] in FURNITURE and not self._own_header(i) or BAD.search(self._names(i, names))
            y[i] = int(bool(y[self.parent[i]] and not bad))
        return y

    def _own_header(self, i: int) -> bool:
        """The header of an article itself, which holds its title; the model judges it by what is in it."""
        return self.tag[i] == "header" and self.in_main[i]

    def _names(self, i: int, names: str) -> str:
        return _HEADER_WORD.sub(" ", names) if self._own_header(i) else names

    def text(self, chosen: list[bool]) -> str:
        """Chosen text, white space single inside blocks, blocks by line."""
        blocks: list[list[str]] = [[]]
        for e, t in self.pieces:
            if e < 0:
                if blocks[-1]:
                    blocks.append([])
            elif chosen[e]:
                blocks[-1].append(t)
        lines = (_SPACE.sub(" ", entities.unescape("".join(b))).strip() for b in blocks)
        return "\n".join(x for x in lines if x)


def marginals(parent: list[int], unary: list[float], pair: tuple[float, float]) -> list[float]:
    """P(content) of each element by sum-product. ``unary``: log odds; ``pair``: P(child is as its parent | parent is
    content), and the same for a parent that isn't. Parents come before their children."""
    n = len(parent)
    stay1, stay0 = pair
    up = [0.0] * n  # log odds that an element has from its subtree
    to_parent = [0.0] * n
    up[:] = unary
    for i in range(n - 1, 0, -1):
        o = math.exp(min(30.0, max(-30.0, up[i])))
        m = math.log((stay1 * o + 1 - stay1) / ((1 - stay0) * o + stay0))
        to_parent[i] = m
        up[parent[i]] += m
    full = up[:]
    for i in range(1, n):
        p = parent[i]
        o = math.exp(min(30.0, max(-30.0, full[p] - to_parent[i])))  # the parent without this child
        full[i] = up[i] + math.log((stay1 * o + 1 - stay0) / ((1 - stay1) * o + stay0))
    return [1 / (1 + math.exp(-min(30.0, max(-30.0, x)))) for x in full]


def fit_pages(pages: list[str]) -> tuple[list[float], tuple[float, float]]:
    """Weights and pair potential from pages that mark their text.

    The unary weights are regularised toward their starting values, so that features which no labelled page shows keep
    their meaning; equal feature sets are counted together.
    """
    seen: Counter = Counter()
    pairs = np.ones((2, 2))
    for page in pages:
        dom = Dom(page)
        y = dom.labels()
        if y is None:
            continue
        for f, label in zip(dom.measures(), y, strict=True):
            seen[tuple(sorted(set(f))), label] += 1
        for i in range(1, len(y)):
            if dom.tag[i] not in MAIN:  # the tag itself explains that step
                pairs[y[dom.parent[i]], y[i]] += 1
    start = np.array(START)
    if len({label for _, label in seen}) < 2:
        return START, START_PAIR
    x = np.zeros((len(seen), len(FEATURES)))
    for k, (f, _) in enumerate(seen):
        x[k, list(f)] = 1
    y, n = np.array([label for _, label in seen], float), np.array(list(seen.values()), float)
    n *= 4000 / n.sum()
    w = start.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 3.0 * np.eye(len(w)), x.T @ (n * (y - p)) - 3.0 * (w - start))
        w += step
        if abs(step).max() < 1e-6:
            break
    share = pairs / pairs.sum(axis=1, keepdims=True)
    return w.tolist(), (float(min(0.98, share[1, 1])), float(min(0.98, max(0.6, share[0, 0]))))


def extract(html: str | None, weights: list[float], pair: tuple[float, float]) -> str:
    if not html:
        return ""
    dom = Dom(html)
    unary = [sum(weights[k] for k in f) for f in dom.measures()]
    return dom.text([p >= 0.5 for p in marginals(dom.parent, unary, pair)])


def _text(batches: Iterator[pa.RecordBatch], weights: list[float], pair: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(h, weights, pair) for h in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _fit(pdf):
    import pandas as pd

    weights, pair = fit_pages(pdf.sort_values("at")["html"].tolist())
    return pd.DataFrame({"weights": [list(weights)], "pair": [list(pair)]})


def fit(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> tuple[list[float], tuple[float, float]]:
    """Trains on a bounded sample; one task reads it."""
    marked = pages.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{html_col}`").cast("string").alias("html")).filter(F.col("html").rlike("(?i)<(article|main)[\\s>]") & (F.length("html") < LONGEST_PAGE))
    # The sample is drawn on ids alone; only its own pages travel.
    drawn = marked.select(F.xxhash64("i").alias("at"), "i").dropna().distinct().orderBy("at", "i").limit(MOST_PAGES)
    sample = marked.join(F.broadcast(drawn), "i").select("at", "html")  # MOST_PAGES ids at most
    row = sample.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_fit, "weights array<double>, pair array<double>").first()
    return (list(row[0]), (row[1][0], row[1][1])) if row else (list(START), START_PAIR)


def extract_pages(pages: DataFrame, weights: list[float], pair: tuple[float, float], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(partial(_text, weights=list(weights), pair=pair), "page_id long, url string, text string, n_chars long")
