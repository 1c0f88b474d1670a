"""A page's element tree, built by the insertion rules of the HTML standard from the tags as they come.

Implied html, head, body, tbody and tr elements are made, blocks end open paragraphs, a heading ends a heading, list items,
options, cells and rows end their like, links end links, and formatting elements that a block cut off are opened again
inside it. Each element has the range of text pieces that it covers, so its text is a slice.

All rules look at counts and last places of open elements by tag and by kind, never down the stack, so work grows with the
page whatever stays unclosed. Kept simple: text that strays between a table's cells stays where it stands, and of the
formatting elements to be opened again the newest FORMATS are remembered.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

# Element names of the HTML standard by the rule that they follow.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr li dd dt listing main menu nav ol p plaintext pre search section summary table ul xmp".split()
).union(HEADINGS)
SPECIAL = ENDS_P.union(
    "applet area base basefont bgsound body br button caption col colgroup embed frame frameset head html iframe img input keygen link marquee meta noembed noframes noscript object param script select source style tbody td template textarea tfoot th thead title tr track wbr".split()
)
SCOPE = frozenset("applet caption html table td th marquee object template foreignobject annotation-xml".split())
MARKERS = frozenset("applet marquee object td th caption template".split())
TABLE_PARTS = frozenset("caption colgroup col tbody thead tfoot tr td th".split())
LEAVES_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
RAW = frozenset(("title", "textarea"))
NO_FORMATS = ENDS_P | TABLE_PARTS | frozenset("script style textarea title noscript template rb rp rt rtc".split())
#: Formatting elements that are opened again at most, and blocks that one end tag passes at most (a fixed value of the standard).
FORMATS, PASSES = 16, 8

_KINDS = {
    "scope": SCOPE, "list": SCOPE.union(("ol", "ul")), "button": SCOPE.union(("button",)), "table": frozenset(("html", "table", "template")), "special": SPECIAL, "stop": SPECIAL.difference(("address", "div", "p")),
}
_KIND_OF = {tag: tuple(k for k, tags in _KINDS.items() if tag in tags) for tag in SPECIAL | SCOPE}


class Node:
    """An element: ``start`` and ``end`` bound its text pieces; ``place`` and ``of_type`` are set once the tree is whole."""

    __slots__ = ("tag", "attrs", "parent", "kids", "start", "end", "index", "live", "place", "of_type", "types")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, start: int) -> None:
        self.tag, self.attrs, self.parent, self.kids, self.start, self.end, self.index, self.live = tag, attrs, parent, [], start, start, -1, False


class Tree(HTMLParser):
    """Feed it a page, then :meth:`finish`."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None, 0)
        self.texts: list[str] = []
        self.stack: list[Node] = []
        self.at: dict[str, list[int]] = defaultdict(list)  # places of open elements by tag, and by kind below
        self.walls: dict[str, list[int]] = {k: [] for k in _KINDS}
        self.formats: list[Node | None] = []  # None marks a cell or the like, which formats don't pass
        self.html = self.head = self.body = None

    # The stack ------------------------------------------------------------------------------------------------------

    def _insert(self, tag: str, attrs: dict[str, str], parent: Node | None = None) -> Node:
        parent = parent or (self.stack[-1] if self.stack else self.root)
        node = Node(tag, attrs, parent, len(self.texts))
        parent.kids.append(node)
        return node

    def _push(self, tag: str, attrs: dict[str, str], parent: Node | None = None) -> Node:
        node = self._insert(tag, attrs, parent)
        node.index, node.live = len(self.stack), True
        self.stack.append(node)
        self.at[tag].append(node.index)
        for k in _KIND_OF.get(tag, ()):
            self.walls[k].append(node.index)
        if tag in MARKERS:
            self.formats.append(None)
        return node

    def _forget(self, node: Node) -> None:
        """The element is open no more, wherever it stands on the stack."""
        node.live = False
        for places in (self.at[node.tag], *(self.walls[k] for k in _KIND_OF.get(node.tag, ()))):
            if places[-1] == node.index:
                places.pop()
            else:
                places.remove(node.index)

    def _close(self, index: int) -> None:
        """Ends the element at ``index`` and all above it."""
        while len(self.stack) > index or self.stack and not self.stack[-1].live:
            node = self.stack.pop()
            if node.live:
                self._forget(node)
                node.end = len(self.texts)
                if node.tag in MARKERS:
                    while self.formats and self.formats.pop() is not None:
                        pass

    def _in_scope(self, tag: str, kind: str = "scope") -> bool:
        own, walls = self.at.get(tag), self.walls[kind]
        return bool(own) and (not walls or own[-1] >= walls[-1])

    def _end_if_open(self, tag: str, kind: str = "scope") -> bool:
        if found := self._in_scope(tag, kind):
            self._close(self.at[tag][-1])
        return found

    # Formatting elements --------------------------------------------------------------------------------------------

    def _reopen(self) -> None:
        """Opens the formatting elements again that a block or an end tag cut off."""
        last = len(self.formats)
        while last and self.formats[last - 1] is not None and not self.formats[last - 1].live:
            last -= 1
        for i in range(last, len(self.formats)):
            self.formats[i] = self._push(self.formats[i].tag, self.formats[i].attrs)

    def _remember(self, node: Node) -> None:
        alike, first = [], 0
        for i in range(len(self.formats) - 1, -1, -1):
            x = self.formats[i]
            if x is None:
                first = i + 1
                break
            if x.tag == node.tag and x.attrs == node.attrs:
                alike.append(i)
        if len(alike) >= 3:
            del self.formats[alike[-1]]
        elif len(self.formats) - first >= FORMATS:
            del self.formats[first]
        self.formats.append(node)

    def _format(self, tag: str) -> Node | None:
        for x in reversed(self.formats):
            if x is None:
                return None
            if x.tag == tag:
                return x
        return None

    def _end_format(self, tag: str) -> None:
        """Ends a formatting element; blocks that are open inside it leave it, each with a copy of it around what it holds."""
        node = self._format(tag)
        if node is None:
            self._end_plain(tag)
            return
        if not node.live:
            self.formats.remove(node)
            return
        if self.walls["scope"] and node.index < self.walls["scope"][-1]:
            return
        special = self.walls["special"]
        blocks = special[bisect_right(special, node.index) :]
        self.formats.remove(node)
        if not blocks:
            self._close(node.index)
            return
        around, below = node, node.index
        self._forget(node)
        for index in blocks[:PASSES]:
            block = self.stack[index]
            around.end = block.start
            common = self._lift(around.parent, below, index)
            block.parent.kids.remove(block) if block.parent.kids[-1] is not block else block.parent.kids.pop()
            block.parent = common
            common.kids.append(block)
            copy = Node(node.tag, node.attrs, block, block.start)
            copy.kids, block.kids = block.kids, [copy]
            for kid in copy.kids:
                kid.parent = copy
            around, below = copy, index
        if len(blocks) <= PASSES:
            self._close(blocks[-1] + 1)
            around.end = len(self.texts)
        else:
            around.end = self.stack[blocks[PASSES]].start

    def _lift(self, common: Node, below: int, index: int) -> Node:
        """What stands between a formatting element and a block that leaves it: the nearest three formatting elements go with
        the block as copies, the others end."""
        start, keep = self.stack[index].start, []
        for i in range(index - 1, below, -1):
            x = self.stack[i]
            if not x.live:
                continue
            x.end = start
            known = next((k for k, f in enumerate(self.formats) if f is x), None)
            if known is not None and len(keep) < 3:
                keep.append((i, known))
            else:
                self._forget(x)
                if known is not None:
                    del self.formats[known]
                    keep = [(j, k - (k > known)) for j, k in keep]
        for i, known in reversed(keep):
            old = self.stack[i]
            copy = Node(old.tag, old.attrs, common, start)
            copy.index, copy.live, old.live = i, True, False
            common.kids.append(copy)
            self.stack[i] = self.formats[known] = common = copy
        return common

    # Tags and text --------------------------------------------------------------------------------------------------

    def _open_html(self, attrs: dict[str, str] | None = None) -> None:
        if self.html is None:
            self.html = self._push("html", dict(attrs or {}))
        for k, v in (attrs or {}).items():
            self.html.attrs.setdefault(k, v)

    def _open_body(self, attrs: dict[str, str] | None = None) -> None:
        self._open_html()
        if self.body is None:
            if self.head is None:
                self.head = self._insert("head", {}, self.html)
            self._close(1)
            self.body = self._push("body", dict(attrs or {}))
        for k, v in (attrs or {}).items():
            self.body.attrs.setdefault(k, v)

    def seen(self, tag: str, attrs: dict[str, str]) -> None:
        """Called for each start tag, in the order of the page."""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._start(tag, attrs, False)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._start(tag, attrs, True)
        if tag in self.CDATA_CONTENT_ELEMENTS and self.stack and self.stack[-1].tag == tag:
            self.set_cdata_mode(tag)  # the slash means nothing in HTML

    def _start(self, tag: str, pairs: list[tuple[str, str | None]], slash: bool) -> None:
        if self.stack and self.stack[-1].tag in RAW:
            self.texts.append(self.get_starttag_text() or "")
            return
        attrs: dict[str, str] = {}
        for k, v in pairs:
            attrs.setdefault(k, v if v is not None else "")
        tag = "img" if tag == "image" else tag
        self.seen(tag, attrs)
        if tag == "html":
            self._open_html(attrs)
        elif tag == "body":
            self._open_body(attrs)
        elif tag == "head":
            self._open_html()
            if self.head is None and self.body is None:
                self.head = self._push("head", attrs)
        elif self.body is None and tag in HEAD_TAGS:
            self._open_html()
            if self.head is None:
                self.head = self._push("head", {})
            parent = self.head if self.stack[-1] is self.html else None
            (self._insert if tag in VOID else self._push)(tag, attrs, parent)
        else:
            self._open_body()
            self._in_body(tag, attrs, slash)

    def _in_body(self, tag: str, attrs: dict[str, str], slash: bool) -> None:
        foreign = max((self.at[t][-1] for t in ("svg", "math") if self.at.get(t)), default=-1)
        if foreign > self.walls["scope"][-1]:
            if tag not in LEAVES_FOREIGN:
                self._insert(tag, attrs) if slash else self._push(tag, attrs)
                return
            self._close(foreign)
        if tag in ("li", "dd", "dt"):
            top = self.walls["stop"][-1]
            if self.stack[top].tag == tag or tag != "li" and self.stack[top].tag in ("dd", "dt"):
                self._close(top)
        elif tag == "form" and self.at.get("form") and not self.at.get("template"):
            return
        if tag in ENDS_P:
            self._end_if_open("p", "button")
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self._close(len(self.stack) - 1)
        elif tag == "button":
            self._end_if_open("button")
        elif tag == "a" and self._format("a") is not None:
            old = self._format("a")
            self._end_format("a")
            if old in self.formats:
                self.formats.remove(old)
            if old.live and old.index > self.walls["special"][-1]:
                self._close(old.index)
        elif tag == "nobr" and self._in_scope("nobr"):
            self._end_format("nobr")
        elif tag in ("option", "optgroup") and self.stack[-1].tag == "option":
            self._close(len(self.stack) - 1)
        elif tag in ("rb", "rp", "rt", "rtc") and self.stack[-1].tag in ("rb", "rp", "rt"):
            self._close(len(self.stack) - 1)
        elif tag == "table" and self.at.get("table") and self.walls["scope"][-1] == self.at["table"][-1]:
            self._close(self.at["table"][-1])
        elif tag in TABLE_PARTS and not self._to_table(tag):
            return
        if tag == "optgroup" and self.stack[-1].tag == "optgroup":
            self._close(len(self.stack) - 1)
        if tag not in NO_FORMATS:
            self._reopen()
        if tag in VOID:
            self._insert(tag, attrs)
        elif slash and tag in ("svg", "math"):
            self._insert(tag, attrs)
        else:
            node = self._push(tag, attrs)
            if tag in FORMATTING:
                self._remember(node)

    def _to_table(self, tag: str) -> bool:
        """Goes up to where a part of a table belongs; False outside of tables."""
        if not self._in_scope("table", "table"):
            return False
        table = self.at["table"][-1]
        above = lambda *tags: max((self.at[t][-1] for t in tags if self.at.get(t) and self.at[t][-1] > table), default=None)
        if tag in ("td", "th"):
            row = above("tr")
            if row is None:
                self._to_table("tr")
                self._push("tr", {})
            else:
                self._close(row + 1)
        elif tag == "tr":
            group = above("tbody", "thead", "tfoot")
            self._close((table if group is None else group) + 1)
            if group is None:
                self._push("tbody", {})
        elif tag == "col" and (group := above("colgroup")) is not None:
            self._close(group + 1)
        else:
            self._close(table + 1)
            if tag == "col":
                self._push("colgroup", {})
        return True

    def _end_plain(self, tag: str) -> None:
        own = self.at.get(tag)
        if own and own[-1] >= self.walls["special"][-1]:
            self._close(own[-1])

    def handle_endtag(self, tag: str) -> None:
        if self.stack and self.stack[-1].tag in RAW and tag != self.stack[-1].tag:
            self.texts.append(f"</{tag}>")
        elif tag in ("html", "body") or not self.stack and tag not in ("p", "br"):
            return
        elif self.body is None:
            own = self.at.get(tag)
            if own:
                self._close(own[-1])
            elif tag in ("p", "br"):
                self._start(tag, [], False)
                self._end_if_open(tag)
        elif tag == "p":
            if not self._end_if_open("p", "button"):
                self._insert("p", {})
        elif tag == "br":
            self._in_body("br", {}, False)
        elif tag in FORMATTING:
            self._end_format(tag)
        elif tag in HEADINGS:
            open_ = [h for h in HEADINGS if self._in_scope(h)]
            if open_:
                self._close(max(self.at[h][-1] for h in open_))
        elif tag == "li":
            self._end_if_open("li", "list")
        elif tag in TABLE_PARTS or tag == "table":
            self._end_if_open(tag, "table")
        elif tag in SPECIAL:
            self._end_if_open(tag)
        else:
            self._end_plain(tag)

    def handle_data(self, data: str) -> None:
        inside = self.stack[-1].tag if self.stack else ""
        if self.body is None and inside in ("", "html", "head"):
            data = data.lstrip()
            if not data:
                return
            self._open_body()
        elif inside not in RAW and inside not in self.CDATA_CONTENT_ELEMENTS:
            self._reopen()
        self.texts.append(data)

    # The whole tree -------------------------------------------------------------------------------------------------

    def finish(self) -> None:
        self.close()
        self._open_body()
        self._close(0)

    def text(self, node: Node) -> str:
        return "".join(self.texts[node.start : node.end])

    def walk(self) -> Iterator[Node]:
        """All elements in the order of the page."""
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node is not self.root:
                yield node
            todo.extend(reversed(node.kids))

    def placed(self) -> list[Node]:
        """All elements in the order of the page, with their places among their siblings."""
        out = list(self.walk())
        for node in (self.root, *out):
            node.types = {}
            for k, kid in enumerate(node.kids):
                kid.place = k + 1
                kid.of_type = node.types[kid.tag] = node.types.get(kid.tag, 0) + 1
        return out
