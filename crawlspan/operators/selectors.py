"""CSS selectors, matched on a page's whole tree.

Supported: tags, ``*``, ``#id``, ``.class``, attributes with ``= ~= |= ^= $= *=`` and the ``i`` flag, ``:not(...)``, ``:is(...)``,
``:where(...)``, ``:has(...)``, ``:root``, ``:empty``, the ``:first-``, ``:last-``, ``:only-`` and ``:nth-`` families, the four
combinators and lists. A text that is no selector, or asks for a state that a stored page doesn't have (``:hover``), is None.

Two passes serve all selectors: one from the top hands partial matches on to children and later siblings; one from the
bottom, for ``:has``, hands them on to parents and earlier siblings. Each element is looked at once for each part of a
selector, however deep the page nests.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from crawlspan.operators.dom import Node, Tree

_NAME = r"-?[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff-]*"
_PIECE = re.compile(
    rf"(?P<tag>{_NAME}|\*)|#(?P<id>[\w\u0080-\U0010ffff-]+)|\.(?P<cls>{_NAME})"
    rf"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[\w.:/#-]+))\s*(?P<flag>[iIsS])?\s*)?\]"
    rf"|:(?P<pseudo>{_NAME})(?P<open>\()?"
)
_GAP = re.compile(r"\s*([,>+~])\s*|\s+")
_NTH = re.compile(r"\s*(?:(?P<word>odd|even)|(?P<a>[+-]?\d*)n\s*(?:(?P<sign>[+-])\s*(?P<b>\d+))?|(?P<only>[+-]?\d+))\s*", re.I)
#: Pseudo-classes without argument: the counts that must be as given, as (what is counted, step, start).
_PLACES = {
    "first-child": [("nth-child", 0, 1)], "last-child": [("nth-last-child", 0, 1)], "only-child": [("nth-child", 0, 1), ("nth-last-child", 0, 1)],
    "first-of-type": [("nth-of-type", 0, 1)], "last-of-type": [("nth-last-of-type", 0, 1)], "only-of-type": [("nth-of-type", 0, 1), ("nth-last-of-type", 0, 1)],
}


@dataclass
class Compound:
    tests: list[tuple]
    joint: str = ""  # how it stands to the one before it: " ", ">", "+" or "~"


Chains = list[list[Compound]]


def _nth(text: str) -> tuple[int, int] | None:
    m = _NTH.fullmatch(text)
    if not m:
        return None
    if m["word"]:
        return 2, int(m["word"].lower() == "odd")
    if m["only"]:
        return 0, int(m["only"])
    a = m["a"]
    return (int(a) if a.lstrip("+-") else int(f"{a}1")), int(f"{m['sign'] or ''}{m['b'] or 0}")


def _inside(text: str, at: int) -> int:
    """The place of the bracket that closes the one before ``at``, or -1."""
    depth, quote = 1, ""
    for k in range(at, len(text)):
        c = text[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        else:
            depth += (c == "(") - (c == ")")
        if not depth:
            return k
    return -1


def parse(css: str, relative: bool = False) -> Chains | None:
    """The alternatives of a selector list, each a chain of compounds from left to right. In a relative selector the first
    compound may have a joint too, a descendant's by default."""
    out, chain, tests, at = [], [], [], 0
    css = css.strip()
    first = " " if relative else ""
    joint = first

    def end() -> bool:
        nonlocal tests
        if not tests:
            return False
        chain.append(Compound(tests, joint))
        tests = []
        return True

    while at < len(css):
        gap = _GAP.match(css, at)
        if gap:
            at = gap.end()
            if relative and not tests and not chain and gap[1] in (">", "+", "~") and joint == first:
                joint = gap[1]
                continue
            if not end():
                return None
            if gap[1] == ",":
                out.append(chain)
                chain, joint = [], first
            else:
                joint = gap[1] or " "
            continue
        m = _PIECE.match(css, at)
        if not m or m["tag"] and tests:
            return None
        at = m.end()
        if m["tag"]:
            tests.append(("tag", m["tag"].lower()))
        elif m["id"]:
            tests.append(("attr", "id", "=", m["id"], False))
        elif m["cls"]:
            tests.append(("attr", "class", "~=", m["cls"], False))
        elif m["attr"]:
            value = next((v for v in (m["dq"], m["sq"], m["bare"]) if v is not None), None)
            tests.append(("attr", m["attr"].lower(), m["op"], value, (m["flag"] or "").lower() == "i"))
        else:
            name, arg = m["pseudo"].lower(), None
            if m["open"]:
                close = _inside(css, at)
                if close < 0:
                    return None
                arg, at = css[at:close], close + 1
            more = _pseudo(name, arg)
            if more is None:
                return None
            tests += more
    if not end():
        return None
    return [*out, chain]


def _pseudo(name: str, arg: str | None) -> list[tuple] | None:
    if arg is None:
        if name in ("root", "scope", "empty"):
            return [("root" if name == "scope" else name,)]
        return _PLACES.get(name)
    if name in ("not", "is", "where", "has"):
        inner = parse(arg, relative=name == "has")
        return None if inner is None else [("is" if name == "where" else name, inner)]
    if name in ("nth-child", "nth-of-type", "nth-last-child", "nth-last-of-type"):
        step = _nth(arg)
        return None if step is None else [(name, *step)]
    return None


def _attr(have: str | None, op: str | None, want: str | None, fold: bool) -> bool:
    if have is None or op is None:
        return have is not None
    if fold:
        have, want = have.lower(), want.lower()
    if op == "=":
        return have == want
    if op == "~=":
        return want in have.split()
    if op == "|=":
        return have == want or have.startswith(f"{want}-")
    return bool(want) and {"^=": have.startswith, "$=": have.endswith, "*=": have.__contains__}[op](want)


class Matcher:
    """Selectors over one page; what inner selectors match is found once and kept."""

    def __init__(self, page: Tree) -> None:
        self.nodes = page.placed()
        self.kept: dict[tuple[str, int], set[int]] = {}

    def select(self, chains: Chains) -> list[Node]:
        """The elements that match, in the order of the page."""
        hits = self._matching(chains)
        return [n for n in self.nodes if id(n) in hits]

    def _fits(self, c: Compound, e: Node) -> bool:
        for kind, *args in c.tests:
            if kind == "tag":
                ok = args[0] in ("*", e.tag)
            elif kind == "attr":
                ok = _attr(e.attrs.get(args[0]), *args[1:])
            elif kind in ("not", "is"):
                ok = (id(e) in self._matching(args[0])) == (kind == "is")
            elif kind == "has":
                ok = id(e) in self._having(args[0])
            elif kind == "root":
                ok = e.parent.parent is None
            elif kind == "empty":
                ok = not e.kids and e.start == e.end
            else:
                a, b = args
                n = e.of_type if kind.endswith("type") else e.place
                if "last" in kind:
                    n = (e.parent.types[e.tag] if kind.endswith("type") else len(e.parent.kids)) + 1 - n
                n -= b
                ok = n == 0 if a == 0 else n % a == 0 and n // a >= 0
            if not ok:
                return False
        return True

    def _matching(self, chains: Chains) -> set[int]:
        key = ("matching", id(chains))
        if key not in self.kept:
            self.kept[key] = set().union(*map(self._from_top, chains))
        return self.kept[key]

    def _from_top(self, chain: list[Compound]) -> set[int]:
        """Parts of the chain that end at an element, as bits: its own, those of all above it, those of all before it."""
        own: dict[int, int] = {}
        above: dict[int, int] = {}
        before: dict[int, tuple[int, int]] = {}  # by parent: the last sibling's own bits, and all earlier siblings'
        out, last = set(), len(chain) - 1
        for e in self.nodes:
            up = id(e.parent)
            reach = {" ": above.get(up, 0), ">": own.get(up, 0), "+": before.get(up, (0, 0))[0], "~": before.get(up, (0, 0))[1]}
            bits = 0
            for k, c in enumerate(chain):
                if (k == 0 or reach[c.joint] >> (k - 1) & 1) and self._fits(c, e):
                    bits |= 1 << k
            own[id(e)] = bits
            above[id(e)] = above.get(up, 0) | bits
            before[up] = bits, before.get(up, (0, 0))[1] | bits
            if bits >> last & 1:
                out.add(id(e))
        return out

    def _having(self, chains: Chains) -> set[int]:
        key = ("having", id(chains))
        if key not in self.kept:
            self.kept[key] = set().union(*map(self._from_bottom, chains))
        return self.kept[key]

    def _from_bottom(self, chain: list[Compound]) -> set[int]:
        """The same from the other end: parts of the chain that start at an element, kept for its children's, its
        descendants', its next sibling's and all later siblings' parents and neighbours."""
        own: dict[int, int] = {}
        below: dict[int, int] = {}  # bits of all descendants
        kids: dict[int, int] = {}  # bits of children
        after: dict[int, tuple[int, int]] = {}
        out, last = set(), len(chain) - 1
        for e in reversed(self.nodes):
            me, up = id(e), id(e.parent)
            reach = {" ": below.get(me, 0), ">": kids.get(me, 0), "+": after.get(up, (0, 0))[0], "~": after.get(up, (0, 0))[1]}
            if reach[chain[0].joint] & 1:
                out.add(me)
            bits = 0
            for k in range(last, -1, -1):
                if (k == last or reach[chain[k + 1].joint] >> (k + 1) & 1) and self._fits(chain[k], e):
                    bits |= 1 << k
            own[me] = bits
            below[up] = below.get(up, 0) | below.get(me, 0) | bits
            kids[up] = kids.get(up, 0) | bits
            after[up] = bits, after.get(up, (0, 0))[1] | bits
        return out
