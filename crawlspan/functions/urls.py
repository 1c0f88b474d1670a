"""URL functions as columns; only full resolution of odd relative links needs Python."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from urllib.parse import quote, urljoin, urlsplit

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Schemes with a default port.
DEFAULT_PORTS = {"http": "80", "https": "443"}
#: ASCII characters that are percent-encoded in the path and in the query of a URL.
PATH_CODED, QUERY_CODED = " \"#<>?`{}", " \"#<>'"
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def resolve(base: str | None, href: str | None) -> str | None:
    """``href`` against ``base``; None where that gives no absolute URL."""
    try:
        joined = urljoin(base or "", (href or "").strip())
        parts = urlsplit(joined)
        if not parts.scheme:
            return None
        if parts.scheme in DEFAULT_PORTS and not parts.hostname:
            return None
        return quote(joined, safe="%/:?#[]@!$&'()*+,;=~-._|")
    except ValueError:
        return None


def url_host(url: Column) -> Column:
    """The host in lower case, '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), F.lit(""))


def is_internal(url: Column, root: Column) -> Column:
    host = url_host(url)
    return F.coalesce((host != "") & ((host == root) | host.endswith(F.concat(F.lit("."), root))), F.lit(False))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _dots(path: Column) -> Column:
    """Removes dot segments; a dot may be written %2e."""
    plain = lambda s: F.regexp_replace(s, "(?i)^(?:\\.|%2e)(\\.|%2e)?$", "<$1>")
    step = lambda acc, s: F.when(plain(s) == "<>", acc).when(plain(s).startswith("<"), F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(s)))
    folded = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    dot = "(?:\\.|%2e)"
    return F.when(path.rlike(f"(?i)(^|/){dot}{{1,2}}(/|$)"), F.when(path.rlike(f"(?i)/{dot}{{1,2}}$") & ~folded.endswith("/"), F.concat(folded, F.lit("/"))).otherwise(folded)).otherwise(path)


def _percent_encode(text: Column, chars: str) -> Column:
    """Percent-encodes ``chars``, control and non-ASCII characters as UTF-8; all else, '%' too, stays as it is."""
    code = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for c in "!$&'()+,/:;=?@[\\]^`{|}~#\"<>":
        if c not in chars:
            code = F.replace(code, F.lit(f"%{ord(c):02X}"), F.lit(c))
    code = F.replace(code, F.lit("%25"), F.lit("%"))  # last: what it brings back is no code to undo
    return F.when(text.rlike("[^!-~]|[" + re.escape(chars) + "]"), code).otherwise(text)


def _ascii_host(host: Column) -> Column:
    """A host in lower case, other scripts as punycode; one that has no such form stays."""
    lower = F.lower(host)
    return F.when(lower.rlike("[^\\x00-\\x7f]"), F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), lower), lower)).otherwise(lower)


def _decoded(text: Column) -> Column:
    """A form-encoded text read: '+' is a space, %XX a byte; what can't be read stays."""
    return F.when(text.rlike("[+%]"), F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))).otherwise(text)


_built: dict[tuple, Column] = {}


def _once(kind: str, name: str, strip_slash: bool, make: Callable[[Column], Column]) -> Column:
    """The expression over a column of this name, built once for a Spark context: it has some thousand nodes."""
    key = (id(SparkContext._active_spark_context), kind, name, strip_slash)
    if key not in _built:
        _built[key] = make(F.col(name))
    return _built[key]


def normalize_url(url: Column | str, strip_slash: bool = True) -> Column:
    """Canonical form: lower-case scheme and ASCII host, no fragment or default port, sorted query, no dot segments.

    The path and the query are percent-encoded where they must be. Query pairs are decoded, sort by key, then value, are
    written anew, and an empty value loses its '='; so an encoded '&' or '=' is a plain one after it. One slash at the end
    of the whole goes, but not where the path is the root. A text that is no absolute URL stays as it is.
    """
    if isinstance(url, str):
        return _once("normal", url, strip_slash, lambda c: normalize_url(c, strip_slash))
    part = lambda i: F.regexp_extract(url, _PARTS, i)
    return _let(F.struct(F.lower(part(1)).alias("scheme"), part(2).alias("place"), part(3).alias("path"), part(4).alias("query")), lambda p: F.when(p["scheme"] == "", url).otherwise(_rebuilt(p, strip_slash)))


def _rebuilt(p: Column, strip_slash: bool) -> Column:
    user = F.regexp_extract(p["place"], "^(.*@)?", 0)
    host, port = _ascii_host(F.regexp_extract(p["place"], r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1)), F.regexp_extract(p["place"], r"(:\d+)$", 1)
    usual = reduce(lambda a, b: a | b, ((p["scheme"] == name) & (port == f":{n}") for name, n in DEFAULT_PORTS.items()))
    pairs = F.filter(F.split(F.substring(p["query"], 2, 1_000_000_000), "&"), lambda x: x != "")
    value = lambda x: F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise(F.lit(""))
    keyed = F.array_sort(F.transform(pairs, lambda x: F.struct(_decoded(F.substring_index(x, "=", 1)).alias("k"), _decoded(value(x)).alias("v"))))
    query = F.array_join(F.transform(keyed, lambda x: F.when(x["v"] == "", x["k"]).otherwise(F.concat(x["k"], F.lit("="), x["v"]))), "&")
    query = F.when(p["query"] != "", F.concat(F.lit("?"), _let(query, lambda q: _percent_encode(q, QUERY_CODED)))).otherwise(F.lit(""))
    front = F.concat(p["scheme"], F.lit("://"), user, host, F.when(usual, F.lit("")).otherwise(port))
    path = _let(F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]), lambda x: _let(_percent_encode(x, PATH_CODED), _dots))
    strip = lambda x: F.when(x["path"] != "/", F.regexp_replace(F.concat(x["path"], x["query"]), "/$", "")).otherwise(F.concat(x["path"], x["query"]))
    return F.concat(front, _let(F.struct(path.alias("path"), query.alias("query")), strip if strip_slash else lambda x: F.concat(x["path"], x["query"])))


def hash_url(url: Column | str) -> Column:
    if isinstance(url, str):
        return _once("hash", url, False, hash_url)
    return F.sha2(normalize_url(url, False), 256)


def rewrite_url(url: Column, rules: list[tuple[str, str]]) -> Column:
    """Applies (pattern, replacement) in order, everywhere."""
    return reduce(lambda u, r: F.regexp_replace(u, r[0], r[1]), rules, url)


def url_allowed(url: Column, include: list[str] | tuple = (), exclude: list[str] | tuple = ()) -> Column:
    """Some include pattern matches, if there are any, and no exclude pattern; a bad pattern raises here."""
    for p in (*include, *exclude):
        re.compile(p)
    some = reduce(lambda a, p: a | url.rlike(p), include, F.lit(not include))
    return reduce(lambda a, p: a & ~url.rlike(p), exclude, some)


def path_segments(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, _PARTS, 3), "/"), lambda x: x != "")


def path_and_query(url: Column) -> Column:
    return F.concat(F.when(F.regexp_extract(url, _PARTS, 3) == "", F.lit("/")).otherwise(F.regexp_extract(url, _PARTS, 3)), F.regexp_extract(url, _PARTS, 4))
