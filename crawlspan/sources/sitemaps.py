"""Sitemap files as rows.

A file is unpacked and read piece by piece; its entries come out as they end, so a task holds the packed file and one piece
of it. Only direct children of an entry count, so that an image's or a video's location is not the page's. A file that is cut
off keeps what was read; after markup that is not well formed, such as a bare ampersand, reading goes on at the next entry.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html.entities import html5
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlspan.sources.scratch import cut

MOST_LEVELS = 3
#: Bytes of a file that are unpacked and read at a time, and rows of a batch.
PIECE, BATCH = 1 << 16, 1000
#: Entries of the two kinds of files, and an entry's fields.
ENTRIES = {"url": "urlset", "sitemap": "sitemapindex"}
FIELDS = ("loc", "lastmod", "changefreq", "priority")
_ENTRY = re.compile(rb"<(?:[\w.-]+:)?(url|sitemap)[\s>]")
_READ = "source_url string, kind string, url string, lastmod string, changefreq string, priority string"


def pieces(body: bytes) -> Iterator[bytes]:
    """A file's bytes, unpacked if they are packed; of a damaged pack, what comes before the damage."""
    packed = body[:2] == b"\x1f\x8b"
    unpack = zlib.decompressobj(wbits=31)
    for at in range(0, len(body), PIECE):
        data = body[at : at + PIECE]
        if not packed:
            yield data
            continue
        try:
            while data:
                yield unpack.decompress(data, 4 * PIECE)
                data = unpack.unconsumed_tail
                if unpack.eof:
                    data, unpack = unpack.unused_data, zlib.decompressobj(wbits=31)
                    if data[:2] != b"\x1f\x8b":
                        return
        except zlib.error:
            return
    if packed:
        yield unpack.flush()


class _Reader:
    """Entries of one file, in ``found`` as they end: kind and the four fields."""

    def __init__(self, encoding: str | None) -> None:
        self.encoding, self.root, self.found = encoding, None, []
        self.lost, self.tail = False, b""  # whether the next entry is sought, and the last bytes that were searched
        self._start()

    def _start(self) -> None:
        self.path: list[str] = []
        self.entry: dict[str, list[str]] = {}
        self.parser, self.fed, self.held = expat.ParserCreate(self.encoding), 0, b""
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self._open, self._close, self._text
        self.parser.UseForeignDTD(True)  # so that entities that no file declares are handed over
        self.parser.ExternalEntityRefHandler = lambda *_: 1
        self.parser.SkippedEntityHandler = lambda name, is_parameter: self._text(html5.get(f"{name};", ""))

    def _open(self, tag: str, _: dict) -> None:
        name = tag.rpartition(":")[2]
        self.path.append(name)
        if len(self.path) == 1:
            self.root = name
        elif len(self.path) == 2:
            self.entry = {}

    def _text(self, data: str) -> None:
        if len(self.path) == 3 and self.path[2] in FIELDS:
            self.entry.setdefault(self.path[2], []).append(data)

    def _close(self, _: str) -> None:
        name = self.path.pop()
        if len(self.path) == 1 and ENTRIES.get(name) == ("sitemapindex" if self.root == "sitemapindex" else "urlset"):
            fields = [" ".join("".join(self.entry.get(f, ())).split()) or None for f in FIELDS]
            if fields[0]:
                self.found.append((name, *fields))

    def feed(self, data: bytes) -> None:
        while True:
            if self.lost:
                data = self.tail + data
                next_entry = _ENTRY.search(data)
                if not next_entry:
                    self.tail = data[-64:]
                    return
                data, self.lost, self.tail = data[next_entry.start() :], False, b""
                self._start()
                self._parse(f"<{ENTRIES[next_entry[1].decode()]}>".encode())
            rest = self._parse(data)
            if rest is None:
                return
            self.lost, data = True, rest

    def _parse(self, data: bytes) -> bytes | None:
        """None if all is well, else what comes after the fault."""
        seen, start = self.held + data, self.fed - len(self.held)
        try:
            self.parser.Parse(data, False)
        except expat.ExpatError:
            return seen[max(0, self.parser.ErrorByteIndex - start) + 1 :]
        self.fed += len(data)
        self.held = seen[max(0, self.parser.CurrentByteIndex - start) :]  # what has not come to an end yet
        return None


def _read(batches: Iterator[pa.RecordBatch], encoding: str | None) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _READ.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [()] * len(names))], names=names)

    rows: list[tuple] = []
    for b in batches:
        for url, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            reader = _Reader(encoding)
            for piece in pieces(body.as_py() or b""):
                reader.feed(piece)
                rows += [(url, *r) for r in reader.found]
                reader.found.clear()
                while len(rows) >= BATCH:
                    yield out(rows[:BATCH])
                    rows = rows[BATCH:]
    yield out(rows)


def read_sitemaps(docs: DataFrame, body: str = "body") -> DataFrame:
    """source_url, kind (url or sitemap), url, lastmod, changefreq, priority of each entry with a location. The body is text,
    or bytes that may be packed."""
    text = dict(docs.dtypes)[body] == "string"
    rows = docs.select(F.col("url").cast("string"), F.col(body).cast("binary").alias("body"))
    return rows.mapInArrow(lambda batches: _read(batches, "utf-8" if text else None), _READ)


def _entries(read: DataFrame) -> DataFrame:
    return read.filter("kind = 'url'").select("source_url", "url", "lastmod", "changefreq", F.expr("try_cast(priority as double)").alias("priority"))


def sitemap_entries(docs: DataFrame, body: str = "body") -> DataFrame:
    """source file, url, lastmod, changefreq, priority of each page entry; a priority that is no number is null."""
    return _entries(read_sitemaps(docs, body))


def sitemap_children(docs: DataFrame, body: str = "body") -> DataFrame:
    """(source_url, url) of the files that sitemap indexes name."""
    return read_sitemaps(docs, body).filter("kind = 'sitemap'").select("source_url", "url")


def expand_sitemaps(roots: DataFrame, docs: DataFrame) -> DataFrame:
    """Entries of the root files and of those their indexes name, at most MOST_LEVELS below. Each file is read once."""
    level, found = roots.select("url").distinct(), None
    for _ in range(MOST_LEVELS + 1):
        read = cut(read_sitemaps(docs.join(level, "url", "left_semi")))
        found = _entries(read) if found is None else found.unionByName(_entries(read))
        level = read.filter("kind = 'sitemap'").select("url").distinct()
        if level.isEmpty():
            break
    return found


def sitemap_candidates(hosts: DataFrame, robots: DataFrame) -> DataFrame:
    """(host, url) to try: what robots files name, then the two usual places."""
    usual = hosts.select("host", F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.concat(F.lit("https://"), F.col("host"), F.lit(p)).alias("url")) for i, p in ((1, "/sitemap.xml"), (2, "/sitemap_index.xml"))])).alias("x")).select("host", "x.o", "x.url")
    named = robots.select("host", F.lit(0).alias("o"), F.explode("sitemaps").alias("url"))
    return named.unionByName(usual).groupBy("host", "url").agg(F.min("o").alias("place"))


def sitemap_table(entries: DataFrame) -> DataFrame:
    """One row for each (crawl_id, url), the first kept."""
    first = Window.partitionBy("crawl_id", "url").orderBy(F.col("lastmod").asc_nulls_last(), "changefreq", "priority")
    return entries.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n").withColumn("source", F.lit("sitemap_xml"))
