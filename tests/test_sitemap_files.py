"""Sitemap files as they are met: packed, cut off, with foreign elements and markup that is not well formed."""

import gzip
import random

import pytest

from crawlspan.sources import sitemaps

ENTRY = "<url><loc>https://t/{}</loc><priority>0.{}</priority></url>"


def read(body, encoding=None):
    rows = []
    reader = sitemaps._Reader(encoding)
    for piece in sitemaps.pieces(body):
        reader.feed(piece)
        rows += reader.found
        reader.found.clear()
    return rows


def locations(body, encoding=None):
    return [r[1] for r in read(body.encode() if isinstance(body, str) else body, encoding)]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<urlset><url><image:image><image:loc>https://i/</image:loc></image:image><loc>https://t/</loc></url></urlset>", ["https://t/"]),
        ("<urlset><url><loc><![CDATA[https://t/?a=1&b]]>&#38;c&amp;d&#x26;e</loc></url></urlset>", ["https://t/?a=1&b&c&d&e"]),
        ("<urlset><url><loc>https://t/?a=1&b=2</loc></url><url><loc>https://t/next</loc></url></urlset>", ["https://t/next"]),
        ("<urlset><url><loc>https://t/1</loc></url><url><loc>https://t/2</url><url><loc>https://t/3</loc></url>", ["https://t/1", "https://t/3"]),
        ("<urlset><url><loc>caf&eacute;&nbsp;x&unknown;</loc></url></urlset>", ["café x"]),
        ("<s:urlset xmlns:s='u'><s:url><s:loc> https://t/ </s:loc></s:url></s:urlset>", ["https://t/"]),
        ("<sitemapindex><sitemap><loc>https://t/s.xml</loc></sitemap><url><loc>https://no/</loc></url></sitemapindex>", ["https://t/s.xml"]),
        ("<urlset><sitemap><loc>https://no/</loc></sitemap><url><loc>https://t/</loc></url></urlset>", ["https://t/"]),
        ("<urlset><url><lastmod>x</lastmod></url><url><loc/></url><url><loc> </loc></url></urlset>", []),
        ('<?xml version="1.0" encoding="ISO-8859-1"?><urlset><url><loc>https://t/é</loc></url></urlset>'.encode("latin-1"), ["https://t/é"]),
        ('<?xml version="1.0" encoding="UTF-16"?><urlset><url><loc>https://t/é</loc></url></urlset>'.encode("utf-16"), ["https://t/é"]),
        ('<!DOCTYPE urlset [<!ENTITY a "x"><!ENTITY e SYSTEM "file:///etc/passwd">]><urlset><url><loc>https://t/&a;&e;</loc></url></urlset>', ["https://t/x"]),
        ("", []), ("no xml at all", []), ("<html><body><p>Not found", []), (b"\x1f\x8bbroken", []), (b"\xff\xfe\x00", []), ("<urlset>" + "<a>" * 50_000, []),
    ],
)
def test_files(body, want):
    assert locations(body) == want


def test_a_cut_pack_keeps_what_was_read():
    body = "<urlset>" + "".join(ENTRY.format(random.Random(i).random(), i % 10) for i in range(5000)) + "</urlset>"
    packed = gzip.compress(body.encode())
    whole = locations(body)
    for cut in (0, 1, 5, 30, len(packed) // 2, len(packed) - 9, len(packed)):
        got = locations(packed[:cut])
        assert got == whole[: len(got)] and len(got) >= 0.9 * 5000 * (cut / len(packed)) - 1500
    assert locations(packed) == whole and locations(packed[:-9])[:4900] == whole[:4900]
    broken = bytearray(packed)
    broken[len(packed) // 2] ^= 0xFF
    assert locations(bytes(broken))[:500] == whole[:500]
    assert locations(gzip.compress(body[:60000].encode()) + gzip.compress(body[60000:].encode())) == whole


@pytest.mark.parametrize("piece", [1, 7, 64, 1000])
def test_pieces_make_no_difference(monkeypatch, piece):
    rng = random.Random(piece)
    faults = ["", "<url><loc>a&b</loc></url>", "<url><loc>x</url>", "<url", "</nothing>", "<url><loc>&#0;</loc></url>", "<b><url><loc>deep</loc></url></b>"]
    body = "<urlset>" + "".join(ENTRY.format(i, i % 10) + rng.choice(faults) for i in range(60)) + "</urlset>"
    whole = locations(body)
    monkeypatch.setattr(sitemaps, "PIECE", piece)
    assert locations(body) == whole == locations(gzip.compress(body.encode())) and len(whole) >= 50


def test_columns(spark):
    """Text and bytes, nulls, repeated rows, an empty table."""
    body = "<urlset>" + ENTRY.format(1, 5) + "<url><loc>https://t/2</loc><priority>high</priority></url></urlset>"
    text = spark.createDataFrame([("a", body), ("a", body), ("n", None), (None, body)], "url string, body string")
    want = [("https://t/1", 0.5), ("https://t/2", None)]
    assert sorted((r["url"], r["priority"]) for r in sitemaps.sitemap_entries(text).collect()) == sorted(want * 3, key=str)
    packed = spark.createDataFrame([("a", bytearray(gzip.compress(body.encode())))], "url string, body binary")
    assert [(r["url"], r["priority"]) for r in sitemaps.sitemap_entries(packed).collect()] == want
    assert sitemaps.sitemap_entries(text.limit(0)).collect() == [] and sitemaps.sitemap_children(text).collect() == []
    index = "<sitemapindex><sitemap><loc>{}</loc></sitemap></sitemapindex>"
    loop = spark.createDataFrame([("r", index.format("s")), ("s", index.format("r")), ("x", body)], "url string, body string")
    assert sitemaps.expand_sitemaps(loop.filter("url = 'r'"), loop).collect() == []
    chain = spark.createDataFrame([("r", index.format("s")), ("s", index.format("x")), ("x", body)], "url string, body string")
    assert sorted(r["url"] for r in sitemaps.expand_sitemaps(chain.filter("url = 'r'"), chain).collect()) == ["https://t/1", "https://t/2"]
