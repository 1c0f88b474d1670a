"""Character references that no semicolon ends."""

import pytest

from crawlspan import registry
from crawlspan.operators import parse

CUT = '<title>a &amp; b &amp</title><script>x = a&amp</script><h1>c &#38</h1><a href="/p?page=2&ref=x&amp;y=1">d&quot;&am</a>'


@pytest.mark.parametrize(("bare", "title", "h1", "anchor"), [(True, "a & b &", "c &", 'd"&am'), (False, "a & b &amp", "c &#38", 'd"&am')])
def test_bare_references(bare, title, h1, anchor):
    got = dict(zip(parse.NAMES, parse.parse_html(CUT, "https://t.example/", "t.example", None, bare), strict=True))
    assert (got["title"], got["h1s"], got["links"][0]["anchor_text"]) == (title, [h1], anchor)
    assert got["links"][0]["href"] == "https://t.example/p?page=2&ref=x&y=1"


def test_scripts_and_comments_stay():
    for html in ("<script>a&amp b</script>", "<style>&amp", "<!-- <script> &amp -->", "&amp;&lt;x & y"):
        assert parse.bare_as_text(html) == html
    assert parse.bare_as_text("<!-- <script> -->&amp") == "<!-- <script> -->&amp;amp"


def test_queries_read_references_as_their_sql(spark, tmp_path):
    spark.createDataFrame([(1, "https://t.example/a", "<html><head><title>x &amp</title></head><body><h1>y &amp</h1> z &amp</body></html>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    row = registry.QUERIES["ext1_7_14_titles"](spark, str(tmp_path)).first()
    assert (row["title"], row["h1"]) == ("x &amp", "y &amp")
    assert registry.QUERIES["ext15_body_text"](spark, str(tmp_path)).first()["body_text"] == "y &amp z &amp"
