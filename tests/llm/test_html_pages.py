"""Main text of pages labelled by hand, and of damaged pages."""

import time

import pytest

from crawlspan.llm import html_text
from tests.conftest import DATA

LONG = "This is a sentence of the article that has some words, a comma and a full stop. It goes on for a while, as articles do."
PAGES = {
    "blog": (
        f"""<html><head><title>Blog</title></head><body><header class="masthead"><a href="/">Home of the blog</a></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
        <main><article><h1>Of  trees</h1><p>{LONG}</p><ul><li>an oak</li><li>a lime &amp; an ash</li></ul><p>Ends here.</p></article>
        <section class="comments"><h2>Comments</h2><p>First! I like it a lot, thank you for writing it.</p></section></main>
        <aside class="sidebar"><p>About the author, who lives in a house.</p></aside><footer>Copyright 2024</footer></body></html>""",
        f"Of trees\n{LONG}\nan oak\na lime & an ash\nEnds here.",
    ),
    "own header": (
        f"""<body><header><p>Site name</p></header><article><header class="entry-header"><h1>My title</h1></header><p>{LONG}</p><footer>Filed under trees</footer></article></body>""",
        f"My title\n{LONG}",
    ),
    "no article": (
        f"""<body><div id="nav"><a href="/x">One</a> <a href="/y">Two</a></div><div class="content"><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><div class="footer"><a href="/z">Terms</a></div></body>""",
        f"Title\n{LONG}\n{LONG}",
    ),
    "notices and forms": (
        f"""<body><div class="cookie-notice"><p>We use cookies, as all do. Agree to it, or leave.</p></div><article><h1>T</h1><p>{LONG}</p><div class="ad"><p>Buy this fine thing now, it is cheap.</p></div>
        <form action="/s"><label>Mail</label><input name=m><button>Send</button></form><p>After&nbsp;it &#8212; the end.</p></article></body>""",
        f"T\n{LONG}\nAfter it — the end.",
    ),
    "formulas and fallbacks": (
        f"""<article><h1>Sums</h1><p>{LONG}</p><p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> holds.</p><object data="x.pdf"><p>See the paper instead.</p></object></article>""",
        f"Sums\n{LONG}\nThe sum a+b holds.\nSee the paper instead.",
    ),
    "table and code": (
        f"""<article><h2>Data</h2><p>{LONG}</p><table><tr><th>Year</th><th>Rain</th></tr><tr><td>2023</td><td>700 mm</td></tr></table><pre>x  =  1
y</pre><blockquote>So it is said.</blockquote></article>""",
        f"Data\n{LONG}\nYear\nRain\n2023\n700 mm\nx = 1 y\nSo it is said.",
    ),
    "scripts and comments": (
        f"""<!DOCTYPE html><!-- <article>no</article> --><body><script>document.write("<p>no</p>")</script><article><p>One<!-- not this --> line,<br>broken in two.</p><style>p {{}}</style><p>{LONG}</p></article><noscript>no</noscript>""",
        f"One line, broken in two.\n{LONG}",
    ),
    "unclosed": (f"""<body><ul class=menu><li><a href=/a>A<li><a href=/b>B</ul><article><h1>U</h1><p>{LONG}<p>Second <b>bold<p>Third</article>""", f"U\n{LONG}\nSecond bold\nThird"),
}


@pytest.fixture(scope="module")
def model(spark):
    return html_text.fit(spark.read.parquet(f"{DATA}/pages.parquet"))


@pytest.mark.parametrize("name", PAGES)
@pytest.mark.parametrize("trained", [True, False])
def test_pages_labelled_by_hand(model, name, trained):
    page, want = PAGES[name]
    assert html_text.extract(page, *(model if trained else (html_text.START, html_text.START_PAIR))) == want


@pytest.mark.parametrize("page", ["<b>" * 20_000 + "x" + "</i>" * 20_000, "<b>" * 20_000 + "<p>x</p>" * 20_000, "<main>" * 20_000 + "x", "<p>x<table>" * 10_000, "<a x='" * 20_000, "<li>" * 20_000], ids=["ends", "paragraphs", "mains", "tables", "quotes", "items"])
def test_damaged_pages_take_linear_time(page):
    began = time.process_time()
    html_text.extract("<main>" + page, html_text.START, html_text.START_PAIR)
    assert time.process_time() - began < 4


def test_odd_rows(spark):
    """Null pages and ids, repeated rows, an empty table, columns that the operator uses itself and names with a dot."""
    rows = [(1, "u", None, "t", 1), (1, "u", None, "t", 1), (None, None, "<article><p>x y.</p></article>", None, None)]
    df = spark.createDataFrame(rows, "`page.id` long, url string, `html.raw` string, text string, n_chars int")
    model = html_text.fit(df, html_col="html.raw", id_col="page.id")
    got = [tuple(r) for r in html_text.extract_pages(df, *model, id_col="page.id", html_col="html.raw").collect()]
    assert sorted(got, key=str) == [(1, "u", "", 0), (1, "u", "", 0), (None, None, "x y.", 4)]
    assert html_text.extract_pages(df.limit(0), *model, id_col="page.id", html_col="html.raw").collect() == []
