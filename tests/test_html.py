import random
import re
from html import unescape

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelake.functions.html import absolute_links, html_to_text, parse_pages, read_page, sanitize
from pagelake.operators.pages import article_table, link_edges, main_content_table, page_metadata, page_parts, sanitize_table
from pagelake.plans.extract import article_documents, extract_pages, judge_pages
from pagelake.sources.tables import read_fixture

from conftest import SF

LONG = "A sentence that carries enough words to count as content of a page. " * 3

# one small page for each thing that matters
KNOTS = f"<!doctype html>\n<meta charset=utf-8><title>Bowline | Rope Room</title>\n<div id=content><ol><li>{LONG * 2}</ol></div>"
LOUD = f"<main><style>.x{{}}</style>{LONG * 2}<script src=x.js></script><b>dry</b> rope holds</main><h1>Loud page</h1>"
GLAZE = f"<p>outside</p><title>Ash glaze</title><article>{LONG * 2}<em>Cone ten.</em></article><p>after</p>"
SOIL = f'<meta property="og:site_name" content="Field Desk"><h1>Clay soils</h1><section class="post">{LONG * 2}<a href="loam.html">loam</a> <img src="/pit.gif"></section>'
NOTE = "<title>Gone fishing</title><body>Back on Monday."
OPEN = "<h1>Tackle</h1><body><ul><li>reel<li>line<b>hook"


def _pages(spark, *htmls):
    return spark.createDataFrame([(i, "https://example.com/dir/page", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_short_pages_are_rejected(spark):
    kept, thrown = extract_pages(_pages(spark, NOTE, GLAZE, OPEN))
    assert [r.page_id for r in kept.collect()] == [1]
    assert sorted((r.page_id, r.reason) for r in thrown.collect()) == [(0, "too_short"), (2, "too_short")]


@pytest.mark.parametrize(
    "html,title,site",
    [(KNOTS, "Bowline | Rope Room", "Rope Room"), (LOUD, "Loud page", None), (GLAZE, "Ash glaze", None), (SOIL, "Clay soils", "Field Desk")],
    ids=["site in the title", "heading only", "title after text", "site in a meta tag"],
)
def test_names_of_kept_pages(spark, html, title, site):
    row = extract_pages(_pages(spark, html))[0].first()
    assert (row.title, row.site_name) == (title, site)


def test_references_of_kept_pages_are_absolute(spark):
    html = extract_pages(_pages(spark, SOIL))[0].first().clean_html
    assert re.findall(r'(?:href|src)="([^"]*)"', html) == ["https://example.com/dir/loam.html", "https://example.com/pit.gif"]


def test_main_part_is_kept_alone(spark):
    row = extract_pages(_pages(spark, GLAZE))[0].first()
    assert row.text.endswith("Cone ten.") and "outside" not in row.text and "after" not in row.text


def test_scripts_and_styles_leave_the_markup(spark):
    html = extract_pages(_pages(spark, LOUD))[0].first().clean_html
    assert "<b>dry</b> rope holds" in html and not re.search(r"<(script|style)|x\.js|\.x", html)


def test_no_title_and_no_text(spark):
    judged = judge_pages(_pages(spark, f"<body><p>{LONG}</p></body>", "<title>T</title><body> \n </body>"))
    assert {r.page_id: r.reason for r in judged.collect()} == {0: "no_title", 1: "no_text"}


def test_titles(spark):
    cases = {
        '<meta property="og:title" content=""><title>T</title>': "",
        "<title> </title><title> Second </title>": "Second",
        "<h1>  </h1><h1><b>Head</b> line</h1>": "Head line",
        "<p>nothing</p>": None,
        "<title>A &amp; B</title>": "A & B",
        "<title>cut &amp</title>": "cut &",
        '<meta content="Turned" property="og:title">': "Turned",
    }
    rows = page_metadata(_pages(spark, *cases)).collect()
    assert {r.html: r.title for r in rows} == cases
    assert {h: read_page(h)[0] for h in cases} == cases


def test_site_names(spark):
    cases = {
        "<title>A | B - C - D</title>": "D",
        "<title>A - B | C</title>": "B | C",
        "<title>A | B | C </title>": "C ",
        "<title>Plain</title>": None,
        "<title></title><title>X - Y</title>": None,
        '<meta property="og:site_name" content="S"><title>X - Y</title>': "S",
    }
    rows = page_metadata(_pages(spark, *cases)).collect()
    assert {r.html: r.site_name for r in rows} == cases
    assert {h: read_page(h)[1] for h in cases} == cases


@pytest.mark.parametrize(
    "html,selector",
    [
        (f"<body><main>{LONG}</main><article>short</article></body>", "main"),
        (f"<body><div role='main'>{LONG}</div></body>", "[role='main']"),
        (f"<body><div class='x content y'>{LONG}</div></body>", ".content"),
        (f"<body><div class='post'>{LONG}</div><div class='content'>no</div></body>", ".post"),
        (f"<body><div class='article'>{LONG}</div></body>", ".article"),
        (f"<body><div id='content'>{LONG}</div></body>", "#content"),
        (f"<body><div id='main'>{LONG}</div></body>", "#main"),
        (f"<body><div class='entry-content'>{LONG}</div></body>", ".entry-content"),
        (f"<body><div class='other'>{LONG}</div></body>", "body"),
        (f"<body><article>short</article><article>{LONG}</article></body>", "article"),
    ],
)
def test_selector_cascade(html, selector):
    _, _, text, source, found = read_page(html)
    assert found == selector
    assert LONG in text and LONG in source


def test_limit_is_bytes_and_strict():
    # 50 two-byte letters are 100 bytes: not more than 100
    assert read_page(f"<body><article>{'é' * 50}</article></body>")[4] == "body"
    assert read_page(f"<body><article>{'é' * 50}x</article></body>")[4] == "article"


def test_body_keeps_script_text_and_unclosed_elements():
    assert read_page("<body><nav>N</nav><script>var x;</script>T")[2] == "Nvar x;T"
    assert read_page(f"<body><article><p>{LONG}<b>open")[2] == LONG + "open"


def test_columns_equal_parser(spark):
    """On regular pages the JVM columns give what the parser gives, on supplied and on odd pages."""
    pages = read_fixture(spark, SF, "pages").select("page_id", "url", "html")
    odd = [KNOTS, LOUD, GLAZE, SOIL, NOTE, OPEN, f"<article>{LONG}<!-- no --></article>", f"<article>{LONG} 1 < 2</article>",
           f"<article>{LONG}&eacute;</article>", f"<article>{LONG}<article>in</article></article>", f"<ARTICLE class=x>{LONG}</ARTICLE >",
           f"<title>a&#39;b</title><article>{LONG}</article>", f"<article>{LONG}<script>x</script></article>", f"</article><article>{LONG}",
           f"<!-- <article>{LONG} old</article> --><main>{LONG} new</main>", f"<script>x = '<article>{LONG}</article>'</script><main>{LONG}</main>",
           f"<!-- <title>Old</title> --><title>New</title><article>{LONG}</article>", f"<script>'<title>JS</title>'</script><title>New</title><article>{LONG}</article>",
           f'<article><p title="a>b">{LONG}</p></article>', f'<p title="<article>">x</p><article>{LONG}</article>', f"<article>{LONG}<!-- cut",
           f"<title>A &mdash; B&#8217;s</title><article>{LONG}</article>", f"<title>a <!-- b --> c</title><article>{LONG}</article>",
           f"<style>a>b</style><article>{LONG}</article><style>c", f"<textarea><article></textarea><article>{LONG}</article>", f"<article>{LONG}\r\n</article>",
           f"<article><p title='it\"s'>{LONG}</p></article>", f"<script src=\"a>b\">'<article>'</script><article>{LONG}</article>"]
    both = page_parts(pages.unionByName(_pages(spark, *odd))).withColumn("p", parse_pages("html"))
    for r in both.collect():
        assert (r.title, r.site_name, r.main_text, r.main_html, r.selector) == (
            r.p.title, r.p.site_name, r.p.text, r.p.html, r.p.selector
        ), r.html[:300]


def test_columns_equal_parser_on_random_pages(spark):
    """Titles that nest, stay open or come twice, articles inside them and around them, comments and entities."""
    rnd = random.Random(7)
    bits = ["<title>", "</title>", "<title>", "</title>", "<article>", "</article>", f"<article>{LONG}", "</article>", "<!doctype html>", "<br/>", "<body>", "<h1>head</h1>",
            "<li>x", "~", "a &amp; b", "&eacute;", "<!-- c -->", "<p class='k'>", "</p>", "one - two", "three | four", "<script>s</script>", "<textarea>", "</textarea>"]
    htmls = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 14))) for _ in range(3000)]
    htmls += [f"<title><!doctype html><article>{LONG}</article><br/>", f"<title><article>{LONG}</article><body><li>x<li>y</article>", f"<article>{LONG}</article><title>late",
              f"<title>a<title>b</title><article>{LONG}</article>", f"</title><article>{LONG}</article>"]
    both = page_parts(_pages(spark, *htmls)).withColumn("p", parse_pages("html"))
    for r in both.collect():
        assert (r.title, r.site_name, r.main_text, r.main_html, r.selector) == (
            r.p.title, r.p.site_name, r.p.text, r.p.html, r.p.selector
        ), r.html


def test_metadata_and_articles_equal_parser(spark):
    odd = [f"<!-- <title>Old</title> --><title>New</title><article>{LONG}</article>", "<title>A &mdash; B&#8217;s - C</title>",
           f"<article>{LONG}<article>inner</article> after</article>", f"<script>'<article>{LONG}</article>'</script><main>{LONG}</main>"]
    for r in article_documents(_pages(spark, *odd).withColumn("source", F.col("html"))).collect():
        title, site, text, _, selector = read_page(r.source)
        assert (r.title, r.site_name) == (title, site)
        assert (r.text or "").split() == (text.split() if selector == "article" else [])


def test_article_columns(spark):
    pages = _pages(spark, f"<article>no</article><article>{LONG}</article>", "<p>none</p>")
    assert [r.main_text for r in article_table(pages).orderBy("page_id").collect()] == [LONG, None]
    assert article_documents(_pages(spark, GLAZE)).first().reason is None
    assert main_content_table(pages).filter("selector = 'article'").count() == 1


def test_html_to_text(one):
    html = "a<br>b<!-- <i>c</i> --><p class='x>y'>d &lt;e&gt; &amp;lt; &copy;</p>"
    assert one(html_to_text("h"), h=html.replace("'x>y'", "'x'")) == "abd <e> &lt; ©"


def test_links(spark):
    html = """<a href="/a">x</a><a href='/single'>y</a><a href=/bare>z</a><img src="i/p.png"><a href="http://Other.org">o</a>"""
    rows = link_edges(_pages(spark, html)).orderBy("kind", "pos").collect()
    assert [(r.kind, r.pos, r.raw, r.absolute, r.host) for r in rows] == [
        ("href", 0, "/a", "https://example.com/a", "example.com"),
        ("href", 1, "http://Other.org", "http://other.org/", "other.org"),
        ("src", 0, "i/p.png", "https://example.com/dir/i/p.png", "example.com"),
    ]


def test_sanitize():
    html = """<p onclick="x()">Hello world</p><script>alert('x')</script><style>b{}</style><!-- c --><iframe src="e"></iframe>
<a href="javascript:alert(1)" title="t">a</a><a href=" java\nscript:x">b</a><a href="/ok">c</a><form><b>bold"""
    out = sanitize(html)
    assert "<p>Hello world</p>" in out
    assert not any(bad in out for bad in ("script", "style", "onclick", "iframe", "<form", "<!--"))
    assert '<a title="t">a</a>' in out and '<a href="/ok">c</a>' in out and out.endswith("<b>bold</b>")


def test_absolute_links_touch_double_quotes_only():
    html = """<a href="/page">x</a><a href='/single'>y</a><img src="image.jpg"><a href="http://[bad">z</a>"""
    out = absolute_links(html, "https://example.com/article/")
    assert 'href="https://example.com/page"' in out and "href='/single'" in out
    assert 'src="https://example.com/article/image.jpg"' in out and 'href="http://[bad"' in out


def test_sanitize_table(spark):
    row = sanitize_table(_pages(spark, '<p><a href="/x">y</a></p><script>z</script>')).first()
    assert row.clean_html == '<p><a href="https://example.com/x">y</a></p>'


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"<>/=!-\"' &;abp\n", "<p>", "</p>", "<article>", "</article>", "<script>", "<!--", "&amp;", "é"]), max_size=60).map("".join))
def test_parser_never_fails(html):
    title, site, text, source, selector = read_page(html)
    assert isinstance(text, str) and isinstance(source, str) and selector
    assert "<script" not in sanitize(html).lower()


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_plain_text_survives_sanitising(text):
    plain = text.replace("<", "").replace("&", "").replace("\r", "").replace("\x00", "")
    assert unescape(sanitize(plain)) == plain


def test_batches_of_long_pages_are_bounded_by_bytes(spark):
    """A Python worker gets a few MB of pages at once, however many rows there are."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"mb": [batch.nbytes / 1e6]})

    pages = spark.range(400).coalesce(1).select(F.concat(F.lit("<p>"), F.repeat(F.lit("word "), 10_000), F.col("id")).alias("html"))
    found = [row["mb"] for row in pages.mapInArrow(sizes, "mb double").collect()]
    assert sum(found) > 19 and max(found) < 4
