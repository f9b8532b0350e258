"""op13: main text of pages, against given pages and templates whose article is known."""

import html
import re
import time

import pytest
from tidewater.llm.html_extract import PAGE, Page, composite_density, extract, main_text
from tidewater.llm.q_html_extract import query

ARTICLE = ["A title of the day", "First paragraph with some words that go on for a while, and then some more of them.",
           "Short.", "Second paragraph & its <signs>, long enough to count as text of an article in any way.",
           "Third paragraph, with a link in the middle of it and words after the link, as articles have them."]
BODY = ("<h1>A title of the day</h1><p>First paragraph with <b>some</b> words\n that go on for a while, and then some more of them.</p><p>Short.</p>"
        "<p>Second paragraph &amp; its &lt;signs&gt;, long enough to count as text&nbsp;of an article in any way.<p>Third paragraph, with "
        "<a href='/x?a=1>2'>a link</a> in the middle of it<br>and words after the link, as articles have them.")
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Menu entry {i}</a></li>" for i in range(9)) + "</ul>"
LONG = "Reader says a lot here, and goes on and on about everything, with many words and few tags. " * 20
OUTSIDE = {
    "nav": f"<nav>{MENU}</nav>", "header": f"<header><h2>Site</h2><p>{LONG}</p>{MENU}</header>", "footer": f"<footer><p>{LONG}</p></footer>",
    "aside": f"<aside><p>{LONG}</p></aside>", "sidebar": f"<div id=sidebar><p>{LONG}</p></div>", "cookie": f"<div class='cookieNotice box'><p>{LONG}</p></div>",
    "ad": f'<div class="ad">{LONG}</div>', "ads": f"<section id='top-ads'>{LONG}</section>", "form": f"<form><label>Mail</label><p>{LONG}</p><button>Go</button></form>",
    "script": "<script>var t='</p>'; if (a<b) {x(\"<div>\")}</script>", "style": "<style>p>a{content:'<p>'}</style>", "note": "<!-- <p>no</p> -->",
    "comments": f"<section id='comments'><h2>Comments</h2><article class='comment'><p>{LONG}</p></article><div>{LONG}</div></section>",
    "comment list": f"<ol class=\"comment-list\"><li><p>{LONG}</p></li><li><p>{LONG}</p></li></ol>", "role": f"<div role=\"navigation\">{MENU}</div>",
    "noscript": f"<noscript>{LONG}</noscript>", "hidden": f"<div hidden><p>{LONG}</p></div><p style='display: none'>{LONG}</p>",
    "plain menu": f"<div>{MENU}</div>",
}
WRAPS = {
    "article": "<article>{}</article>", "main": "<main><div>{}</div></main>", "class": "<div class='content with-sidebar'>{}</div>",
    "nested": "<div><div id=page><section>{}</section></div></div>", "article in main": "<main class=has-sidebar><article class='post comments-open'>{}</article></main>",
    "article body": "<div class=page><article><header>{}</article></div>",
}


@pytest.mark.parametrize("wrap", WRAPS)
@pytest.mark.parametrize("extra", OUTSIDE)
def test_templates(wrap, extra):
    """Before and after the article, and all extras at once."""
    x, a = OUTSIDE[extra], WRAPS[wrap].format(BODY)
    want = "\n".join(ARTICLE)
    for page in (f"<html><head><title>T</title></head><body>{x}{a}</body></html>", f"<body>{a}{x}", f"{x}{a}{x}", "".join(OUTSIDE.values()) + a):
        assert main_text(page) == want, page[:200]


def test_inside_the_article():
    for x in ("ad", "ads", "form", "script", "style", "note", "comments", "comment list", "aside", "cookie", "nav", "footer", "hidden"):
        assert main_text(f"<body><article>{BODY}{OUTSIDE[x]}<p>End of it.</p></article>") == "\n".join([*ARTICLE, "End of it."]), x


def test_sections_without_names():
    page = f"<body><div>{MENU}</div><div><div><p>{LONG}</p><p>{LONG}</p></div><div><p>{LONG}</p><p>One more.</p></div></div><div>{MENU}</div></body>"
    assert main_text(page) == "\n".join([LONG.strip()] * 3 + ["One more."])


def test_density_falls_with_links():
    plain, linked = composite_density(1000, 5, 0, 0, 0.2), composite_density(1000, 5, 900, 5, 0.2)
    assert plain > 5 * linked and composite_density(0, 3, 0, 0, 0.1) == 0


def test_markup():
    assert main_text("") == main_text("<html></html>") == main_text("<script>x") == main_text("<!-- x") == ""
    assert main_text("just words") == "just words"
    assert main_text("<p>a < b and 1<2 &amp &am; &copy;&#65;&#x42;</p>") == "a < b and 1<2 & &am; ©AB"
    assert main_text("<p>one<p>two<ul><li>three<li>four</ul>five<table><tr><td>six<td>seven<tr><td>eight</table>") == "\n".join(
        "one two three four five six seven eight".split())
    assert main_text("<article><p>cut <b>off</b> he") == "cut off he" and main_text("<article><p>kept</p><p cla") == "kept"
    assert main_text("<p>a\t\n b<br/>c　d</p>") == "a b c d"
    assert main_text("<TITLE>t</TITLE><P>upper</P>") == "upper"
    assert main_text("<article><i>x<p>y</i>z</p></article>") == "x\nyz"


def test_tree():
    page = Page("<div><p>a<div>b</div></p></section></div>c")
    assert page.tag == ["#", "div", "p", "div"] and page.parent == [-1, 0, 1, 1]


@pytest.mark.parametrize("unit", ["<div>", "<b>", '<a b=">" ', "<", "<p>x", "</b>", "<!--", "&amp;", "<li>x<ul>", "<a b='>", "\"'=<a ", "<i><div><b></i>",
                                  "</div>", "<td>", "x " * 5, "<a class='"])
def test_long_pages_take_linear_time(unit):
    t = time.time()
    main_text(unit * (400_000 // len(unit)))
    assert time.time() - t < 20


def test_given_pages(spark):
    """The article element's blocks, by patterns."""
    got = {r.page_id: r for r in query(spark, "/root/testdata/sf0.01").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p.html, re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub(r"</?b>|<br>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", article))
        want = "\n".join(b for b in blocks if b)
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (want, len(want), p.url)


def test_nulls_repeats_and_extra_columns(spark):
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<p>ä</p>"), (2, "v", "")], "page_id long, url string, html string")
    got = extract(pages.selectExpr("*", "1 AS text", "'x' AS n_chars")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, None, "", 0), (1, None, "", 0), (None, "u", "ä", 1), (2, "v", "", 0)]))
    assert extract(pages.where("false")).collect() == [] and extract(pages).columns == [x.split()[0] for x in PAGE.split(", ")]
