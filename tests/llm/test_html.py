import re
from html import unescape

import pytest

from placebook.llm import html
from placebook.llm.queries import op9_html_extraction

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="</p><article>no</article>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li><li><a href="/x">More</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><div class="ad">Buy this now, it is cheap and good for you and all of your friends.</div>
{body}
<aside>Aside text</aside><form><label>Mail</label><input><button>Send</button></form><footer>&copy; somebody</footer></body></html>"""
LONG = "A sentence of some length that fills a paragraph with words, and then some more of them."


def test_articles():
    body = f"<article><h1>Title &amp; more</h1><p><b>{LONG}<br><p>Short.</p><p>{LONG} a<i>b</i>c &lt;x&gt;</p><nav>no</nav><div class='share'>no</div><footer>no</footer></article>"
    body += "<section id='comments'><article class='comment'><p>" + LONG * 5 + "</p></article></section>"
    assert html.main_text(PAGE.format(body=body)) == f"Title & more {LONG} Short. {LONG} abc <x>"


@pytest.mark.parametrize("open_tag, close_tag", [("<main>", "</main>"), ("<div id='content'>", "</div>"), ("<table><tr><td>", "</td></tr></table>"), ("", "")])
def test_pages_without_articles(open_tag, close_tag):
    body = f"{open_tag}<h2>Title</h2><p>{LONG}</p><p>Short.</p><p>{LONG}\n\t{LONG}</p><ul><li>One</li><li>Two</li></ul>{close_tag}<div class='comments'>{LONG * 9}</div>"
    assert html.main_text(PAGE.format(body=body)) == f"Title {LONG} Short. {LONG} {LONG} One Two"


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<!--", "</article>", "<script>x", "<article></article>", "<nav>a</nav>"])
def test_pages_without_text(page):
    assert html.main_text(page) in ("", "<")


def test_odd_pages():
    assert html.main_text("just words") == "just words"
    assert html.main_text("<article><p>cut off he&amp") == "cut off he&"
    assert html.main_text("<article><p>cut off<p class='x") == "cut off"
    assert html.main_text("<article><div>a</nav></span>b</div></div>c") == "a b c"
    assert html.main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert html.main_text("<article><p>" + "word " * 200_000) == " ".join(["word"] * 200_000)
    pieces = "<article>" + f"<p>{LONG} &eacute;&#233;</p>" * 3000
    assert html.main_text(pieces) == " ".join([f"{LONG} éé"] * 3000)


def test_smoothing_keeps_short_lines_among_long_ones():
    values = [1.0, 1.0, 1.0, 90.0, 80.0, 2.0, 90.0, 85.0, 1.0, 1.0, 1.0]
    assert html.smoothed(values)[5] > 20 > html.smoothed(values)[0]
    assert html.smoothed([4.0] * 5) == pytest.approx([4.0] * 5)


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, "u", "<article>é a</article>", "y"), (2, "u", "<article>é a</article>", "y")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html.extract(df).collect()) == [(1, "", 0), (2, "é a", 3), (2, "é a", 3)]
    assert html.extract(df.limit(0)).count() == 0


def test_query_gives_the_articles_of_the_given_pages(spark, sf_dir):
    """These pages mark their article; its text without tags is what a pattern finds."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op9_html_extraction(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for row in rows:
        inner = re.search(r"(?s)<article>(.*?)(</article>|$)", pages[row.page_id])
        plain = unescape(re.sub(r"<[^>]*(>|$)", " ", re.sub(r"</?[bia]\b[^>]*>", "", inner[1]))) if inner else ""
        assert row.text == " ".join(plain.split()) and row.n_chars == len(row.text)


@pytest.mark.parametrize("wrapper", ["div class='content-sidebar-wrap'", "div class='with-sidebar'", "section id='search-results'", "div class='ad-free'", "form action='/'", "div role='form'"])
@pytest.mark.parametrize("inner", ["<main><article>{}</article></main>", "<article>{}</article>", "<div>{}</div>"])
def test_containers_that_hold_the_main_text_are_not_apart(wrapper, inner):
    text = f"<h2>Title</h2><p>{LONG}</p><p>Short.</p><div class='sidebar'>{LONG}</div><p>{LONG} {LONG} {LONG}</p>"
    body = f"<{wrapper}>{inner.format(text)}<div class='related'><article>{LONG}</article></div></{wrapper.split()[0]}>"
    if "article" not in inner:
        body = body.replace("article", "p")
    assert html.main_text(PAGE.format(body=body)) == f"Title {LONG} Short. {LONG} {LONG} {LONG}"
    assert html.main_text(f"<form><p>{LONG}</p><div class='wrap'><div class='ad'>x</div><p>{LONG}</p></div></form>") == f"{LONG} {LONG}"


def test_adverts_within_an_article():
    link = "<a href='/x'>Buy this</a>"
    body = f"<article><p>{LONG}</p><p class='ad'>Cheap {LONG}<br>and good</p><p>{LONG}</p><p>Short.</p>" + f"<p>{LONG}</p>" * 4 + f"<div>{link}</div><div>{link}</div><div>{link}</div><div>{link}</div><div>{link}</div></article>"
    got = html.main_text(PAGE.format(body=body))
    assert got.startswith(f"{LONG} {LONG} Short. {LONG}") and "Cheap" not in got and "good" not in got and got.count("Buy this") <= 2
