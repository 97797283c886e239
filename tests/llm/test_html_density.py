import re
from html import unescape

import duckdb
import pytest

from cellgrid.llm import html_density
from cellgrid.llm.html_density import extract_pages, main_text, parse, score
from tests.conftest import TESTDATA

from .helpers import with_clashes


def article_by_hand(html):
    """What the test pages hold between their article tags."""
    inside = html[html.index("<article>") + 9 : html.rindex("</article>")]
    lines = (" ".join(unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inside))
    return "\n".join(x for x in lines if x)


def test_all_pages_of_the_test_table():
    for (html,) in duckdb.sql(f"SELECT html FROM '{TESTDATA}/sf0.01/pages.parquet'").fetchall():
        assert main_text(html) == article_by_hand(html)


def test_page_furniture_goes():
    long = "A paragraph that is long enough to count as the text of the page, with some more words. "
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p > a {{}}</style></head><body class="has-sidebar">
    <header><h1>Site</h1><ul><li><a href=/a>A</a></ul></header><div id="cookie-notice">We use cookies.</div>
    <div class="wrap"><div class="sidebar"><p>{long}</p></div><div class="content"><h2>Title &amp; more</h2><p>First <i>para</i>graph
      with <a href=q>a link</a>.<p>Second&nbsp; one &#8211; &eacute;&copy;<br>next line<ul><li>item one<li>item two</ul>
    <form><p>Sign up now</p><input></form><script>var t = "<p>no</p>";</script><!-- <p>no</p> --><p>{long}</p></div></div>
    <section id="comments"><article class="comment"><p>{long * 3}</p></article></section><footer>&copy; foot</footer></body></html>"""
    assert main_text(page) == "\n".join(
        ["Title & more", "First paragraph with a link.", "Second one – é©", "next line", "item one", "item two", long.strip()]
    )


INLINE = sorted(html_density._INLINE - html_density._VOID)


@pytest.mark.parametrize("tag", INLINE)
def test_nested_element_of_a_dropped_one_ends_nothing(tag):
    for inner in (tag, "div", "span"):
        page = f'<body><p>First words of the page.</p><{tag} class="share"><{inner}>Tweet</{inner}></{tag}><p>END of the words.</p></body>'
        assert main_text(page) == "First words of the page.\nEND of the words."
        page = f'<body><p>First words of the page.</p><{tag} hidden><{inner}>Tweet<{inner}>x</{inner}></{inner}></{tag}><p>END of the words.</p></body>'
        assert main_text(page) == "First words of the page.\nEND of the words."


@pytest.mark.parametrize("name", [
    "content has-sidebar", "no-ads", "content-with-sidebar", "legal-news", "ad-free", "page menu-open", "post sponsored", "withoutComments", "sidebar-left layout",
])
def test_a_name_alone_does_not_lose_the_article(name):
    p = "<p>Some words of a paragraph that goes on for a while.</p>"
    text = "\n".join(["Some words of a paragraph that goes on for a while."] * 6)
    for attribute in ("class", "id"):
        assert main_text(f'<body><div {attribute}="{name}">{p * 6}</div><div><a href=1>Home</a></div></body>').startswith(text)


def test_names_inside_an_article():
    p = "<p>Some words of a paragraph that goes on for a while.</p>"
    page = f'<body><article><h2 id="legal">Title</h2>{p}<p class="ad-free">Kept.</p><p id="notice">Kept too.</p><div class="related">Gone.</div>{p}</article></body>'
    assert main_text(page).split("\n")[0] == "Title" and "Kept." in main_text(page) and "Kept too." in main_text(page) and "Gone" not in main_text(page)


def test_long_comments_do_not_win_over_a_short_article():
    page = "<body><div class=post><p>A short article of one sentence.</p></div><div id=comments>" + "<p>One more long opinion of a reader, at length.</p>" * 20 + "</div></body>"
    assert main_text(page) == "A short article of one sentence."


def test_sections_beside_the_core_stay():
    p = "<p>Some words of a paragraph that goes on for a while.</p>"
    page = f"<body><div><div>{p * 3}</div><div>{p}<p>Short.</p></div><div><a href=1>x</a> <a href=2>yy</a> <a href=3>zz</a></div></div></body>"
    assert main_text(page).count("\n") == 4 and main_text(page).endswith("Short.")


def test_odd_input():
    assert main_text(None) == main_text("") == main_text("<!-- open") == main_text("<script>x") == main_text("<p></p>") == ""
    assert main_text("plain <b>text</b>") == "plain text" and main_text("a < b <") == "a < b <"
    assert main_text("<p>x") == "x" and main_text("</div></p>y<p") == "y<p"
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert len(main_text("<body><article><p>" + "word " * 200_000 + "</p></article></body>")) == 200_000 * 5 - 1


def test_density_falls_with_links():
    root = parse("<body><div>" + "text " * 40 + "</div><div><a href=x>" + "text " * 40 + "</a></div></body>")
    plain, linked = [n for n in score(root) if n.tag == "div"]
    assert sorted([plain.density, linked.density])[0] == (linked if linked.link_chars else plain).density


def test_frame(spark):
    rows = [(1, "u", "<p>one</p>"), (2, None, None), (None, "u", ""), (3, "u", "<p>a\U0001f642 b"), (3, "u", "<p>a\U0001f642 b")]
    df = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted(map(str, (tuple(r) for r in extract_pages(df).collect())))
    assert got == sorted(map(str, [(1, "u", "one", 3), (2, None, "", 0), (None, "u", "", 0), (3, "u", "a\U0001f642 b", 4), (3, "u", "a\U0001f642 b", 4)]))
    assert extract_pages(df.limit(0)).count() == 0
