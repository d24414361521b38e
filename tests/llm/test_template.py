"""Main texts of pages: markup of many kinds, site templates, and the whole table against its own articles."""

from __future__ import annotations

import html
import re

import pytest

from heliospark.llm.template import Page, extract

CASES = {
    "article": ("<nav>Menu</nav><article><h1>Title</h1><p>One <b>bo</b>ld.<p>Two&amp;more &eacute;&#33;</article><footer>f</footer>", "Title One bold. Two&more é!"),
    "broken": ("<article><p><b>Bold.<br><p>Next</p></b> tail<ul><li>a<li>b</ul></article><p>after", "Bold. Next tail a b"),
    "inner boilerplate": (
        "<main><h1>T</h1><div class='share-buttons'>Share</div><p>Text</p><aside>Side</aside><form><input>Mail</form>"
        "<div id='comments'><article class='comment'><p>Nice</p></article></div><p class='ad'>Buy</p><button>OK</button></main>",
        "T Text",
    ),
    "headers": ("<header><h1>Site</h1></header><article><header><h1>Head</h1></header><header>Logo</header><p>x</p></article>", "Head x"),
    "related": ("<div class=related><article>Teaser</article></div><div class=page><main>Text</main></div>", "Text"),
    "layout": ("<div class=page-sidebar-left><main>Text</main></div>", "Text"),
    "wrapped in a form": ("<form id=f><article><p>Text</p></article></form>", "Text"),
    "by class": ("<div class='menu'><a href=/>x</a></div><div class='post-content'><p>A long enough text.</p></div><div>Bye</div>", "A long enough text."),
    "no main part": ("<body><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul><p>Text <a href=4>link</a></p></body>", "Text link"),
    "quotes": ("""<article><p title="a>b" data-x='"'>x</p><p class=a">y "z"</p><p title="open>w</p></article>""", 'x y "z" w'),
    "script": ("<article><script>if (a<b) '</p>'</script><style>p{}</style><p>1 < 2 & 3 &gt; 2</p><!-- <p>no --></article>", "1 < 2 & 3 > 2"),
    "cut off": ("<article><p>text &am</article><p class=", "text &am"),
    "open comment": ("<article>a<!-- b</article>", "a"),
    "space": ("<article>\n a\t\xa0 b<br>c<wbr>d<p> e </article>", "a b cd e"),
    "plain": ("just text", "just text"),
    "empty": ("", ""),
    "table": ("<article><table><tr><td>1<td>2<tr><th>3</table><dl><dt>a<dd>b</dl></article>", "1 2 3 a b"),
}


@pytest.mark.parametrize("name", CASES)
def test_page(name):
    source, text = CASES[name]
    assert Page(source).main_text(frozenset()) == text


def test_deep_and_wide_pages_end():
    assert Page("<div>" * 20_000 + "x").main_text(frozenset()) == "x"
    assert Page("<p><b>" * 20_000 + "x").main_text(frozenset()) == "x"
    assert len(Page("<a<" * 20_000).main_text(frozenset())) < 60_001


SCHEMA = "page_id long, url string, html string, host string, templates string, node long, text int"


def texts(spark, rows):
    out = extract(spark.createDataFrame([(i, u, h, "h", "t", 1, 2) for i, u, h in rows], SCHEMA).repartition(3))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert all(r.n_chars == len(r.text) for r in out.collect())
    return sorted(((r.page_id, r.text) for r in out.collect()), key=repr)


def test_templates_of_a_host_go(spark):
    notice = "<div><p>Our shop has moved.</p></div>"
    page = lambda k, extra: f"<body>{extra}<div><h1>T{k}</h1><p>Text number {k} of this page.</p></div><div>End</div></body>"
    rows = [(k, f"http://A.org/{k}", page(k, notice)) for k in range(6)]
    rows += [(10, "http://b.org/", page(10, notice)), (None, None, None), (11, "nothing", ""), (12, "http://b.org/", page(10, notice))]
    expected = [(k, f"T{k} Text number {k} of this page.") for k in range(6)]
    other = "Our shop has moved. T10 Text number 10 of this page. End"
    assert texts(spark, rows) == sorted(expected + [(10, other), (12, other), (None, ""), (11, "")], key=repr)


def test_repeated_articles_and_their_paragraphs_stay(spark):
    line = "<p>This text may be copied freely.</p>"
    rows = [(k, "http://a.org/", f"<nav>n{k}</nav><article><p>Same text</p>{line}</article>") for k in range(20)]
    rows += [(k, "http://a.org/", f"<nav>n{k}</nav><article><p>Text {k}</p>{line}<div>Read our other pages!</div></article>") for k in range(20, 40)]
    rows += [(k, "http://c.org/", f"<div><div><p>Same text</p>{line}</div></div><div>n{k}</div>") for k in range(40, 50)]
    expected = [(k, "Same text This text may be copied freely.") for k in range(20)]
    expected += [(k, f"Text {k} This text may be copied freely.") for k in range(20, 40)]
    expected += [(k, f"Same text This text may be copied freely. n{k}") for k in range(40, 50)]
    assert texts(spark, rows) == sorted(expected, key=repr)


def test_no_pages(spark):
    assert texts(spark, []) == []


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        inside = re.search("<article>(.*)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub("</?(p|h1|br)>", " ", inside).replace("<b>", "").replace("</b>", "")).split())
