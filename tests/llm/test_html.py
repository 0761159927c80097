"""Main text of pages: a plain block splitter on the standard library's parser, pages of every odd kind, and the tree."""

import time
from html.parser import HTMLParser

import numpy as np
import pytest

from lorekeep.llm import html_extract, queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home"><header><h1>Site name</h1></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div id="cookie-notice">We use cookies to make this site work well for all of you, please agree to it now</div><article><h1>Head &amp; line</h1><p>First   <b>para</b>graph with caf&eacute;&nbsp;and <a href=x>a link</a> in it.
<p>Short.<script>if (a<b) document.write("<p>no</p>")</script><aside>Read our other long story about things that aren't part of this one at all</aside><section class="comments"><p>I liked this article very much and say so here in many words</p></section></article>
<form><p>Subscribe to the letter that we send each week to all of our readers</p></form><footer>&copy; all rights</footer>"""



class Plain(HTMLParser):
    """Blocks of pages without unseen surprises: (text, words in links, elements around it)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found, self.pieces, self.skip, self.link = [], [], [], 0, False

    def cut(self):
        words = "".join(t for t, _ in self.pieces).split()
        if words:
            self.found.append((" ".join(words), sum(len(t.split()) for t, a in self.pieces if a), tuple(self.open)))
        self.pieces = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.skip += 1
        elif tag == "br":
            self.pieces.append((" ", False))
        elif tag == "a":
            self.link = True
        elif tag in html_extract._BLOCK:
            self.cut()
            if tag in ("p", "li") and self.open and self.open[-1] in ("p", tag):
                self.open.pop()
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.skip -= 1
        elif tag == "a":
            self.link = False
        elif tag in html_extract._BLOCK:
            self.cut()
            while tag in self.open and self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.skip:
            self.pieces.append((data, self.link))


def plain_blocks(page):
    p = Plain()
    p.feed(page)
    p.close()
    p.cut()
    return p.found


@pytest.fixture(scope="module")
def tree():
    return html_extract.trained()


def text_of(page, tree):
    return html_extract.main_texts([page], tree)[0]


def test_html(tree):
    got = text_of(PAGE, tree)
    assert got == "Head & line\nFirst paragraph with café and a link in it.\nShort."
    assert text_of(PAGE.replace("<article>", '<div class="entry">').replace("</article>", "</div>"), tree) == got
    assert html_extract.main_texts(["", "<div>" * 50, "<p", "<!-- x", "<a href='"], tree)[:2] == ["", ""]


def test_all_pages_equal_a_plain_splitter(spark, small):
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op3_html_main_text(spark, small).collect()}
    assert got.keys() == rows.keys()
    for i, page in rows.items():
        want = plain_blocks(page or "")
        assert [(b.text, b.linked) for b in html_extract.blocks(page or "")] == [w[:2] for w in want]
        text = "\n".join(t for t, _, around in want if "article" in around)
        assert got[i] == (text, len(text))


def test_no_article_text_is_lost(tree):
    for page, want in (
        ("<article><p>a b</p><button>go<p>more words here</p></article><p>beside", "a b\nmore words here"),
        ("<article><p>a</p><select><option>x<p>b c</p><svg><p>d</p><canvas><p>e</p></article>", "a\nb c\nd\ne"),
        ("<article><p>where <math><mi>x</mi></math> is</p></article>", "where x is"),
        ("<article><p>one two</p><ul><li><a href=#>link text</a></li></ul></article>", "one two\nlink text"),
        ('<article class="share-holder-report article"><p>text here</p></article>', "text here"),
        ('<article class="footer-free-legal-analysis"><p>text here</p></article>', "text here"),
        ("<article><p>a<p>b<script>x < y</script><p>c <a href=#>d<p>e f g h i j k</article>", "a\nb\nc d\ne f g h i j k"),
        ("<form><nav><a>menu</a></nav><article><p>hello there</p></article></form>", "hello there"),
        ("<article><p>1 < 2 and 3 > 2 &lt;b&gt; &#x41; &amp;amp;</p><!-- never closed <p>c</p></article>", "1 < 2 and 3 > 2 <b> A &amp;\nc"),
        ("<article><pre>a\n\n  b\u00a0c</pre><table><tr><td>d<td>e</table></article>", "a b c\nd\ne"),
        ("<article><script>var a = 1;<p>b</p><p>c</p></article>", "b\nc"),
        ("<article><p title='a > b' data-x=\"</article>\">a</p></article>", "a"),
    ):
        assert text_of(page, tree) == want, page
    long = "w " * 400000
    assert text_of(f"<nav><a>m</a></nav><article><p>{long}</p></article>", tree) == long.strip()


def test_left_out(tree):
    for left in ("<form><p>{}</p></form>", "<aside><p>{}</p></aside>", "<footer>{}</footer>", "<nav>{}</nav>", "<div class='ad'>{}</div>", "<div id=comments><div class=comment><p>{}</p></div></div>", "<p hidden>{}</p>", "<div style='display:none'>{}</div>", "<button>{}</button>", "<dialog>{}</dialog>", "<div role=navigation>{}</div>", "<div class='cookie-notice'><p>{}</p></div>"):
        for n in (1, 8, 70):
            assert text_of(f"<article><h1>t</h1><p>{'a ' * 40}</p>{left.format('b ' * n)}<p>{'c ' * 30}</p></article>", tree).count("b") == 0, left
            assert text_of(f"<p>{'b ' * n}</p><article><p>{'a ' * 40}</p></article><div>{'b ' * n}</div>", tree).count("b") == 0


def test_names_that_tell(tree):
    run = "a " * 60
    for left in ("<div class=discussion><p>{}</p></div>", "<div id=disqus_thread><p>{}</p></div>", "<section class=user-comments><p>{}</p></section>", "<div class=gdpr-bar>{}</div>", "<div class='alert alert-box'>{}</div>", "<div class=x9-newsletter-q>{}</div>"):
        for page in ("<main><h1>t</h1><p>{run}</p>{left}<p>{run}</p></main>", "<article><p>{run}</p>{left}</article>"):
            assert "b" not in text_of(page.format(run=run, left=left.format("b " * 30)), tree), left
    assert "b" not in text_of(f"<div class=gdpr-bar>{'b ' * 20}</div><p>{run}</p><p>{run}</p><p>{run}</p>", tree)
    for kept in ("<div class=banner><h1>{}</h1></div>", "<div class=masthead><h1>{}</h1></div>", "<div class='post-comments-free text'><p>{}</p></div>", "<section class='panel-discussion-report'><p>{}</p></section>"):
        assert text_of(f"<article>{kept.format('b b b b')}<p>{run}</p></article>", tree).startswith("b b b b"), kept
    assert text_of(f"<article class=newsletter><p>{run}</p></article>", tree) == run.strip()
    # Without a marked article the neighbours decide: the same nine words among text, and among links.
    nine, link = "c " * 9, "<div><a href=#>d d</a></div>"
    assert "c" in text_of(f"<p>{run}</p><p>{run}</p><p>{nine}</p><p>{run}</p><p>{run}</p>", tree) and "c" not in text_of(f"{link * 4}<div>{nine}</div>{link * 4}", tree)


def test_the_tree_looks_at_neighbours(tree):
    x, y = html_extract.labelled()
    assert ((tree.predict(x) >= 0.5) == y).mean() > 0.98
    assert {"link_density", "link_density_before", "words_before", "words_behind"} <= tree.used()
    # The same block among running text, and between links.
    row = lambda before, dense: np.array([[9, 0.0, before, dense, 40 if dense == 0 else 2, dense, 0, 0]])
    assert tree.predict(row(40, 0.0)) >= 0.5 > tree.predict(row(2, 1.0))


def test_reading_takes_linear_time(tree):
    for page in ("<div>" * 60000 + "x</b>" * 60000, "<a " * 300000, '<a x=">' * 150001, "<a " + 'x="1" ' * 170000, "<script>" * 120000, "<span class=ad>" * 40000 + "<p>x" * 40000, "<!-- " * 200000, "<p>x</div>" * 100000, "<a>" * 300000, "<" * 1000000):
        start = time.perf_counter()
        html_extract.main_texts([page], tree)
        assert time.perf_counter() - start < 8


def test_html_of_odd_rows(odd, spark, small):
    extra = odd.selectExpr("doc_id as page_id", "source as url", "text as html", "'clash' as text", "1 as n_chars", "'clash' as k0")
    got = html_extract.extract(extra).collect()
    assert len(got) == extra.count() and [(r.text, r.n_chars) for r in got if r.page_id == 2] == [("", 0)]
    assert html_extract.extract(extra.limit(0)).count() == 0
    named = extra.selectExpr("concat('p', page_id) as page_id", "url", "html")
    assert "p7" in {r.page_id for r in html_extract.extract(named).collect()}
