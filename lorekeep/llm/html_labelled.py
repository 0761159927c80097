"""Labelled pages for the decision tree of html_extract.py, labelled by hand.

What is inside an element with `data-main` is article text, everything else isn't. `{40}` stands for a
run of 40 words, so that the layouts stay readable.
"""

from __future__ import annotations

import re

_WORDS = "the plain text of a page is set in blocks and each block has some words that a reader would read".split()

PAGES = (
    # a news page with all the usual marks
    """<header><a href=#>{2}</a><p>{9}</p></header><nav><ul><li><a href=#>{1}</a><li><a href=#>{2}</a><li><a href=#>{1}</a></ul></nav><div class=ad>{6}</div>
    <article data-main><h1>{9}</h1><p>{60}</p><p>{2}</p><h2>{4}</h2><p>{35} <a href=#>{3}</a> {12}</p><ul><li><a href=#>{4}</a><li><a href=#>{6}</a><li>{12}</ul><p>{90}</p><p>{1}</p></article>
    <aside><h3>{2}</h3><p>{45}</p></aside><section id=comments><h3>{2}</h3><p>{30}</p><p>{14}</p></section><footer><p>{14}</p><a href=#>{2}</a></footer>""",
    # an article between adverts and notices that nothing but their place tells apart
    """<p>{8}</p><nav><a href=#>{1}</a> <a href=#>{1}</a></nav><div>{12}</div><article data-main><h1>{7}</h1><p>{3}</p><p>{120}</p><p>{5}</p><p>{18} <a href=#>{9}</a></p></article><div>{22}</div><p>{40}</p><div>{3}</div><footer>{11}</footer>""",
    # main without article, with sections, a table and a quotation; a cookie notice and a form behind
    """<div class="cookie-notice"><p>{18}</p><button>{1}</button></div><main data-main><h1>{6}</h1><section><h2>{3}</h2><p>{80}</p><table><tr><td>{2}<td>{3}<tr><td>{1}<td>{1}</table><blockquote>{25}</blockquote></section><section><h2>{2}</h2><p>{8}</p><ol><li>{4}<li>{15}</ol></section></main>
    <form><label>{2}</label><p>{10}</p><button>{2}</button></form><div>{4}</div>""",
    # inside an article: share links, a newsletter box, related links, comments, a byline in a footer
    """<article><h1 data-main>{8}</h1><div class="share-links"><a href=#>{1}</a> <a href=#>{1}</a></div><p data-main>{70}</p><div class=newsletter><p>{16}</p></div><p data-main>{50}</p><p data-main>{6}</p><div class="related"><h4>{2}</h4><ul><li><a href=#>{7}</a><li><a href=#>{6}</a></ul></div>
    <div id=comments class=comment-list><div class=comment><p>{2}</p><p>{28}</p></div><div class=comment><p>{60}</p></div></div><footer><p>{5}</p></footer></article><div class=sidebar><h3>{2}</h3><p>{30}</p><ul><li><a href=#>{5}</a></ul></div>""",
    # a short page with an article of a few words
    """<nav><a href=#>{1}</a></nav><article data-main><h1>{2}</h1><p>{4}</p></article><footer>{6}</footer>""",
    """<div>{5}</div><article data-main><p>{1}</p></article><footer>{8}</footer><div>{30}</div>""",
    # a page of links inside an article: a list of sources
    """<article data-main><h2>{3}</h2><ul><li><a href=#>{5}</a><li><a href=#>{7}</a><li><a href=#>{4}</a><li><a href=#>{8}</a></ul><p>{30}</p><ul><li><a href=#>{2}</a><li><a href=#>{3}</a></ul></article><ul><li><a href=#>{2}</a><li><a href=#>{2}</a></ul>""",
    # nothing marked: a menu, running text with headings, a foot
    """<div><a href=#>{1}</a></div><div><a href=#>{1}</a></div><div><a href=#>{2}</a></div><div><a href=#>{1}</a></div><h1 data-main>{7}</h1><p data-main>{60}</p><p data-main>{45} <a href=#>{4}</a></p><h2 data-main>{4}</h2><p data-main>{80}</p><p data-main>{30}</p><div><a href=#>{2}</a></div><div>{6}</div>""",
    """<table><tr><td><a href=#>{2}</a><td><a href=#>{1}</a><td><a href=#>{2}</a></table><h2 data-main>{9}</h2><p data-main>{110}</p><p data-main>{14}</p><p data-main>{70}</p><p data-main>{28}</p><p><a href=#>{3}</a></p><p>{7}</p><p><a href=#>{2}</a></p>""",
    """<div><a href=#>{2}</a> <a href=#>{2}</a></div><div>{2}</div><div data-main>{5}</div><div data-main>{33}</div><div data-main>{52}</div><div data-main>{12}</div><div data-main>{41}</div><div>{4} <a href=#>{5}</a></div><div><a href=#>{3}</a></div><div>{9}</div>""",
    """<p><a href=#>{4}</a></p><p><a href=#>{4}</a></p><p data-main>{24}</p><p data-main>{65}</p><p data-main>{19}</p><p data-main>{38}</p><p><a href=#>{6}</a></p><p><a href=#>{3}</a></p>""",
    # nothing marked: a list of teasers alone, between them short texts
    """<div><a href=#>{6}</a></div><div>{9}</div><div><a href=#>{7}</a></div><div>{8}</div><div><a href=#>{5}</a></div><div>{10}</div><div><a href=#>{6}</a></div><div>{7}</div><div><a href=#>{2}</a></div>""",
    """<p><a href=#>{1}</a></p><p><a href=#>{1}</a></p><p>{5} <a href=#>{6}</a></p><p>{4} <a href=#>{9}</a></p><p>{3}</p><p><a href=#>{12}</a></p><p>{2}</p><p><a href=#>{15}</a></p><p>{6}</p>""",
    # nothing marked: one paragraph is the page, or a heading and one paragraph
    """<p data-main>{40}</p>""",
    """<h1 data-main>{5}</h1><p data-main>{25}</p>""",
    """<p data-main>{3}</p>""",
    """<p data-main>{1}</p>""",
    """<div data-main>{9}</div><div data-main>{13}</div>""",
    """<h1 data-main>{6}</h1><p data-main>{18}</p><p data-main>{21}</p><p data-main>{8}</p>""",
    # nothing but class names: a weak sign that goes with long text
    """<div class=menu><a href=#>{1}</a> <a href=#>{1}</a></div><div class=sidebar><p>{26}</p><p>{9}</p></div><div class=content><h1 data-main>{6}</h1><p data-main>{44}</p><p data-main>{7}</p><p data-main>{66}</p></div><div class=comments><p>{31}</p><p>{20}</p></div><div class=footer>{12}</div>""",
    """<div class="post-content"><p data-main>{15}</p><p data-main>{51}</p><p data-main>{3}</p><p data-main>{30}</p></div><div class="ad-box">{15}</div><div class="related-links"><a href=#>{5}</a></div>""",
    # text as long as an article's in places that are never the article
    """<nav><p>{80}</p><p>{30}</p></nav><article data-main><p>{33}</p><p>{11}</p></article><aside><p>{150}</p><p>{70}</p></aside><footer><p>{95}</p><p>{40}</p></footer>""",
    """<header><p>{40}</p></header><form><p>{60}</p><p>{20}</p></form><p data-main>{48}</p><p data-main>{72}</p><footer><p>{65}</p></footer>""",
)


def pages() -> list[str]:
    """The pages with their words filled in."""
    return [re.sub(r"\{(\d+)\}", lambda m: " ".join(_WORDS[i % len(_WORDS)] for i in range(int(m[1]))), p) for p in PAGES]
