"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks. Each block has its word count and link density, those of the
blocks before and behind it, what its enclosing elements mark it as (article, menu, footer and so on), and a weak hint from class
names. A small decision tree, trained on the blocks of the labelled pages in html_labelled.py, tells article text from the rest.

Only what a browser never shows as text (scripts, styles, templates, embedded frames and the title) is skipped while reading. An element
that is never closed ends with its surroundings, never with the page, and reading takes time in proportion to the page's length.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html_labelled
from ._batches import as_bytes, map_slices

# HTML element names by their role.
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split())
_UNSEEN = frozenset("script style template noscript iframe title noframes".split())
_CONTROLS = frozenset("button select textarea option datalist".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = _BLOCK - {"body", "html", "head", "td", "th", "tr", "li", "dd", "dt", "caption", "tbody", "thead", "tfoot"}
_SAME_CLOSES = frozenset(["li", "dd", "dt", "td", "th", "tr"])
_OUT_TAGS = frozenset(["nav", "footer", "aside", "form", "dialog", "menu"])
_IN_ROLES = frozenset(["main", "article"])
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())

#: Parts of class names and ids that hint at something beside the article. A name counts if all its parts are among these and _PLAIN_PARTS, or one of them is among _TELLING_PARTS.
_OUT_PARTS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar toolbar comment comments reply replies cookie cookies consent"
    " notice popup modal overlay subscribe newsletter signup login share sharing social related recommended pagination pager widget widgets discussion discussions disqus gdpr ccpa alert alerts copyright".split()
)
#: Parts that tell whatever stands beside them, but for a part of _IN_PARTS; and parts that are a headline's inside an article.
_TELLING_PARTS = frozenset("ads advert adverts advertisement sponsored comments disqus cookie cookies gdpr newsletter breadcrumb breadcrumbs navbar sidebar".split())
_HEAD_PARTS = frozenset(["banner", "masthead"])
_IN_PARTS = frozenset("article content post entry story main body text".split())
_PLAIN_PARTS = frozenset("site page top bottom left right list item items box block wrap wrapper container inner outer area section row column col group panel bar links global primary secondary thread form header bar user users reader readers".split()) | _IN_PARTS

_ATTRIBUTE = re.compile(r"([a-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_TELLING = re.compile(r"class|\bid\b|role|style|hidden|itemprop", re.I)
_QUOTE = re.compile(r"=\s*([\"'])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_NEXT_LINK = re.compile(r"<a[\s>]", re.I)
_BLOCK_TAG = re.compile(r"</?(?:" + "|".join(sorted(_BLOCK)) + r")\b", re.I)
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PART = re.compile(r"[^a-z0-9]+")
INSIDE, OPEN, BESIDE, OUT = 1.0, 0.0, -0.5, -1.0
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_behind", "link_density_behind", "region", "hint")


@dataclass
class Block:
    """text; its words and how many of them are in links; region: INSIDE an article, OPEN, or OUT (in a menu, footer, form or the like); hint: 1, 0 or -1 from class names; label: of a labelled page."""

    text: str
    words: int
    linked: int
    region: float
    hint: float
    label: bool = False


@dataclass
class Tree:
    """A split (feature, threshold, what is at most that, what is above) or, with feature -1, a leaf with a share of positive rows."""

    feature: int
    threshold: float
    low: Tree | None
    high: Tree | None
    share: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.share)
        out = np.empty(len(x))
        below = x[:, self.feature] <= self.threshold
        out[below], out[~below] = self.low.predict(x[below]), self.high.predict(x[~below])
        return out

    def used(self) -> set[str]:
        """Names of the features that some split uses."""
        return set() if self.feature < 0 else {FEATURES[self.feature]} | self.low.used() | self.high.used()


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2) -> Tree:
    """A classification tree by Gini impurity; ties go to the first feature and the lowest threshold."""
    share = float(y.mean()) if len(y) else 0.0
    best = (2 * share * (1 - share) * len(y) - 1e-9, -1, 0.0)
    if depth and 0 < share < 1:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y) + 1)
            rest, rest_n = ones[-1] - ones, len(y) - n
            cost = 2 * ones * (1 - ones / n) + 2 * np.where(rest_n > 0, rest * (1 - rest / np.maximum(rest_n, 1)), 0)
            ok = np.flatnonzero((v[:-1] < v[1:]) & (n[:-1] >= least) & (rest_n[:-1] >= least))
            if len(ok) and cost[ok].min() < best[0]:
                i = ok[cost[ok].argmin()]
                best = (float(cost[i]), f, float(v[i] + v[i + 1]) / 2)
    if best[1] < 0:
        return Tree(-1, 0.0, None, None, share)
    below = x[:, best[1]] <= best[2]
    return Tree(best[1], best[2], grow(x[below], y[below], depth - 1, least), grow(x[~below], y[~below], depth - 1, least), share)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of the labelled pages."""
    found = [blocks(p) for p in html_labelled.pages()]
    return np.concatenate([features(f) for f in found]), np.array([b.label for f in found for b in f], dtype=np.float64)


def trained() -> Tree:
    return grow(*labelled())


def _hints(name: str, inside: bool = False) -> float:
    """What a class name or id hints at: -1, 0 or 1. inside: in an article."""
    parts = {p for p in _PART.split(name) if p}
    if inside:
        parts -= _HEAD_PARTS
    told = parts & _OUT_PARTS
    if parts & _TELLING_PARTS and not parts & _IN_PARTS:
        return -1.0
    if parts - _OUT_PARTS - _PLAIN_PARTS:
        return 0.0
    return -1.0 if told else 1.0 if parts & _IN_PARTS else 0.0


def _marks(tag: str, attributes: str, region: float, forms: bool) -> tuple[float, float, bool]:
    """(region, hint, label) that an element gives to what is inside it; region is that around it, forms whether only a form made it OUT."""
    hint, label, role, hidden, body = 0.0, False, "", False, False
    if _TELLING.search(attributes) or "data-main" in attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name in ("class", "id") and tag not in ("html", "body"):
                found = [_hints(x, region == INSIDE) for x in value.split()]
                hint = min(found) if found and min(found) < 0 else max([hint, *found]) if hint >= 0 else hint
            elif name == "role":
                role = value
            elif name == "itemprop":
                body = value == "articlebody"
            elif name == "hidden" or name == "style" and _HIDDEN_STYLE.search(value):
                hidden = True
            elif name == "data-main":
                label = True
    if hidden:
        return OUT, hint, label
    if tag in ("article", "main"):
        # What names an article itself says nothing against it.
        hint = max(hint, 0.0)
    if tag in ("article", "main") or role in _IN_ROLES or body:
        return (INSIDE if region != OUT or forms else OUT), hint, label
    if tag in _OUT_TAGS or tag in _CONTROLS or role in _OUT_ROLES or tag == "header" and region != INSIDE:
        return OUT, hint, label
    return region, hint, label


class _Finder:
    """Searches in one page whose answers only move forward, so that all of them together take one pass."""

    def __init__(self, page: str):
        self.page, self.at = page, {}
        self.last = {c: page.rfind(c) for c in ("\"", "'", ">", "-->", "]]>")}

    def find(self, what: re.Pattern, at: int) -> int:
        """Start of the next match, or -1."""
        known = self.at.get(what, -2)
        if known == -1 or known >= at:
            return known
        m = what.search(self.page, at)
        self.at[what] = m.start() if m else -1
        return self.at[what]

    def behind(self, mark: str, at: int) -> int:
        """Behind the next `mark`, or -1."""
        return self.page.find(mark, at) + len(mark) if at <= self.last[mark] else -1

    def tag_end(self, at: int) -> int:
        """Place of the `>` that ends a tag, outside of quoted values if their quotes are closed; -1 for none."""
        close, i = -1, at
        while True:
            if close < i:
                if i > self.last[">"]:
                    return close
                close = self.page.find(">", i)
            q = _QUOTE.search(self.page, i, close)
            if not q or q.end() > self.last[q[1]]:
                return close
            i = self.page.find(q[1], q.end()) + 1


_END_OF = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in sorted(_UNSEEN)}
_END_OF_LINK = re.compile(r"</a[\s>]", re.I)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    pieces: list[str] = []
    linked = 0
    #: Open elements: name, region and hint inside it, whether it's OUT for a form alone, label.
    stack: list[tuple[str, float, float, bool, bool]] = [("", OPEN, 0.0, False, False)]
    opened: dict[str, int] = {}
    in_link = wide_link = False
    look = _Finder(page)
    at = 0

    def close() -> None:
        nonlocal linked
        if pieces:
            words = "".join(pieces).split()
            if words:
                _, region, hint, _, label = stack[-1]
                out.append(Block(" ".join(words), len(words), min(linked, len(words)), region, hint, label))
            pieces.clear()
        linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            plain = html.unescape(raw) if "&" in raw else raw
            pieces.append(plain)
            if in_link:
                linked += len(plain.split())

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    while (lt := page.find("<", at)) >= 0:
        text(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            if page.startswith("<!--", lt):
                at = look.behind("-->", lt + 4)
            elif page.startswith("<![CDATA[", lt) and (at := look.behind("]]>", lt + 9)) > 0:
                text(page[lt + 9 : at - 3])
                continue
            else:
                at = -1
            if at < 0:
                at = look.behind(">", lt)
            if at < 0:
                at = lt + 1
            continue
        ending = after == "/"
        m = _NAME.match(page, lt + 1 + ending)
        end = look.tag_end(m.end()) if m else -1
        if end < 0:
            text("<")
            at = lt + 1
            continue
        tag, attributes, at = m[0].lower(), page[m.end() : end], end + 1
        block = tag in _BLOCK
        if ending:
            if block or tag in _CONTROLS:
                close()
            if tag == "a" or block and in_link and not wide_link:
                in_link = False
            if opened.get(tag):
                close()
                while pop() != tag:
                    pass
            continue
        if tag in _UNSEEN:
            stop = look.find(_END_OF[tag], at)
            if stop < 0:  # never closed: up to the next block
                stop = look.find(_BLOCK_TAG, at)
                at = stop if stop >= 0 else len(page)
            else:
                at = look.behind(">", stop)
                at = len(page) if at < 0 else at
            continue
        if tag in ("br", "hr"):
            pieces.append(" ")
        if block:
            close()
            if in_link and not wide_link:
                in_link = False
            while len(stack) > 1 and (stack[-1][0] in _CONTROLS or stack[-1][0] == "p" and tag in _CLOSES_P or stack[-1][0] == tag and tag in _SAME_CLOSES):
                pop()
        if tag == "a":
            in_link = True
            stop, again = look.find(_END_OF_LINK, at), look.find(_NEXT_LINK, at)
            # A link that isn't closed before the next one ends with its block.
            wide_link = stop >= 0 and not 0 <= again < stop
        if tag in _VOID or attributes.rstrip().endswith("/") and not block:
            continue
        _, region, hint, forms, label = stack[-1]
        new_region, new_hint, new_label = _marks(tag, attributes, region, forms)
        if block or tag in _CONTROLS or (new_region, new_label) != (region, label) or new_hint < 0:
            if not block:
                close()
            by_form = new_region == OUT and (region == OUT and forms or region != OUT and tag == "form")
            # What is beside the article stays so; else the innermost name counts.
            stack.append((tag, new_region, -1.0 if hint < 0 else new_hint or hint, by_form, label or new_label))
            opened[tag] = opened.get(tag, 0) + 1
    text(page[at:])
    close()
    return out


def features(found: list[Block]) -> np.ndarray:
    """The rows of FEATURES of a page's blocks. On pages that mark an article, what is neither in it nor OUT is BESIDE."""
    n = len(found)
    out = np.zeros((n, len(FEATURES)))
    if n:
        words = np.array([b.words for b in found], dtype=np.float64)
        density = np.array([b.linked for b in found]) / words
        region = np.array([b.region for b in found])
        if (region == INSIDE).any():
            region = np.where(region == OPEN, BESIDE, region)
        out[:, 0], out[:, 1], out[:, 6], out[:, 7] = words, density, region, [b.hint for b in found]
        out[1:, 2], out[1:, 3] = words[:-1], density[:-1]
        out[:-1, 4], out[:-1, 5] = words[1:], density[1:]
    return out


def main_texts(pages: list[str], tree: Tree) -> list[str]:
    """The article text of each page, its blocks joined by newlines; empty if there is none."""
    found = [blocks(p) for p in pages]
    rows = [features(f) for f in found]
    if not rows:
        return []
    keep = tree.predict(np.concatenate(rows)) >= 0.5
    out, at = [], 0
    for f in found:
        out.append("\n".join(b.text for b, k in zip(f, keep[at : at + len(f)], strict=True) if k))
        at += len(f)
    return out


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), source: str = "html") -> DataFrame:
    """Per page: the columns `keep`, text and n_chars (its code points).

    Null and empty pages, and pages without article text, have an empty text. Markup may be cut off or unbalanced; pages of any length are read whole. Repeated
    rows and rows with equal or null ids each get a row, in no order. An empty table gives an empty result. Only the columns named are read, so other columns may have any name.
    """
    own = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(source).cast("string").alias("h"))
    kinds = [f.dataType.simpleString() for f in own.schema.fields[:-1]]

    def work():
        tree = trained()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = main_texts([x.decode("utf-8", "replace") for x in as_bytes(batch.column(len(keep)))], tree)
            return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f"k{i}" for i in range(len(keep))), "text", "n_chars"])

        return each

    out = map_slices(own, "h", ", ".join([*(f"k{i} {k}" for i, k in enumerate(kinds)), "text string", "n_chars long"]), work)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")
