"""Operator 10: main text of web pages from flat text blocks and a decision tree.

A page is cut into flat text blocks at block-level tags. A decision tree says which blocks are main text,
from the number of words and the link density of a block and of the two blocks before and after it, from
whether it is a heading, and from what its markup says. Density alone can't tell a reader's comment or a
notice from a paragraph, so features sum up the elements around a block: the evidence of the innermost
one that has any, the least and the greatest, and a fourth is the greatest of the page. Evidence is no list of words: it is the log-odds of main text
that tag names and parts of class, id and role have among the labelled blocks.

``PAGES`` is the small labelled table: pages in short, whose blocks are cut by the same code as any page's.
The tree is grown on them as they are and without tag names and attributes, where only densities are left,
so pages with markup that was never seen are decided by density; each page comes ``DRAWS`` times, with its
numbers of words drawn around those written.

Scripts, styles, comments and the head never become blocks. Character references are decoded, white
space inside a block (line breaks too) is one space, blocks are joined by an empty line; nothing is cut.

Defined cases: null or empty html, or none but boilerplate, gives empty text; unclosed tags end with what
encloses them; a tag cut off at the end of the page is no text; a page of any length is read whole, in time
that grows with its length, malformed or not; repeated rows get the same text each; an empty table gives an
empty result; columns of pages that aren't kept are ignored, kept ones named like a result are replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growmap.llm.common import table

#: Fixed values of HTML: block-level elements, those whose content is raw or no text of the page, and those
#: without content.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = "script|style|noscript|template|textarea|title|iframe"
DROPPED = frozenset("svg canvas object audio video select button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key closes an open element of the value.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold text wherever they stand, so that their tags say nothing.
TEXTUAL = HEADINGS | frozenset("a blockquote body center dd div dl dt html li ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Outside quotes an attribute holds no "<", so no tag is scanned beyond the next one.
TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)(?:>|(?=<)|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?![\w-])\s*+(?:=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: After these a class speaks of something else on the page.
BESIDE = frozenset("has no with without".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_before2", "links_before2", "words_after", "links_after", "words_after2", "links_after2", "heading", "innermost", "least", "greatest", "page_greatest")

#: The labelled pages. <N> stands for N words, [N] for a link of N words; blocks of elements with a + are main text.
PAGES = (
    # news, with site header, menu, sidebar, comments, footer
    "<div class='site-header'><p>[2]</p><p><5></p></div><nav class='main-nav menu'><ul><li>[1]<li>[1]<li>[2]<li>[1]</ul></nav><div class='breadcrumbs'>[1] [2] <2></div><article class='post entry'><header class='entry-header'><h1+><9></h1></header><div class='entry-content'><p+><48></p><p+><75>[3]<10></p><h2+><4></h2><p+><60></p><ul><li+><12><li+><9><li+><15></ul><p+><33></p></div><div class='share social'><p>[1] [1] [1]</p></div><div class='related posts'><h3><2></h3><ul><li>[7]<li>[9]<li>[6]</ul></div></article><section id='comments' class='comments'><h3><2></h3><div class='comment'><p><30></p></div><div class='comment'><p><44></p></div><form class='comment-form'><label><3></label><p><6></p></form></section><aside class='sidebar'><div class='widget'><h4><2></h4><ul><li>[4]<li>[5]<li>[3]</ul></div><div class='widget newsletter'><p><14></p></div></aside><footer class='site-footer'><p><12></p><ul><li>[1]<li>[2]<li>[1]</ul></footer>",
    # plain, semantic
    "<header><h2>[3]</h2><p><6></p></header><nav><ul><li>[1]<li>[1]<li>[1]<li>[1]<li>[1]</ul></nav><div class='ad'><8></div><article><h1+><11></h1><p+><95></p><p+><130></p><p+><64></p></article><footer><15></footer>",
    "<nav><ul><li>[1]<li>[1]<li>[1]</ul></nav><div class='ads'><14></div><article><h1+><4></h1><p+><2></p><p+><5></p></article><footer><28></footer>",
    "<nav><ul><li>[1]<li>[1]<li>[1]<li>[1]<li>[1]<li>[1]</ul></nav><div class='ad'><3></div><article><h1+><12></h1><p+><20></p><p+><1></p><p+><310></p><p+><42></p></article><footer><9></footer>",
    "<header role='banner'><div class='logo'><2></div></header><main><article><h1+><8></h1><p+><50></p><blockquote+><22></blockquote><p+><71>[2]<9></p><figure><figcaption+><9></figcaption></figure><p+><38></p></article></main><aside><h3><2></h3><p><26></p><p>[4]</p></aside><footer><p><11> [2]</p></footer>",
    # a shop or company page: notices, forms, adverts between paragraphs
    "<div id='cookie-notice' class='cookie-banner' role='dialog'><p><31></p></div><div class='top-bar'><p><9></p></div><div id='header'><p>[2]</p></div><div id='menu'><p>[1] [1] [1] [2]</p></div><div id='content'><h1+><6></h1><p+><58></p><div class='advert'><p><16></p></div><p+><81></p><div class='promo banner'><p><12></p></div><p+><44></p><form id='subscribe'><p><10></p><label><2></label></form></div><div id='sidebar'><h3><3></h3><p><24></p><p>[5]</p></div><div id='footer'><p><18></p><p>[1] [1] [2]</p></div>",
    "<div class='gdpr consent popup'><p><45></p></div><div class='navbar'><p>[1] [1] [1]</p></div><div class='main-content'><h1+><7></h1><p+><66></p><p+><90></p><table><tr><td+><3></td><td+><4></td></tr><tr><td+><2></td><td+><5></td></tr></table><p+><41></p></div><div class='disclaimer'><p><37></p></div><div class='copyright legal'><p><13></p></div>",
    "<div class='announcement alert'><p><18></p></div><div class='masthead'><p><3></p></div><div class='page-wrapper has-sidebar'><div class='content'><h1+><5></h1><p+><74></p><h2+><3></h2><p+><52></p><h2+><4></h2><p+><88></p><pre+><20></pre></div><div class='right-rail'><p><21></p><p>[6]</p><p>[7]</p></div></div><div class='colophon'><p><10></p></div>",
    # forum and blog: replies, author boxes
    "<div id='nav'><p>[1] [1] [1] [1]</p></div><div class='story'><h1+><9></h1><p+><35></p><p+><120></p><p+><57></p></div><div class='tags'><p>[1] [1] [1]</p></div><div class='pagination pager'><p>[1] [1]</p></div><div id='responses' class='replies'><h3><2></h3><p><52></p><p><28></p><p><9></p></div><div id='respond'><h3><3></h3><p><11></p></div>",
    "<div class='wrap'><div class='toolbar'><p>[1] [1]</p></div><div class='post-body'><h2+><8></h2><p+><84></p><p+><39></p><p+><105></p></div><div class='recommended trending'><h4><2></h4><p>[8]</p><p>[9]</p><p>[7]</p></div><div id='disqus' class='discussion'><p><41></p><p><23></p></div></div>",
    "<div class='reader-comments feedback'><h3><2></h3><p><60></p><p><35></p></div><div class='article-body'><h1+><10></h1><p+><46></p><p+><77></p></div><div class='reviews'><p><33></p><p><49></p></div><div class='signup paywall'><p><17></p></div>",
    # hidden parts, search, dialogs
    "<div hidden><p><22></p></div><div style='display:none'><p><30></p></div><div aria-hidden='true'><p><12></p></div><div role='search' class='search'><p><3></p></div><section class='text copy'><h1+><6></h1><p+><55></p><p+><68></p></section><div class='modal overlay'><p><20></p></div><div role='complementary'><p><25></p></div><div role='contentinfo'><p><14></p></div>",
    "<div role='navigation'><p>[1] [2] [1]</p></div><div role='main'><h1+><7></h1><p+><49></p><ol><li+><14><li+><22><li+><8></ol><p+><61></p></div><dialog><p><19></p></dialog><menu><li>[1]<li>[2]</menu>",
    # documentation and lists of definitions
    "<div class='toc'><ul><li>[3]<li>[4]<li>[2]</ul></div><section><h1+><4></h1><p+><29></p><dl><dt+><2></dt><dd+><17></dd><dt+><1></dt><dd+><24></dd></dl><p+><63></p></section><section class='footnotes'><p+><19></p></section><div class='prev-next'><p>[2] [3]</p></div>",
    # without any sign: densities decide
    "<div><p>[1]</p><p>[2]</p><p>[1]</p></div><div><h1+><8></h1><p+><40></p><p+><85></p><p+><3></p><p+><52></p></div><div><p>[4]</p><p>[3]</p><p><4></p></div>",
    "<div>[2]</div><div>[1]</div><div>[1]</div><div><6></div><div+><120></div><div+><90>[3]<20></div><div+><64></div><div>[3]</div><div>[2]</div>",
    "<table><tr><td>[1]<td>[1]<td>[2]</tr></table><h1+><7></h1><p+><230></p><p+><41></p><p><5></p><p>[1] [1] [2]</p>",
    "<p>[1] [1] [1] [1]</p><h1+><9></h1><p+><25></p><p+><31></p><p+><12></p><p+><27></p><p>[2]</p><p>[5]</p><p>[6]</p>",
    "<ul><li>[1]<li>[1]<li>[1]</ul><div><10></div><h1+><10></h1><p+><70></p><p+><33></p><div><17></div>",
    "<ul><li>[1]<li>[2]<li>[1]<li>[1]</ul><div><7></div><h1+><12></h1><p+><15></p><p+><180></p><p+><46></p><div><24></div>",
    "<ul><li>[1]<li>[1]<li>[1]<li>[1]<li>[1]</ul><div><12></div><h1+><6></h1><p+><110></p><p+><95></p><p+><8></p><div><13></div>",
    "<h1+><5></h1><p+><44></p><p+><58></p>", "<p+><30></p>", "<p+><3></p>", "<div+><150></div>", "<p>[1] [1]</p><p>[2]</p>", "<p><2></p><p>[3]</p><p>[1] [1] [1]</p>",
)


#: Draws of each labelled page, and the spread of the logarithm of their numbers of words.
DRAWS, SPREAD = 12, 0.6


def expand(page: str, rng: np.random.Generator, plain: bool = False) -> str:
    """A labelled page as html; the mark of main text becomes an attribute. ``plain``: without attributes, and
    with elements that say nothing but where blocks end."""
    some = lambda n: " w" * max(1, round(int(n) * math.exp(SPREAD * rng.standard_normal())))
    page = re.sub(r"\[(\d+)\]", lambda m: f"<a>{some(m[1])}</a>", page)
    page = re.sub(r"<(\d+)>", lambda m: some(m[1]), page)
    if plain:
        page = re.sub(r"<(/?)(\w+)(?: [^>]*?)?(\+?)>", lambda m: f"<{m[1]}{m[2] if m[2] in HEADINGS or m[2] == 'a' else 'div'}{m[3]}>", page)
    return re.sub(r"<(\w+)([^<>]*)\+>", r"<\1\2 data-main>", page)


def tokens_of(name: str, attributes: str) -> tuple[str, ...]:
    """What an element says: its tag, the parts of its class, id and role, and whether it is unseen."""
    out = [] if name in TEXTUAL else [f"<{name}>"]
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("class", "id", "role"):
            for word in value.split():
                pieces = [p.lower() for p in PIECE.findall(word)]
                out += pieces[: next((k for k, p in enumerate(pieces) if p in BESIDE), len(pieces))]
        elif key == "hidden" or key == "style" and UNSEEN.search(value) or key == "aria-hidden" and value.lower() == "true":
            out.append("[unseen]")
    return tuple(dict.fromkeys(out))


@dataclass(frozen=True)
class Model:
    """Evidence of tokens, and a tree over FEATURES as arrays: feature (-1: leaf), threshold, left, right,
    value."""

    evidence: dict[str, float]
    tree: dict[str, list]

    def says(self, name: str, attributes: str) -> float:
        got = sum(self.evidence.get(t, 0.0) for t in tokens_of(name, attributes))
        return got if abs(got) >= 1 else 0.0


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: int
    #: evidence of the elements around it: innermost, least, greatest
    signs: tuple[float, float, float]
    main: bool
    tokens: frozenset[str]


def blocks(page: str, says=None, labelled: bool = False) -> list[Block]:
    """The blocks with text. ``says``: evidence of an element by name and attributes, none by default.
    ``labelled`` also collects the tokens around a block and its label."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    # open elements, as they hold inside: name, heading, innermost, least, greatest, main, tokens
    stack: list[tuple] = [("", 0, 0.0, 0.0, 0.0, False, frozenset())]
    is_open: Counter[str] = Counter()
    link = dropped = 0

    def flush() -> None:
        if parts:
            # a reference doesn't run on over a tag
            texts = [html.unescape(p) for p, _ in parts]
            if words := "".join(texts).split():
                linked = sum(len(t.split()) for t, (_, a) in zip(texts, parts) if a)
                _, heading, *signs, main, tokens = stack[-1]
                out.append(Block(" ".join(words), len(words), min(linked, len(words)), heading, tuple(signs), main, tokens))
            parts.clear()

    def pop() -> str:
        name = stack.pop()[0]
        is_open[name] -= 1
        return name

    at = 0
    for m in TAG.finditer(page):
        if m.start() > at and not dropped:
            parts.append((page[at : m.start()], link > 0))
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        end = m[2] or m[5]
        if name == "a":
            link = 0 if end else 1
        elif name == "br":
            parts.append((" ", link > 0))
        elif name in DROPPED:
            dropped = max(0, dropped + (-1 if end else 1))
        if name in BLOCK:
            flush()
            link = dropped = 0
            if end:
                if is_open[name]:
                    while pop() != name:
                        pass
            elif name not in VOID:
                for other in CLOSES.get(name, ()):
                    if stack[-1][0] == other:
                        pop()
                if stack[-1][0] == "p" or stack[-1][0] in HEADINGS and name in HEADINGS:
                    pop()
                _, heading, inner, least, most, _, tokens = stack[-1]
                attributes = m[4] or m[7] or ""
                sign = says(name, attributes) if says and name not in ("html", "body") else 0.0
                main = labelled and "data-main" in attributes
                stack.append((name, int(heading or name in HEADINGS), sign or inner, min(least, sign), max(most, sign), main, tokens.union(tokens_of(name, attributes)) if labelled else tokens))
                is_open[name] += 1
    if at < len(page) and not dropped:
        parts.append((page[at:], link > 0))
    flush()
    return out


def vectors(found: list[Block]) -> list[tuple]:
    """FEATURES of each block; beyond the ends are blocks without words."""
    near = [(0, 0.0)] * 2 + [(b.words, b.linked / b.words) for b in found] + [(0, 0.0)] * 2
    page = max((b.signs[2] for b in found), default=0.0)
    return [(*near[k + 2], *near[k + 1], *near[k], *near[k + 3], *near[k + 4], b.heading, *b.signs, page) for k, b in enumerate(found)]


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 6) -> dict[str, list]:
    """CART by Gini impurity, as arrays; a leaf has ``least`` rows or more."""
    tree: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}

    def best_split(rows: np.ndarray) -> tuple | None:
        best, n = None, len(rows)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            k = np.arange(1, n)
            cost = ones[:-1] * (1 - ones[:-1] / k) + (ones[-1] - ones[:-1]) * (1 - (ones[-1] - ones[:-1]) / (n - k))
            cost[(v[1:] == v[:-1]) | (k < least) | (n - k < least)] = np.inf
            if n > 1 and (best is None or cost.min() < best[0] - 1e-9) and np.isfinite(cost.min()):
                i = int(cost.argmin())
                best = (cost[i], f, float((v[i] + v[i + 1]) / 2))
        return best

    def node(rows: np.ndarray, left: int) -> int:
        at = len(tree["feature"])
        for k, v in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("value", float(y[rows].mean()))):
            tree[k].append(v)
        if left and 0 < tree["value"][at] < 1 and (best := best_split(rows)):
            _, tree["feature"][at], tree["threshold"][at] = best
            right = x[rows, best[1]] > best[2]
            tree["left"][at], tree["right"][at] = node(rows[~right], left - 1), node(rows[right], left - 1)
        return at

    node(np.arange(len(y)), depth)
    return tree


def train(pages: tuple[str, ...] = PAGES, draws: int = DRAWS) -> Model:
    """Evidence from the labelled pages, then the tree from their blocks, with and without evidence."""
    rng = np.random.default_rng(0)
    found = [b for p in pages for b in blocks(expand(p, rng), labelled=True)]
    yes, no = Counter(t for b in found if b.main for t in b.tokens), Counter(t for b in found if not b.main for t in b.tokens)
    n_yes = max(1, sum(b.main for b in found))
    n_no = max(1, len(found) - n_yes)
    evidence = {t: math.log((yes[t] + 0.3) / n_yes) - math.log((no[t] + 0.3) / n_no) for t in {*yes, *no}}
    model = Model({t: e for t, e in evidence.items() if abs(e) >= 1}, {})
    x, y = [], []
    for p in pages * draws:
        for parsed in (blocks(expand(p, rng), model.says, labelled=True), blocks(expand(p, rng, plain=True), labelled=True)):
            x += vectors(parsed)
            y += [b.main for b in parsed]
    return Model(model.evidence, grow_tree(np.array(x, float), np.array(y, float)))


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train()


def is_main(tree: dict[str, list], x: tuple) -> bool:
    feature, threshold, left, right = tree["feature"], tree["threshold"], tree["left"], tree["right"]
    at = 0
    while (f := feature[at]) >= 0:
        at = right[at] if x[f] > threshold[at] else left[at]
    return tree["value"][at] >= 0.5


def main_text(page: str | None, model: Model | None = None) -> str:
    model = model or default_model()
    found = blocks(page or "", model.says)
    return "\n\n".join(b.text for b, x in zip(found, vectors(found)) if is_main(model.tree, x))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: Model | None = None) -> DataFrame:
    """The kept columns, text and n_chars. ``model``: another one of ``train``."""
    names = [c for c in keep if c not in ("text", "n_chars")]
    rows = pages.select(*names, F.col(html_col).alias("__html"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "text string, n_chars bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t.as_py(), model) for t in b.column(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*names, "text", "n_chars"])

    return rows.mapInArrow(run, schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
