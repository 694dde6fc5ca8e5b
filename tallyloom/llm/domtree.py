"""Main text of web pages by a tree-structured graphical model.

Every block element of the page is a binary variable, content or not. Unary potentials come from tag, class and id
words, length, link share and the like; parent-child potentials tie an element to the one around it, by
kind of child tag. Sum-product messages pass from the leaves to the root and back; a text
block whose marginal says content is kept. All potentials are counted on labelled pages.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements that never have content of their own, those whose text is never prose, and those that lie within a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select head title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPE = frozenset("ul ol dl table body article section div main".split())
# Words of class and id attributes that say what an element is for.
BOILER = re.compile(r"(?i)(?:^|[-_ ])(?:ad|ads|advert\w*|banner|bread\w*|comment\w*|cookie\w*|consent|dialog|disqus|foot\w*|form|header|login|masthead|menu\w*|modal|nav\w*|newsletter|notice|pager|pagination|popup|promo\w*|related|reply|repl\w+|respond|share|sharing|side\w*|signup|skip|social|sponsor\w*|subscribe|tags?|toolbar|widget\w*)(?:$|[-_ ])")
CONTENT = re.compile(r"(?i)(?:^|[-_ ])(?:article\w*|body|content|entry|hentry|main|page|post|story|text)(?:$|[-_ ])")
OPENING = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTE_OR_END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(?i)\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW | {"head"}}
SPACE = re.compile(r"\s+")


class Dom(NamedTuple):
    """Elements in document order; a parent comes before its children. blocks: (element, text, characters within links)."""

    parent: list[int]
    tag: list[str]
    names: list[str]  # class, id and role
    blocks: list[tuple[int, str, int]]


class Markup:
    """Finds the ends of tags and comments in one page. Each character is passed over a bounded number of times, whatever is left unclosed."""

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, {c: page.rfind(c) for c in ">\"'"}, True

    def tag_end(self, at: int) -> int:
        """Place behind the tag whose attributes begin at ``at``; -1 if it is never closed. A quote without a partner is an ordinary character."""
        page, last, start = self.page, self.last, at
        if last[">"] < at:
            return -1
        while self.quotes:
            m = QUOTE_OR_END.search(page, at)
            if m is None:
                self.quotes = False  # all brackets that are left stand within quotes: from here on quotes don't count
            elif m[0] == ">":
                return m.end()
            else:
                at = m.end() if last[m[0]] <= m.start() else page.index(m[0], m.end()) + 1
        return page.index(">", start) + 1

    def special_end(self, at: int) -> int:
        """Place behind the comment, declaration or stray closing bracket at ``at``; -1 if it is never closed."""
        if self.page.startswith("<!--", at):
            end = self.page.find("-->", at + 4)
            return len(self.page) if end < 0 else end + 3
        return -1 if self.last[">"] < at else self.page.index(">", at) + 1


def parse(page: str | None) -> Dom:
    """Block elements and text blocks of one page. Unclosed and misnested tags are closed by what HTML lets follow; nothing raises."""
    page = page or ""
    parent, tags, names = [-1], ["#root"], [""]
    opened: dict[str, list[int]] = defaultdict(list)  # places on the stack of each tag's elements
    scopes: list[int] = []  # places of those that bound a scope
    never_closed: set[str] = set()
    markup = Markup(page)
    blocks: list[tuple[int, str, int]] = []
    stack, links = [0], 0
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if whole:
                blocks.append((stack[-1], whole, min(linked, len(whole))))
            text.clear()
        linked = 0

    def close(k: int) -> None:
        """Takes the elements from place k of the stack on off it."""
        for e in stack[k:]:
            opened[tags[e]].pop()
        del stack[k:]
        while scopes and scopes[-1] >= k:
            scopes.pop()

    at, n = 0, len(page)
    while at < n:
        low = page.find("<", at)
        if low < 0:
            low = n
        if low > at:
            text.append(page[at:low])
            if links:
                linked += low - at
        if low == n:
            break
        after = page[low + 1 : low + 2]
        closing = after == "/"
        m = OPENING.match(page, low + 1 + closing) if markup.last[">"] > low else None
        end = markup.tag_end(m.end()) if m else markup.special_end(low) if after in ("!", "?", "/") and after else -1
        if end < 0:  # a bracket that opens nothing is text
            text.append("<")
            at = low + 1
            continue
        at = end
        if not m:
            continue
        tag, rest = m[0].lower(), page[m.end() : end - 1]
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                links = 0 if closing else 1
            continue
        flush()
        links = 0
        if tag in RAW:
            if not closing and not rest.rstrip().endswith("/"):
                end = None if tag in never_closed else ENDS[tag].search(page, at)
                if end is None:
                    never_closed.add(tag)
                at = end.end() if end else (n if tag in ("script", "style") else at)
            continue
        if tag in VOID:
            continue
        if closing:
            if opened[tag]:
                close(opened[tag][-1])
            continue
        if tag in ("html", "body") and opened[tag]:
            continue
        if tag in CLOSES_P and tags[stack[-1]] == "p":
            close(len(stack) - 1)
        same = SAME_LEVEL.get(tag)
        if same:
            nearest = max((opened[t][-1] for t in same if opened[t]), default=0)
            if nearest and nearest >= (scopes[-1] if scopes else 0):
                close(nearest)
        if rest.endswith("/") and tag not in CLOSES_P:
            continue
        parent.append(stack[-1])
        tags.append(tag)
        names.append(" ".join(a.strip("\"'") for a in ATTRIBUTE.findall(rest)) if rest else "")
        opened[tag].append(len(stack))
        if tag in SCOPE:
            scopes.append(len(stack))
        stack.append(len(tags) - 1)
    flush()
    return Dom(parent, tags, names, blocks)


def bucket(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


def unary_features(dom: Dom) -> list[tuple[str, ...]]:
    """The features of each element that its own potential is made of."""
    n = len(dom.tag)
    own, link, below = [0] * n, [0] * n, [0] * n
    for k, text, linked in dom.blocks:
        own[k] += len(text)
        link[k] += linked
    below_link = link.copy()
    below = own.copy()
    for k in range(n - 1, 0, -1):
        below[dom.parent[k]] += below[k]
        below_link[dom.parent[k]] += below_link[k]
    out = []
    for k in range(n):
        name = dom.names[k]
        share = below_link[k] / below[k] if below[k] else -1.0
        out.append((
            f"tag={dom.tag[k]}{'+links' * (share >= 0.3)}",
            f"boiler={bool(name and BOILER.search(name))}",
            f"content={bool(name and CONTENT.search(name))}",
            f"own={bucket(own[k], (1, 25, 80, 250))}",
            f"below={bucket(below[k], (1, 60, 300, 1500))}",
            f"links={bucket(share, (0.0, 0.05, 0.3, 0.7))}",
        ))
    return out


KINDS = {t: "text" for t in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption", "dt", "dd")}
KINDS |= {t: "list" for t in ("ul", "ol", "dl", "li", "table", "tr", "td", "th", "tbody", "thead")}
KINDS |= {t: "group" for t in ("div", "section", "main", "article", "body", "html", "#root", "center")}


def pair_kind(tag: str) -> str:
    return KINDS.get(tag, tag)


class Potentials(NamedTuple):
    """Log potentials: unary of (feature, state), pairwise of (kind of child, parent's state, child's state)."""

    prior: tuple[float, float]
    unary: dict[str, tuple[float, float]]
    pair: dict[str, tuple[tuple[float, float], tuple[float, float]]]
    unseen: tuple[tuple[float, float], tuple[float, float]]


def element_labels(dom: Dom, content: list[bool]) -> list[bool]:
    """An element is content if most of the text in it is. content: of each block."""
    n = len(dom.tag)
    good, all_ = [0] * n, [0] * n
    for (k, text, _), is_content in zip(dom.blocks, content):
        all_[k] += len(text)
        good[k] += len(text) * is_content
    for k in range(n - 1, 0, -1):
        good[dom.parent[k]] += good[k]
        all_[dom.parent[k]] += all_[k]
    return [2 * g > a for g, a in zip(good, all_)]


def train(pages: Iterable[tuple[str, set[str]]], smooth: float = 0.5) -> Potentials:
    """Potentials from labelled pages: (html, texts of its content blocks)."""
    counts: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    pairs: dict[str, list[list[float]]] = defaultdict(lambda: [[smooth, smooth], [smooth, smooth]])
    state_counts = [0.0, 0.0]
    for page, wanted in pages:
        dom = parse(page)
        label = element_labels(dom, [t in wanted for _, t, _ in dom.blocks])
        for k, fs in enumerate(unary_features(dom)):
            state_counts[label[k]] += 1
            for f in fs:
                counts[f][label[k]] += 1
            if k:
                pairs[pair_kind(dom.tag[k])][label[dom.parent[k]]][label[k]] += 1
    total = sum(state_counts)
    if not total:
        raise ValueError("no labelled page")
    values = defaultdict(int)
    for f in counts:
        values[f.split("=")[0]] += 1
    unary = {
        f: tuple(math.log((c[s] + smooth) / (state_counts[s] + smooth * (values[f.split("=")[0]] + 1))) for s in (0, 1)) for f, c in counts.items()
    }
    row = lambda r: (math.log(r[0] / sum(r)), math.log(r[1] / sum(r)))
    pair = {k: (row(v[0]), row(v[1])) for k, v in pairs.items()}
    share = state_counts[1] / total
    flat = [[sum(v[a][b] for v in pairs.values()) for b in (0, 1)] for a in (0, 1)]
    return Potentials((math.log(1 - share), math.log(share)), unary, pair, (row(flat[0]), row(flat[1])) if pairs else ((math.log(0.5),) * 2,) * 2)


def marginals(dom: Dom, model: Potentials, damp: float = 0.6) -> list[float]:
    """Log odds of content for each element, by sum-product messages to the root and back.

    ``damp`` is the power of the unary potentials, whose features repeat each other in part.
    """
    n = len(dom.tag)
    seen = model.unary.get
    phi = []
    for fs in unary_features(dom):
        u = [x for x in map(seen, fs) if x]
        phi.append((sum(x[1] for x in u) - sum(x[0] for x in u)) * damp)
    prior = model.prior[1] - model.prior[0]

    def through(odds: float, p: tuple, up: bool) -> float:
        """Log odds that pass an edge; p[a][b]: parent's state a, child's b."""
        hi = max(odds, 0.0)
        zero, one = math.exp(-hi), math.exp(odds - hi)
        if up:
            return math.log((math.exp(p[1][0]) * zero + math.exp(p[1][1]) * one) / (math.exp(p[0][0]) * zero + math.exp(p[0][1]) * one))
        return math.log((math.exp(p[0][1]) * zero + math.exp(p[1][1]) * one) / (math.exp(p[0][0]) * zero + math.exp(p[1][0]) * one))

    table = [model.pair.get(pair_kind(t), model.unseen) for t in dom.tag]
    up = [0.0] * n
    belief = phi.copy()
    belief[0] += prior
    for k in range(n - 1, 0, -1):
        up[k] = through(belief[k], table[k], True)
        belief[dom.parent[k]] += up[k]
    for k in range(1, n):  # parents first: belief of the parent is final here
        belief[k] += through(belief[dom.parent[k]] - up[k], table[k], False)
    return belief


def main_text(page: str | None, model: Potentials) -> str:
    dom = parse(page)
    odds = marginals(dom, model)
    return "\n".join(text for k, text, _ in dom.blocks if odds[k] > 0)


def labelled_pages(rows: int = 400, seed: int = 11) -> Iterator[tuple[str, set[str]]]:
    """Reproducible labelled pages in the layouts that sites commonly use: (html, texts of the content blocks).

    Pages that people have labelled can be used in its place.
    """
    rng = np.random.default_rng(seed)
    syllables = "ka lo mi ren ta vo shi pal dor en ist ur be na".split()
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    prose = lambda low, high: (" ".join(word() for _ in range(rng.integers(low, high))) + ".").capitalize()
    some = lambda *x: x[rng.integers(len(x))]
    link = lambda: f'<a href="/{word()}">{word()}</a>'
    attr = lambda *names: some("", f' class="{some(*names)}"', f' id="{some(*names)}"') if rng.random() < 0.5 else f' class="{some(*names)}"'
    for _ in range(rows):
        wanted: set[str] = set()
        terse = rng.random() < 0.15  # dialogues, poems: many short paragraphs

        def own(low: int, high: int) -> str:
            t = prose(low, high)
            wanted.add(t)
            return t

        def paragraph() -> str:
            t = own(1, 7) if terse else own(1, 90)
            style = rng.random()
            if style < 0.15:
                return f"<p><b>{t}<br>"
            if style < 0.3:
                words = t.split(" ")
                words[0] = f"<a href='/x'>{words[0]}</a>"
                return f"<p>{' '.join(words)}</p>"
            return f"<p>{t}</p>"

        menu = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.integers(3, 9))) + "</ul>"
        top = [f"<nav{attr('nav', 'menu')}>{menu()}</nav>"] if rng.random() < 0.8 else [f'<div class="{some("menu", "navbar", "nav-main")}">{menu()}</div>']
        if rng.random() < 0.5:
            top.append(f"<header{attr('header', 'masthead')}><h2>{prose(1, 4)}</h2><p>{prose(3, 9)}</p></header>")
        extra = [
            lambda: f'<div class="{some("ad", "ads", "advert", "sponsored", "banner", "promo")}">{prose(4, 20)}</div>',
            lambda: f'<div class="{some("cookie-notice", "notice", "consent", "popup", "newsletter")}"><p>{prose(6, 25)}</p></div>',
            lambda: f"<aside{attr('sidebar', 'widget', 'related')}><h3>{prose(1, 4)}</h3>{some(menu(), '<p>' + prose(8, 25) + '</p>')}</aside>",
            lambda: f'<form{attr("search", "form", "login")}><label>{prose(1, 3)}</label><input name="q"><button>{word()}</button></form>',
            lambda: f'<div class="{some("share", "social", "tags", "breadcrumb", "pagination")}">{link()} {link()} {link()}</div>',
            lambda: f'<div class="{some("sidebar", "region sidebar", "side-column")}"><div class="{some("block", "widget")}"><p>{prose(6, 25)}</p></div></div>',
        ]
        remark = lambda: some(
            f'<div class="comment"><p>{prose(5, 40)}</p></div>', f'<article class="comment"><div class="{some("content", "body", "text")}"><p>{prose(5, 40)}</p></div></article>', f'<li class="comment"><b>{word()}</b><p>{prose(5, 40)}</p></li>'
        )
        comments = lambda: f'<{(t := some("div", "section", "ol"))} class="{some("comments", "comment-list", "reply-list")}">' + "".join(remark() for _ in range(rng.integers(1, 5))) + f"</{t}>"
        body = [f"<h1>{own(2, 12)}</h1>"]
        for k in range(rng.integers(8, 40) if terse else rng.integers(1, 12)):
            kind, listing = rng.random(), some("ul", "ol")
            body.append(
                f"<h2>{own(2, 8)}</h2>" if kind < 0.1 else f"<blockquote>{own(8, 40)}</blockquote>" if kind < 0.15
                else f"<{listing}>" + "".join(f"<li>{own(2, 20)}</li>" for _ in range(rng.integers(2, 7))) + f"</{listing}>" if kind < 0.25 else paragraph()
            )
            if rng.random() < 0.08:
                body.append(extra[rng.integers(len(extra))]())
        column = lambda n: "<br>".join(link() for _ in range(n))
        table = (f"<table><tr><td>{column(rng.integers(3, 9))}</td><td>", f"</td><td>{column(rng.integers(2, 9))}</td></tr></table>")
        shell = some(table, ("<article>", "</article>"), ("<main><article>", "</article></main>"), ('<div class="post-content">', "</div>"), ('<div id="content">', "</div>"), ("<main>", "</main>"), ("<section class=\"story\">", "</section>"))
        tail = [e() for e in extra if rng.random() < 0.3] + ([comments()] if rng.random() < 0.4 else [])
        foot = f"<footer>&copy; {word()}.example &middot; {prose(3, 14)}</footer>" if rng.random() < 0.7 else f'<div class="footer"><p>{prose(3, 14)}</p></div>'
        before = [e() for e in extra if rng.random() < 0.25]
        yield "<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t='</p>'</script></head><body>" + "".join([*top, *before, shell[0], *body, shell[1], *tail, foot]) + "</body></html>", wanted


def extract_text(pages: DataFrame, model: Potentials, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars (code points).

    Text blocks of the page in order, joined by one line feed, white space inside a block as one space. Null and empty pages, and pages without
    content, give an empty text. Null ids and urls and repeated rows are passed through; other columns are ignored. Whole pages are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, model) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
