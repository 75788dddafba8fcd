"""Main-text extraction with a tree-structured graphical model.

A page becomes a tree of its block-level elements.  Each element has a hidden state, content or not.
Unary potentials come from structure first: the kinds of elements around it, where it stands relative to
the element with most prose (its hub: above, child, deeper, before, after), the amount, share and
punctuation of its text, its share of links, and how many siblings look alike; the words of class, id and
role help where they are known.  Pairwise potentials connect parent and child.  Sum-product messages go up
and down the tree and give each element's marginal; the text blocks of elements with a content marginal
of at least one half are the main text.  Unary weights are a regularised logistic model, pairwise
potentials are counts, both fitted on labelled pages: :func:`labelled_pages` composes them from wrappers
and page parts, a good part of them with no or meaningless names.

Defined results: a null or empty page has an empty text and 0 characters; tags left open or closed
twice are resolved as below; a tie (a marginal of exactly one half) is content, and of several elements
with equally much prose the first is the hub; a very long or deep page is parsed whole in time linear in
its length; repeated rows each give one row; an empty table gives no rows; extra columns are ignored.  A
block's white space becomes single spaces (a line break is white space), blocks are joined in page order
by one newline, and nothing is cut off.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, sigmoid, texts

# HTML element kinds.
BLOCKS = set(
    "html head body header footer nav main aside article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption form fieldset legend select option button label address details summary dialog menu hr center".split()
)
RAW = set("script style title textarea iframe noscript noframes template xmp svg object".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag closes an open element of the listed kinds.
CLOSES = {
    "p": {"p"}, "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "option": {"option"},
    "tr": {"p", "td", "th", "tr"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"},
}
#: Elements that hold others; parent-child potentials of these differ from those of the rest.
CONTAINERS = set("html body main article section div aside header footer nav form table".split())
#: Elements that an implied end tag doesn't reach out of.
SCOPES = {"ul", "ol", "dl", "table", "select", "html"}
#: Elements whose kind says something about all that is inside them.
MARKS = "article main section nav aside header footer form table ul ol dl figure blockquote pre address details dialog menu select fieldset button label".split()
#: Elements whose text counts as prose of the element around them.
PROSE = set("p h1 h2 h3 h4 h5 h6 li dd dt pre blockquote figcaption".split())
#: Elements that never hold the article, whatever they hold.
ASIDE = set("nav aside footer form select dialog menu button".split())

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?:(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<loose>[^>]*)(?:>|\Z))|<[!?/][^>]*(?:>|\Z)", re.S
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LETTERS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"[\s\xa0]+")
_STOPS = re.compile(r"[.!?,;:]")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    names: tuple[str, ...]
    label: int
    words: int = 0
    link_words: int = 0
    stops: int = 0


@dataclass
class Page:
    elements: list[Element]
    blocks: list[tuple[int, str]]


class OpenElements:
    """The stack of open elements, with counts that tell at once whether an end tag has anything to close."""

    def __init__(self, elements: list[Element]):
        self.elements, self.stack = elements, [0]
        self.within: list[Counter[str]] = [Counter()]  # open tags inside each open scope
        self.all: Counter[str] = Counter()

    def push(self, i: int) -> None:
        tag = self.elements[i].tag
        self.stack.append(i)
        self.all[tag] += 1
        self.within[-1][tag] += 1
        if tag in SCOPES:
            self.within.append(Counter())

    def pop(self) -> str:
        tag = self.elements[self.stack.pop()].tag
        if tag in SCOPES:
            self.within.pop()
        self.all[tag] -= 1
        self.within[-1][tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        if self.all[tag]:
            while self.pop() != tag:
                pass

    def close_implied(self, kinds: set[str]) -> None:
        here = self.within[-1]
        while any(here[k] for k in kinds):
            while self.pop() not in kinds:
                pass


def parse(html: str) -> Page:
    """Elements in page order (parents first) and text blocks with the element they stand in."""
    elements = [Element("html", -1, (), 0)]
    blocks: list[tuple[int, str]] = []
    open_ = OpenElements(elements)
    text: list[str] = []
    links = link_words = 0

    def flush() -> None:
        nonlocal link_words
        if not text:
            return
        joined = _SPACE.sub(" ", unescape("".join(text))).strip()
        text.clear()
        if joined:
            e = elements[open_.stack[-1]]
            e.words += joined.count(" ") + 1
            e.link_words += link_words
            e.stops += len(_STOPS.findall(joined))
            blocks.append((open_.stack[-1], joined))
        link_words = 0

    at = 0
    while m := _TAG.search(html, at):
        piece = html[at : m.start()]
        if piece:
            text.append(piece)
            if links:
                link_words += len(piece.split())
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in RAW:
            if not m["end"]:
                end = _RAW_END[tag].search(html, at)
                at = end.end() if end else len(html)
        elif tag == "a":
            links = 0 if m["end"] else 1
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCKS:
            flush()
            if m["end"]:
                open_.close(tag)
            elif tag not in VOID:
                open_.close_implied(CLOSES.get(tag, {"p"}))
                names, label = [], elements[open_.stack[-1]].label
                for a in _ATTR.finditer(attrs) if (attrs := m["attrs"] or m["loose"]) else ():
                    value = a[2] or a[3] or a[4] or ""
                    if a[1].lower() == "data-label":
                        label = int(value == "main")
                    else:
                        names += _LETTERS.findall(value.lower())
                elements.append(Element(tag, open_.stack[-1], tuple(names), label))
                open_.push(len(elements) - 1)
    text.append(html[at:])
    flush()
    return Page(elements, blocks)


# --- features --------------------------------------------------------------------------------------


def hub_of(page: Page) -> int:
    """The element that prose gathers in: paragraphs count for what is around them, and half for what is around
    that.  Inside an article or main element it is the innermost of these."""
    n = len(page.elements)
    gain, barred, whole = [0.0] * n, [False] * n, [-1] * n
    for i, e in enumerate(page.elements):
        if i:
            barred[i] = barred[e.parent] or e.tag in ASIDE or e.tag == "header" and whole[e.parent] < 0
            whole[i] = i if e.tag in ("article", "main") else whole[e.parent]
        if e.words and not barred[i]:
            prose = e.words - 0.9 * e.link_words
            at = e.parent if e.tag in PROSE and i else i
            gain[at] += prose
            if at:
                gain[page.elements[at].parent] += prose / 2
    best = max(range(n), key=lambda i: (whole[i] >= 0 and gain[i] > 0, gain[i], -i))
    return whole[best] if whole[best] >= 0 else best


def features(page: Page, bits: dict[str, int]) -> tuple[list[tuple], list[int]]:
    """Each element's own description, and the set (as bits) of kinds and names of it and what it stands in."""
    elements = page.elements
    n = len(elements)
    words, linked, stops = ([getattr(e, k) for e in elements] for k in ("words", "link_words", "stops"))
    alike: Counter[tuple] = Counter()
    inner = [0] * n
    for i in range(n - 1, 0, -1):
        p = elements[i].parent
        for sizes in (words, linked, stops):
            sizes[p] += sizes[i]
        alike[p, elements[i].tag, elements[i].names] += 1
        inner[p] += 1
    hub = hub_of(page)
    above, i = set(), elements[hub].parent
    while i >= 0:
        above.add(i)
        i = elements[i].parent
    out: list[tuple] = []
    around: list[int] = []
    place: list[str] = []
    for i, e in enumerate(elements):
        if i == hub:
            at = "hub"
        elif i in above:
            at = "above"
        elif i and place[e.parent] in ("hub", "child", "deeper"):
            at = "child" if e.parent == hub else "deeper"
        else:
            at = "before" if i < hub else "after"
        place.append(at)
        mask = around[e.parent] if i else 0
        for name in (e.tag, *e.names):
            mask |= bits.get(f"in {name}", 0)
        around.append(mask)
        size = min(5, words[i].bit_length() // 2)
        link = "none" if not words[i] else min(3, int(4 * linked[i] / words[i]))
        prose = "none" if not words[i] else min(2, int(12 * stops[i] / words[i]))
        same = min(3, alike[e.parent, e.tag, e.names].bit_length()) if i else 0
        holds = "holds" if inner[i] else "leaf"
        share = min(4, 5 * words[i] // max(1, words[0]))
        out.append((e.tag, at, link, holds, size, prose, same, elements[e.parent].tag if i else "", share, e.names))
    return out, around


def spelled(described: tuple) -> list[str]:
    """The names of the features that an element's description stands for."""
    tag, at, link, holds, size, prose, same, parent, share, names = described
    return [
        f"tag {tag}", f"at {at}", f"tag {tag} at {at}", f"links {link} at {at}", f"links {link} {holds} at {at}", f"links {link} tag {tag} at {at}", f"size {size} at {at}", f"stops {prose} at {at}",
        f"same {same} {holds} at {at}", f"parent {parent} tag {tag} at {at}", f"share {share} at {at}", *(f"name {x}" for x in names),
    ]


class TreeModel:
    """Unary weights per feature and parent-child potentials, fitted on labelled pages."""

    def __init__(self, pages: list[str], l2: float = 1e-4, steps: int = 150, rate: float = 0.1):
        parsed = [parse(p) for p in pages]
        spread = Counter(n for p in parsed for n in {x for e in p.elements for x in e.names})
        known = sorted(n for n, k in spread.items() if k >= 3)
        self.bits = {f"in {x}": 1 << k for k, x in enumerate([*MARKS, *(n for n in known if n not in MARKS)])}
        pairs: Counter[tuple[bool, int, int]] = Counter()
        seen: Counter[tuple] = Counter()  # elements alike in all features are one weighted row
        for page in parsed:
            own, around = features(page, self.bits)
            for e, described, mask in zip(page.elements, own, around, strict=True):
                seen[described[:-1], tuple(x for x in described[-1] if f"in {x}" in self.bits), mask, e.label] += 1
                if e.parent >= 0:
                    pairs[e.tag in CONTAINERS, page.elements[e.parent].label, e.label] += 1
        rows = [spelled((*own, names)) + [b for b, bit in self.bits.items() if mask & bit] for own, names, mask, _ in seen]
        columns = {f: j for j, f in enumerate(sorted({f for r in rows for f in r}))}
        x, y = np.zeros((len(rows), len(columns) + 1), np.float32), np.array([k[-1] for k in seen], np.float32)
        weight = np.array(list(seen.values()), np.float32) / max(1, seen.total())
        x[:, -1] = 1
        for i, r in enumerate(rows):
            x[i, [columns[f] for f in r]] = 1
        theta, m, v = np.zeros(x.shape[1], np.float32), 0.0, 0.0
        for step in range(1, steps + 1):
            g = x.T @ (weight * (sigmoid(x @ theta) - y)) + l2 * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
            theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights = {f: float(theta[j]) for f, j in columns.items()}
        # the pairwise potentials hold how frequent content is, so the unary ones give it up
        share = (float(weight @ y) * seen.total() + 0.5) / (seen.total() + 1)
        self.root = math.log(share / (1 - share))
        self.bias = float(theta[-1]) - self.root
        self.pair = {k: [[(pairs[k, p, c] + 0.5) / (pairs[k, p, 0] + pairs[k, p, 1] + 1) for c in (0, 1)] for p in (0, 1)] for k in (False, True)}

    def odds(self, page: Page) -> list[float]:
        """Log odds of content of each element, from its own features and what it stands in."""
        own, around = features(page, self.bits)
        inner: dict[tuple, float] = {}  # elements alike are many
        outer: dict[int, float] = {}
        out = []
        for described, mask in zip(own, around, strict=True):
            if (x := inner.get(described)) is None:
                x = inner[described] = sum(self.weights.get(f, 0.0) for f in spelled(described))
            if (y := outer.get(mask)) is None:
                y = outer[mask] = self.bias + sum(self.weights.get(b, 0.0) for b, bit in self.bits.items() if mask & bit)
            out.append(max(-30.0, min(30.0, x + y)))
        out[0] += self.root
        return out

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each element, by sum-product messages up and then down the tree."""
        n = len(page.elements)
        belief = [[1.0, math.exp(x)] for x in self.odds(page)]
        up = [[1.0, 1.0]] * n
        for i in range(n - 1, 0, -1):  # children stand after their parents
            a, b = belief[i]
            pair = self.pair[page.elements[i].tag in CONTAINERS]
            m = [pair[p][0] * a + pair[p][1] * b for p in (0, 1)]
            up[i] = [m[0] / (m[0] + m[1]), m[1] / (m[0] + m[1])]
            parent = belief[page.elements[i].parent]
            x, y = parent[0] * up[i][0], parent[1] * up[i][1]
            parent[0], parent[1] = x / (x + y), y / (x + y)
        for i in range(1, n):
            a, b = belief[page.elements[i].parent]
            a, b = a / max(up[i][0], 1e-300), b / max(up[i][1], 1e-300)
            pair = self.pair[page.elements[i].tag in CONTAINERS]
            down = [a * pair[0][c] + b * pair[1][c] for c in (0, 1)]
            x, y = belief[i][0] * down[0], belief[i][1] * down[1]
            belief[i] = [x / (x + y), y / (x + y)]
        return [b[1] / (b[0] + b[1]) for b in belief]

    def main_text(self, html: str) -> str:
        page = parse(html)
        marginal = self.marginals(page)
        return "\n".join(t for i, t in page.blocks if marginal[i] >= 0.5)


# --- labelled pages --------------------------------------------------------------------------------

# Names in use for the parts of pages.
NAMES = {
    "main": "content post-content entry-content article-body story post text body main-content",
    "menu": "menu navbar nav navigation top-nav site-nav breadcrumb breadcrumbs tabs toolbar",
    "header": "site-header masthead logo branding top header",
    "footer": "site-footer footer copyright legal colophon bottom",
    "side": "sidebar widget rail aside related recommended popular trending taboola outbrain more",
    "ad": "ad ads advert advertisement sponsored promo promoted banner",
    "notice": "cookie consent notice alert popup modal gdpr overlay",
    "comments": "comments comment-list commentlist discussion responses disqus replies",
    "comment": "comment reply comment-body response",
    "share": "share social sharing follow",
    "form": "newsletter subscribe search login signup",
    "meta": "byline author meta date",
}


class Composer:
    """Draws labelled pages: every part that isn't the article carries the label on its outermost element."""

    def __init__(self, seed: int):
        self.draw = random.Random(seed)

    def prose(self, low: int, high: int) -> str:
        draw, n, out = self.draw, self.draw.randint(low, high), []
        while n > 0:
            k = min(n, draw.randint(4, 16))
            out.append(" ".join("word" + draw.choice(["", "", "", "", ",", "!", "##"]) for _ in range(k)) + draw.choice(["."] * 6 + ["", "!!"]))
            n -= k
        return " ".join(out)

    def attributes(self, kind: str) -> str:
        chance = self.draw.random()
        if chance < 0.4:
            return ""
        name = self.draw.choice(NAMES[kind].split()) if chance < 0.65 else "".join(self.draw.choices("bcdfghklmnprstvwxz", k=7))
        return f' {self.draw.choice(["class", "class", "id"])}="{name}"'

    def tag(self, tags: str, kind: str, inside: str) -> str:
        tag = self.draw.choice(tags.split())
        return f"<{tag}{self.attributes(kind)}>{inside}</{tag}>"

    def links(self, n: int, words: int = 3) -> list[str]:
        return [f'<a href="/x">{" ".join(["word"] * self.draw.randint(1, words))}</a>' for _ in range(n)]

    def menu(self) -> str:
        links = self.links(self.draw.randint(2, 9))
        if self.draw.random() < 0.15:
            links = ["word"] * len(links)
        way = self.draw.randrange(4)
        if way == 0:
            return f"<table{self.attributes('menu')}><tr>{''.join(f'<td>{x}</td>' for x in links)}</tr></table>"
        inside = f"<ul>{''.join(f'<li>{x}</li>' for x in links)}</ul>" if way < 3 else self.draw.choice([" ", " | "]).join(links)
        return self.tag("nav div div", "menu", inside)

    def header(self) -> str:
        title = self.draw.choice(["<h1>word word</h1>", '<a href="/">word</a>', "<div>word word</div>", '<h2><a href="/">word</a></h2>'])
        return self.tag("header header div", "header", title + self.draw.choice(["", f"<p>{self.prose(2, 9)}</p>"]) + self.draw.choice(["", self.menu(), self.form()]))

    def form(self) -> str:
        return f"<form{self.attributes('form')}>{self.draw.choice(['', f'<p>{self.prose(4, 25)}</p>', '<label>word</label>'])}{self.draw.choice(['', '<select><option>word<option>word word</select>'])}<button>word</button></form>"

    def ad(self) -> str:
        text = self.prose(2, 30)
        return self.tag("div div section", "ad", self.draw.choice([text, f"<p>{text}</p>", f'<a href="/x">{text}</a>']))

    def notice(self) -> str:
        return self.tag("div div section dialog", "notice", f"<p>{self.prose(6, 45)}</p>{self.draw.choice(['<button>word</button>', self.links(1)[0], ''])}")

    def side(self) -> str:
        title = self.draw.choice(["", "<h3>word word</h3>", "<h2>word</h2>"])
        n = self.draw.randint(2, 7)
        if self.draw.random() < 0.6:
            inside = f"<ul>{''.join(f'<li>{x}</li>' for x in self.links(n, 12))}</ul>"
        else:
            inside = "".join(f"<div{a}><h4>{x}</h4>{self.draw.choice(['', f'<p>{self.prose(3, 18)}</p>'])}</div>" for a in [self.attributes("side")] for x in self.links(n, 9))
        return self.tag("aside div div section", "side", title + inside)

    def share(self) -> str:
        links = self.links(self.draw.randint(2, 6), 2)
        return self.tag("div div", "share", self.draw.choice([f"<ul>{''.join(f'<li>{x}</li>' for x in links)}</ul>", " ".join(links)]))

    def comments(self) -> str:
        outer = self.draw.choice(["section", "div", "div", "ol", "ul"])
        item, own = ("li" if outer in ("ol", "ul") else self.draw.choice(["div", "div", "article"])), self.attributes("comment")
        meta = self.draw.choice(["", "<div>word word</div>", '<div><a href="/u">word</a> word</div>', "<h4>word</h4>", "<b>word</b>"])
        one = lambda: f"<{item}{own}>{meta}{self.draw.choice([self.prose(3, 30), ''.join(f'<p>{self.prose(3, 40)}</p>' for _ in range(self.draw.randint(1, 2)))])}</{item}>"
        title = "" if outer in ("ol", "ul") else self.draw.choice(["", "<h2>word</h2>", "<h3>7 word</h3>"])
        return f"<{outer}{self.attributes('comments')}>{title}{''.join(one() for _ in range(self.draw.randint(1, 7)))}{'' if outer in ('ol', 'ul') else self.draw.choice(['', self.form()])}</{outer}>"

    def footer(self) -> str:
        inside = self.draw.choice([f"&copy; {self.prose(2, 12)}", f"<p>{self.prose(3, 30)}</p>", f"{self.menu()}<p>{self.prose(3, 20)}</p>", f"{' '.join(self.links(3))} {self.prose(2, 9)}"])
        return self.tag("footer footer footer div", "footer", inside)

    def block(self) -> str:
        draw = self.draw
        p = lambda low=3, high=90: f"<p>{self.prose(low, high)}{draw.choice(['</p>', '</p>', '</p>', ''])}"
        li = lambda: "".join(f"<li>{self.prose(1, 25)}</li>" for _ in range(draw.randint(1, 6)))
        cell = lambda: f"<td>{self.prose(1, 6)}</td>"
        return draw.choice([
            p, p, p, p, p, p, lambda: p(1, 4), lambda: p(40, 200), lambda: f"<p>{self.prose(3, 20)} {self.links(1)[0]} {self.prose(1, 20)}</p>", lambda: f"<p><b>{self.prose(1, 9)}<br>{self.prose(1, 9)}</b></p>",
            lambda: f"<h{draw.randint(2, 4)}>word word</h{draw.randint(2, 4)}>", lambda: f"<h2>word word</h2>{p()}", lambda: f"<ul>{li()}</ul>", lambda: f"<ol>{li()}</ol>",
            lambda: f"<ul>{''.join(f'<li>{x}</li>' for x in self.links(draw.randint(1, 6), 5))}</ul>", lambda: f"<blockquote>{p()}</blockquote>", lambda: f"<pre>{self.prose(3, 40)}</pre>",
            lambda: f"<figure><figcaption>{self.prose(2, 15)}</figcaption></figure>", lambda: f"<table>{''.join(f'<tr>{cell()}{cell()}</tr>' for _ in range(draw.randint(1, 4)))}</table>",
            lambda: f"<dl><dt>word</dt><dd>{self.prose(2, 20)}</dd></dl>", lambda: f"<div>{p()}{p()}</div>", lambda: f"<section><h2>word word</h2>{p()}{p()}</section>", lambda: f"<div>{self.prose(5, 60)}</div>",
        ])()

    def article(self) -> str:
        """The blocks of an article, with other parts between them now and then."""
        draw = self.draw
        title = draw.choice(["<h1>word word word</h1>"] * 4 + ["<h2>word word</h2>", "", f"<h1>{self.prose(3, 20)}</h1>"])
        meta = draw.choice(["", "", f"<p{self.attributes('meta')}>word word, word 3</p>", f"<div{self.attributes('meta')}>word word</div>"])
        head = f"<header>{title}{meta}</header>" if title and draw.random() < 0.25 else title + meta
        out = [head, *(self.block() for _ in range(draw.choice([0, 1, 1, 2, 3, 5, 8, 12])))]
        for _ in range(draw.choice([0, 0, 1, 2])):
            out.insert(draw.randint(1, len(out)), other(draw.choice([self.ad, self.side, self.share, self.form, self.comments, self.menu, self.notice, self.footer])()))
        return "".join(out) if "".join(out) else "<p>word word.</p>"

    def page(self) -> str:
        draw, inside = self.draw, self.article()
        way, own = draw.randrange(10), self.attributes("main")
        if way < 5:
            tag = draw.choice(["article", "article", "main", "article", "section"])
            body = f'<{tag}{own} data-label="main">{inside}</{tag}>'
            body = f"<main>{body}</main>" if tag == "article" and draw.random() < 0.3 else body
        elif way < 8:
            body = f'<div{own} data-label="main">{draw.choice([inside, f"<div{self.attributes('main')}>{inside}</div>"])}</div>'
        elif way == 8:
            body = f'<table><tr><td data-label="main">{inside}</td>{draw.choice(["", other(f"<td>{self.side()}</td>")])}</tr></table>'
        else:
            body = ""
        before = "".join(other(x()) for x in draw.sample([self.menu, self.header, self.notice, self.ad, self.menu, self.side], draw.randint(0, 3)))
        after = "".join(other(x()) for x in draw.sample([self.comments, self.footer, self.side, self.ad, self.share, self.notice, self.footer, self.comments], draw.randint(0, 4)))
        if not body:
            return f'<html><head><title>x</title></head><body data-label="main">{before}{inside}{after}</body></html>'
        shell = self.attributes("main") if draw.random() < 0.3 else None
        whole = f"{before}{body}{after}"
        return f"<html><head><title>x</title></head><body>{whole if shell is None else f'<div{shell}>{whole}</div>'}</body></html>"


def other(part: str) -> str:
    """``part`` with the label of what isn't content on its outermost element."""
    return re.sub(r"^<(\w+)", r'<\1 data-label="other"', part)


def labelled_pages(n: int = 800, seed: int = 5) -> list[str]:
    """Training pages: articles in many wrappers among and around other parts."""
    composer = Composer(seed)
    return [composer.page() for _ in range(n)]


@cache
def trained() -> TreeModel:
    return TreeModel(labelled_pages())


def extract(pages: DataFrame, training: list[str] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    model = trained() if training is None else TreeModel(training)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.main_text(h) for h in texts(batch.column("html"))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return mapped(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
