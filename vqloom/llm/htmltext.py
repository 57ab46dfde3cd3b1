"""HTML main text by a tree-structured graphical model.

A page is parsed into a tree of elements and text runs, one node each, with a binary label: content or not. Every node has a potential
from its features (tag, words of its class and id, length, link share, punctuation), every parent-child edge a 2 x 2 potential chosen by the child's kind.
Sum-product messages go up from the leaves and down from the root and give each node's marginal; text runs whose marginal is at
least one half are the main text. The potentials are trained on labelled pages by gradient ascent on the exact likelihood: observed
minus expected feature counts, the latter from the same messages.

The labelled pages are made here from a small grammar of page parts (`labelled_pages`), whose labels are known by construction.

Defined results: a null or empty page has the empty text; markup that never closes is closed at the end; text of script, style and the like is
never text; a page whose content has no positive node gives the empty text. Nothing is cut or capped.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

#: A tag runs to its '>' or the end; a quote counts only behind '=', and one that never closes is a plain character. Nothing is given back, so a scan is linear.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</?([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Words of names; the first and the last group mark one that the name itself takes back.
NAME = re.compile(r"((?:no|without|hide|not)[-_])?+([a-z]++)([-_](?:off|none|closed|disabled|hidden)\b)?")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Their text is never part of a page.
RAW = {"script", "style", "template", "noscript", "textarea", "title", "iframe", "svg", "math", "object", "select", "canvas", "xmp"}
CLOSING = {t: re.compile(rf"</{t}\s*+>", re.I) for t in RAW}
#: Elements that run inside a line; all others make blocks and nodes.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: A start tag of the key closes an open one of the values.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SCOPE = {"table", "td", "th", "ul", "ol", "dl", "body", "html", "div", "article", "section", "aside", "main"}


class Node:
    """An element (tag) or a text run (tag '#'), with what its features need."""

    __slots__ = ("tag", "names", "up", "kids", "text", "linked", "chars")

    def __init__(self, tag: str, up: int, names: tuple[str, ...] = ()):
        self.tag, self.up, self.names, self.kids = tag, up, names, []
        self.text: list[str] = []
        self.linked = self.chars = 0


class _Open:
    """The open elements. Counts by name, for each block of inline elements and each scope, tell whether an end tag has anything to close, so that none searches in vain."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = [("page", 0)]  # inline ones stand for the block around them
        self.blocks: Counter = Counter()
        self.inline: list[Counter] = [Counter()]
        self.scopes: list[Counter] = [Counter()]
        self.links = 0

    def push(self, tag: str, node: int) -> None:
        self.stack.append((tag, node))
        if tag in INLINE:
            self.inline[-1][tag] += 1
            self.links += tag == "a"
            return
        self.blocks[tag] += 1
        self.inline.append(Counter())
        if tag in SCOPE:
            self.scopes.append(Counter())
        self.scopes[-1][tag] += 1

    def pop_to(self, tags) -> None:
        """Closes elements up to the last one of `tags`."""
        tag = ""
        while tag not in tags:
            tag, _ = self.stack.pop()
            if tag in INLINE:
                self.inline[-1][tag] -= 1
                self.links -= tag == "a"
                continue
            self.blocks[tag] -= 1
            self.inline.pop()
            self.scopes[-1][tag] -= 1
            if tag in SCOPE:
                self.scopes.pop()

    def end(self, tag: str) -> None:
        """An inline element closes within its block only."""
        if (self.inline[-1] if tag in INLINE else self.blocks)[tag] > 0:
            self.pop_to((tag,))

    def make_room(self, tags: set[str]) -> None:
        """Closes the last open one of `tags` within the nearest scope."""
        if any(self.scopes[-1][t] > 0 for t in tags):
            self.pop_to(tags)


def parse(html: str) -> list[Node]:
    """Nodes in page order, each after its parent; the first is the page. Time is linear in the page's length."""
    nodes = [Node("page", -1)]
    opened = _Open()
    run, at = -1, 0

    def add(piece: str, whole: bool = True) -> None:
        nonlocal run
        if not piece:
            return
        here = opened.stack[-1][1]
        if run < 0:
            if not piece.strip():
                return
            nodes.append(Node("#", here))
            run = len(nodes) - 1
            nodes[here].kids.append(run)
        node = nodes[run]
        text = unescape(piece) if whole and "&" in piece else piece
        node.text.append(text)
        node.chars += len(text)
        if opened.links:
            node.linked += len(text)

    while m := TOKEN.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        token = m.group()
        if not m.group(1):
            if token.startswith("<![CDATA["):
                add(token[9:].removesuffix("]]>"), False)
            continue
        tag, end = m.group(1).lower(), token[1] == "/"
        if not end and tag in RAW:
            close = CLOSING[tag].search(html, at)
            at = close.end() if close else len(html)
            if tag not in ("svg", "math"):
                run = run if tag in INLINE else -1
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in INLINE:
            opened.end(tag) if end else opened.push(tag, opened.stack[-1][1])
            continue
        run = -1
        if tag in VOID:
            continue
        if end:
            opened.end(tag)
            continue
        shut = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        if shut:
            opened.make_room(shut)
        names = []
        rest = m.group(2)
        if rest and "=" in rest or rest and "hidden" in rest:
            for a in ATTRIBUTE.finditer(rest):
                kind, value = a.group(1).lower(), (a.group(2) or "").lower()
                if kind in ("class", "id", "role"):
                    names += [w for no, w, off in NAME.findall(value) if not no and not off]
                elif kind == "hidden" or "none" in value.replace(" ", "") and kind == "style" or kind == "aria-hidden" and "true" in value:
                    names.append("hidden")
        here = opened.stack[-1][1]
        nodes.append(Node(tag, here, tuple(names)))
        nodes[here].kids.append(len(nodes) - 1)
        opened.push(tag, len(nodes) - 1)
    add(html[at:])
    return nodes


#: Words of class names that say the same about a part of the page.
GROUPS = {
    "ad": "ad ads adv advert advertisement sponsor sponsored promo promotion banner",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc links tabs skip",
    "side": "sidebar side aside widget related recommend recommended more rail trending popular",
    "notice": "cookie cookies consent notice gdpr popup modal overlay alert subscribe newsletter signup paywall login toast",
    "comment": "comment comments reply replies discussion respond disqus reader feedback",
    "foot": "footer foot copyright legal imprint disclaimer colophon",
    "head": "header masthead topbar logo branding banner site toolbar",
    "share": "share sharing social tags meta byline author date tools print",
    "form": "search form newsletter contact",
    "main": "article content main post entry story body text page prose",
    "hidden": "hidden sr",
}
WORD_GROUP = {w: g for g, words in GROUPS.items() for w in words.split()}
TAGS = ("page", "html", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "nav", "aside", "header", "footer", "form", "fieldset", "button", "table", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "dl", "dialog", "details", "head", "address", "menu")
FEATURE_NAMES = ["bias", "text", "other", *[f"tag {t}" for t in TAGS], *[f"name {g}" for g in GROUPS], "short", "long", "linked", "stops", "sign"]
INDEX = {n: i for i, n in enumerate(FEATURE_NAMES)}
#: Edges by the child's kind.
EDGES = {"#": 0, "p": 1, "li": 1, "h1": 1, "h2": 1, "h3": 1, "tr": 1, "td": 1, "blockquote": 1, "nav": 2, "aside": 2, "header": 2, "footer": 2, "form": 2, "dialog": 2}
EDGE_KINDS = 4
SIGNS = re.compile("©")


def node_features(node: Node) -> list[int]:
    """Indexes of a node's binary features."""
    out = [0]
    if node.tag == "#":
        text = "".join(node.text)
        out.append(INDEX["text"])
        if node.chars < 25:
            out.append(INDEX["short"])
        elif node.chars > 120:
            out.append(INDEX["long"])
        if node.linked * 2 > node.chars:
            out.append(INDEX["linked"])
        if text.rstrip()[-1:] in (".", "!", "?", "…", "。", '"', "”"):
            out.append(INDEX["stops"])
        if SIGNS.search(text):
            out.append(INDEX["sign"])
        return out
    out.append(INDEX.get(f"tag {node.tag}", INDEX["other"]))
    for g in {WORD_GROUP[w] for w in node.names if w in WORD_GROUP}:
        out.append(INDEX[f"name {g}"])
    return out


def edge_kind(node: Node) -> int:
    return EDGES.get(node.tag, 3)


def marginals(nodes: list[Node], features: list[list[int]], unary: list[float], pair: list[tuple[float, float, float, float]]) -> tuple[list[float], list[tuple[float, float, float, float]], float]:
    """P(content) of every node, the joint of every edge (parent, child: 00, 01, 10, 11), and the log partition sum.

    pair: log potentials (00, 01, 10, 11) by the edge's kind. Messages are differences of logs; children come after their parents.
    """
    n = len(nodes)
    own = [sum(unary[i] for i in f) for f in features]
    belief = own[:]  # log odds from the subtree
    up = [0.0] * n
    total = 0.0
    lift = lambda x: x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))
    for i in range(n - 1, 0, -1):
        a, b, c, d = pair[edge_kind(nodes[i])]
        x = belief[i]
        zero, one = a + lift(b - a + x), c + lift(d - c + x)
        up[i] = one - zero
        total += zero
        belief[nodes[i].up] += up[i]
    total += lift(belief[0])
    outer = [0.0] * n  # log odds from everything outside the subtree
    prob, joint = [0.0] * n, [(0.0, 0.0, 0.0, 0.0)] * n
    sigmoid = lambda x: 1 / (1 + math.exp(-x)) if x > -700 else 0.0
    prob[0] = sigmoid(belief[0])
    for i in range(1, n):
        p = nodes[i].up
        a, b, c, d = pair[edge_kind(nodes[i])]
        cavity = belief[p] + outer[p] - up[i]
        outer[i] = (b + lift(d - b + cavity)) - (a + lift(c - a + cavity))
        x = belief[i]
        prob[i] = sigmoid(x + outer[i])
        s = (a, b + x, c + cavity, d + cavity + x)
        top = max(s)
        e = [math.exp(v - top) for v in s]
        z = sum(e)
        joint[i] = (e[0] / z, e[1] / z, e[2] / z, e[3] / z)
    return prob, joint, total


class Model:
    def __init__(self, unary: list[float], pair: list[tuple[float, float, float, float]]):
        self.unary, self.pair = unary, pair

    def text(self, html: str) -> str:
        nodes = parse(html)
        prob, _, _ = marginals(nodes, [node_features(x) for x in nodes], self.unary, self.pair)
        blocks = (" ".join("".join(x.text).split()) for x, p in zip(nodes, prob, strict=True) if x.tag == "#" and p >= 0.5)
        return " ".join(b for b in blocks if b)


def train(pages: list[tuple[str, set[str]]], steps: int = 150, rate: float = 0.5, l2: float = 2e-3) -> Model:
    """Gradient ascent on labelled pages: html, and the texts of its content runs."""
    data = []
    for html, content in pages:
        nodes = parse(html)
        y = [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            node = nodes[i]
            if node.tag == "#":
                y[i] = int(" ".join("".join(node.text).split()) in content)
            if y[i] and i:
                y[node.up] = 1  # an element is content if it holds any
        data.append((nodes, [node_features(x) for x in nodes], y))
    unary, pair = np.zeros(len(FEATURE_NAMES)), np.zeros((EDGE_KINDS, 4))
    gu, gp = np.zeros_like(unary), np.zeros_like(pair)
    for _ in range(steps):
        du, dp = -l2 * unary * len(data), -l2 * pair * len(data)
        weights, tables = unary.tolist(), [tuple(r) for r in pair.tolist()]
        for nodes, features, y in data:
            prob, joint, _ = marginals(nodes, features, weights, tables)
            for i, node in enumerate(nodes):
                for f in features[i]:
                    du[f] += y[i] - prob[i]
                if i:
                    kind = edge_kind(node)
                    dp[kind] -= joint[i]
                    dp[kind, 2 * y[node.up] + y[i]] += 1
        gu += du * du
        gp += dp * dp
        unary += rate * du / np.sqrt(gu + 1e-6)
        pair += rate * dp / np.sqrt(gp + 1e-6)
    return Model(unary.tolist(), [tuple(r) for r in pair.tolist()])


def labelled_pages(n: int = 120, seed: int = 5) -> list[tuple[str, set[str]]]:
    """Pages of the usual parts, with the texts of their content blocks.

    Parts come in many forms, some closing tags are left out as careless authors do, and one container in six bears a name that
    belongs to another part, so that no single name decides.
    """
    r = random.Random(seed)
    every = [w for words in GROUPS.values() for w in words.split()]
    pages = []
    for number in range(n):
        content: set[str] = set()
        careless = r.random() < 0.25
        close = lambda t: "" if careless and t in ("p", "li", "td", "tr", "b", "i", "span") and r.random() < 0.5 else f"</{t}>"  # noqa: B023, E731

        def words(lo: int, hi: int) -> str:
            return " ".join("".join(r.choice("abdegiklmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(r.randint(lo, hi)))

        def sentence() -> str:
            return words(4, 14).capitalize() + r.choice([".", ".", ".", ".", "!", "?", ":", ";", "…", ")"])

        def prose(keep: bool = True, hi: int = 6) -> str:
            t = " ".join(sentence() for _ in range(r.randint(1, hi)))
            if keep:
                content.add(t)
            return t

        def names(own: str) -> str:
            """A class or id, or none: a word of `own`, sometimes with neutral or foreign ones."""
            if not own or r.random() < 0.1:
                return ""
            out = [r.choice(own.split())]
            if r.random() < 0.3:
                out.append(words(1, 1))
            if r.random() < 0.16:
                out.append(r.choice(every))
            r.shuffle(out)
            return f' {r.choice(["class", "class", "id"])}="{r.choice([" ", " ", "-"]).join(out)}"'

        def menu(k: int) -> str:
            items = [f'<a href="/{i}">{words(1, 3)}</a>' for i in range(k)]
            return "<ul>" + "".join(f"<li>{i}{close('li')}" for i in items) + "</ul>" if r.random() < 0.8 else r.choice([" | ", " ", " &middot; "]).join(items)

        def box(own: str, inner: str, tags: tuple = ("div", "section", "aside")) -> str:
            t = r.choice(tags)
            return f"<{t}{names(own)}>{inner}</{t}>"

        def emphasis(t: str) -> str:
            tag = r.choice(["b", "i", "em", "strong", "span"])
            return f"<{tag}>{t}</{tag}>" if r.random() < 0.7 else f"<{tag}>{t}<br>"

        title = prose(hi=1) if r.random() < 0.5 else words(3, 9)
        content.add(title)
        body = [f"<h1>{title}</h1>"]
        terse = r.random() < 0.3  # nothing but short lines, some of them again and again
        for _ in range(r.randint(2, 9)):
            kind = r.random()
            if terse:
                text = prose(hi=1) if r.random() < 0.5 else words(1, 2).capitalize() + "."
                content.add(text)
                body.append(f"<p>{text}{close('p')}" * r.randint(1, 12))
            elif kind < 0.58:
                body.append(f"<p>{prose()}{close('p')}")
            elif kind < 0.66:
                body.append(f"<p>{emphasis(prose(hi=1))}{close('p')}")
            elif kind < 0.74:
                head = words(2, 6)
                content.add(head)
                body.append(f"<{(h := r.choice(['h2', 'h3']))}>{head}</{h}>")
            elif kind < 0.82:
                items = [words(2, 9) for _ in range(r.randint(2, 4))]
                content.update(items)
                tag = r.choice(["ul", "ul", "ol"])
                body.append(f"<{tag}>" + "".join(f"<li>{i}{close('li')}" for i in items) + f"</{tag}>")
            elif kind < 0.87:
                body.append(f"<blockquote><p>{prose(hi=3)}</p></blockquote>")
            elif kind < 0.91:
                body.append(f"<pre>{prose(hi=2)}</pre>")
            elif kind < 0.94:
                body.append(f"<figure><img src=x><figcaption>{prose(hi=1)}</figcaption></figure>")
            elif kind < 0.97:
                body.append(f"<div>{prose()}</div>")
            else:
                cells = [words(1, 4) for _ in range(4)]
                content.update(cells)
                body.append("<table>" + "".join(f"<tr><td>{a}{close('td')}<td>{b}{close('td')}{close('tr')}" for a, b in (cells[:2], cells[2:])) + "</table>")
            if r.random() < 0.12:
                body.append(box("ad advert sponsored promo banner", f"<p>{prose(False, 2)}</p>" if r.random() < 0.5 else sentence(), ("div", "aside")))
            if r.random() < 0.08:
                body.append(box("share social related newsletter tags", menu(3) if r.random() < 0.5 else f"<p>{sentence()}</p>"))
        if r.random() < 0.15:
            body.append('<div class="comments">' + "".join(f'<div class="comment"><p>{prose(False, 4)}</p></div>' for _ in range(2)) + "</div>")
        if r.random() < 0.15:
            body.insert(0, f"<header><p>{words(1, 4)}</p></header>")
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        own = names("content main post entry story body article text page prose")
        article = f"<{tag}{own if tag not in ('article', 'main') or r.random() < 0.4 else ''}>{''.join(body)}</{tag}>"
        if r.random() < 0.25:
            article = f"<main>{article}</main>"
        if r.random() < 0.3:
            article = f"<div{names('row col wrapper main layout grid')}>{article}</div>"
        before, after = [], []
        if r.random() < 0.6:
            before.append(f"<nav{names('menu top primary') if r.random() < 0.4 else ''}>{menu(r.randint(3, 7))}</nav>" if r.random() < 0.7 else box("menu navbar breadcrumb", menu(4), ("div", "ul")))
        if r.random() < 0.4:
            before.insert(0, f"<header>{r.choice([f'<h1>{words(1, 3)}</h1>', f'<p>{sentence()}</p>', f'<div>{words(1, 3)}</div>', menu(4)])}</header>")
        if r.random() < 0.5:
            before.append(box("ad ads advert banner sponsored promo", prose(False, 3), ("div", "aside")))
        if r.random() < 0.4:
            before.append(box("cookie consent notice popup alert gdpr", f"<p>{prose(False, 2)}</p><button>{words(1, 2)}</button>" if r.random() < 0.7 else prose(False, 2), ("div", "section", "dialog")))
        if r.random() < 0.35:
            (before if r.random() < 0.5 else after).append(f"<form><label>{words(1, 3)}</label><p>{sentence()}</p><button>{words(1, 2)}</button></form>")
        if r.random() < 0.45:
            inner = menu(4) if r.random() < 0.4 else f"<h3>{words(1, 4)}</h3><p>{prose(False)}</p>"
            (after if r.random() < 0.7 else before).append(f"<aside>{inner}</aside>" if r.random() < 0.5 else box("sidebar related widget side", inner))
        if r.random() < 0.45:
            inner = f"<h3>{words(1, 2)}</h3>" + "".join(r.choice([f'<div class="comment"><p>{prose(False, 4)}</p></div>', f"<p>{prose(False, 4)}</p>", f"<li>{prose(False, 3)}</li>"]) for _ in range(r.randint(1, 4)))
            after.append(f'<{(t := r.choice(["section", "div", "ol"]))} {r.choice(["class", "id"])}="{r.choice(["comments", "comments", "replies", "discussion"])}">{inner}</{t}>')
        if r.random() < 0.8:
            after.append(f"<footer>{r.choice(['&copy; ' + words(1, 3) + ' &middot; ' + sentence(), '<p>' + prose(False, 2) + '</p>', menu(3)])}</footer>" if r.random() < 0.8 else box("footer copyright legal", f"<p>{sentence()}</p>", ("div",)))
        inside = f"{''.join(before)}{article}{''.join(after)}"
        if r.random() < 0.25:
            inside = f"<div{names('page wrapper container root')}>{inside}</div>"
        page = f"<html><head><title>{words(2, 5)}</title></head><body{names('page home single') if r.random() < 0.3 else ''}>{inside}"
        pages.append((page + ("</body></html>" if number % 5 else ""), content))
    return pages


@lru_cache(1)
def default_model() -> Model:
    return train(labelled_pages())


def with_main_text(df: DataFrame, html: str = "html", into: str = "text", model: Model | None = None) -> DataFrame:
    model = model or default_model()

    @F.pandas_udf("string")
    def run(cells: pd.Series) -> pd.Series:
        return pd.Series([model.text(c) for c in cells], dtype=object)

    return df.withColumn(into, run(whole_text(html)))


def op7_html(pages: DataFrame) -> DataFrame:
    out = with_main_text(pages.select("page_id", "url", "html"), into="text")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
