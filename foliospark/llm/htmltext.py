"""Main text of web pages: boosted trees over DOM-node features, decoded so that nodes agree with their ancestors.

Block elements and the runs of text between them are the nodes. Trees give each node log odds of being main text, from its subtree's
text and link density, attribute tokens, depth and siblings. What a token of class, id and role says is learned from the training pages, too: its log
odds of standing on main text. Decoding picks for each element one of content (all below is content too),
boilerplate (all below is dropped) or container (children choose, at a price), with the largest total; so no dropped node has kept descendants.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm import gbt
from foliospark.llm.common import small_batches, turns

# Element names of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul head button".split())
#: Opening one of these ends an open element of the listed names, up to the nearest of the boundary names.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
BOUNDARY = frozenset("ul ol menu dl table html body div section article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What it costs to part the children of an element that hold text.
PARTING = 4.0

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)|<[!?][^>]*(?:>|\Z)", re.S)
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style|data-truth)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_TOKEN = re.compile(r"[a-z]+")
_PUNCT = re.compile(r"[.,;:!?]")


@dataclass
class Page:
    """Nodes in page order; node 0 is the root. Text runs have the tag ``#``."""

    tag: list[str] = field(default_factory=lambda: ["html"])
    parent: list[int] = field(default_factory=lambda: [-1])
    tokens: list[frozenset] = field(default_factory=lambda: [frozenset()])
    hidden: list[bool] = field(default_factory=lambda: [False])
    text: list[str] = field(default_factory=lambda: [""])
    linked: list[int] = field(default_factory=lambda: [0])
    inline: list[int] = field(default_factory=lambda: [0])
    truth: list[int] = field(default_factory=lambda: [-1])

    def add(self, tag: str, parent: int, tokens: frozenset = frozenset(), hidden: bool = False, text: str = "", linked: int = 0, inline: int = 0, truth: int = -1) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.tokens.append(tokens)
        self.hidden.append(hidden)
        self.text.append(text)
        self.linked.append(linked)
        self.inline.append(inline)
        self.truth.append(truth)
        return len(self.tag) - 1


def _attributes(source: str, marks: bool) -> tuple[frozenset, bool, int]:
    """Tokens of class, id and role, whether the element is hidden, and the mark of a training page (-1 without, or where ``marks`` are not read)."""
    tokens: set[str] = set()
    hidden, truth = False, -1
    for name, value in _NAMES.findall(source):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            found = _TOKEN.findall(value)
            tokens.update(found)
            tokens.update(f"^{t}" for t in found[:1])  # what stands first is the name, the rest may speak of other things
        elif name == "data-truth":
            truth = int(value) if marks else -1
        else:
            hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "")
    return frozenset(tokens), hidden, truth


def parse(source: str, marks: bool = False) -> Page:
    """A forgiving parse: inline elements only count as features, unclosed and stray tags are mended as browsers do.

    ``marks``: read ``data-truth``, as generated training pages have it; in other pages it is an attribute like any other.
    """
    page, stack, at = Page(), [0], 0
    run: list[str] = []
    open_: Counter = Counter()  # of each name, so that a stray end tag needs no look at the stack
    links = linked = inline = 0

    def close_run() -> None:
        nonlocal linked, inline
        text = " ".join("".join(run).split())
        if text:
            page.add("#", stack[-1], text=text, linked=linked, inline=inline)
        run.clear()
        linked = inline = 0

    def take(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        run.append(text)
        if links:
            linked += len(text)

    def end(names: tuple[str, ...]) -> None:
        """Leave the innermost open element of one of the names, and all in it."""
        while len(stack) > 1:
            name = page.tag[stack.pop()]
            open_[name] -= 1
            if name in names:
                return

    while True:
        m = _TAG.search(source, at)
        if not m:
            take(source[at:])
            break
        if m.start() > at:
            take(source[at:m.start()])
        name = m.group(2)
        if name is None:
            at = m.end()
            continue
        name = name.lower()
        done = _REST.match(source, m.end())
        stop = done.end() if done else source.find(">", m.end()) + 1 or len(source)
        rest, at = source[m.end():stop], stop
        if m.group(1):
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCK:
                close_run()
                if open_[name]:
                    end((name,))
                    links = 0
            continue
        if name in RAW:
            if not rest.rstrip(">").endswith("/"):
                done = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
                at = done.end() if done else len(source)
            continue
        if name == "br" or name == "hr":
            run.append(" ")
        elif name == "a":
            links = 1
        if name not in BLOCK or name in VOID:
            inline += name not in VOID
            continue
        close_run()
        links = 0
        if open_["p"] and "p" in (page.tag[i] for i in stack[-3:]):
            end(("p",))
        for other in ENDS.get(name, ()):
            if open_[other]:
                for depth in range(len(stack) - 1, 0, -1):
                    tag = page.tag[stack[depth]]
                    if tag in ENDS[name]:
                        end((tag,))
                        break
                    if tag in BOUNDARY:
                        break
                break
        if name in ("html", "body") and open_[name]:
            continue
        tokens, hidden, truth = _attributes(rest, marks)
        stack.append(page.add(name, stack[-1], tokens, hidden, truth=truth))
        open_[name] += 1
    close_run()
    return page


#: Characters of html of a turn, where pages aren't longer themselves; nodes that the trees judge at a time.
TURN, NODES = 1 << 20, 1 << 16
#: Names of a node's features, in the order of ``node_features``.
FEATURES = (
    "chars", "words", "link_density", "tag_density", "punctuation", "text_runs", "paragraphs", "headings", "items", "share_of_page", "share_of_parent", "depth", "position", "siblings", "place_among_siblings",
    "alike_siblings", "own_low", "own_high", "above_low", "above_high", "part_low", "part_high", "kind", "above_kind", "part_kind", "hidden", "above_hidden", "short_run", "before_chars", "after_chars", "capitals",
    "parent_chars", "parent_paragraphs", "parent_link_density", "parent_punctuation", "chars_of_a_sibling")
#: An element with more of the page's text than this isn't a part of the page.
WHOLE = 0.9

_KINDS = {"nav": 1, "menu": 1, "footer": 2, "aside": 3, "header": 4, "form": 5, "button": 5, "fieldset": 5, "noscript": 5, "dialog": 5, "search": 5, "head": 5, "option": 5, "legend": 5,
          "article": 10, "main": 11, "p": 9, "blockquote": 9, "pre": 9, "h1": 8, "h2": 8, "h3": 8, "h4": 8, "h5": 8, "h6": 8, "li": 6, "ul": 6, "ol": 6, "table": 7, "td": 7, "tr": 7, "#": 7.5}


@lru_cache(maxsize=1)
def _is_upper() -> np.ndarray:
    return np.fromiter((chr(i).isupper() for i in range(0x110000)), bool, 0x110000)


def _text_counts(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Characters, spaces, punctuation marks and capitals of each text, from one array of all code points."""
    size = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.append(0, np.cumsum(size))
    within = lambda marked: np.diff(np.append(0, np.cumsum(marked))[ends])
    return size, within(points == 32), within(np.isin(points, [ord(c) for c in ".,;:!?"])), within(_is_upper()[points])


def node_features(pages: list[Page], weights: dict[str, float]) -> np.ndarray:
    """Features of all nodes of all pages, page by page. ``weights``: log odds of attribute tokens; others count as 0.

    Nodes come in page order, so that a subtree is a run of nodes. What is above a node is passed down level by level and comes twice: of all
    ancestors, and of those that are parts of the page.
    """
    joined = lambda lists: list(chain.from_iterable(lists))
    counts = np.array([len(p.tag) for p in pages], np.int64)
    root = np.append(0, np.cumsum(counts))[:-1]
    n = int(counts.sum())
    parent = np.array(joined(p.parent for p in pages), np.int64) + np.repeat(root, counts)
    parent[root] = root
    child = np.ones(n, bool)
    child[root] = False
    above = parent.tolist()
    depth_, size_ = [0] * n, [1] * n
    for i, p in enumerate(above):
        if i != p:
            depth_[i] = depth_[p] + 1
    for i in range(n - 1, -1, -1):
        if above[i] != i:
            size_[above[i]] += size_[i]
    depth, end = np.array(depth_, np.int64), np.arange(n) + np.array(size_, np.int64)

    names, tag = np.unique(np.array(joined(p.tag for p in pages)), return_inverse=True)
    of_name = lambda wanted: np.array([x in wanted for x in names.tolist()], bool)[tag]
    run = of_name(("#",))
    kind = np.array([_KINDS.get(x, 7.0) for x in names.tolist()])[tag]
    at = np.flatnonzero(run)
    chars, spaces, marks, capitals = _text_counts([t for p in pages for t in p.text if t])

    def subtrees(values: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(values))
        return total[end] - total[:n]

    def of_runs(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[at] = values
        return out

    own = of_runs(chars)
    c, words, punct, caps = (subtrees(x) for x in (own, of_runs(spaces + 1), of_runs(marks), of_runs(capitals)))
    linked = subtrees(of_runs(np.minimum(np.array(joined(p.linked for p in pages), np.int64)[at], chars)))
    tags = subtrees(np.where(run, np.array(joined(p.inline for p in pages), np.int64), 1))
    runs, paras, heads, items = (subtrees(x) for x in (run, of_name(("p",)), of_name(HEADINGS), of_name(("li",))))

    low, high = np.zeros(n), np.zeros(n)
    for i, tokens in enumerate(joined(p.tokens for p in pages)):
        if tokens:
            known = [weights.get(x, 0.0) for x in tokens]
            low[i], high[i] = min(0.0, *known), max(0.0, *known)
    all_chars = np.repeat(np.maximum(1, c[root]), counts)
    hidden = np.array(joined(p.hidden for p in pages), bool)
    strong, part = (kind <= 5) | (kind >= 10), c / all_chars <= WHOLE
    l1, h1, l2, h2, hid = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, bool)
    k1, k2 = np.full(n, 7.0), np.full(n, 7.0)
    by_depth = np.argsort(depth, kind="stable")
    level = np.searchsorted(depth[by_depth], np.arange(1, int(depth.max(initial=0)) + 2))
    for a, b in zip(level[:-1].tolist(), level[1:].tolist(), strict=True):
        i = by_depth[a:b]
        p = parent[i]
        is_part = part[p]
        l1[i], h1[i] = np.minimum(l1[p], low[p]), np.maximum(h1[p], high[p])
        l2[i], h2[i] = np.where(is_part, np.minimum(l2[p], low[p]), l2[p]), np.where(is_part, np.maximum(h2[p], high[p]), h2[p])
        k1[i] = np.where(strong[p] & (k1[p] > 5), kind[p], k1[p])
        k2[i] = np.where(is_part & strong[p] & (k2[p] > 5), kind[p], k2[p])
        hid[i] = hid[p] | hidden[p]

    sib = np.where(child, np.bincount(parent[child], minlength=n)[parent], 1)
    by_parent = np.flatnonzero(child)[np.argsort(parent[child], kind="stable")]
    place, alike = np.zeros(n), np.zeros(n)
    place[by_parent] = np.arange(len(by_parent)) - np.searchsorted(parent[by_parent], parent[by_parent])
    _, same, number = np.unique((parent * max(1, len(names)) + tag)[child], return_inverse=True, return_counts=True)
    alike[child] = number[same] / sib[child]
    before = np.append(0, np.cumsum(own))[:n]
    before = before - np.repeat(before[root], counts)
    of_parent = lambda x: x[parent]
    columns = (
        c, words, linked / np.maximum(1, c), tags / np.maximum(1, c), punct / np.maximum(1, words), runs, paras, heads, items, c / all_chars, c / np.maximum(1, of_parent(c)), depth, before / all_chars,
        sib, place / sib, alike, low, high, l1, h1, l2, h2, kind, k1, k2,
        hidden, hid, run & (c < 40), before, all_chars - before - c, caps / np.maximum(1, c),
        of_parent(c), of_parent(paras), of_parent(linked) / np.maximum(1, of_parent(c)), of_parent(punct) / np.maximum(1, of_parent(words)), of_parent(c) / sib)
    out = np.empty((n, len(FEATURES)), np.float32)
    for j, x in enumerate(columns):
        out[:, j] = x
    return out


def decode(page: Page, margin: np.ndarray) -> list[str]:
    """Texts of the runs that are kept, in page order. Parting costs only where more than one child holds text."""
    n = len(page.tag)
    whole, free = [float(x) for x in margin], [0.0] * n  # all of the subtree content; the best choice of the children
    kids, full = [False] * n, [0] * n
    best = [0.0] * n
    for i in range(n - 1, -1, -1):
        if full[i] > 1:
            free[i] -= PARTING
        best[i] = max(whole[i], -whole[i], free[i]) if kids[i] else abs(whole[i])
        if i:
            p = page.parent[i]
            whole[p] += whole[i]
            free[p] += best[i]
            kids[p] = True
            full[p] += page.tag[i] == "#" or full[i] > 0
    state, out = [0] * n, []  # 1 content, -1 boilerplate, 0 container
    for i in range(n):
        above = state[page.parent[i]] if i else 0
        if above:
            state[i] = above
        elif not kids[i] or best[i] > free[i]:
            state[i] = 1 if whole[i] > 0 else -1
        if state[i] > 0 and page.tag[i] == "#":
            out.append(page.text[i])
    return out


# ---- training pages -------------------------------------------------------------------------------------------------------------------

_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu an er in on th st".split()


def _prose(draw: random.Random, low: int, high: int) -> str:
    out = []
    for _ in range(max(1, draw.randint(low, high) // 9)):
        words = ["".join(draw.choices(_SYLLABLES, k=draw.randint(1, 4))) for _ in range(draw.randint(3, 16))]
        out.append(" ".join(words).capitalize() + draw.choice("...?!"))
    return " ".join(out)


def _name(draw: random.Random, plain: float, *names: str) -> str:
    dull = draw.choice(["", f' class="c{draw.randint(1, 99)}"', f' class="box-{draw.choice("qwzvk")}{draw.randint(1, 9)}"', ' class="row mt-4 px-2"', ' class="col-md-8 flex wide"', f' class="css-{draw.randint(1, 999)}x"'])
    if draw.random() > plain:
        return dull
    extra = draw.choice(["", "", "", "-1", "-wrap", "-box", "-area", " wide", " clearfix", " mt-2 p-3", " inner"])
    return f' {draw.choice(["class", "class", "id"])}="{draw.choice(names)}{extra}"'


#: Words that layouts put on pages and articles to say what surrounds them, though they are no such thing themselves.
ASIDES = "tag category more meta sidebar comments comment share header footer nav ad banner notice related side message widget menu social popup form search open closed has no with format standard single type status".split()


def _beside(draw: random.Random) -> str:
    """Class names that speak of other things: ``tag-news category-more has-sidebar``."""
    return "".join(f' {draw.choice(ASIDES)}{draw.choice(["", "-", "-", "_"])}{draw.choice(["news", "open", "more", "box", "x", "top", "7"]) if draw.random() < 0.7 else draw.choice(ASIDES)}' for _ in range(draw.randint(1, 4)))


def training_page(draw: random.Random) -> str:
    """A page of random layout whose elements say in ``data-truth`` whether they hold main text."""
    plain = draw.choice([1.0, 1.0, 1.0, 0.95, 0.8])
    semantic = draw.random() < 0.6
    named = draw.choice([1.0, 0.7, 0.3, 0.0])  # how often what holds main text says so
    words = lambda k: " ".join("".join(draw.choices(_SYLLABLES, k=draw.randint(1, 3))) for _ in range(k))
    label = lambda: draw.choice([str, str.capitalize])(words(draw.randint(1, 3))) + draw.choice(["", "", "", ".", ",", "?"])
    link = lambda: f'<a href="/{words(1)}">{label()}</a>'
    el = lambda tag, names, inner, y: f'<{tag}{_name(draw, plain, *names)} data-truth="{y}">{inner}</{tag}>'

    def holder(tag: str, names: tuple[str, ...], inner: str, truth: str = "") -> str:
        """An element of main text or of all: its name may be dull or speak of other things as well."""
        name, beside = _name(draw, named, *names), draw.random()
        if 'class="' in name and beside < 0.35:
            name = name[:-1] + _beside(draw) + '"'
        elif beside > 0.9:  # such words may stand first or alone, too
            name = f' class="{_beside(draw).strip()}' + draw.choice(["", " " + draw.choice(names)]) + '"'
        return f"<{tag}{name}{truth}>{inner}</{tag}>"

    def menu(tag: str, *names: str) -> str:
        if draw.random() < 0.7:
            inner = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(draw.randint(2, 12))) + "</ul>"
        else:
            inner = draw.choice([" ", " | ", ""]).join(link() for _ in range(draw.randint(2, 9)))
        return el(tag if semantic else "div", names, inner, 0)

    def paragraph() -> str:
        text = _prose(draw, 9, draw.choice([30, 90, 250])) if draw.random() < 0.88 else f"{words(draw.randint(1, 4)).capitalize()}."
        if draw.random() < 0.2:
            text = f"<b>{text}<br>" if draw.random() < 0.5 else f"{text} {link()} {words(5)}."
        return f"<p>{text}" + draw.choice(["</p>", "</p>", "</p>", ""])

    def article() -> str:
        parts = [f"<h1>{words(draw.randint(2, 9)).capitalize()}</h1>"] if draw.random() < 0.8 else []
        if parts and semantic and draw.random() < 0.15:
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(draw.choice([0, 1, 1, 2, 3, 5, 8, 14, 30, 60])):
            kind = draw.random()
            if kind < 0.8:
                parts.append(paragraph())
            elif kind < 0.87:
                parts.append("<ul>" + "".join(f"<li>{words(draw.randint(3, 18))}.</li>" for _ in range(draw.randint(2, 6))) + "</ul>")
            elif kind < 0.93:
                parts.append(f"<h2>{words(draw.randint(2, 6)).capitalize()}</h2>{paragraph()}")
            elif kind < 0.97:
                parts.append(f"<blockquote>{paragraph()}</blockquote>")
            else:
                parts.append(f"<table><tr><td>{words(3)}</td><td>{words(4)}</td></tr><tr><td>{words(3)}</td><td>{words(6)}</td></tr></table>")
        if not parts:
            parts.append(_prose(draw, 2, 60))
        for _ in range(draw.choice([0, 0, 0, 1, 1, 2])):
            parts.insert(draw.randint(0, len(parts)), side())
        body = "".join(parts)
        if draw.random() < 0.3:
            body = holder("div", ("entry-content", "text", "inner", "body", "article-body"), body)
        return holder(draw.choice(["article", "main", "section"]) if semantic else "div", ("article", "content", "post hentry", "entry", "post", "entry-content", "main", "story-body", "text", "page-content", "prose", "copy", "blog-post"), body, ' data-truth="1"')

    def side() -> str:
        kind = draw.random()
        if kind < 0.35:
            return el("div", ("ad", "ads", "advert", "advertisement", "banner", "promo", "promotion", "sponsor", "sponsored"), draw.choice([_prose(draw, 3, 12), _prose(draw, 9, 60), link(), f"<p>{_prose(draw, 5, 30)}</p>"]), 0)
        if kind < 0.55:
            return el(draw.choice(["div", "section"]), ("notice", "notices", "cookie-notice", "cookies", "consent", "gdpr", "alert", "warning", "newsletter", "message", "popup", "modal", "overlay", "subscribe", "disclaimer"), f"<p>{_prose(draw, 5, 40)}</p>" + draw.choice(["", f"<button>{words(1)}</button>"]), 0)
        if kind < 0.75:
            return el("form", ("search", "login", "signin", "signup", "register", "subscribe", "subscription", "form", "feedback"), f"<label>{words(2)}</label><input name=q><button>{words(1)}</button>", 0)
        return menu("div", "share", "sharing", "social", "follow", "related", "recommended", "more", "tags", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "toolbar", "byline", "teaser")

    def comments() -> str:
        inner = f"<h3>{words(1).capitalize()}</h3>" + "".join(f'<div class="{draw.choice(["comment", "reply", "c1"])}"><p>{_prose(draw, 5, 80)}</p></div>' for _ in range(draw.randint(1, 8)))
        return el(draw.choice(["section", "div", "ol"]), ("comments", "comment-list", "commentlist", "respond", "replies", "discussion", "disqus", "reader-comments"), inner, 0).replace('class="c', 'class="comment c', 1)

    top = [menu("nav", "nav", "menu", "navbar", "navigation", "main-menu", "menubar", "skip")] if draw.random() < 0.9 else [] + [side() for _ in range(draw.choice([0, 0, 1, 2]))]
    if draw.random() < 0.6:
        top.insert(0, el("header" if semantic else "div", ("header", "masthead", "site-header", "head", "page-header"), f"<h1>{words(draw.randint(1, 3)).capitalize()}</h1>" + draw.choice(["", f"<p>{words(6).capitalize()}</p>", link()]), 0))
    bottom = [comments()] if draw.random() < 0.35 else []
    if draw.random() < 0.45:
        bottom.append(el("aside" if semantic else "div", ("sidebar", "side", "widget", "widgets", "rail", "complementary", "aside"), f"<h3>{words(2)}</h3>" + draw.choice([f"<p>{_prose(draw, 9, 60)}</p>", "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(5)) + "</ul>"]), 0))
    if draw.random() < 0.9:
        bottom.append(el("footer" if semantic else "div", ("footer", "site-footer", "foot", "bottom", "copyright", "legal", "contentinfo"), draw.choice(["&copy; ", "&copy; ", ""]) + f"{words(2)} &middot; " + draw.choice([_prose(draw, 9, 30), _prose(draw, 30, 200), words(6), link() + " " + link()]), 0))
    middle = [article()]
    if draw.random() < 0.25:
        middle.insert(draw.randint(0, 1), bottom.pop(0) if len(bottom) > 1 else side())
    wrap = lambda inner: holder("div", ("wrap", "container", "page", "site", "content", "main", "layout"), inner)
    inner = wrap("".join(middle)) if draw.random() < 0.5 else "".join(middle)
    body = inner if draw.random() < 0.14 else "".join(top) + inner + "".join(bottom)
    if draw.random() < 0.3:
        body = wrap(body)
    of_body = f' class="page{_beside(draw)}"' if draw.random() < 0.3 else ""
    return f"<!DOCTYPE html><html><head><title>{words(4)}</title><script>var a='<p>';</script></head><body{of_body}>{body}</body></html>"


def labelled_nodes(page: Page) -> np.ndarray:
    """1 main text, 0 boilerplate, -1 for containers of both; an element without a mark takes its parent's."""
    n = len(page.tag)
    own, held = [-1] * n, [set() for _ in range(n)]
    for i in range(1, n):
        own[i] = page.truth[i] if page.truth[i] >= 0 else own[page.parent[i]]
    for i in range(n - 1, 0, -1):
        if page.tag[i] == "#":
            held[i].add(own[i])
        held[page.parent[i]] |= held[i]
    return np.array([next(iter(h)) if len(h) == 1 else -1 for h in held])


@dataclass
class Extractor:
    """What is learned: log odds of attribute tokens, and the trees."""

    weights: dict[str, float]
    trees: gbt.Boosted

    def margins(self, pages: list[Page]) -> list[np.ndarray]:
        """Of each node of each page: log odds of main text. A wrapper of nearly all of the page says nothing itself."""
        if not pages:
            return []
        x = node_features(pages, self.weights)
        element = np.array([tag not in ("#", "article", "main") for p in pages for tag in p.tag])
        margin = np.concatenate([self.trees.margin(x[at:at + NODES]) for at in range(0, len(x), NODES)])
        margin[element & (x[:, FEATURES.index("share_of_page")] > WHOLE)] = 0.0
        return np.split(margin, np.cumsum([len(p.tag) for p in pages])[:-1])


def token_weights(pages: list[Page], most: float = 4.0) -> dict[str, float]:
    """Smoothed log odds of each token of standing on or in main text; on elements that hold both it counts for both."""
    counts: dict[str, list[float]] = {}
    total = [1.0, 1.0]
    for page in pages:
        truth = labelled_nodes(page)
        for tokens, y in zip(page.tokens, truth.tolist(), strict=True):
            for t in tokens:
                c = counts.setdefault(t, [0.5, 0.5])
                for side in (0, 1) if y < 0 else (y,):
                    c[side] += 1
                    total[side] += 1
    base = float(np.log(total[1] / total[0]))
    return {t: float(np.clip(np.log(c[1] / c[0]) - base, -most, most)) for t, c in counts.items() if sum(c) >= 4}


@lru_cache(maxsize=2)
def trained(pages: int = 700, seed: int = 12, trees: int = 90, depth: int = 5) -> Extractor:
    """Learned from generated pages of many layouts."""
    draw = random.Random(seed)
    parsed = [parse(training_page(draw), marks=True) for _ in range(pages)]
    weights = token_weights(parsed[: pages * 3 // 4])  # the trees see other pages too, so that they don't trust tokens too much
    later = parsed[pages // 4:]
    truth = [labelled_nodes(page) for page in later]
    known = [t >= 0 for t in truth]
    weight = np.concatenate([np.full(k.sum(), 30 / max(1, k.sum())) for k in known])
    x, y = node_features(later, weights)[np.concatenate(known)], np.concatenate(truth)
    return Extractor(weights, gbt.fit(x, y[y >= 0].astype(float), trees=trees, depth=depth, least=25, ridge=3.0, weight=weight, share=0.5))


def main_texts(sources: list[str], model: Extractor) -> list[str]:
    pages = [parse(s) for s in sources]
    return [" ".join(decode(page, m)) for page, m in zip(pages, model.margins(pages), strict=True)]


def extract(pages: DataFrame, model: Extractor | None = None) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of each page: the main text of its whole html.

    Null and empty html give an empty text. Every row is answered once, repeated and null ids too. No attribute of a page is read but class, id,
    role, hidden, aria-hidden and style. Pages are judged in turns of ``TURN`` characters of html, or one by one where they are longer: memory follows the
    largest page.
    """
    spark = pages.sparkSession
    small_batches(spark, 128)
    shared = spark.sparkContext.broadcast(model or trained())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = [s or "" for s in batch.column(2).to_pylist()]
            ends = np.append(0, np.cumsum([len(s) for s in sources]))
            texts = []
            for first, end in turns(ends, TURN):
                texts += main_texts(sources[first:end], shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    found = pages.select("page_id", "url", "html").mapInArrow(apply, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
