"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks (operator 8).

A page is parsed into leaf blocks: runs of text between block-level tags, with the open elements
around each. Features come from those ancestors (tags, and words of class, id and role) and from the
text. Two labels, main and other; the chain's weights are trained on labelled pages by gradient
ascent of the conditional likelihood, and a page's labels are decoded by Viterbi.

The labelled pages are written by ``labelled_pages``: seeded layouts of many kinds with the label of
every block known.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that end a block of text.
BLOCK_TAGS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
# Elements without content.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no text of the page if their end tag follows; unclosed, they drop nothing.
# The content of script, style, iframe, noframes and textarea is raw text to their end tag or the page's end.
DROP_TAGS = frozenset("template svg math object canvas audio video".split())
# Of these, those whose content cannot end an element outside.
SCOPES = frozenset("template svg math object".split())
# Elements that an open paragraph ends before.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
# An element of the key ends the open ones of its set.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|iframe|noframes|textarea)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(hidden)\b", re.S)
_NAME = re.compile(r"[a-zA-Z]+")
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Words that name the parts of a page in class and id attributes.
MAIN_WORDS = ["content", "article", "post", "entry", "story", "main", "body", "text", "article-body", "post-content", "entry-content", "story-body", "page-content", "main-content", "articleBody", "markdown", "prose"]
OTHER_WORDS = {
    "nav": ["nav", "navbar", "menu", "main-menu", "top-nav", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs", "skip-link", "navigation"],
    "header": ["header", "site-header", "masthead", "topbar", "banner", "logo", "branding", "tagline"],
    "footer": ["footer", "site-footer", "copyright", "legal", "colophon", "bottom"],
    "aside": ["sidebar", "aside", "widget", "related", "recommended", "trending", "popular", "more-stories", "read-more", "tags", "author-bio", "rail", "side", "promo-box"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner-ad", "adsbox", "ad-slot", "dfp", "outbrain", "taboola"],
    "notice": ["cookie", "cookie-banner", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "paywall", "message", "privacy-notice", "announcement", "warning", "toast"],
    "form": ["form", "search", "search-form", "newsletter", "subscribe", "signup", "login", "contact-form", "feedback", "survey"],
    "comments": ["comments", "comment", "comment-list", "comment-body", "reply", "replies", "respond", "disqus", "discussion", "reader-comments", "feedback-list", "reviews"],
    "share": ["share", "social", "sharing", "social-links", "share-buttons", "follow"],
}

_KIND_OF = {w.lower(): kind for kind, names in OTHER_WORDS.items() for name in names for w in _NAME.findall(_CAMEL.sub(" ", name)) if w.lower() not in ("main", "body", "post", "text", "list", "more", "site", "top", "read", "box", "stories", "links", "buttons", "slot", "author", "side", "bottom", "button")}
_KIND_TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "button": "form", "select": "form", "label": "form", "fieldset": "form", "dialog": "notice"}
_MAIN_OF = {w.lower() for name in MAIN_WORDS for w in _NAME.findall(_CAMEL.sub(" ", name))} - {"main", "page", "text"}


class Node:
    """An element of a page and what it adds to its ancestors, so that a path of any depth takes no more than its last element.

    ``new`` are the features no ancestor has; ``own`` those of this path alone.
    """

    __slots__ = ("parent", "tag", "new", "own", "kinds", "named", "host", "leaf", "near")

    def __init__(self, parent: Node | None, tag: str, words: tuple[str, ...], seen: set[str]):
        """``seen`` holds the features of the open elements and gets the new ones."""
        p = parent
        self.parent, self.tag = p, tag
        self.kinds, self.named, self.host, self.leaf, self.near = (p.kinds, p.named, p.host, p.leaf, p.near) if p else (False, False, "", "", 0)
        self.named = self.named or not _MAIN_OF.isdisjoint(words)
        if p is None or tag in ("html", "body"):  # which a page may leave out
            self.new: tuple[str, ...] = ()
        else:
            kinds = [_KIND_OF[w] for w in words if w in _KIND_OF]
            if tag in _KIND_TAGS:
                kinds.append(_KIND_TAGS[tag])
            found = ["in:" + tag, *["word:" + w for w in words], *["kind:" + k for k in kinds]]
            self.new = tuple(f for f in dict.fromkeys(found) if f not in seen)
            seen.update(self.new)
            self.kinds = self.kinds or bool(kinds)
            if tag == "article" or (tag == "main" and not self.host):
                self.host = tag
            if tag in BLOCK_TAGS and tag != "br":
                self.leaf, self.near = tag, self.near + 1
        host = self.host or ("named" if self.named else "none")
        self.own = ("host:" + host + ("" if self.kinds else ":clean"), "leaf:" + self.leaf, "depth:" + str(min(self.near, 6)))


ROOT = Node(None, "", (), set())


@dataclass
class Block:
    text: str
    path: Node
    linked: int = 0  # characters within links


@lru_cache(maxsize=20_000)
def _words_of(attributes: str) -> tuple[str, ...]:
    out = []
    for name, a, b, c, hidden in _ATTR.findall(attributes):
        name, value = name.lower(), a or b or c
        if hidden or (name == "hidden") or (name == "aria-hidden" and value == "true"):
            out.append("hidden")
        elif name in ("class", "id", "role", "itemprop"):
            out += [w.lower() for w in _NAME.findall(_CAMEL.sub(" ", value))]
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            out.append("hidden")
    return tuple(dict.fromkeys(out))


#: What an element of the key ends: the open elements it ends, and those beyond which it ends none.
_OVER = {t: (("p",), ("table", "button", "td", "th", *DROP_TAGS)) for t in ENDS_P} | {
    t: (tuple(over), ({"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}.get(t, ("table",))) + tuple(DROP_TAGS)) for t, over in ENDS.items()
}


class _Open:
    """The open elements, with the places of each tag, so that no look at them takes longer the more are open."""

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.scopes: list[int] = []
        self.seen: set[str] = set()

    @property
    def top(self) -> Node:
        return self.nodes[-1] if self.nodes else ROOT

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of any of the tags, or -1."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def push(self, tag: str, words: tuple[str, ...]) -> None:
        k = len(self.nodes)
        self.nodes.append(Node(self.top, tag, words, self.seen))
        self.places.setdefault(tag, []).append(k)
        if tag in BLOCK_TAGS:
            self.blocks.append(k)
        if tag in SCOPES:
            self.scopes.append(k)

    def pop(self, to: int) -> None:
        while len(self.nodes) > to:
            n = self.nodes.pop()
            self.places[n.tag].pop()
            self.seen.difference_update(n.new)
        for held in (self.blocks, self.scopes):
            while held and held[-1] >= to:
                held.pop()


def parse(page: str) -> list[Block]:
    """The leaf blocks of a page in order; character references are decoded and white space is one space.

    Time and memory are in proportion to the page, however many elements stay open.
    """
    blocks: list[Block] = []
    stack = _Open()
    text: tuple | None = None  # pieces, the last first: (before, piece), so that what there was can be kept by a reference
    linked = 0
    path: Node | None = None
    held: list[tuple] = []  # the open elements of DROP_TAGS: place in the stack, and what there was before each

    def flush() -> None:
        nonlocal text, linked, path
        if text is not None:
            pieces = []
            while text is not None:
                text, piece = text
                pieces.append(piece)
            raw = "".join(reversed(pieces))
            joined = _SPACE.sub(" ", entities.unescape(raw) if "&" in raw else raw).strip()
            if joined:
                blocks.append(Block(joined, path if path is not None else stack.top, min(linked, len(joined))))
        linked, path = 0, None

    def add(piece: str) -> None:
        nonlocal text, linked, path
        if piece:
            if path is None and not piece.isspace():
                path = stack.top
            text = (text, piece)
            if stack.places.get("a"):
                linked += len(piece)

    def pop(to: int) -> None:
        stack.pop(to)
        while held and held[-1][0] >= to:
            held.pop()

    at = 0
    while m := _TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1] and held and stack.last(("svg", "math")) >= 0:
                opened = page.index(">", m.start()) + 1
                if page[opened - 2] == "/":  # closed in itself there
                    at = opened
            continue
        tag = tag.lower()
        block = tag in BLOCK_TAGS
        if block:
            flush()
        if m[2]:
            k = stack.last((tag,))
            wall = stack.scopes[-1] if stack.scopes else -1
            if not block and tag not in DROP_TAGS and stack.blocks:  # an inline end tag never ends a block
                wall = max(wall, stack.blocks[-1])
            if k >= 0 and k >= wall:
                before = next((h for h in reversed(held) if h[0] <= k), None) if held else None
                pop(k)
                if before is not None and before[0] == k:
                    _, n, text, linked, path = before
                    del blocks[n:]
            continue
        if tag in VOID_TAGS:
            continue
        if over := _OVER.get(tag):
            k = stack.last(over[0])
            if k >= 0 and k > stack.last(over[1]):
                pop(k)
        if not m[0].endswith("/>"):
            if tag in DROP_TAGS:
                held.append((len(stack.nodes), len(blocks), text, linked, path))
            stack.push(tag, _words_of(m[4]) if m[4] else ())
    add(page[at:])
    flush()
    return blocks


def path_features(path: Node) -> tuple[str, ...]:
    """Features of a block's ancestors below html and body, each once."""
    out = set(path.own)
    while path is not None:
        out.update(path.new)
        path = path.parent
    return tuple(sorted(out))


#: Characters of scripts that are written without spaces between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def text_features(b: Block) -> tuple[str, ...]:
    """Features of a block's text."""
    n = b.text.count(" ") + 1
    if not b.text.isascii():
        n += len(_UNSPACED.findall(b.text)) // 2  # about two characters a word
    size = "words:" + ("1" if n == 1 else "2-4" if n < 5 else "5-12" if n < 13 else "13-40" if n < 41 else "41-")
    share = b.linked / max(len(b.text), 1)
    links = "links:" + ("none" if share == 0 else "some" if share < 0.5 else "most")
    last = b.text[-1]
    end = "end:" + ("stop" if last in ".!?…。" else "mark" if not last.isalnum() else "letter")
    out = [size, links, end]
    if b.text[0] in "©" or "©" in b.text[:40]:
        out.append("copyright")
    return tuple(out)


@dataclass
class Crf:
    """Weights of two labels (0 other, 1 main): a feature's weight counts for main and against other."""

    weights: dict[str, float] = field(default_factory=dict)
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def scores(self, blocks: list[Block]) -> list[float]:
        """What speaks for main in each block by itself; an element's share is added up once a page."""
        get = self.weights.get
        shared: dict[Node, float] = {ROOT: 0.0}
        out = []
        for b in blocks:
            chain, node = [], b.path
            while node not in shared:
                chain.append(node)
                node = node.parent
            s = shared[node]
            for node in reversed(chain):
                for f in node.new:
                    s += get(f, 0.0)
                shared[node] = s
            for f in b.path.own:
                s += get(f, 0.0)
            for f in text_features(b):
                s += get(f, 0.0)
            out.append(s)
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels together, by Viterbi."""
        if not blocks:
            return []
        (s00, s01), (s10, s11) = self.step.tolist()
        e, *rest = self.scores(blocks)
        v0, v1 = self.start[0] - e, self.start[1] + e
        back = []
        for e in rest:
            a, c = v0 + s00, v1 + s10
            d, f = v0 + s01, v1 + s11
            back.append((0 if a >= c else 1, 0 if d >= f else 1))
            v0, v1 = max(a, c) - e, max(d, f) + e
        label = 0 if v0 >= v1 else 1
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]


def _gradient(e: np.ndarray, step: np.ndarray, start: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the labels y say against the chain's marginals: for each block, each pair of labels, and the first."""
    n = len(e)
    own = np.stack([-e, e], 1)
    a = np.empty((n, 2))
    a[0] = start + own[0]
    for t in range(1, n):
        a[t] = own[t] + np.logaddexp(a[t - 1, 0] + step[0], a[t - 1, 1] + step[1])
    b = np.zeros((n, 2))
    for t in range(n - 2, -1, -1):
        b[t] = np.logaddexp(step[:, 0] + own[t + 1, 0] + b[t + 1, 0], step[:, 1] + own[t + 1, 1] + b[t + 1, 1])
    z = np.logaddexp(*a[-1])
    p = np.exp(a + b - z)
    pair = np.exp(a[:-1, :, None] + step[None] + (own + b)[1:, None, :] - z).sum(0) if n > 1 else np.zeros((2, 2))
    told = np.zeros((2, 2))
    np.add.at(told, (y[:-1], y[1:]), 1)
    first = -p[0]
    first[y[0]] += 1
    return (y == 1) - p[:, 1], told - pair, first


def train_crf(pages: list[tuple[list[Block], list[int]]], epochs: int = 8, rate: float = 0.1, decay: float = 1e-4, seed: int = 3) -> Crf:
    """Stochastic gradient ascent of the conditional likelihood with weight decay."""
    crf = Crf()
    rng = random.Random(seed)
    data = [([(*path_features(b.path), *text_features(b)) for b in blocks], np.array(y)) for blocks, y in pages if blocks]
    w = crf.weights
    for epoch in range(epochs):
        rng.shuffle(data)
        r = rate / (1 + epoch)
        for rows, y in data:
            e = np.array([sum(w.get(f, 0.0) for f in row) for row in rows])
            g, gs, g0 = _gradient(e, crf.step, crf.start, y)
            for row, d in zip(rows, g.tolist(), strict=True):
                if abs(d) > 1e-4:
                    for f in row:
                        w[f] = w.get(f, 0.0) * (1 - decay) + r * d
            crf.step += r * gs / len(y)
            crf.start += r * g0
    return crf


# --- labelled pages -----------------------------------------------------------------------------

class _Writer:
    """Writes one page and remembers every block's label."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.out: list[str] = []
        self.labels: list[int] = []

    def words(self, low: int, high: int) -> str:
        letters = "etaoinshrdlucmfwyp"
        n = self.rng.randint(low, high)
        return " ".join("".join(self.rng.choice(letters) for _ in range(self.rng.randint(1, 10))) for _ in range(n))

    def sentence(self, low: int = 1, high: int = 60) -> str:
        s = self.words(low, high).capitalize()
        mark = self.rng.random()
        return s + ("." if mark < 0.7 else "!" if mark < 0.75 else " |" if mark < 0.8 else "&amp;" if mark < 0.85 else "")

    def tag(self, name: str, word: str | None = None) -> str:
        if word is None:
            return f"<{name}>"
        kind = self.rng.choice(["class", "class", "class", "id", "role"])
        more = " " + self.words(1, 1) if kind == "class" and self.rng.random() < 0.3 else ""
        return f'<{name} {kind}="{word}{more}">'

    def put(self, label: int, text: str, open_: str = "", close: str = "") -> None:
        self.out += [open_, text, close]
        self.labels.append(label)

    def group(self, kind: str) -> None:
        """A part of the page that is not its main text."""
        rng = self.rng
        semantic = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        use = semantic if semantic and rng.random() < 0.6 else rng.choice(["div", "div", "section", "ul" if kind in ("nav", "share") else "div"])
        word = rng.choice(OTHER_WORDS[kind]) if use != semantic or rng.random() < 0.5 else None
        self.out.append(self.tag(use, word))
        if kind in ("nav", "share") or (kind in ("aside", "footer", "header") and rng.random() < 0.4):
            if use != "ul":
                self.out.append("<ul>")
            for _ in range(rng.randint(1, 7)):
                self.put(0, self.words(1, 4), '<li><a href="/x">', "</a></li>")
            if use != "ul":
                self.out.append("</ul>")
        elif kind == "form":
            for _ in range(rng.randint(1, 4)):
                self.put(0, self.words(1, 12), rng.choice(["<label>", "<p>", "<button>", "<legend>"]), "")
                self.out.append(rng.choice(["<input>", "<br>", "</p>", "<input type=text><br>"]))
        elif kind == "comments":
            self.put(0, self.words(1, 3), "<h3>", "</h3>")
            for _ in range(rng.randint(1, 5)):
                inner = rng.choice(["div", "li", "article", "section"])
                self.out.append(self.tag(inner, rng.choice(OTHER_WORDS["comments"]) if rng.random() < 0.7 else None))
                if rng.random() < 0.6:
                    self.put(0, self.words(1, 2), rng.choice(["<b>", "<span>"]) if rng.random() < 0.3 else "<div>", "</div>")
                for _ in range(rng.randint(1, 3)):
                    self.put(0, self.sentence(), "<p>", "</p>")
                self.out.append(f"</{inner}>")
        else:
            for _ in range(rng.randint(1, 3)):
                lead = rng.choice(["<p>", "<div>", "<p>", ""])
                if kind == "footer" and rng.random() < 0.5:
                    self.put(0, "&copy; " + self.sentence(1, 25), lead or "<p>", "</p>" if lead != "<div>" else "</div>")
                elif lead:
                    self.put(0, self.sentence(1, 45), lead, "</p>" if lead == "<p>" else "</div>")
                else:
                    self.put(0, self.sentence(1, 45), "", "<br>")
        self.out.append(f"</{use}>")

    def body(self) -> None:
        """The main text, with other parts in between now and then."""
        rng = self.rng
        if rng.random() < 0.75:
            h = rng.choice(["h1", "h1", "h2"])
            head = rng.random() < 0.15
            self.put(1, self.words(1, 12), ("<header>" if head else "") + f"<{h}>", f"</{h}>" + ("</header>" if head else ""))
        for _ in range(rng.randint(1, 14)):
            r = rng.random()
            if r < 0.62:
                text = self.sentence()
                if rng.random() < 0.2:
                    text += f' <a href="/y">{self.words(1, 4)}</a> ' + self.words(1, 5)
                if rng.random() < 0.2:
                    text = f"<b>{text}</b>"
                self.put(1, text, "<p>", rng.choice(["</p>", "</p>", ""]))
            elif r < 0.70:
                self.put(1, self.sentence(), "<p><b>", "<br>")
            elif r < 0.76:
                h = rng.choice(["h2", "h3", "h4"])
                self.put(1, self.words(1, 8), f"<{h}>", f"</{h}>")
            elif r < 0.83:
                use = rng.choice(["ul", "ol"])
                self.out.append(f"<{use}>")
                for _ in range(rng.randint(1, 5)):
                    self.put(1, self.sentence(1, 25), "<li>", rng.choice(["</li>", ""]))
                self.out.append(f"</{use}>")
            elif r < 0.87:
                self.put(1, self.sentence(), "<blockquote>" + ("<p>" if rng.random() < 0.5 else ""), "</blockquote>")
            elif r < 0.90:
                self.put(1, self.sentence(), "<pre>", "</pre>")
            elif r < 0.93:
                self.out.append("<table>")
                for _ in range(rng.randint(1, 3)):
                    self.out.append("<tr>")
                    for _ in range(rng.randint(1, 3)):
                        self.put(1, self.words(1, 6), "<td>", "</td>")
                    self.out.append("</tr>")
                self.out.append("</table>")
            elif r < 0.95:
                self.put(1, self.sentence(1, 20), "<figure><img src=x><figcaption>", "</figcaption></figure>")
            else:
                self.group(rng.choice(["ad", "ad", "aside", "share", "form", "notice"]))

    def page(self) -> str:
        rng = self.rng
        if rng.random() < 0.85:  # others are fragments without a head
            self.out.append("<!DOCTYPE html><html><head><title>")
            self.put(0, self.words(1, 12))
            self.out.append("</title><style>p{margin:0}</style><script>track('</p>')</script></head><body>")
        before = [k for k, p in (("notice", 0.3), ("header", 0.5), ("nav", 0.7), ("ad", 0.4), ("form", 0.2), ("aside", 0.15), ("share", 0.1)) if rng.random() < p]
        rng.shuffle(before)
        for k in before:
            self.group(k)
        if rng.random() < 0.2:
            self.out.append("<!-- note -->")
        wrap = [t for t, p in (("main", 0.4), ("div", 0.5), ("article", 0.6), ("div", 0.3), ("section", 0.15)) if rng.random() < p] or ["div"]
        for t in wrap:
            plain = t in ("main", "article")
            self.out.append(self.tag(t, rng.choice(MAIN_WORDS) if rng.random() < (0.3 if plain else 0.8) else None))
        self.body()
        if rng.random() < 0.25:
            self.group(rng.choice(["comments", "share", "aside", "ad"]))
        for t in reversed(wrap):
            self.out.append(f"</{t}>")
        after = [k for k, p in (("comments", 0.35), ("aside", 0.4), ("share", 0.2), ("form", 0.25), ("ad", 0.3), ("notice", 0.2), ("nav", 0.2), ("footer", 0.8)) if rng.random() < p]
        if rng.random() < 0.3:
            rng.shuffle(after)
        for k in after:
            self.group(k)
        self.out.append(rng.choice(["</body></html>", ""]))
        return "".join(self.out)


def labelled_pages(n: int, seed: int = 1) -> list[tuple[str, list[Block], list[int]]]:
    """``n`` seeded pages with their blocks and labels; pages whose parse has other blocks than were written are left out."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = _Writer(rng)
        page = w.page()
        blocks = parse(page)
        if len(blocks) == len(w.labels):
            out.append((page, blocks, w.labels))
    return out


#: Labelled pages that the model of a session is trained on.
TRAINING_PAGES = 1500


@lru_cache(maxsize=2)
def trained(n: int = TRAINING_PAGES, seed: int = 1) -> Crf:
    return train_crf([(b, y) for _, b, y in labelled_pages(n, seed)])


def main_text(page: str | None, crf: Crf) -> str:
    """The main blocks of a page, one a line."""
    blocks = parse(page or "")
    return "\n".join(b.text for b, y in zip(blocks, crf.decode(blocks), strict=True) if y)


def extract_main_text(pages: DataFrame, crf: Crf | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for each row, from the whole html.

    A null or empty page gives the empty text, and so does one without main blocks. Broken markup is
    read as far as it goes. Repeated rows each give a row; other columns are ignored.
    """
    crf = crf or trained()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [main_text(x.as_py(), crf) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")
