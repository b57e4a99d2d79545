"""A small tolerant HTML tree: nodes, text runs and their features."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

from .common import lowered

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg".split())
BLOCK = frozenset(
    "address article aside blockquote body br-block center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
ENDS_P = BLOCK - {"body", "html", "head", "title", "option"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl select body html div article section main aside nav footer header form td th button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HIDDEN = RAW | {"head"}
FOREIGN = frozenset("svg math path g circle rect line use".split())  # in HTML only these close themselves by a slash

# Words in class, id and role attributes that speak for or against an article.
GOOD = frozenset("article articlebody body content entry main post story text blog page prose read".split())
BAD = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer form header login masthead"
    " menu nav navbar navigation newsletter notice pagination popup promo related replies reply respond search share sharing sidebar signup social"
    " sponsor sponsored subscribe tags toolbar widget".split()
)
QUOTED = re.compile(r"=\s*([\"'])")
NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Page:
    """Nodes in page order; node 0 is the root. A text run is a node of tag #text."""

    tag: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    tokens: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    text: list[str] = field(default_factory=lambda: [""])
    marks: list[str] = field(default_factory=lambda: [""])

    def add(self, tag: str, parent: int, tokens: tuple[str, ...] = (), text: str = "", marks: str = "") -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.tokens.append(tokens)
        self.text.append(text)
        self.marks.append(marks)
        return len(self.tag) - 1


def attribute_tokens(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    return tuple(t.lower() for m in ATTRIBUTE.finditer(attributes) for t in TOKEN.findall(m[2] or m[3] or m[4] or ""))


class Markup:
    """Tags of a page, one after the other. What a search has not found is not searched again, so no
    part of a page is read more than a few times."""

    def __init__(self, source: str):
        self.source = source
        self.absent: dict[str, int] = {}  # from where on there is none

    def find(self, what: str, at: int) -> int:
        """The next place, or -1."""
        if at >= self.absent.get(what, len(self.source) + 1):
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.absent[what] = at
        return found

    def after(self, what: str, at: int) -> int:
        """Behind the next place, or the page's end."""
        found = self.find(what, at)
        return len(self.source) if found < 0 else found + len(what)

    def tag_end(self, at: int) -> int:
        """The > that ends a tag whose name ends here: not one in a quoted value, unless the quote
        never ends."""
        source = self.source
        while True:
            close = self.find(">", at)
            if close < 0:
                return -1
            quote = QUOTED.search(source, at, close)
            if not quote:
                return close
            end = self.find(quote[1], quote.end())
            if end < 0:
                return close
            at = end + 1

    def next(self, at: int) -> tuple[int, int, str, str]:
        """(start, end, name, attributes) of the next tag; an end tag's name starts with /, a
        comment's or declaration's is empty. The start is -1 if there is none."""
        source = self.source
        while (at := self.find("<", at)) >= 0:
            if source.startswith("<!--", at):
                return at, self.after("-->", at + 4), "", ""
            if source.startswith("<![CDATA[", at):
                return at, self.after("]]>", at + 9), "", ""
            if source[at + 1 : at + 2] in ("!", "?"):
                if (end := self.find(">", at)) >= 0:
                    return at, end + 1, "", ""
            elif m := NAME.match(source, at + 1):
                if (end := self.tag_end(m.end())) >= 0:
                    return at, end + 1, m[0].lower(), source[m.end() : end]
            at += 1
        return -1, -1, "", ""


class Stack:
    """The open elements, with how many of each name there are at all and in the innermost scope."""

    def __init__(self):
        self.open: list[tuple[int, str]] = []
        self.held: Counter[str] = Counter()
        self.scopes: list[tuple[str, Counter[str]]] = [("", Counter())]

    @property
    def top(self) -> int:
        return self.open[-1][0] if self.open else 0

    def push(self, node: int, name: str) -> None:
        self.open.append((node, name))
        self.held[name] += 1
        self.scopes[-1][1][name] += 1
        if name in SCOPE:
            self.scopes.append((name, Counter()))

    def pop(self) -> str:
        name = self.open.pop()[1]
        if name in SCOPE:
            self.scopes.pop()
        self.held[name] -= 1
        self.scopes[-1][1][name] -= 1
        return name

    def reaches(self, names: set[str] | frozenset[str]) -> bool:
        scope, inside = self.scopes[-1]
        return scope in names or any(inside[n] for n in names)

    def close(self, names: set[str] | frozenset[str]) -> None:
        """End the innermost of these elements unless an element that holds its own stands between."""
        while self.reaches(names):
            while (name := self.pop()) not in names:
                pass
            if name not in ("td", "th"):
                return


def parse(source: str) -> Page:
    """Never fails: unknown markup is text, unclosed elements end with the page."""
    page, stack = Page(), Stack()
    markup = Markup(source)
    low = lowered(source)
    endings = Markup(low)
    at, end = 0, len(source)

    def words(raw: str) -> None:
        if raw:
            page.add("#text", stack.top, text=html.unescape(raw) if "&" in raw else raw)

    while at < end:
        start, after, name, attributes = markup.next(at)
        if start < 0:
            words(source[at:])
            break
        words(source[at:start])
        at = after
        if not name:
            continue
        if name[0] == "/":
            name = name[1:]
            if stack.held[name]:
                while stack.pop() != name:
                    pass
            elif name == "p":
                page.add("p", stack.top)
            continue
        if name in ENDS_P:
            stack.close({"p"})
        if name in CLOSES:
            stack.close(CLOSES[name])
        node = page.add(name, stack.top, attribute_tokens(attributes), marks=attributes if "x-" in attributes else "")
        if name in RAW:
            close = at
            while (close := endings.find(f"</{name}", close)) >= 0 and low[close + len(name) + 2 : close + len(name) + 3].isalnum():
                close += 1
            page.add("#text", node, text=source[at:close] if close >= 0 else source[at:])
            at = endings.after(">", close) if close >= 0 else end
        elif name not in VOID and not (attributes.endswith("/") and name in FOREIGN):
            stack.push(node, name)
    return page


FEATURES = 22
_kind = {"article": 1, "main": 1, "section": 2, "div": 2, "p": 3, "pre": 3, "blockquote": 3, "nav": 4, "footer": 4, "header": 4, "aside": 4, "form": 5, "button": 5, "select": 5, "input": 5, "ul": 6, "ol": 6, "li": 6, "table": 7, "tr": 7, "td": 7, "a": 8, "#text": 9, "body": 10, "html": 10, "#root": 10} | dict.fromkeys(HEADINGS, 11)


def node_features(page: Page) -> np.ndarray:
    n = len(page.tag)
    tag, parent, text = page.tag, page.parent, page.text
    length, linked, marks, elements, children = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    depth, place, before, good, bad, up_good, up_bad, up_kind, hidden, in_link = ([0] * n for _ in range(10))
    kind = [_kind.get(t, 0) for t in tag]
    total = 0
    for i in range(n):
        p = parent[i]
        if p >= 0:
            place[i] = children[p]
            children[p] += 1
            depth[i] = depth[p] + 1
            hidden[i] = hidden[p] or tag[i] in HIDDEN
            in_link[i] = in_link[p] or tag[i] == "a"
            up_good[i] = up_good[p] + good[p]
            up_bad[i] = up_bad[p] + bad[p]
            up_kind[i] = 1 if kind[p] == 1 else 4 if kind[p] in (4, 5) else up_kind[p]
        for t in page.tokens[i]:
            good[i] += t in GOOD
            bad[i] += t in BAD
        before[i] = total
        if text[i] and not hidden[i]:
            length[i] = len(text[i].strip())
            total += length[i]
            marks[i] = text[i].count(".") + text[i].count(",")
            linked[i] = length[i] if in_link[i] else 0
    for i in range(n - 1, 0, -1):
        p = parent[i]
        length[p] += length[i]
        linked[p] += linked[i]
        marks[p] += marks[i]
        elements[p] += elements[i] + (tag[i] != "#text")
    below_main = [0] * n
    for i in range(n - 1, 0, -1):
        below_main[parent[i]] |= below_main[i] or kind[i] == 1
    L, P = np.array(length, float), np.maximum(np.array(parent), 0)
    E, C = np.array(elements, float), np.array(children, float)
    whole = max(total, 1)
    columns = [
        np.array(kind), np.log1p(L), L / whole, L / np.maximum(L[P], 1), L / (E + 1), np.array(linked) / np.maximum(L, 1),
        np.array(marks) / np.maximum(L, 1), np.log1p(E), C, np.array(depth), np.array(place), np.array(place) / np.maximum(C[P] - 1, 1),
        C[P], np.array(before) / whole, np.array(good), np.array(bad), np.array(up_good), np.array(up_bad), np.array(up_kind),
        np.array(below_main), np.array(kind)[P], (np.array(linked) / np.maximum(L, 1))[P],
    ]
    out = np.column_stack(columns).astype(np.float32)
    return out


def collected(page: Page, keep: np.ndarray) -> str:
    """Text of the kept nodes: white space in a block is one space, blocks part by a newline."""
    blocks: list[str] = []
    run: list[str] = []
    last_block = 0
    block_of = [0] * len(page.tag)
    hidden = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        p, tag = page.parent[i], page.tag[i]
        hidden[i] = hidden[p] or tag in HIDDEN
        block_of[i] = i if tag in BLOCK else block_of[p]
        if tag in BLOCK and run:
            blocks.append("".join(run))
            run = []
        if tag == "#text" and keep[i] and not hidden[i]:
            if block_of[i] != last_block and run:
                blocks.append("".join(run))
                run = []
            last_block = block_of[i]
            run.append(page.text[i])
        elif tag == "br" and run:
            run.append(" ")
    blocks.append("".join(run))
    return "\n".join(clean for clean in (" ".join(b.split()) for b in blocks) if clean)
