"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

Each node of a page (elements and text runs) has features: kind, subtree text, density, share of
links, depth, place among its siblings, words in its class, id and role. Gradient-boosted trees, trained
here on labelled pages built from layouts, give the log odds that a node holds or leads to main text.
Decoding picks the set of nodes with the highest likelihood among those in which every kept node's
parent is kept, so that no verdict contradicts one above it, and in which a run of text and inline
elements is kept or dropped as one. Scripts, styles and the head are never text.

A null or empty html has the empty text. Broken markup is read tolerantly. White space inside a block
is one space, blocks part by one newline, character references are decoded. Pages are handled one by
one; repeated rows give repeated results, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, boost
from .common import text_chunks
from .dom import BLOCK, HIDDEN, Page, collected, node_features, parse

TRAINING_PAGES = 500


class Layouts:
    """Labelled pages: x-keep marks what belongs to the article, x-drop what in it does not. Words are
    made of random letters, so that only structure, density and attributes can be learned."""

    def __init__(self, seed: int = 5):
        self.rng = Random(seed)

    def word(self) -> str:
        r = self.rng
        return "".join(r.choice("bcdfgklmnprstvwz") + r.choice("aeiou") for _ in range(r.choice([1, 1, 2, 2, 3, 4])))

    def words(self, low: int, high: int) -> str:
        r = self.rng
        out = [self.word() for _ in range(r.randint(low, high))]
        style = r.random()
        if style < 0.08:
            out = [w.upper() + "!!" for w in out]
        elif style < 0.16:
            out = [w + r.choice(["###", "$$$", "&amp;&amp;", "***", "%"]) for w in out]
        elif style < 0.2:
            return " | ".join(out)
        return " ".join(w + r.choice(["", "", "", "", ",", "."]) for w in out).capitalize() + "."

    def target(self) -> str:
        r = self.rng
        return r.choice(['"/{}"', "/{}", '"https://{}.example/a/"', "/{}/", "'?{}=1'", '"#{}"']).format(self.word())

    def links(self, low: int, high: int) -> str:
        items = [f"<a href={self.target()}>{self.words(1, 2)}</a>" for _ in range(self.rng.randint(low, high))]
        if self.rng.random() < 0.6:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return self.rng.choice([" ", " | ", ""]).join(items)

    def inline(self, low: int, high: int) -> str:
        r = self.rng
        text = self.words(low, high)
        if r.random() < 0.25:
            text = f"<b>{text}" + r.choice(["</b>", "<br>"])
        if r.random() < 0.2:
            text = f"{self.words(1, 8)} <a href={self.target()}>{self.words(1, 4)}</a> {r.choice(['', text])}"
        if r.random() < 0.1:
            text += f" <em>{self.words(1, 5)}</em>"
        return text

    def paragraphs(self) -> str:
        r = self.rng
        out = []
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 10, 20])):
            kind = r.random()
            body = self.inline(1, r.choice([3, 12, 50, 120]))
            if kind < 0.8:
                out.append(f"<p>{body}" + r.choice(["</p>", "</p>", ""]))
            elif kind < 0.85:
                out.append(f"<h2>{self.words(2, 6)}</h2>")
            elif kind < 0.9:
                out.append("<ul>" + "".join(f"<li>{self.inline(3, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.94:
                out.append(f"<blockquote><p>{body}</p></blockquote>")
            elif kind < 0.97:
                out.append(f"<table><tr><td>{self.words(1, 5)}</td><td>{self.words(1, 5)}</td></tr></table>")
            else:
                out.append(f"<pre>{body}</pre>")
        return "".join(out)

    def aside(self) -> str:
        """Something that is no article, in one of its usual forms."""
        r = self.rng
        name = lambda *options: r.choice(options)
        forms = [
            lambda: f"<nav>{self.links(3, 9)}</nav>",
            lambda: f'<div class="{name("menu", "navbar", "top-nav", "breadcrumb", "pagination")}">{self.links(3, 9)}</div>',
            lambda: f"<header>{name('<h1>' + self.words(1, 3) + '</h1>', '<p>' + self.words(2, 8) + '</p>', self.links(2, 5))}</header>",
            lambda: f'<div id="{name("header", "masthead")}"><span>{self.words(1, 5)}</span>{self.links(0, 5)}</div>',
            lambda: f"<footer>&copy; {self.words(2, 25)}{name('', self.links(2, 5))}</footer>",
            lambda: f'<div class="{name("footer", "site-footer", "page-footer")}"><p>&copy; {self.words(2, 25)}</p></div>',
            lambda: f'<aside>{name("<h3>" + self.words(1, 3) + "</h3>" + self.links(2, 6), "<p>" + self.words(3, 30) + "</p>")}</aside>',
            lambda: f'<div class="{name("sidebar", "widget", "related", "related-posts", "promo")}"><p>{self.words(2, 25)}</p>{self.links(0, 5)}</div>',
            lambda: f'<div class="{name("ad", "ads", "advert", "ad-banner", "sponsored", "banner")}">{self.words(2, 18)}</div>',
            lambda: f'<div class="{name("cookie-notice", "notice", "cookie-consent", "popup", "newsletter")}"><p>{self.words(4, 25)}</p><button>OK</button></div>',
            lambda: f'<form action="/s">{self.words(1, 6)}<input name="q"><button>{self.words(1, 2)}</button></form>',
            lambda: f'<section class="{name("comments", "comment-list", "discussion", "replies")}"><h3>{self.words(1, 2)}</h3>' + "".join(f'<div class="comment"><b>{self.words(1, 2)}</b><p>{self.words(3, 50)}</p></div>' for _ in range(r.randint(1, 5))) + "</section>",
            lambda: f'<ol id="comments">' + "".join(f"<li><p>{self.words(3, 40)}</p></li>" for _ in range(r.randint(1, 5))) + "</ol>",
            lambda: f'<div class="{name("share", "social", "tags", "subscribe")}">{self.links(2, 5)}</div>',
        ]
        return r.choice(forms)()

    def page(self) -> str:
        r = self.rng
        head = "<head>" + "".join(r.sample(['<meta charset="utf-8">', f"<title>{self.words(2, 8)}</title>", f"<style>.{self.word()} {{ color: red }}</style>", f"<script>document.write('<p>{self.word()}')</script>", f"<link rel=icon href={self.target()}>"], r.randint(1, 5))) + "</head>"
        head = r.choice(["<!DOCTYPE html>", ""]) + f"<html>{head}<body>"
        above = "".join(self.aside() for _ in range(r.choice([0, 1, 1, 2, 3, 4])))
        below = "".join(self.aside() for _ in range(r.choice([0, 1, 1, 2, 3, 4])))
        inner = r.choice([f"<h1>{self.words(2, 8)}</h1>", ""]) + self.paragraphs()
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            inner += self.aside().replace(">", " x-drop>", 1) + (self.paragraphs() if r.random() < 0.6 else "")
        if r.random() < 0.15:  # an article without an element of its own
            inner = "".join(f"<h1 x-keep>{self.words(2, 8)}</h1>" for _ in range(r.randint(0, 1)))
            body = inner + "".join(f"<p x-keep>{self.inline(4, 60)}</p>" for _ in range(r.randint(1, 12)))
        else:
            tag, attributes = r.choice(
                [("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main-content"'), ("div", ' class="article-body"'), ("section", ' class="entry story"'), ("div", ""), ("div", f' class="{self.word()}-item-post"'), ("div", ' class="menu-item-post"'), ("td", "")]
            )
            body = f"<{tag}{attributes} x-keep>{inner}</{tag}>"
            if tag == "td":
                body = f"<table><tr><td>{self.links(2, 6)}</td>{body}</tr></table>"
        for _ in range(r.choice([0, 0, 1, 2])):
            body = r.choice(["<div>{}</div>", '<div class="wrapper">{}</div>', "<main>{}</main>", '<div id="page">{}</div>']).format(body + (self.aside() if r.random() < 0.3 else ""))
        stray = self.words(1, 8) if r.random() < 0.1 else ""
        return head + above + stray + body + below + "</body></html>"


def node_labels(page: Page) -> np.ndarray:
    """1 for nodes inside the marked article, without its dropped parts, and for those above it."""
    n = len(page.tag)
    inside, label = [False] * n, np.zeros(n, bool)
    for i in range(1, n):
        p, marks = page.parent[i], page.marks[i]
        inside[i] = ("x-keep" in marks or inside[p]) and "x-drop" not in marks
        label[i] = inside[i]
        if "x-keep" in marks:
            while p >= 0:
                label[p] = True
                p = page.parent[p]
    return label


@lru_cache(maxsize=4)
def train(pages: int = TRAINING_PAGES, seed: int = 5) -> Boosted:
    layouts = Layouts(seed)
    parsed = [parse(layouts.page()) for _ in range(pages)]
    return boost(np.concatenate([node_features(p) for p in parsed]), np.concatenate([node_labels(p) for p in parsed]).astype(float))


def decode(parent: list[int], margin: np.ndarray) -> np.ndarray:
    """The most likely set of kept nodes that holds each kept node's parent.

    Keeping a node adds its log odds to the likelihood; a subtree is worth keeping if its own and its
    kept children's odds add up to more than nothing.
    """
    gain = margin.tolist()
    for i in range(len(gain) - 1, 0, -1):
        if gain[i] > 0:
            gain[parent[i]] += gain[i]
    keep = np.zeros(len(gain), bool)
    keep[0] = gain[0] > 0
    for i in range(1, len(gain)):
        keep[i] = keep[parent[i]] and gain[i] > 0
    return keep


def runs(page: Page) -> np.ndarray:
    """Which nodes are decided as one: for each the first node of its run. A block stands alone; text
    and inline elements that follow each other in one block are a run, with all they hold."""
    first = list(range(len(page.tag)))
    open_run: dict[int, int] = {}  # of a block, its run that may go on
    for i in range(1, len(first)):
        p = page.parent[i]
        if page.tag[i] in BLOCK:
            open_run.pop(p, None)
        elif p == 0 or page.tag[p] in BLOCK:
            first[i] = open_run.setdefault(p, i)
        else:
            first[i] = first[p]
    return np.array(first)


def decode_page(page: Page, margin: np.ndarray) -> np.ndarray:
    """Decoding over blocks and runs."""
    first = runs(page)
    hidden = np.zeros(len(first), bool)
    for i in range(1, len(first)):
        hidden[i] = page.tag[i] in HIDDEN or hidden[page.parent[i]]
    units, unit = np.unique(first, return_inverse=True)
    total = np.bincount(unit, np.where(hidden, 0.0, margin), len(units))
    parent = unit[np.maximum(np.array(page.parent)[units], 0)]
    return decode(parent.tolist(), total)[unit]


def extract_texts(sources: list[str], model: Boosted) -> list[str]:
    pages = [parse(s) for s in sources]
    found = [node_features(p) for p in pages]
    margins = np.split(model.margins(np.concatenate(found)), np.cumsum([len(f) for f in found])[:-1]) if found else []
    return [collected(p, decode_page(p, m)) for p, m in zip(pages, margins, strict=True)]


def extract_main_text(pages: DataFrame, model: Boosted) -> DataFrame:
    """(page_id, url, text) of each row."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            texts = extract_texts([h or "" for h in batch.column(2).to_pylist()], shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string")
