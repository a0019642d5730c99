"""Main text of web pages: a conditional random field over the leaf blocks of a page, decoded by Viterbi."""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescale.llm import crf

BITS = 14
PAGES = 500
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|iframe|svg)(?=[\s/>])[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
# Elements by their role in the page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br object canvas noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Kinds of names in class, id and role attributes, by how their parts begin.
NAMES = {
    "ad": "ad ads adv advert advertisement adsbygoogle sponsor sponsored promo promotion banner adbox",
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay newsletter subscribe subscription paywall toast message",
    "comment": "comment comments commentlist reply replies respond disqus discussion review reviews feedback",
    "side": "sidebar side aside secondary widget widgets related recommended recommendations more trending popular complementary rail teaser",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs crumbs tabs toolbar topbar pagination pager skip toc search tags",
    "foot": "footer foot copyright legal colophon contentinfo bottom imprint credits",
    "head": "header head masthead logo brand site top",
    "share": "share sharing social follow login signup form",
    "main": "article content main post entry story body text page prose document",
}
KINDS = {word: kind for kind, words in NAMES.items() for word in words.split()}
WORDS = re.compile(r"\b(cookies?|subscribe|newsletter|sign in|log in|copyright|all rights reserved|advertisement|sponsored|comments?|reply|share|follow us|privacy|terms|search)\b", re.I)


@dataclass
class Block:
    text: str
    path: list[tuple[str, tuple[str, ...]]]
    linked: int = 0


@dataclass
class _Open:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    path: list = field(default_factory=list)


def kinds_of(attributes: str) -> tuple[str, ...]:
    out = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            out |= {KINDS[p] for p in re.split(r"[^a-z]+", value) if p in KINDS}
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            out.add("hidden")
    return tuple(sorted(out))


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks in order: text between the borders of block elements, references decoded, white space joined.

    Unclosed elements end with their parent, a paragraph also where a block element begins. Scripts, styles, comments and
    declarations have no text. A null or empty page has no block.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    now = _Open()

    def flush() -> None:
        nonlocal now
        text = " ".join("".join(now.parts).split())
        if text:
            out.append(Block(text, now.path, now.linked))
        now = _Open()

    def add(raw: str) -> None:
        if not raw:
            return
        text = html.unescape(raw)
        if not now.path and text.strip():
            now.path = list(stack)
        now.parts.append(text)
        if any(t == "a" for t, _ in stack):
            now.linked += len(text.strip())

    def close(tags: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return

    at, page = 0, page or ""
    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "br":
            now.parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if m[2]:
            close((tag,))
            continue
        if tag not in INLINE:
            if tag in CLOSES:
                close(CLOSES[tag])
            if any(t == "p" for t, _ in stack):
                close(("p",))
        if tag not in VOID and not m[4].rstrip().endswith("/"):
            stack.append((tag, kinds_of(m[4])))
    add(page[at:])
    flush()
    return out


def features(block: Block, before: Block | None) -> list[str]:
    """Ancestor tags, kinds of their names, and the block's own text."""
    tags = [t for t, _ in block.path if t not in ("html", "body")]
    kinds = [k for _, ks in block.path for k in ks]
    n, share = len(block.text.split()), block.linked / max(1, len(block.text))
    last = tags[-1] if tags else "none"
    near = next((k for _, ks in reversed(block.path) for k in ks), "none")
    size = "0" if n < 4 else "1" if n < 9 else "2" if n < 20 else "3" if n < 50 else "4"
    link = "0" if share < 0.2 else "1" if share < 0.7 else "2"
    out = [f"t:{t}" for t in set(tags)] + [f"k:{k}" for k in set(kinds)] + [f"near:{near}", f"last:{last}", f"n:{size}", f"a:{link}", f"na:{size}{link}"]
    out += [f"end:{block.text[-1] in '.!?:…”\"'}", f"word:{bool(WORDS.search(block.text))}{size}", f"art:{min(2, tags.count('article'))}"]
    if before is not None:
        out.append(f"same:{before.path[:-1] == block.path[:-1]}")
    return out


def numbers(names: list[str]) -> list[int]:
    return [zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in names]


@dataclass
class Model:
    emit: np.ndarray
    start: np.ndarray
    trans: np.ndarray


def extract(page: str | None, model: Model) -> str:
    """The main text: blocks that Viterbi decoding labels as content, joined by one space."""
    found = blocks(page)
    if not found:
        return ""
    scores = np.array([model.emit[numbers(features(b, found[i - 1] if i else None))].mean(0) for i, b in enumerate(found)])
    path = crf.viterbi(scores, model.start, model.trans)
    return " ".join(found[i].text for i in range(len(found)) if path[i] and not fallback(found[i]) or fallback(found[i]) and beside_content(found, path, i))


def fallback(block: Block) -> bool:
    """Whether the block lies in a noscript element: part of the text, or a notice about scripts."""
    return any(t == "noscript" for t, _ in block.path)


def beside_content(found: list[Block], path: np.ndarray, i: int) -> bool:
    """Whether the next block before or after, both in the body itself, is content and has the noscript element's parent."""
    parent = found[i].path[: next(k for k, (t, _) in enumerate(found[i].path) if t == "noscript")]
    near = [next((j for j in side if not fallback(found[j])), None) for side in (range(i - 1, -1, -1), range(i + 1, len(found)))]
    held = [j is not None and bool(path[j]) and found[j].path[: len(parent)] == parent and len(found[j].path) <= len(parent) + 1 for j in near]
    return any(held) if any(t not in ("html", "body") for t, _ in parent) else all(held)


class Generator:
    """Labelled pages in many layouts: invented words, common element and class names. Content blocks are remembered by text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.n = 0
        self.content: set[str] = set()

    def words(self, low: int, high: int, stop: str = "") -> str:
        self.n += 1
        pick = lambda: "".join(self.r.choice("aeiou") + self.r.choice("bcdfglmnprstv") for _ in range(self.r.randint(1, 4)))
        return f"{pick().capitalize()}{self.n} " + " ".join(pick() for _ in range(self.r.randint(low, high))) + stop

    def main(self, tag: str, low: int, high: int) -> str:
        text = self.words(low, high, self.r.choice([".", ".", ".", "!", "?", ""]))
        self.content.add(" ".join(text.split()))
        inner = text
        if self.r.random() < 0.2:
            first, _, rest = text.partition(" ")
            inner = f"{first} <a href='/x'>{rest}</a>" if self.r.random() < 0.2 else f"<b>{first}</b> {rest}"
        return f"<{tag}>{inner}</{tag}>" if self.r.random() < 0.9 or tag != "p" else f"<p>{inner}"

    def named(self, tag: str, names: str, inner: str) -> str:
        return f'<{tag} {self.r.choice(["class", "id"])}="{self.r.choice(names.split())}">{inner}</{tag}>'

    def junk(self, kind: str) -> str:
        r, box = self.r, self.r.choice(["div", "div", "section", "aside"])
        links = lambda a, b: "".join(f"<li><a href='/{i}'>{self.words(0, 2)}</a></li>" for i in range(r.randint(a, b)))
        paras = lambda a, b: "".join(f"<p>{self.words(2, 30, '.')}</p>" for _ in range(r.randint(a, b)))
        plain = lambda: self.words(2, 30, ".")
        if kind == "menu":
            return r.choice([f"<nav><ul>{links(3, 8)}</ul></nav>", self.named("div", "menu navigation nav main-menu breadcrumbs navbar", f"<ul>{links(2, 7)}</ul>"), self.named("ul", "nav menu breadcrumb", links(2, 6))])
        if kind == "head":
            inner = f"<h1>{self.words(0, 3)}</h1>" if r.random() < 0.5 else f"<a href='/'>{self.words(0, 2)}</a><p>{self.words(2, 8)}</p>"
            return r.choice([f"<header>{inner}</header>", self.named("div", "header masthead site-header top", inner)])
        if kind == "ad":
            return self.named(box, "ad ads advert advertisement sponsored promo ad-slot banner", r.choice([plain(), paras(1, 2), f"<a href='/'>{plain()}</a>"]))
        if kind == "notice":
            return self.named(box, "cookie-notice cookie-banner notice consent alert newsletter subscribe popup gdpr", r.choice([plain(), paras(1, 2)]) + r.choice(["", "<button>OK</button>"]))
        if kind == "side":
            return r.choice([f"<aside>{paras(1, 3)}</aside>", self.named(box, "sidebar widget related secondary side-bar related-posts", f"<h3>{self.words(0, 2)}</h3>" + r.choice([paras(1, 3), f"<ul>{links(2, 6)}</ul>"]))])
        if kind == "form":
            return f"<form><label>{self.words(0, 2)}</label><input name=q><select><option>{self.words(0, 1)}<option>{self.words(0, 1)}</select><button>{self.words(0, 1)}</button>{r.choice(['', paras(1, 1)])}</form>"
        if kind == "comment":
            one = lambda: r.choice([f"<div class='comment'>{paras(1, 2)}</div>", f"<article class='comment'>{paras(1, 2)}</article>", f"<li class='comment'>{plain()}</li>", paras(1, 1)])
            return self.named(r.choice(["section", "div", "ol"]), "comments comment-list reader-comments replies responses discussion".replace("responses", "reviews"), r.choice(["", f"<h2>{self.words(0, 2)}</h2>"]) + "".join(one() for _ in range(r.randint(1, 4))))
        if kind == "share":
            return self.named(r.choice(["div", "ul"]), "share social follow-us", links(2, 4))
        return r.choice([f"<footer>{plain()}</footer>", f"<footer>&copy; {plain()}<p>{self.words(2, 8)}</p></footer>", self.named("div", "footer site-footer copyright legal", r.choice([plain(), paras(1, 2)]))])

    def page(self) -> tuple[list[Block], list[int]]:
        r = self.r
        self.content = set()
        body = [self.main(r.choice(["h1", "h1", "h2"]), 1, 14)] if r.random() < 0.9 else []
        for _ in range(r.randint(1, 10)):
            kind = r.random()
            if kind < 0.7:
                body.append(self.main("p", *r.choice([(0, 4), (5, 20), (15, 80)])))
            elif kind < 0.8:
                body.append("<ul>" + "".join(self.main("li", 0, 15) for _ in range(r.randint(1, 4))) + "</ul>")
            else:
                body.append(self.main(r.choice(["h2", "h3", "blockquote", "pre"]), 0, 12))
        for kind in r.sample(["ad", "form", "notice", "side", "share", "menu"], r.choice([0, 0, 0, 1, 1, 2])):
            body.insert(r.randint(0, len(body)), self.junk(kind))
        if r.random() < 0.15:
            body.append(self.junk("comment"))
        inner = "".join(body)
        inner = r.choice([f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", self.named("div", "content main post entry-content article-body story main-content", inner), f"<div><div>{inner}</div></div>", f"<table><tr><td>{inner}</td></tr></table>", inner])
        before = [self.junk(k) for k in r.sample(["menu", "head", "ad", "notice", "form", "share"], r.randint(0, 4))]
        after = [self.junk(k) for k in r.sample(["side", "comment", "ad", "share", "form", "menu", "foot", "notice"], r.randint(0, 5))]
        title = f"<head><title>{self.words(1, 9)}</title></head>" if r.random() < 0.8 else ""
        found = blocks(f"<html>{title}<body>{''.join(before)}{inner}{''.join(after)}</body></html>")
        return found, [int(b.text in self.content) for b in found]


def train(pages: int = PAGES, seed: int = 23, steps: int = 120) -> Model:
    """Fit on `pages` generated labelled pages."""
    made, generator = [], Generator(seed)
    for _ in range(pages):
        found, labels = generator.page()
        if found:
            made.append((found, labels))
    lists = [numbers(features(b, found[i - 1] if i else None)) for found, _ in made for i, b in enumerate(found)]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    w = crf.fit(np.array([f for x in lists for f in x]), owner, np.arange(len(lists)), np.array([y for _, ys in made for y in ys]), np.array([len(ys) for _, ys in made]), 1 << BITS, 2, steps=steps, rate=0.3, ridge=1e-5)
    return Model(w["emit"], w["start"], w["trans"])


def main_text(pages: DataFrame, model: Model, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """Every row with the main text of its whole page; null and empty pages, and pages of no content, have an empty text."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract(x, shared.value) for x in batch], dtype=object)

    return pages.withColumn(out_col, extracted(F.col(html_col)))
