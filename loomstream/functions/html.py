"""HTML pages to columns, with the standard library's parser in Arrow batches.

Selectors: tag, .class, #id, [attr="v"], descendant and > child steps. Malformed markup is read as far as it goes.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstream.session import ship

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BREAKS = frozenset("br p h1 h2 h3".split())
_CLOSES = {"p": {"p", "div", "h1", "h2", "h3", "ul", "ol", "section", "article"}, "li": {"li"}}


class Node:
    __slots__ = ("attrs", "kids", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.kids: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [k for k in reversed(n.kids) if isinstance(k, Node)]

    def text(self, sep: str = "") -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in ("script", "style"):
                if sep and n.tag in _BREAKS:
                    out.append(sep)
                stack += reversed(n.kids)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if self.at.tag in _CLOSES and tag in _CLOSES[self.at.tag]:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(page: str) -> Node:
    b = _Builder()
    b.feed(page or "")
    b.close()
    return b.root


_STEP = re.compile(r"([\w*-]+)?((?:[.#][\w-]+|\[[^\]]+\])*)")


@lru_cache(512)
def _selector(text: str) -> list[tuple[str, str, list[tuple[str, str | None]]]]:
    steps, how = [], " "
    for part in re.findall(r">|[^\s>]+(?:\[[^\]]*\])?", text):
        if part == ">":
            how = ">"
            continue
        m = _STEP.fullmatch(part)
        if not m:
            raise ValueError(f"selector not known: {text}")
        tests: list[tuple[str, str | None]] = []
        for t in re.findall(r"[.#][\w-]+|\[[^\]]+\]", m[2]):
            if t[0] == ".":
                tests.append(("class", t[1:]))
            elif t[0] == "#":
                tests.append(("id", t[1:]))
            else:
                name, _, value = t[1:-1].partition("=")
                tests.append((name, value.strip("\"'") if _ else None))
        steps.append((how, m[1] or "*", tests))
        how = " "
    return steps


def _fits(n: Node, tag: str, tests) -> bool:
    if tag not in ("*", n.tag):
        return False
    for name, value in tests:
        have = n.attrs.get(name)
        if have is None or (name == "class" and value not in have.split()) or (name != "class" and value is not None and have != value):
            return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Nodes in document order."""
    steps = _selector(selector)

    def up(n: Node | None, i: int) -> bool:
        if i < 0:
            return True
        how = steps[i + 1][0]
        p = n.parent if n else None
        while p is not None and p.tag:
            if _fits(p, *steps[i][1:]) and up(p, i - 1):
                return True
            if how == ">":
                return False
            p = p.parent
        return False

    last = len(steps) - 1
    return [n for n in root.walk() if n.tag and _fits(n, *steps[last][1:]) and up(n, last - 1)]


def unescape(text: str) -> str:
    return re.sub("[​-‏﻿]", "", _html.unescape(text)).replace("\u00a0", " ")


def paragraphs(root: Node, selectors: list[str], longest: int = 10_240) -> list[str]:
    """Lines of the selected elements, each element once; without selectors or hits, of the <p> under the heaviest parent."""
    nodes: list[Node] = []
    for s in selectors or []:
        nodes += [n for n in select(root, s) if n not in nodes]
    order = {id(n): i for i, n in enumerate(root.walk())}
    nodes.sort(key=lambda n: order[id(n)])
    if not nodes:
        weight: dict[int, tuple[int, Node]] = {}
        for p in select(root, "p"):
            size, parent = len(p.text()), p.parent
            weight[id(parent)] = (weight.get(id(parent), (0, parent))[0] + size, parent)
        if weight:
            best = max(weight.values(), key=lambda x: x[0])[1]
            nodes = [k for k in best.kids if isinstance(k, Node) and k.tag == "p"]
    out = []
    for n in nodes:
        for line in n.text("\n").split("\n"):
            line = re.sub(r"\s+", " ", unescape(line)).strip()
            if line:
                out.append(line if len(line) <= longest else line[: longest - 1] + "…")
    return out


def _resolved(base: str, href: str) -> str | None:
    try:
        return urljoin(base, href)
    except ValueError:
        return None


def links(root: Node, url: str) -> list[str]:
    base = next((n.attrs["href"] for n in select(root, "base") if n.attrs.get("href")), url)
    out = []
    for n in select(root, "a"):
        href = n.attrs.get("href", "").strip()
        if href and not re.match(r"(?i)(javascript|mailto|whatsapp):", href):
            out.append(_resolved(_resolved(url, base) or url, href))
    return list(dict.fromkeys(x for x in out if x))


# Where pages state their title, description and so on, best place first.
TITLE_PLACES = ("fb_title", "hdl", "Headline", "sailthru.title", "og:title", "rnews:headline", "alternativeHeadline")
_META = {
    "title": TITLE_PLACES, "description": ("og:description", "description", "sailthru.description"), "author": ("author", "sailthru.author", "article:author"), "type": ("og:type",),
    "image_url": ("og:image", "twitter:image"), "published": ("article:published_time", "pubdate", "date", "sailthru.date"), "modified": ("article:modified_time", "lastmod"), "origin": ("og:site_name",),
}


_FOLLOW = re.compile(r"(?i)facebook|twitter")


def _kept(lines: list[str], blacklist: list[str], known: bool) -> list[str]:
    """Lines without those that a pattern is found in and, on known sites, without a leading by-line and calls to follow."""
    out: list[str] = []
    for x in lines:
        low = x.lower()
        if any(re.search(p, x) for p in blacklist):
            continue
        if known and ((not out and low.startswith("by ") and len(x) < 100) or ("follow " in low and _FOLLOW.search(low))):
            continue
        out.append(x)
    return out


def facts(page: str, url: str, selectors: list[str], blacklist: list[str] | None = None) -> dict:
    root = parse(page)
    meta: dict[str, str] = {}
    for n in select(root, "meta"):
        for name in ("name", "property", "itemprop"):
            if n.attrs.get(name) and n.attrs.get("content"):
                meta.setdefault(n.attrs[name], n.attrs["content"])
    out: dict = {k: next((unescape(meta[p]).strip() for p in places if p in meta), None) for k, places in _META.items()}
    if not out["title"]:
        out["title"] = next((unescape(n.text()).strip() for n in select(root, "title")), None)
    found = links(root, url)
    sources = [n.attrs["src"] for n in root.walk() if n.tag in ("video", "source") and n.attrs.get("src") and (n.tag == "video" or n.parent.tag == "video")]
    videos = found + [n.attrs.get("src", "") for n in root.walk() if n.tag in ("iframe", "source", "embed")]
    ids = (re.search(r"(?:youtube\.com/(?:watch\?(?:[^#]*&)?v=|embed/|v/)|youtu\.be/)([\w-]{6,})", v) for v in videos)
    return out | {"paragraph": _kept(paragraphs(root, selectors), blacklist or [], bool(selectors)), "links": found, "youtube": list(dict.fromkeys(m[1] for m in ids if m)), "videos": list(dict.fromkeys(v for v in (_resolved(url, v) for v in sources) if v)), "keywords": meta.get("keywords") or meta.get("news_keywords")}


PAGE = "title string, description string, author string, type string, image_url string, published string, modified string, origin string, paragraph array<string>, links array<string>, youtube array<string>, videos array<string>, keywords string"


def page_facts(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and facts of rows with url, html and optionally selectors and text_blacklist (array<string>). Null pages have empty facts."""
    ship(pages.sparkSession)
    extra = [c for c in ("selectors", "text_blacklist") if c in pages.columns]
    cols = [*dict.fromkeys([*keys, "url"]), "html", *(c for c in extra if c not in keys)]
    names = [x.split()[0] for x in PAGE.split(", ")]
    kept = [pages.schema[k] for k in dict.fromkeys([*keys, "url"])]

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            lists = [pdf[c] if c in extra else [None] * len(pdf) for c in ("selectors", "text_blacklist")]
            got = [facts(h or "", u or "", *(list(x) if x is not None else [] for x in more)) for h, u, *more in zip(pdf["html"], pdf["url"], *lists, strict=True)]
            yield pd.concat([pdf[[f.name for f in kept]].reset_index(drop=True), pd.DataFrame(got, columns=names)], axis=1)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return pages.select(*cols).mapInPandas(read, f"{ddl}, {PAGE}")


def good_paragraph(text: Column, offset: Column, blacklist: Column) -> Column:
    """Whether an element's text is a paragraph: not empty, no by-line in first place, no call to follow, none of the site's patterns (array<string>) found in it."""
    low = F.lower(text)
    byline = (offset == 0) & low.startswith("by ") & (F.length(text) < 100)
    follow = (low.contains("facebook") | low.contains("twitter")) & low.contains("follow ")
    listed = F.exists(F.coalesce(blacklist, F.array().cast("array<string>")), lambda p: F.regexp_like(text, p))
    return F.coalesce((F.trim(text) != "") & ~byline & ~follow & ~listed, F.lit(False))


def meta_keywords(c: Column, body: Column) -> Column:
    """Keywords of a meta tag, split by the more frequent of , and ; - those that share a word with the body."""
    sep = F.when(F.regexp_count(c, F.lit(",")) > F.regexp_count(c, F.lit(";")), ",").otherwise(";")
    words = F.split(F.lower(body), r"[^\p{L}\p{N}]+")
    return F.filter(F.transform(F.split(c, sep), lambda k: F.trim(k)), lambda k: (k != "") & F.arrays_overlap(F.split(F.lower(k), r"[^\p{L}\p{N}]+"), words))
