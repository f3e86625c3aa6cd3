"""Main text of web pages, by boosted trees over the nodes of a page."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import boosting
from basketry.llm.dom import NODES, Page, block_text, feature_blocks, features, kept_nodes, parse
from basketry.llm.text import map_pieces

#: bounds of the training sample: pages that lend their words, their greatest length, and pages built from them
LENDERS = 200
LENDER_CHARS = 20_000
TRAINING_PAGES = 500

#: fixed values: how training pages name their parts
MAIN = ("content", "main", "post", "entry content", "article body", "story", "text", "page content", "post body")
PARTS = {
    "menu": (("nav", "div", "ul", "header"), ("nav", "menu", "navbar", "main menu", "breadcrumb", "site nav", "topbar", "pagination")),
    "header": (("header", "div"), ("header", "masthead", "site header", "banner", "branding", "logo")),
    "footer": (("footer", "div"), ("footer", "site footer", "copyright", "colophon", "bottom", "legal")),
    "sidebar": (("aside", "div", "section"), ("sidebar", "side", "widget", "related", "recommended", "most read", "tags", "trending")),
    "notice": (("div", "section", "p"), ("notice", "cookie banner", "consent", "alert", "gdpr", "disclaimer", "popup", "overlay modal")),
    "advert": (("div", "aside", "ins", "section"), ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner ad", "ad slot")),
    "form": (("form", "div"), ("form", "search", "login", "newsletter", "subscribe", "signup", "contact form")),
    "comments": (("div", "section", "ol"), ("comments", "comment", "comment list", "disqus", "replies", "discussion", "respond")),
    "share": (("div", "ul"), ("share", "social", "share buttons", "follow", "toolbar", "byline meta")),
}
_WORD = re.compile(r"<[^>]*>|[^<\s]+")


class Builder:
    """Random pages of known main text, written in borrowed words; comments switch main text on and off."""

    def __init__(self, words: list[str], seed: int):
        words = words or ["word"]
        self.starts, self.rng = len(words), np.random.default_rng(seed)
        self.words = words + (words * (200 // len(words) + 1))[:200]  # no text is longer

    def pick(self, options):
        return options[self.rng.integers(len(options))]

    def text(self, low: int, high: int) -> str:
        start, size = int(self.rng.integers(self.starts)), int(self.rng.integers(low, high + 1))
        return html.escape(" ".join(self.words[start : start + size]))

    def names(self, kinds: tuple[str, ...], often: float = 0.8) -> str:
        if self.rng.random() > often:
            return ""
        return f' {self.pick(("class", "class", "id"))}="{self.pick(kinds).replace(" ", self.pick((" ", "-", "_")))}"'

    def part(self, kind: str) -> str:
        tags, kinds = PARTS[kind]
        tag = self.pick(tags)
        named = tag in ("nav", "footer", "aside", "form")
        head = f"<{tag}{self.names(kinds, 0.5 if named else 1.0)}>"
        if kind in ("menu", "share"):
            items = "".join(f"<li><a href='/x'>{self.text(1, 2)}</a></li>" for _ in range(self.rng.integers(2, 9)))
            body = items if tag in ("ul", "ol") else f"<ul>{items}</ul>" if self.rng.random() < 0.7 else re.sub("</?li>", " ", items)
        elif kind == "form":
            body = f"<label>{self.text(1, 3)}</label><input name=q><select><option>{self.text(1, 1)}</select><button>{self.text(1, 2)}</button>"
        elif kind == "comments":
            body = "".join(
                f'<div{self.names(("comment", "reply", "comment body"), 0.6)}><p>{self.text(3, 40)}</p></div>' for _ in range(self.rng.integers(1, 6))
            )
        elif kind == "sidebar" and self.rng.random() < 0.6:
            body = f"<h3>{self.text(1, 3)}</h3><ul>" + "".join(f"<li><a href=y>{self.text(2, 7)}</a></li>" for _ in range(self.rng.integers(2, 7))) + "</ul>"
        elif kind == "header":
            body = f"<a href=/>{self.text(1, 3)}</a><p>{self.text(1, 6)}</p>" if self.rng.random() < 0.5 else f"<div>{self.text(1, 4)}</div>"
        else:
            body = self.text(2, 30) if self.rng.random() < 0.6 else f"<p>{self.text(2, 30)}</p>"
        return f"{head}{body}</{tag}>"

    def block(self) -> str:
        kind = self.rng.random()
        if kind < 0.08:
            return f"<p><b>{self.text(1, int(self.pick((9, 40))))}<br>"
        if kind < 0.72:
            return f"<p>{self.text(1, int(self.pick((3, 20, 60, 150))))}</p>"
        if kind < 0.78:
            return f"<p><b>{self.text(2, 40)}<br><p>{self.text(1, 40)}</p>"
        if kind < 0.84:
            return f"<h{self.pick((2, 3))}>{self.text(1, 6)}</h2>"
        if kind < 0.9:
            return "<ul>" + "".join(f"<li>{self.text(2, 15)}</li>" for _ in range(self.rng.integers(1, 6))) + "</ul>"
        if kind < 0.94:
            return f"<blockquote><p>{self.text(3, 40)}</p></blockquote>"
        if kind < 0.97:
            return f"<table><tr><td>{self.text(1, 3)}</td><td>{self.text(1, 5)}</td></tr></table>"
        return f"<figure><img src=a><figcaption>{self.text(2, 9)}</figcaption></figure>"

    def page(self) -> str:
        some = lambda kinds, share: [self.part(k) for k in kinds if self.rng.random() < share]
        tag = self.pick(("article", "article", "main", "div", "section"))
        name = self.names(MAIN, 0.3 if tag in ("article", "main") else 1.0)
        blocks = [self.block() for _ in range(self.rng.integers(1, int(self.pick((1, 2, 4, 8, 25))) + 1))]
        title = f"<h1>{self.text(1, 9)}</h1>" if self.rng.random() < 0.8 else ""
        extra = some(("advert", "share", "sidebar"), 0.12)
        cut = int(self.rng.integers(len(blocks) + 1))
        inner = "".join(blocks[:cut]) + "".join(f"<!--off-->{e}<!--on-->" for e in extra) + "".join(blocks[cut:])
        main = f"<{tag}{name}><!--on-->{title}{inner}<!--off--></{tag}>"
        before = some(("menu", "header", "notice", "advert", "share", "form"), 0.45)
        after = some(("sidebar", "comments", "footer", "notice", "advert", "form", "menu"), 0.45)
        self.rng.shuffle(before)
        for _ in range(self.rng.integers(0, 3)):
            wrap = self.pick(("div", "section", "main"))
            main = f'<{wrap}{self.names(("wrapper", "container", "page", "site", "row", "col", "layout", "main"), 0.7)}>' + (
                "".join(some(("advert", "sidebar"), 0.15)) + main + "".join(some(("comments", "advert", "sidebar", "share"), 0.2))
            ) + f"</{wrap}>"
        return (
            f"<!DOCTYPE html><html><head><title>{self.text(1, 9)}</title><style>p{{}}</style></head><body>"
            + "".join(before) + main + "".join(after) + "<script>var a='</p>';</script></body></html>"
        )


def labelled(source: str) -> tuple[Page, np.ndarray]:
    """A built page and, per node, whether main text lies in it."""
    page = parse(source.replace("<!--on-->", "\0").replace("<!--off-->", "\1"))
    main, on, runs = np.zeros(len(page.tags), bool), False, []
    for block, node, text, link in page.runs:
        for piece in re.split("([\0\1])", text):
            if piece in ("\0", "\1"):
                on = piece == "\0"
            elif piece:
                runs.append((block, node, piece, link))
                main[node] |= on and not piece.isspace()
    page.runs[:] = runs
    for k in range(len(main) - 1, 0, -1):
        main[page.parents[k]] |= main[k]
    return page, main


def train(pages: DataFrame, key: str = "page_id", source: str = "html", seed: int = 1) -> boosting.Trees:
    """Trees for built pages in words of a bounded sample of ``pages``.

    The sample is the first LENDERS pages by a hash of the key, among those of up to
    LENDER_CHARS characters; TRAINING_PAGES pages are built from its words.
    """
    short = pages.where(F.length(source) <= LENDER_CHARS).select(F.col(key).alias("key"), F.col(source).alias("html"))
    # keys are chosen first, so no task sends more than these pages
    chosen = short.select("key", F.xxhash64("key", F.lit(seed)).alias("lot")).distinct().orderBy("lot").limit(LENDERS)
    lent = short.join(F.broadcast(chosen), "key").limit(LENDERS).collect()
    lent.sort(key=lambda r: (r["lot"], r["html"]))
    words = [w for r in lent for w in _WORD.findall(r["html"]) if not w.startswith("<")]
    builder = Builder([html.unescape(w) for w in words], seed)
    made = [labelled(builder.page()) for _ in range(TRAINING_PAGES)]
    x = np.concatenate([features(page)[1:] for page, _ in made])
    y = np.concatenate([main[1:] for _, main in made]).astype(float)
    return boosting.fit(x, y, seed=seed)


def extract_texts(sources: list[str | None], trees: boosting.Trees) -> Iterator[str]:
    """Main text of each page; features of about NODES nodes are held at a time."""
    pages = [parse(s) for s in sources]
    score, held, rows = [np.empty(0)], [], 0
    for page in pages:
        for block in feature_blocks(page):
            held.append(block)
            rows += len(block)
            if rows >= NODES:
                score.append(trees.margin(np.concatenate(held)))
                held, rows = [], 0
    if held:
        score.append(trees.margin(np.concatenate(held)))
    score, low = np.concatenate(score), 0
    for page in pages:
        high = low + len(page.tags)
        yield block_text(page, kept_nodes(page, score[low:high]))
        low = high


def main_text(df: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", trees: boosting.Trees | None = None) -> DataFrame:
    """Per row (key, url, text, n_chars): the main text of the page, its blocks as lines.

    The trees score every node by its subtree's text density, links, marks and
    size, its depth and siblings, and the tags and names on it and above it.
    Nodes are kept so that their scores add up to the most while no node is kept
    without its parent.  Text in scripts, styles and comments is never read.

    A null, empty or text-free page has an empty text; text without any markup
    is kept.  Repeated rows, null keys and null URLs give a row each, an empty
    table none.  Other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(trees or train(df, key, source))  # a fixed number of trees
    given = df.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(source).alias("html"))
    kind = given.schema["key"].dataType.simpleString()

    def work(piece):
        texts = list(extract_texts(piece.column("html").to_pylist(), shared.value))
        return {"key": piece.column("key"), "url": piece.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    made = map_pieces(given, "html", f"key {kind}, url string, text string, n_chars bigint", work, 1 << 20)
    return made.withColumnRenamed("key", key).withColumnRenamed("url", url)
