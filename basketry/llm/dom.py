"""HTML as a list of nodes and text blocks, and features of the nodes."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: fixed values of the markup language
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: an element of the first kind ends at the start of one of the second
ENDS_BEFORE = {
    "p": frozenset(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
        "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
#: elements that an end tag or an implied end does not reach across
SCOPE = frozenset("table td th caption button object template".split())
ENDED_BY = {name: tuple(e for e, before in ENDS_BEFORE.items() if name in before) for name in frozenset().union(*ENDS_BEFORE.values())}
FAR_ENDS = frozenset("table tr tbody thead tfoot body html".split())
ITEMS = frozenset("li dt dd option".split())
#: elements that stop an implied end, and those that stop that of an item as well
BORDER = tuple(sorted(SCOPE - {"td", "th"}))
LISTS = ("ul", "ol", "dl", "select")

TAG = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)>",
    re.S,
)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
TOKEN = re.compile(r"[a-z]{2,}")
MARKS = re.compile(r"[.,;:!?]")

BUCKETS = 96
#: nodes whose features are held at a time, about 830 bytes each
NODES = 1 << 14
NUMERIC = (
    "depth", "children", "siblings", "place among siblings", "siblings of its tag", "chars", "words", "chars a node",
    "share of link text", "marks a word", "share of the page's text", "share of its parent's text", "nodes", "own chars",
    "place on the page", "attribute tokens",
)
N_FEATURES = len(NUMERIC) + 2 * BUCKETS


@dataclass
class Page:
    """Nodes in page order: tag, parent, tokens; and text runs as (block, node, text, in a link)."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    tokens: list[list[str]] = field(default_factory=list)
    runs: list[tuple[int, int, str, bool]] = field(default_factory=list)


def parse(source: str | None) -> Page:
    """Read a page; malformed markup gives some tree, never an error.

    Elements inside running text become nodes only if they carry names.  The
    places of the open elements are kept by name, so no tag walks the stack, and
    nothing is looked for past the last ``>``: time grows with the page only.
    """
    source = source or ""
    page = Page(["#page"], [-1], [[]])
    stack: list[tuple[str, int]] = [("#page", 0)]
    open_at: dict[str, list[int]] = {}
    block, links, at, n = 0, 0, 0, len(source)
    last = source.rfind(">") + 1

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            page.runs.append((block, stack[-1][1], html.unescape(raw) if "&" in raw else raw, links > 0))
        elif raw:
            page.runs.append((block, stack[-1][1], " ", links > 0))

    def pop(to: int) -> None:
        nonlocal links
        while len(stack) > to:
            name = stack.pop()[0]
            open_at[name].pop()
            links -= name == "a"

    def top(names) -> int:
        return max((places[-1] for places in map(open_at.get, names) if places), default=0)

    while at < last:
        found = TAG.search(source, at, last)
        if not found:
            break
        if found.start() > at:
            text(source[at : found.start()])
        at = found.end()
        name = found["name"]
        if name is None:
            if found["comment"] is not None and found.end("comment") == at:
                at = n  # never closed
            continue
        name = name.lower()
        if found["end"]:
            if name not in INLINE:
                block += 1
            place = top((name,))
            if place and (name in FAR_ENDS or place >= top(SCOPE)):
                pop(place)
            continue
        if name not in INLINE:
            block += 1
        place = top(ENDED_BY.get(name, ()))
        if place and place > top(BORDER + LISTS if name in ITEMS else BORDER):
            pop(place)
        if name in VOID:
            continue
        rest = found["rest"]
        names = [a or b or c for a, b, c in NAMES.findall(rest)] if "=" in rest else []
        tokens = [t for value in names for t in TOKEN.findall(value.lower())]
        if not rest.endswith("/") or name not in ("svg", "path", "iframe"):
            open_at.setdefault(name, []).append(len(stack))
        if name not in INLINE or tokens:
            page.tags.append(name)
            page.parents.append(stack[-1][1])
            page.tokens.append(tokens)
            stack.append((name, len(page.tags) - 1))
        else:
            stack.append((name, stack[-1][1]))
        links += name == "a"
        if rest.endswith("/") and name in ("svg", "path", "iframe"):
            stack.pop()
        if name in RAW:
            close = re.compile(rf"</{name}[\s/>]", re.I).search(source, at)
            at = close.start() if close else n
    if at < n:
        # no tag can end any more; an open comment or declaration hides what follows it
        found = re.compile("<[!?]").search(source, at)
        text(source[at : found.start() if found else n])
    return page


def bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


def feature_blocks(page: Page, size: int = NODES) -> Iterator[np.ndarray]:
    """A row of numbers per node, ``size`` nodes at a time: NUMERIC, then token buckets of the node and of those above it."""
    n = len(page.tags)
    parent = np.array(page.parents)
    chars, words, marks, linked, own = (np.zeros(n) for _ in range(5))
    for _, node, text, link in page.runs:
        length = len(text.strip())
        own[node] += length
        linked[node] += length if link else 0
        words[node] += text.count(" ") + 1 if length else 0
        marks[node] += len(MARKS.findall(text)) if length else 0
    chars[:] = own
    nodes = np.ones(n)
    depth, children = np.zeros(n), np.zeros(n)
    place, kin = np.zeros(n), Counter()
    mine, above = [0] * n, [0] * n  # buckets as bits
    for k in range(1, n):  # parents come before their children
        p = page.parents[k]
        depth[k] = depth[p] + 1
        place[k] = children[p]
        children[p] += 1
        kin[p, page.tags[k]] += 1
        bits = 1 << bucket("<" + page.tags[k])
        for token in page.tokens[k]:
            bits |= 1 << bucket(token)
        mine[k], above[k] = bits, mine[p] | above[p]
    for k in range(n - 1, 0, -1):
        p = parent[k]
        for a in (chars, words, marks, linked, nodes):
            a[p] += a[k]
    base = len(NUMERIC)
    for low in range(0, n, size):
        cut = slice(low, min(low + size, n))
        out = np.zeros((cut.stop - low, N_FEATURES), np.float32)
        up = np.maximum(parent[cut], 0)
        out[:, 0], out[:, 1], out[:, 2] = depth[cut], children[cut], children[up]
        out[:, 3] = place[cut] / np.maximum(children[up], 1)
        out[:, 4] = [kin[p, t] for p, t in zip(page.parents[cut], page.tags[cut])]
        out[:, 5], out[:, 6], out[:, 7] = np.log1p(chars[cut]), np.log1p(words[cut]), chars[cut] / nodes[cut]
        out[:, 8] = linked[cut] / np.maximum(chars[cut], 1)
        out[:, 9] = marks[cut] / np.maximum(words[cut], 1)
        out[:, 10], out[:, 11] = chars[cut] / max(chars[0], 1), chars[cut] / np.maximum(chars[up], 1)
        out[:, 12], out[:, 13] = np.log1p(nodes[cut]), np.log1p(own[cut])
        out[:, 14] = np.arange(low, cut.stop) / n
        out[:, 15] = [len(t) for t in page.tokens[cut]]
        for first, bits in ((base, mine), (base + BUCKETS, above)):
            raw = np.frombuffer(b"".join(b.to_bytes(BUCKETS // 8, "little") for b in bits[cut]), np.uint8)
            out[:, first : first + BUCKETS] = np.unpackbits(raw.reshape(-1, BUCKETS // 8), axis=1, bitorder="little")
        yield out


def features(page: Page) -> np.ndarray:
    """All rows of ``feature_blocks``."""
    return np.concatenate(list(feature_blocks(page)))


def kept_nodes(page: Page, score: np.ndarray) -> np.ndarray:
    """The set of nodes of highest total score in which a node's parent is kept with it; the page itself is."""
    best = score.astype(float).copy()
    for k in range(len(best) - 1, 0, -1):
        if best[k] > 0:
            best[page.parents[k]] += best[k]
    keep = np.zeros(len(best), bool)
    keep[0] = True
    for k in range(1, len(best)):
        keep[k] = keep[page.parents[k]] and best[k] > 0
    return keep


def block_text(page: Page, keep: np.ndarray) -> str:
    """Text of the kept nodes: white space in a block as one space, a line per block."""
    lines, parts, current = [], [], None
    for block, node, text, _ in page.runs:
        if block != current:
            lines.append("".join(parts))
            parts, current = [], block
        if keep[node]:
            parts.append(text)
    lines.append("".join(parts))
    return "\n".join(filter(None, (" ".join(x.split()) for x in lines)))
