"""Plain-Python versions of the operators, and small awkward tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

BASE = (
    "Es war einmal ein kleiner Bach der durch das grosse Tal floss und am Ende in den weiten See kam "
    "wo die Boote lagen und die Kinder spielten bis der Abend sank und alle nach Hause gingen um zu essen"
)
ENGLISH = (
    "the river runs down to the sea and the boats come home with the evening wind while people on the shore "
    "wait for their friends and talk about the weather and the fish that the nets have brought today"
)


def awkward() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empty, long, repeated and near-equal texts."""
    near = BASE.replace("Abend", "Morgen")
    texts = [
        (0, BASE, "de", "a"),
        (1, near, "de", "a"),
        (2, ENGLISH, "en", "b"),
        (3, BASE, "de", None),
        (4, None, None, "b"),
        (5, "", "en", "b"),
        (6, " \t\n", None, "c"),
        (7, "one two", "en", "c"),
        (8, "ONE two", "en", None),
        (9, "12 34 !!", None, "c"),
        (10, "x" * 250 + " " + ENGLISH + "\n" + BASE, "en", "d"),
        (11, (ENGLISH + "\n") * 40, "en", "d"),
        (12, "naïve ▁ 漢字 \U0001f600\n\n  two  spaces", "fr", "d"),
        (12, "naïve ▁ 漢字 \U0001f600\n\n  two  spaces", "fr", "d"),
        (None, ENGLISH + " and more words follow here", "en", "b"),
    ]
    return [(d, t, l, s, len(t) if t else 0) for d, t, l, s in texts]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None) -> set:
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_groups(rows: list[tuple[int, str]], percent: int = 75) -> dict[int, tuple[int, int]]:
    """Of (id, text): (number of shingles, smallest id reachable)."""
    sets = {d: shingles(t) for d, t in rows}
    group = {d: d for d in sets}

    def find(d):
        while group[d] != d:
            d = group[d]
        return d

    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                group[high] = low
    return {d: (len(s), find(d)) for d, s in sets.items()}


def without_repeats(rows: list[tuple[int, str]], size: int = 100) -> dict[int, tuple]:
    """Of (id, text), ids different: (bytes, removed, runs, SHA-256 of the rest)."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - size + 1):
            s = raw[i : i + size]
            if s in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(s)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out[d] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def base_statistics(text: str | None) -> tuple[int, ...]:
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def unigram(rows: list[tuple[int, str]]) -> tuple[int, dict[int, tuple[int, int, float]]]:
    """Training tokens, and per id: tokens, known ones, log10 probability."""
    tokens = {d: words((t or "").translate(LOWER)) + [None] for d, t in rows}
    counts = Counter(x for d, t in tokens.items() if d is None or zlib.crc32(str(d).encode()) % 10 for x in t)
    total = sum(counts.values())
    mass = total + 0.1 * (len(counts) + 1)
    return total, {
        d: (len(t), sum(counts[x] > 0 for x in t), sum(math.log10((counts[x] + 0.1) / mass) for x in t))
        for d, t in tokens.items()
    }
