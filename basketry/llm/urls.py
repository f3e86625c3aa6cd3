"""Judging URLs by a weighted vocabulary, after rules for hosts and paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: terms that block a URL alone
STRICT = ("porn", "xxx", "casino", "viagra", "escort", "hentai", "warez", "malware", "phishing", "jackpot")
#: fixed values: terms of which several different ones block a URL
SOFT = ("adult", "sex", "nude", "bet", "poker", "slots", "loan", "pills", "crack", "torrent", "dating", "cheap", "free", "win")


class Rules:
    """Host and path rules: ``rules`` maps "host/path" to "allow" or "block".

    A rule holds for its host and all hosts below it, if the path starts with
    the rule's.  The longest rule text wins; at equal length the longer host.
    """

    def __init__(self, rules: Mapping[str, str]):
        self.rules = []
        for name, verdict in rules.items():
            host, slash, path = name.partition("/")
            self.rules.append((name, host.lower(), slash + path, verdict))
        self.rules.sort(key=lambda rule: (-len(rule[0]), -len(rule[1])))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        for name, own, start, verdict in self.rules:
            if (host == own or host.endswith("." + own)) and path.startswith(start):
                return name, verdict
        return None, None


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    stop = min((at for at in map(rest.find, "/?#") if at >= 0), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:stop])
    tail = rest[stop:]
    end = min((at for at in map(tail.find, "?#") if at >= 0), default=len(tail))
    return host, tail[:end]


class Vocabulary:
    """Strict and soft terms in one Aho-Corasick automaton.

    A term counts where no ASCII letter or digit touches it on either side.
    """

    def __init__(self, strict: Sequence[str], soft: Sequence[str]):
        self.automaton = ahocorasick.Automaton()
        for kind, terms in (("soft", soft), ("strict", strict)):  # a term in both lists is strict
            for term in terms:
                if term:
                    self.automaton.add_word(term.lower(), (kind, term.lower()))
        if len(self.automaton):
            self.automaton.make_automaton()

    def count(self, url: str | None) -> tuple[int, int]:
        """Occurrences of strict terms, and number of different soft terms."""
        if not url or not len(self.automaton):
            return 0, 0
        text = url.lower()
        strict, soft = 0, set()
        for last, (kind, term) in self.automaton.iter(text):
            first = last - len(term) + 1
            if first and _alnum(text[first - 1]) or last + 1 < len(text) and _alnum(text[last + 1]):
                continue
            if kind == "strict":
                strict += 1
            else:
                soft.add(term)
        return strict, len(soft)


def _alnum(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def judge_urls(
    df: DataFrame,
    rules: Mapping[str, str],
    key: str = "page_id",
    url: str = "url",
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_limit: int = 2,
) -> DataFrame:
    """Per row: (key, host, path, rule, n_strict, n_soft, verdict).

    The longest fitting rule decides; without one, a URL is blocked by one
    strict term or by ``soft_limit`` different soft terms, anywhere in it.
    Terms are matched in the lower-cased URL.

    A null URL, or one without ``://``, has an empty host and path and no rule;
    a null one has no terms, so it is allowed.  Repeated rows and null keys give
    a row each, an empty table none.  Other columns are not read.
    """

    def judge(batches):
        book, words = Rules(rules), Vocabulary(strict, soft)
        for batch in batches:
            urls = batch.column(1).to_pylist()
            parts = [split_url(u) for u in urls]
            found = [book.find(*p) for p in parts]
            counts = [words.count(u) for u in urls]
            own = ["block" if a >= 1 or b >= soft_limit else "allow" for a, b in counts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([p[0] for p in parts], pa.string()),
                    pa.array([p[1] for p in parts], pa.string()),
                    pa.array([r for r, _ in found], pa.string()),
                    pa.array([a for a, _ in counts], pa.int64()),
                    pa.array([b for _, b in counts], pa.int64()),
                    pa.array([v or w for (_, v), w in zip(found, own)], pa.string()),
                ],
                names=["key", "host", "path", "rule", "n_strict", "n_soft", "verdict"],
            )

    given = df.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
    kind = given.schema["key"].dataType.simpleString()
    made = given.mapInArrow(
        judge, f"key {kind}, host string, path string, rule string, n_strict bigint, n_soft bigint, verdict string"
    )
    return made.withColumnRenamed("key", key)
