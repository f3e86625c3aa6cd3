"""Quality rules: base statistics of a text, and how far its make-up is from its language's."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.text import (
    LOWER,
    U64,
    Words,
    map_pieces,
    mix64,
    n_code_points,
    packed,
    pieces,
    repeated,
    span_hashes,
    word_ngrams,
)
from basketry.plans.scratch import materialize

#: fixed values: character classes of a histogram; a byte that continues a character has none
CLASSES = ("lower", "upper", "beyond ASCII", "digit", "space", "sentence mark", "symbol", "other")
SYMBOLS = b"#*$%&|<>"
SENTENCE_MARKS = b".,;:!?'\"()-"
N_CLASSES = len(CLASSES)


def _class_table() -> np.ndarray:
    table = np.full(256, 7, np.int16)
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 0, 1, 3
    table[0xC0:], table[0x80:0xC0] = 2, -1
    table[[0x20, *range(0x09, 0x0E)]] = 4
    table[list(SENTENCE_MARKS)], table[list(SYMBOLS)] = 5, 6
    return table


CLASS = _class_table()
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
#: a language is learned from so many languages at most; words are common from this share on, so at most 1 / share a language
MAX_LANGUAGES = 1000
COMMON_SHARE = 0.001
MIN_COUNT = 20


@dataclass(frozen=True)
class References:
    """Per language: shares of the character classes, and of its common words with the rest last."""

    classes: dict[str, np.ndarray]
    words: dict[str, tuple[np.ndarray, np.ndarray]]  # sorted word hashes, shares in that order and of the rest


def class_histograms(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Characters of each class, a row per text."""
    n_docs = len(at) - 1
    kind = CLASS[buf]
    doc = np.repeat(np.arange(n_docs), np.diff(at))
    seen = kind >= 0
    return np.bincount(doc[seen] * N_CLASSES + kind[seen], minlength=n_docs * N_CLASSES).reshape(n_docs, N_CLASSES)


def base_statistics(buf: np.ndarray, at: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each packed text."""
    n_docs = len(at) - 1
    words = Words(buf, at)
    heads = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    symbols = np.concatenate(([0], np.cumsum(IS_SYMBOL[buf])))
    # a line starts at a text's start and after each line feed
    feeds = np.flatnonzero(buf == 0x0A)
    full = at[:-1][np.diff(at) > 0]
    start = np.union1d(full, feeds + 1)
    start = start[start < len(buf)]
    end = np.append(start[1:], len(buf))
    end = end - (buf[end - 1] == 0x0A) if len(end) else end
    wordy = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[wordy], end[wordy]
    line_doc = np.searchsorted(at, start, "right") - 1
    earlier, _ = repeated(span_hashes(buf, start, end) ^ mix64(line_doc, 3))
    grams, first = word_ngrams(words, window)
    _, twice = repeated(grams ^ mix64(words.doc[first], 4))
    cover = np.zeros(len(words) + 1, np.int32)
    np.add.at(cover, first[twice], 1)
    np.subtract.at(cover, first[twice] + window, 1)
    covered = np.cumsum(cover[:-1]) > 0
    per_doc = lambda doc: np.bincount(doc, minlength=n_docs)
    return {
        "n_words": np.diff(words.first),
        "word_chars": np.bincount(words.doc, weights=heads[words.end] - heads[words.start], minlength=n_docs).astype(np.int64),
        "n_symbols": symbols[at[1:]] - symbols[at[:-1]],
        "n_dup_lines": per_doc(line_doc[earlier]),
        "n_repeat_words": per_doc(words.doc[covered]),
    }


def learn_references(df: DataFrame, text: str = "text", lang: str = "lang") -> References:
    """Class and word shares of every language, from all texts that name theirs.

    A task adds up its own counts before anything is exchanged.  What reaches
    the driver is one number per language and class, and the common words:
    those with at least ``COMMON_SHARE`` of their language's words (and
    ``MIN_COUNT`` occurrences), hence a bounded number.
    """
    rows = df.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    number = {name: k for k, name in enumerate(languages)}

    def count(batches):
        classes = np.zeros((len(languages), N_CLASSES), np.int64)
        total = np.zeros(len(languages), np.int64)
        keys, sums = np.empty(0, U64), np.empty(0, np.int64)  # language in the top bits, word hash below

        def table(kind, l, code, n):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(l), kind, np.int32)), pa.array(l.astype(np.int32)), pa.array(code.astype(np.int64)), pa.array(n)],
                names=["kind", "l", "code", "n"],
            )

        def word_rows():
            return table(1, keys >> U64(48), keys & U64((1 << 48) - 1), sums)

        for batch in batches:
            for piece in pieces(batch, "text"):
                buf, at = packed(piece.column("text"))
                own = np.array([number[x] for x in piece.column("lang").to_pylist()])
                np.add.at(classes, own, class_histograms(buf, at))
                words = Words(LOWER[buf], at)
                np.add.at(total, own, np.diff(words.first))
                key = (words.hash & U64((1 << 48) - 1)) | (own[words.doc].astype(U64) << U64(48))
                new, n = np.unique(key, return_counts=True)
                both, inverse = np.unique(np.concatenate([keys, new]), return_inverse=True)
                sums = np.bincount(inverse, weights=np.concatenate([sums, n]), minlength=len(both)).astype(np.int64)
                keys = both
                if len(keys) > 1 << 20:
                    yield word_rows()
                    keys, sums = keys[:0], sums[:0]
        yield word_rows()
        l, c = np.nonzero(classes)
        yield table(0, l, c, classes[l, c])
        yield table(2, np.arange(len(languages)), np.zeros(len(languages)), total)

    if not languages:
        return References({}, {})
    counts = rows.mapInArrow(count, "kind int, l int, code bigint, n bigint").groupBy("kind", "l", "code").agg(F.sum("n").alias("n"))
    counts = materialize(counts.where(f"kind <> 1 OR n >= {MIN_COUNT}"), "quality-counts")
    few = counts.where("kind <> 1").toPandas()
    totals = few[few.kind == 2].set_index("l").n
    common = counts.where(
        (F.col("kind") == 1)
        & F.expr("CASE l " + " ".join(f"WHEN {l} THEN n >= {max(MIN_COUNT, COMMON_SHARE * t)}" for l, t in totals.items()) + " END")
    ).toPandas()
    class_shares, word_shares = {}, {}
    for k, name in enumerate(languages):
        own = few[(few.kind == 0) & (few.l == k)]
        shares = np.zeros(N_CLASSES)
        shares[own.code] = own.n
        if shares.sum():
            class_shares[name] = shares / shares.sum()
        mine = common[common.l == k].sort_values("code")
        if len(mine):
            rest = totals[k] - mine.n.sum()
            word_shares[name] = (mine.code.to_numpy(U64), np.append(mine.n.to_numpy(float), rest) / totals[k])
    return References(class_shares, word_shares)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, 0 to 1, of each row of shares ``p`` from the shares ``q``."""
    middle = (p + q) / 2

    def half(a):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / middle), 0).sum(axis=1)

    return np.sqrt(np.clip((half(p) + half(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def distances(buf: np.ndarray, at: np.ndarray, langs: list[str | None], refs: References) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each text's class shares and common-word shares from its language's.

    A text without a known language is held against all, the nearest counts.
    """
    n_docs = len(at) - 1
    chars, words = np.zeros(n_docs), np.zeros(n_docs)
    if not refs.classes:
        return chars, words
    counts = class_histograms(buf, at)
    shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    tokens = Words(LOWER[buf], at)
    low = tokens.hash & U64((1 << 48) - 1)
    known = np.array([x if x in refs.classes else "" for x in langs], dtype=object)
    best_char, best_word = np.full(n_docs, np.inf), np.full(n_docs, np.inf)
    for name, reference in refs.classes.items():
        mine = np.flatnonzero((known == name) | (known == ""))
        if not len(mine):
            continue
        best_char[mine] = np.minimum(best_char[mine], js_distance(shares[mine], reference))
        if name in refs.words:
            hashes, expected = refs.words[name]
            chosen = np.zeros(n_docs, bool)
            chosen[mine] = True
            row = np.cumsum(chosen) - 1
            here = chosen[tokens.doc]
            place = np.minimum(np.searchsorted(hashes, low[here]), len(hashes) - 1)
            place = np.where(hashes[place] == low[here], place, len(hashes))
            width = len(hashes) + 1
            table = np.bincount(row[tokens.doc[here]] * width + place, minlength=len(mine) * width).reshape(-1, width)
            own = table / np.maximum(table.sum(axis=1, keepdims=True), 1)
            best_word[mine] = np.minimum(best_word[mine], js_distance(own, expected))
    return np.where(np.isfinite(best_char), best_char, 0), np.where(np.isfinite(best_word), best_word, 0)


def quality_rules(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    max_char_distance: float = 0.25,
    max_word_distance: float = 0.5,
    min_chars: int = 300,
    min_words: int = 100,
    references: References | None = None,
) -> DataFrame:
    """Base statistics, distances from the language's make-up, and a verdict for each row.

    A text fails the base rules with under 20 words, or if more than 30 % of its
    words stand in 8-word windows that the text repeats.  It fails the method if
    its character classes are farther than ``max_char_distance`` from its
    language's, or its common words farther than ``max_word_distance``; short
    texts, below ``min_chars`` characters or ``min_words`` words, have too few
    to be judged by that distance.

    A null or empty text has zeros and fails; a null or unknown language is
    compared with all, the nearest counts; without any labelled text distances
    are 0.  Repeated rows and null keys give a row each, an empty table none.
    Other columns are not read.
    """
    refs = references if references is not None else learn_references(df, text, lang)
    shared = df.sparkSession.sparkContext.broadcast(refs)  # bounded: languages x (classes + common words)
    given = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    kind = given.schema["key"].dataType.simpleString()
    schema = (
        f"key {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "base_failed boolean, char_distance double, word_distance double, kept boolean"
    )

    def work(piece):
        buf, at = packed(piece.column("text"))
        made = base_statistics(buf, at)
        failed = (made["n_words"] < 20) | (100 * made["n_repeat_words"] > 30 * made["n_words"])
        chars, words = distances(buf, at, piece.column("lang").to_pylist(), shared.value)
        odd = (chars > max_char_distance) & (n_code_points(buf, at) >= min_chars)
        odd |= (words > max_word_distance) & (made["n_words"] >= min_words)
        return {"key": piece.column("key"), **made, "base_failed": failed, "char_distance": chars, "word_distance": words, "kept": ~failed & ~odd}

    return map_pieces(given, "text", schema, work).withColumnRenamed("key", key)
