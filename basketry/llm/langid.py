"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.text import map_pieces, pieces

LETTER = re.compile(r"[^\W\d_]")
#: a model is at most so many numbers, so its broadcast is bounded
MAX_NUMBERS = 1 << 24
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """``log_prob[b, l]``: log-probability of n-gram bucket ``b`` in language ``l``."""

    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray
    n_max: int


def ngram_buckets(texts: pa.Array, n_max: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to ``n_max``: (document number, bucket) of all n-grams of code points, lower-cased."""
    strings = [t.lower() if t else "" for t in texts.to_pylist()]
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(strings), dtype=np.int32), size)
    code = points * np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    grams = code.copy()
    for n in range(1, n_max + 1):
        if n > 1:
            grams = (grams[:-1] * np.uint32(0x85EBCA6B)) ^ code[n - 1 :]
            grams ^= grams >> np.uint32(13)
        here = len(grams)
        same = doc[:here] == doc[len(doc) - here :]
        mixed = grams * np.uint32(0xC2B2AE35) + np.uint32(n)
        bucket = (mixed >> np.uint32(32 - (buckets - 1).bit_length())).astype(np.int32)
        yield doc[:here][same], bucket[same]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", n_max: int = 3, buckets: int = 1 << 15, alpha: float = 0.5) -> Model:
    """Learn from all rows of ``labelled`` with a language; ``buckets`` is a power of two.

    Tasks count n-grams per language and bucket; the sums, ``buckets`` times the
    number of languages, come to the driver as the model.  More languages than
    the bound allows are an error.  Without labelled rows the model knows no
    language.
    """
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MAX_NUMBERS // buckets + 1).collect())
    if len(languages) * buckets > MAX_NUMBERS:
        raise ValueError(f"more than {MAX_NUMBERS // buckets} languages: take fewer buckets")
    if not languages:
        return Model([], np.zeros(0), np.zeros((buckets, 0), np.float32), n_max)
    number = {name: k for k, name in enumerate(languages)}

    def count(batches):
        counts, docs = np.zeros((len(languages), buckets), np.int64), np.zeros(len(languages), np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                own = np.array([number[x] for x in piece.column("lang").to_pylist()], np.int32)
                np.add.at(docs, own, 1)
                for doc, bucket in ngram_buckets(piece.column("text"), n_max, buckets):
                    counts += np.bincount(own[doc] * buckets + bucket, minlength=counts.size).reshape(counts.shape)
        at_lang, at_bucket = np.nonzero(counts)
        seen = np.flatnonzero(docs)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([at_lang, seen]).astype(np.int32)),
                pa.array(np.concatenate([at_bucket, np.full(len(seen), -1)]).astype(np.int32)),
                pa.array(np.concatenate([counts[at_lang, at_bucket], docs[seen]])),
            ],
            names=["l", "b", "n"],
        )

    sums = rows.mapInArrow(count, "l int, b int, n bigint").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((buckets, len(languages)), alpha)
    ngrams = sums[sums.b >= 0]
    table[ngrams.b, ngrams.l] += ngrams.n
    prior = np.zeros(len(languages))
    documents = sums[sums.b < 0]
    prior[documents.l] = documents.n
    log_prob = np.log(table) - np.log(table.sum(axis=0))
    return Model(languages, np.log(prior / prior.sum()), log_prob.astype(np.float32), n_max)


def lettered(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter."""
    return np.array([bool(t and LETTER.search(t)) for t in texts.to_pylist()], bool)


def score_texts(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """Best language and its posterior probability for each text."""
    n_docs, n_langs = len(texts), len(model.languages)
    known = lettered(texts)
    if not n_langs:
        return [UNKNOWN] * n_docs, np.zeros(n_docs)
    total = np.tile(model.log_prior, (n_docs, 1))
    for doc, bucket in ngram_buckets(texts, model.n_max, len(model.log_prob)):
        first = np.searchsorted(doc, np.arange(n_docs))
        full = np.flatnonzero(np.diff(np.append(first, len(doc))))
        if len(full):
            for l in range(n_langs):
                column = np.ascontiguousarray(model.log_prob[:, l])
                total[full, l] += np.add.reduceat(column[bucket], first[full], dtype=np.float64)
    best = total.argmax(axis=1)
    top = total[np.arange(n_docs), best]
    share = 1 / np.exp(total - top[:, None]).sum(axis=1)
    names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
    return names, np.where(known, share, 0.0)


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Per row (key, lang_pred, score, row): the language of the whole text and its posterior probability.

    ``row`` is a struct of the columns of ``keep``, and there only if some are named.

    A null text, or one without a letter, is ``und`` with score 0, as is every
    text if the model knows no language.  Of equally likely languages the first
    in name order is taken.  Repeated rows and null keys give a row each, an
    empty table none.  Columns other than key and text are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most MAX_NUMBERS numbers
    row = [F.struct(*[F.col(c) for c in keep]).alias("row")] if keep else []
    given = df.select(F.col(key).alias("key"), F.col(text).alias("text"), *row)
    schema = f"key {given.schema['key'].dataType.simpleString()}, lang_pred string, score double"
    if keep:
        schema += f", row {given.schema['row'].dataType.simpleString()}"

    def work(piece):
        names, score = score_texts(piece.column("text"), shared.value)
        out = {"key": piece.column("key"), "lang_pred": names, "score": score}
        return out | ({"row": piece.column("row")} if keep else {})

    return map_pieces(given, "text", schema, work).withColumnRenamed("key", key)


def fold(key: str = "doc_id", folds: int = 4) -> Column:
    """Fold of a row by the checksum of its key's text; null keys are in no fold."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def identify(
    df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", keep: Sequence[str] = (), **options
) -> DataFrame:
    """Learn from the labelled rows outside fold 2 of 4 and predict all rows; adds ``held_out``."""
    held_out = F.coalesce(fold(key) == 2, F.lit(False))
    model = fit(df.where(~held_out), text, lang, **options)
    return predict(df, model, key, text, keep).withColumn("held_out", held_out)


def known_rows(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """Rows of ``df`` whose language is recognised, unchanged; learns as ``identify`` does.

    Any text with a letter gets a language, so null texts and those without a
    letter go, no others; so too if no language could be learned.
    """
    model = fit(df.where(~F.coalesce(fold(key) == 2, F.lit(False))), text, lang, **options)
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most MAX_NUMBERS numbers

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, text):
                names, _ = score_texts(piece.column(text), shared.value)
                known = [name != UNKNOWN for name in names] if shared.value.languages else lettered(piece.column(text))
                yield piece.filter(pa.array(known, pa.bool_()))

    return df.mapInArrow(run, df.schema)
