"""Language-model scores of whole documents: a unigram base and a gated recurrent network.

Token counts come from all training documents.  The network's words are the
most frequent ones; every other word is the network's word *rare*, times the
word's share among the rare ones, so a document's probability is that of its
whole token sequence.  The network first learns from a bounded number of tokens
on the driver, then every task learns on from all training documents that it
holds, and the tasks' weights are averaged by their tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import gru
from basketry.llm.langid import fold
from basketry.llm.text import LOWER, U64, Words, map_pieces, packed, pieces
from basketry.plans.scratch import materialize

ALPHA = 0.1
#: code of the end token; no word has it, as a word's code is never 0
END_CODE = 0
#: the network's words: the end token, *rare*, and the most frequent others
END, RARE = 0, 1
#: words whose counts every task has at hand; rarer ones are joined
NEAR_WORDS = 1 << 17
#: texts of so many bytes are run side by side
TOGETHER = 6 << 20


@dataclass(frozen=True)
class Settings:
    words: int = 1024
    classes: int = 32
    hidden: int = 24
    width: int = 16
    first_tokens: int = 400_000  # learned on the driver before the tasks go on
    first_passes: int = 3
    rate: float = 0.004


@dataclass(frozen=True)
class Model:
    codes: np.ndarray  # sorted codes of the near words, their counts and network ids
    counts: np.ndarray
    ids: np.ndarray
    tokens: int  # N, and V distinct ones
    distinct: int
    rare_mass: float  # of all words that the network does not know, unseen ones once
    shape: gru.Shape
    weights: dict[str, np.ndarray]

    @property
    def mass(self) -> float:
        return self.tokens + ALPHA * (self.distinct + 1)


def token_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of each text and then one end token, and where each text's start."""
    buf, at = packed(texts)
    words = Words(LOWER[buf], at)
    code = np.maximum(words.hash >> U64(1), U64(1)).astype(np.int64)
    bounds = words.first + np.arange(len(at))
    return np.insert(code, words.first[1:], END_CODE), bounds


def count_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """(code, n) of all tokens; a task adds up its own first."""

    def merged(parts):
        codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(where, weights=np.concatenate([n for _, n in parts]), minlength=len(codes)).astype(np.int64)

    def run(batches):
        parts, size = [(np.empty(0, np.int64), np.empty(0, np.int64))], 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                parts.append(np.unique(token_codes(piece.column("text"))[0], return_counts=True))
                size += len(parts[-1][0])
                if size > 1 << 20:
                    parts = [merged(parts)]
                    size = len(parts[0][0])
                    if size > 1 << 19:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], names=["code", "n"])
                        parts, size = [(np.empty(0, np.int64), np.empty(0, np.int64))], 0
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(parts)], names=["code", "n"])

    found = df.select(F.col(text).alias("text")).mapInArrow(run, "code bigint, n bigint")
    return found.groupBy("code").agg(F.sum("n").alias("n"))


def _network_ids(codes: np.ndarray, model_codes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    if not len(model_codes):
        return np.where(codes == END_CODE, END, RARE)
    near = np.minimum(np.searchsorted(model_codes, codes), len(model_codes) - 1)
    return np.where(model_codes[near] == codes, ids[near], RARE)


def fit(training: DataFrame, counts: DataFrame, settings: Settings) -> Model:
    """Learn from all rows (key, text) of ``training``, whose token counts are ``counts``.

    The driver gets NEAR_WORDS counts, about ``first_tokens`` tokens, and one sum
    of weights per parameter.
    """
    spark = training.sparkSession
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = int(totals["n"] or 0), int(totals["v"])
    near = counts.orderBy(F.desc("n"), "code").limit(NEAR_WORDS).toArrow()
    codes, n = near.column("code").to_numpy(), near.column("n").to_numpy()
    word = codes != END_CODE
    chosen = codes[word][: settings.words - 2]
    chosen_n = n[word][: settings.words - 2]
    end_n = int(n[~word].sum())
    rare_n = tokens - end_n - int(chosen_n.sum())
    rare_mass = rare_n + ALPHA * (distinct - len(chosen) - (end_n > 0)) + ALPHA
    # the end token, *rare* and each class of words are classes
    bounds = np.concatenate(([0, 1], 2 + gru.class_bounds(chosen_n, settings.classes)))
    shape = gru.Shape(bounds, settings.hidden, settings.width)
    ids = np.full(len(codes), RARE, np.int32)
    ids[~word] = END
    ids[np.flatnonzero(word)[: len(chosen)]] = 2 + np.arange(len(chosen))
    order = np.argsort(codes)
    codes, n, ids = codes[order], n[order], ids[order]
    weights = gru.start(shape, np.concatenate(([end_n, rare_n], chosen_n)))
    if not tokens:
        return Model(codes, n, ids, 0, 0, rare_mass, shape, weights)

    share = min(1.0, settings.first_tokens / tokens)
    lot = (F.xxhash64("key", F.lit(17)).bitwiseAND(F.lit((1 << 40) - 1))) < int(share * (1 << 40))

    def streams(df):
        def work(piece):
            code, at = token_codes(piece.column("text"))
            found = _network_ids(code, codes, ids).astype(np.int32)
            return {"ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found))}

        return map_pieces(df, "text", "ids array<int>", work)

    first = [np.array(r["ids"]) for r in streams(training.where(lot)).toLocalIterator()]
    if first:
        first.sort(key=lambda x: x.tobytes())
        stream, begin = _joined(first)
        state = None
        for _ in range(settings.first_passes):
            state = gru.train(stream, begin, weights, shape, settings.rate, state=state)
    own_words = ids != RARE
    # the network's own words and the weights
    shared = spark.sparkContext.broadcast((codes[own_words], ids[own_words], gru.flat(weights)))

    def learn(batches):
        codes, ids, values = shared.value
        own, state, seen = gru.unflat(values, shape), None, 0
        for batch in batches:
            for piece in pieces(batch, "text", TOGETHER):
                code, at = token_codes(piece.column("text"))
                begin = np.zeros(len(code), bool)
                begin[at[:-1]] = True
                state = gru.train(_network_ids(code, codes, ids), begin, own, shape, settings.rate / 2, state=state)
                seen += len(code)
        if seen:
            values = gru.flat(own).astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, len(values), dtype=np.int32)), pa.array(np.concatenate(([float(seen)], values)))],
                names=["place", "value"],
            )

    sums = training.select("text").mapInArrow(learn, "place int, value double")
    sums = sums.groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    values = np.zeros(sums.num_rows)
    values[sums.column("place").to_numpy() + 1] = sums.column("value").to_numpy()
    if len(values) and values[0]:
        weights = gru.unflat(values[1:] / values[0], shape)
    return Model(codes, n, ids, tokens, distinct, rare_mass, shape, weights)


def _joined(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    stream = np.concatenate(documents)
    begin = np.zeros(len(stream), bool)
    begin[np.cumsum([0] + [len(d) for d in documents[:-1]])] = True
    return stream, begin


def _document_parts(given: DataFrame, shared) -> DataFrame:
    """Per row: tokens, those near, their base score, the network's score, and the words that are not near.

    ``far`` has a struct (code, n) for each distinct word of the row that is not near.
    """

    def work(piece):
        model = shared.value
        code, at = token_codes(piece.column("text"))
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        place, known = _places(code, model)
        part = np.log10((model.counts[place[known]] + ALPHA) / model.mass)
        ids = np.where(known, model.ids[place], RARE) if len(model.codes) else _network_ids(code, model.codes, model.ids)
        docs = len(at) - 1
        far_doc, far = doc[~known], code[~known]
        order = np.lexsort((far, far_doc))
        far_doc, far = far_doc[order], far[order]
        fresh = np.ones(len(far), bool)
        fresh[1:] = (far_doc[1:] != far_doc[:-1]) | (far[1:] != far[:-1])
        first = np.flatnonzero(fresh)
        words = pa.StructArray.from_arrays(
            [pa.array(far[first]), pa.array(np.diff(np.append(first, len(far))))], names=["code", "n"]
        )
        return {
            "key": piece.column("key"),
            "row": piece.column("row"),
            "held_out": piece.column("held_out"),
            "n_tokens": np.diff(at),
            "near": np.bincount(doc[known], minlength=docs),
            "near_base": np.bincount(doc[known], weights=part, minlength=docs),
            "n_rare": np.bincount(doc[ids == RARE], minlength=docs),
            "rare_base": np.bincount(
                doc[known & (ids == RARE)], weights=part[ids[known] == RARE], minlength=docs
            ),
            "network": gru.log_likelihoods(ids, at, model.weights, model.shape) / np.log(10),
            "far": pa.ListArray.from_arrays(
                pa.array(np.searchsorted(far_doc[first], np.arange(docs + 1)).astype(np.int32)), words
            ),
        }

    kind = given.schema["key"].dataType.simpleString()
    schema = (
        f"key {kind}, row bigint, held_out boolean, n_tokens bigint, near bigint, near_base double, n_rare bigint, "
        "rare_base double, network double, far array<struct<code: bigint, n: bigint>>"
    )
    return map_pieces(given, "text", schema, work, TOGETHER)


def _places(code: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    if not len(model.codes):
        return np.zeros(len(code), np.int64), np.zeros(len(code), bool)
    place = np.minimum(np.searchsorted(model.codes, code), len(model.codes) - 1)
    return place, model.codes[place] == code


def score_documents(
    df: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10, settings: Settings = Settings()
) -> DataFrame:
    """Per row (key, held_out, n_tokens, n_known, train_tokens, base_score, score), log10 probabilities of whole texts.

    Rows whose fold is 0 of ``folds`` are held out of training.  Tokens are the
    words, A-Z lower-cased, and one end.  ``base_score`` sums
    log10((c + ALPHA) / (N + ALPHA (V + 1))) over tokens; ``score`` is the
    network's, in which a word it does not know has the probability of *rare*
    times (c + ALPHA) / (the rare words' sum of that).

    A null or empty text is its end token alone.  Null keys are trained on.
    Repeated rows are scored alike.  Without training rows all counts are 0 and
    the network knows the end and *rare* only; an empty table gives no rows.
    Other columns are not read.
    """
    given = df.select(
        F.col(key).alias("key"),
        F.col(text).alias("text"),
        F.coalesce(fold(key, folds) == 0, F.lit(False)).alias("held_out"),
        F.xxhash64(F.col(key), F.col(text)).alias("row"),
    )
    training = given.where("NOT held_out").select("key", "text")
    counts = materialize(count_tokens(training), "token-counts")
    model = fit(training, counts, settings)
    shared = df.sparkSession.sparkContext.broadcast(model)  # NEAR_WORDS counts and the weights
    near = materialize(_document_parts(given, shared), "document-parts")  # read twice: a text is run once
    far = near.select("row", F.posexplode("far").alias("place", "word")).select("row", "place", "word.code", "word.n")
    part = F.log10((F.coalesce("c", F.lit(0)) + F.lit(ALPHA)) / F.lit(model.mass)) * F.col("n")
    words = far.join(counts.select("code", F.col("n").alias("c")), "code", "left")
    # equal rows come several times: all their sums are divided by their number
    sums = words.groupBy("row").agg(
        F.sum(part).alias("far_base"),
        F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("far_known"),
        F.count(F.when(F.col("place") == 0, 1)).alias("rows"),
    )
    both = near.join(sums.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left")
    far_base = F.coalesce(F.col("far_base") / F.col("rows"), F.lit(0.0))
    change = float(np.log10(model.mass / model.rare_mass))
    return both.select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("near") + F.coalesce((F.col("far_known") / F.col("rows")).cast("bigint"), F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("near_base") + far_base).alias("base_score"),
        (F.col("network") + F.col("rare_base") + far_base + F.col("n_rare") * change).alias("score"),
    )
