"""Vectors as short codes: the nearest entries of one codebook for each part of a vector.

Codebooks are fitted by rounds of nearest entry and mean over all vectors.
Tasks hold the codebooks, whose size is fixed by parameters, find nearest
entries through a tree (``gnat``) and pass on one sum per entry; the sums meet
in a grouped aggregate and only the new codebooks come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.gnat import Gnat
from basketry.llm.vectors import floor_means, matrix, whole_vectors
from basketry.plans.scratch import materialize

#: copies of each label's sum, so that one label's rows may be joined in several tasks
SALTS = 16


@dataclass
class Codebooks:
    """``values[part, entry]``: whole components, of a vector's part times ``scale``."""

    values: np.ndarray
    scale: int

    def digest(self) -> str:
        """SHA-256 of all components in order, as decimal numbers joined by commas."""
        return hashlib.sha256(",".join(map(str, self.values.ravel().tolist())).encode()).hexdigest()

    def trees(self) -> list[Gnat]:
        return [Gnat(book) for book in self.values]


def _nearest(trees: list[Gnat], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances and indices, a row per vector and a column per part."""
    parts = np.split(vectors, len(trees), axis=1)
    found = [tree.nearest(part) for tree, part in zip(trees, parts)]
    return np.stack([d for d, _ in found], 1), np.stack([i for _, i in found], 1)


def _sums(kept: DataFrame, books: Codebooks) -> DataFrame:
    """(part, entry, n, sums) over all vectors; every task passes on at most a row for each entry."""
    parts, entries, width = books.values.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.trees()
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            vectors = matrix(batch.column(0), parts * width)
            _, codes = _nearest(trees, vectors)
            for p in range(parts):
                counts[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(sums[p], codes[:, p], vectors[:, p * width : (p + 1) * width])
        part, entry = np.nonzero(counts)
        flat = sums[part, entry].ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), lists],
            names=["part", "entry", "n", "sums"],
        )

    made = kept.select("vector").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    return made.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums")
    )


def _improved(kept: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry replaced by its parts' floor(mean); an entry without parts stays."""
    parts, entries, width = books.values.shape
    counts = np.zeros((parts, entries), np.int64)
    sums = np.zeros((parts, entries, width), np.int64)
    for row in _sums(kept, books).toLocalIterator():  # parts x entries rows at most
        counts[row["part"], row["entry"]] = row["n"]
        sums[row["part"], row["entry"]] = row["sums"]
    flat = floor_means(sums.reshape(-1, width), counts.ravel(), books.values.reshape(-1, width))
    return Codebooks(flat.reshape(books.values.shape), books.scale)


def _encoded(kept: DataFrame, books: Codebooks) -> DataFrame:
    """The columns of ``kept`` but ``vector``, with ``codes`` and ``error``."""
    parts, _, width = books.values.shape
    names = [c for c in kept.columns if c != "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.trees()
        for batch in batches:
            away, codes = _nearest(trees, matrix(batch.column("vector"), parts * width))
            bounds = pa.array(np.arange(0, codes.size + 1, parts, dtype=np.int32))
            lists = pa.ListArray.from_arrays(bounds, pa.array(codes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), lists, pa.array(away.sum(axis=1))], names=[*names, "codes", "error"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in names)
    return kept.mapInArrow(run, f"{schema}, codes array<int>, error bigint")


def whole_rows(df: DataFrame, key: str, vector: str, label: str, parts: int, scale: int) -> tuple[DataFrame, int]:
    """A stored table (key, label, vector) of the rows that can be coded, and their number of components."""
    columns = {"key": F.col(key), "label": F.col(label)}
    kept = materialize(whole_vectors(df, vector, scale, columns), "whole-vectors")
    size = F.size("vector")
    lengths = kept.where((size > 0) & (size % parts == 0)).groupBy(size.alias("size")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    width = most[0]["size"] if most else 0
    return kept.where(size == width), width


def fit_codebooks(kept: DataFrame, width: int, parts: int, entries: int, rounds: int, scale: int) -> Codebooks:
    """Codebooks that start as the parts of the first vectors by key and improve ``rounds`` times."""
    first = kept.orderBy(F.asc_nulls_last("key"), "vector").limit(entries).select("vector").collect()
    vectors = np.array([r["vector"] for r in first], np.int64).reshape(-1, width)
    books = Codebooks(np.stack(np.split(vectors, parts, axis=1)), scale)
    for _ in range(rounds):
        books = _improved(kept, books)
    return books


def encode_vectors(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
) -> tuple[DataFrame, Codebooks | None]:
    """Per vector (key, label, codes, error, label_error), and the codebooks.

    Each component x becomes floor(``scale`` * x); a vector is cut into ``parts``
    equal consecutive parts, each coded by the nearest of at most ``entries``
    entries of its codebook (ties to the lower index).  ``error`` is the sum of
    the parts' squared distances, ``label_error`` its sum over equal labels,
    nulls together.

    Left out are null vectors, those with null or non-finite components, and
    those of another length than the most common one that ``parts`` divides (the
    longer of equally common).  Fewer vectors than ``entries`` make smaller
    codebooks.  Repeated rows are coded each; null keys come last in the choice
    of the first entries, equal keys in the order of their vectors.  An empty
    table gives no rows and no codebooks.  Other columns are not read.
    """
    kept, width = whole_rows(df, key, vector, label, parts, scale)
    if not width:
        empty = kept.select("key", "label", F.lit(None).cast("array<int>").alias("codes"))
        return empty.select("*", *[F.lit(None).cast("bigint").alias(c) for c in ("error", "label_error")]).limit(0), None
    books = fit_codebooks(kept, width, parts, entries, rounds, scale)
    coded = materialize(_encoded(kept, books), "codes")
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    # one label may hold most of the rows: its sum is there once for each salt
    totals = materialize(totals, "label-errors").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("key", "codes"), F.lit(SALTS)).cast("int"))
    joined = salted.join(totals, (F.col("label").eqNullSafe(F.col("_label"))) & (salted["_salt"] == totals["_salt"]))
    return joined.select("key", "label", "codes", "error", "label_error"), books


def code_text(codes: str = "codes", digits: int = 2) -> Column:
    """Codes as hex text, ``digits`` each."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), digits, "0"))), "")


def decode_vectors(coded: DataFrame, books: Codebooks, codes: str = "codes", vector: str = "vector") -> DataFrame:
    """``coded`` with ``vector``: the entries its codes name, in the unit of the original components.

    A component lies within a step of 1 / scale above its whole number, so the middle of the step is given.
    """
    parts, _, width = books.values.shape
    table = (books.values + 0.5) / books.scale
    names = coded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = matrix(batch.column(names.index(codes)), parts)
            flat = np.concatenate([table[p][picked[:, p]] for p in range(parts)], axis=1).ravel()
            bounds = pa.array(np.arange(0, len(flat) + 1, parts * width, dtype=np.int32))
            lists = pa.ListArray.from_arrays(bounds, pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*names, vector])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    return coded.mapInArrow(run, f"{schema}, `{vector}` array<double>")
