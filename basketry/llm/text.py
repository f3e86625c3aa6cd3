"""Whole texts as byte arrays, their words and hashes, a bounded piece of a batch at a time.

Texts are handled inside tasks as one packed byte array with offsets, so numpy
works on many documents at once.  A batch is cut into pieces of about
``PIECE_BYTES``; one document is never cut, so memory is bounded by that or by
the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20
U64 = np.uint64

#: word separators of the contracts: space and 0x09 to 0x0D
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = np.asarray(x, U64) + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODE = mix64(np.arange(256), 11)
_place = mix64(np.arange(64), 12) | U64(1)


def place_code(n: int) -> np.ndarray:
    """Odd random multipliers for the first ``n`` places of a word."""
    global _place
    if n > len(_place):
        _place = mix64(np.arange(2 * n), 12) | U64(1)
    return _place


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each starts; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of ``batch`` with about ``limit`` bytes of ``column``, one row at least."""
    _, at = packed(batch.column(column))
    low = 0
    while low < batch.num_rows:
        high = int(np.searchsorted(at, at[low] + limit, "right")) - 1
        high = min(max(high, low + 1), batch.num_rows)
        yield batch.slice(low, high - low)
        low = high


class Words:
    """The words of packed texts: spans, document number and 64-bit hash of each.

    ``first[d]`` and ``first[d + 1]`` bound the words of document ``d``.
    """

    def __init__(self, buf: np.ndarray, at: np.ndarray, hashed: bool = True):
        inside = ~SEPARATOR[buf]
        fresh = np.zeros(len(buf) + 1, bool)  # a text starts here
        fresh[at] = True
        before = np.empty(len(buf), bool)
        before[:1] = True
        before[1:] = ~inside[:-1]
        start = np.flatnonzero(inside & (before | fresh[:-1]))
        after = np.empty(len(buf), bool)
        after[-1:] = True
        after[:-1] = ~inside[1:]
        self.start = start
        self.end = np.flatnonzero(inside & (after | fresh[1:])) + 1
        self.first = np.searchsorted(start, at)
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        if hashed:
            self.hash = span_hashes(buf, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; spans are not empty, in order, and do not overlap."""
    if not len(start):
        return np.empty(0, U64)
    size = end - start
    head = np.cumsum(size) - size
    place = np.arange(head[-1] + size[-1]) - np.repeat(head, size)
    code = BYTE_CODE[buf[place + np.repeat(start, size)]]
    code *= place_code(int(size.max()))[place]
    return mix64(np.add.reduceat(code, head) + size.astype(U64))


def word_ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words within one document, and the index of its first word."""
    count = len(words) - n + 1
    if count < 1:
        return np.empty(0, U64), np.empty(0, np.int64)
    first = np.flatnonzero(words.doc[:count] == words.doc[n - 1 :])
    total = np.zeros(count, U64)
    for k in range(n):
        total *= U64(0xD6E8FEB86659FD93)
        total += words.hash[k : k + count]
        total ^= total >> U64(32)
    return mix64(total[first], n), first


def n_code_points(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of each packed text: its bytes that do not continue a character."""
    heads = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    return heads[at[1:]] - heads[at[:-1]]


def map_pieces(df, column: str, schema: str, work, limit: int = PIECE_BYTES):
    """``work(piece)`` -> dict of columns, over all rows of ``df`` by pieces of ``limit`` bytes; a lazy DataFrame.

    ``work`` gets Arrow record batches with the columns of ``df``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, column, limit):
                made = work(piece)
                if made is not None:
                    yield pa.RecordBatch.from_arrays(
                        [_as_array(made[f.name], f.type) for f in out], schema=out
                    )

    return df.mapInArrow(run, schema)


def _as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether an equal one stands earlier, and whether an equal one stands anywhere else."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    later = np.zeros(len(keys), bool)
    later[1:] = ranked[1:] == ranked[:-1]
    both = later.copy()
    both[:-1] |= later[1:]
    out_later, out_both = np.empty_like(later), np.empty_like(both)
    out_later[order], out_both[order] = later, both
    return out_later, out_both
