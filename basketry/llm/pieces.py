"""Encoding texts into the pieces of a SentencePiece BPE vocabulary, with seeded merge dropout, and decoding them.

A text starts as single characters; of all neighbouring pairs whose
concatenation is a piece, the pair of best score is merged, the leftmost on a
tie, until none is left.  A pair that comes up is skipped for good if a hash,
keyed by the seed, says so; it can come up again only as a pair of other pieces.
All units of a batch are merged side by side in numpy: a unit is a run of
spaces with the characters up to the next space, as no piece reaches from a
character into a following space.  Every occurrence of a unit has hashes of its
own; occurrences share a row of the matrices as long as the same pairs of the
unit were skipped in all of them.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.text import U64, map_pieces, mix64, packed

SPACE_MARK = "▁"
#: longer units are merged one by one with a heap
LONGEST = 64
_SPACE = 0x20
#: texts of so many bytes are encoded together, their equal units once
TOGETHER = 3 << 20
_place = mix64(np.arange(1 << 12), 51) | U64(1)


@dataclass(frozen=True)
class Vocabulary:
    """Tables of a vocabulary; their size depends on it alone."""

    pieces: list[str]
    char_ids: np.ndarray  # piece of each code point, or -1
    space_id: int
    byte_ids: np.ndarray
    slot_keys: np.ndarray  # open-addressed table: left * n + right -> merged piece
    slot_ids: np.ndarray
    scores: np.ndarray
    ranks: np.ndarray  # of the scores, best first; equal scores have one rank
    raw: np.ndarray  # bytes of all pieces
    raw_at: np.ndarray

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each pair's concatenation, -1 if it is no piece."""
        key = left.astype(np.int64) * len(self.pieces) + right
        slot = _slot(key, len(self.slot_keys))
        found = np.where(self.slot_keys[slot] == key, self.slot_ids[slot], np.int32(-1))
        more = np.flatnonzero((found < 0) & (self.slot_keys[slot] >= 0) & (self.slot_keys[slot] != key))
        while len(more):
            slot[more] = (slot[more] + 1) & (len(self.slot_keys) - 1)
            here = self.slot_keys[slot[more]]
            hit = here == key[more]
            found[more[hit]] = self.slot_ids[slot[more[hit]]]
            more = more[~hit & (here >= 0)]
        return found


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    return ((key.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(65 - size.bit_length())).astype(np.int64)


def load_vocabulary(path: str) -> Vocabulary:
    """Read a BPE model with byte fallback, dummy prefix and untouched white space; others are refused."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as schema

    proto = schema.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    norm, train = proto.normalizer_spec, proto.trainer_spec
    if train.model_type != train.BPE or not train.byte_fallback or norm.remove_extra_whitespaces or norm.precompiled_charsmap or not norm.add_dummy_prefix:
        raise ValueError("not a BPE vocabulary with byte fallback and untouched white space")
    model = SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    names = [model.id_to_piece(i) for i in range(n)]
    normal = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
    ids = {p: i for i, p in enumerate(names) if normal[i]}
    if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in ids):
        raise ValueError("a piece reaches over a space")
    table: dict[int, int] = {}
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
            if left is not None and right is not None:
                table[left * n + right] = i
        if len(piece) > 1 and any(c not in ids for c in piece):
            raise ValueError("a character of a piece is no piece")
    size = 1 << max(4, (4 * len(table)).bit_length())
    keys, values = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
    for key, value in table.items():
        slot = int(_slot(np.array([key]), size)[0])
        while keys[slot] >= 0:
            slot = (slot + 1) & (size - 1)
        keys[slot], values[slot] = key, value
    char_ids = np.full(0x110000, -1, np.int32)
    for c, i in ids.items():
        if len(c) == 1 and c != SPACE_MARK:
            char_ids[ord(c)] = i
    scores = np.array([model.get_score(i) for i in range(n)], np.float32)
    _, ranks = np.unique(-scores, return_inverse=True)
    if n >= np.iinfo(np.int16).max:
        raise ValueError("vocabularies up to 32,766 pieces only")
    raw = [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(names)]
    byte_ids = np.zeros(256, np.int32)
    for i in range(n):
        if model.is_byte(i):
            byte_ids[raw[i][0]] = i
    return Vocabulary(
        names,
        char_ids,
        ids[SPACE_MARK],
        byte_ids,
        keys,
        values,
        scores,
        ranks.astype(np.int16),
        np.frombuffer(b"".join(raw), np.uint8),
        np.concatenate(([0], np.cumsum([len(r) for r in raw]))),
    )


@dataclass(frozen=True)
class Dropout:
    """A pair of pieces that comes up is skipped with probability ``share``."""

    share: float = 0.1
    seed: int = 0

    def skips(self, key: np.ndarray, place: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Whether ``pair`` is skipped at ``place`` of the occurrence named ``key``."""
        if not self.share:
            return np.zeros(np.broadcast(key, place, pair).shape, bool)
        code = mix64(key ^ (place.astype(U64) << U64(32)) ^ pair.astype(U64), 52)
        return (code >> U64(11)).astype(np.float64) < self.share * 2.0**53


class _Rows:
    """Segmentations under way, as matrices of a row each, and the occurrences that have them.

    ``ids`` is padded by -1; ``rank`` holds the rank of the piece that each
    neighbouring pair would make, or ``NONE``; ``place`` where each piece starts.
    """

    NONE = np.iinfo(np.int16).max

    def __init__(self, ids: np.ndarray, size: np.ndarray, row: np.ndarray, keys: np.ndarray, vocab: Vocabulary, drop: Dropout):
        self.ids, self.size, self.row, self.keys, self.vocab, self.drop = ids, size, row, keys, vocab, drop
        self.number = np.arange(len(row))  # of the occurrences
        self.place = np.broadcast_to(np.arange(ids.shape[1], dtype=np.int8), ids.shape)
        self.rank = np.full((len(ids), ids.shape[1] - 1), self.NONE, np.int16)

    def rate(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank the pair at ``at`` of each of ``rows``.

        A row is split if only some of its occurrences skip the pair; returns
        the rows from which new ones, added at the end, were split.
        """
        left, right = self.ids[rows, at], self.ids[rows, at + 1]
        merged = self.vocab.merged(left, right)
        live = np.flatnonzero((merged >= 0) & (left >= 0) & (right >= 0))
        self.rank[rows, at] = self.NONE
        rows, at, left, right = rows[live], at[live], left[live], right[live]
        self.rank[rows, at] = self.vocab.ranks[merged[live]]
        if not self.drop.share or not len(rows):
            return rows[:0]
        nth = np.full(len(self.ids), -1)
        nth[rows] = np.arange(len(rows))
        nth = nth[self.row]
        here = np.flatnonzero(nth >= 0)
        nth = nth[here]
        pair = left.astype(np.int64) * len(self.vocab.pieces) + right
        skipped = self.drop.skips(self.keys[here], self.place[rows, at][nth], pair[nth])
        here, nth = here[skipped], nth[skipped]
        n_skips, n = np.bincount(nth, minlength=len(rows)), np.bincount(self.row, minlength=len(self.ids))[rows]
        self.rank[rows[n_skips == n], at[n_skips == n]] = self.NONE
        both = np.flatnonzero((n_skips > 0) & (n_skips < n))
        fresh = np.full(len(rows), -1)
        fresh[both] = len(self.ids) + np.arange(len(both))
        moved = fresh[nth] >= 0
        self.row[here[moved]] = fresh[nth[moved]]
        for name in ("ids", "size", "place", "rank"):
            table = getattr(self, name)
            setattr(self, name, np.concatenate((table, table[rows[both]])))
        self.rank[fresh[both], at[both]] = self.NONE
        return rows[both]

    def take(self, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keep the rows that are ``on``; (occurrences, their rows, sizes, ids) of the others."""
        new = np.where(on, np.cumsum(on), np.cumsum(~on)) - 1
        stay = on[self.row]
        out = self.number[~stay], new[self.row[~stay]], self.size[~on], self.ids[~on]
        self.number, self.row, self.keys = self.number[stay], new[self.row[stay]], self.keys[stay]
        self.ids, self.size, self.place, self.rank = self.ids[on], self.size[on], self.place[on], self.rank[on]
        return out


def _segments(ids: np.ndarray, size: np.ndarray, row: np.ndarray, keys: np.ndarray, vocab: Vocabulary, drop: Dropout) -> list[tuple]:
    """Merge units (rows of ``ids``, -1 padded) for occurrences named ``keys`` of the units ``row``.

    Returns blocks of (occurrences, their rows, counts of the rows, pieces of the rows).
    """
    done = []
    if ids.shape[1] < 2:
        return [(np.arange(len(row)), row, size, ids)]
    s = _Rows(ids, size, row, keys, vocab, drop)
    for column in range(ids.shape[1] - 1):
        rows = np.flatnonzero(s.ids[:, column + 1] >= 0)
        s.rate(rows, np.full(len(rows), column))
    while True:
        best = s.rank.argmin(axis=1)
        on = s.rank[np.arange(len(best)), best] < s.NONE
        if not on.all():
            done.append(s.take(on))
            best = best[on]
        if not len(best):
            return done
        line = np.arange(len(best))
        s.ids[line, best] = vocab.merged(s.ids[line, best], s.ids[line, best + 1])
        s.size = s.size - 1
        # close the gap behind the merged pair, and drop columns that no row uses any more
        used = int(s.size.max())
        still = np.arange(used) <= best[:, None]
        s.ids = np.where(still, s.ids[:, :used], s.ids[:, 1 : used + 1])
        s.place = np.where(still, s.place[:, :used], s.place[:, 1 : used + 1])
        if used < 2:
            done.append(s.take(np.zeros(len(best), bool)))
            return done
        s.rank = np.where(still[:, 1:], s.rank[:, : used - 1], s.rank[:, 1:used])
        left = np.flatnonzero(best > 0)
        best = np.concatenate((best, best[s.rate(left, best[left] - 1)]))
        right = np.flatnonzero(best < used - 1)
        s.rate(right, best[right])


def _long_segment(ids: np.ndarray, key: np.uint64, vocab: Vocabulary, drop: Dropout) -> np.ndarray:
    """The same for one unit of any length, by an agenda of pairs."""
    n = len(ids)
    symbol, before, after = ids.tolist(), list(range(-1, n - 1)), [*range(1, n), -1]
    agenda: list = []

    def push(lefts: list[int]) -> None:
        lefts = [i for i in lefts if i >= 0 and after[i] >= 0]
        if not lefts:
            return
        a, b = np.array([symbol[i] for i in lefts]), np.array([symbol[after[i]] for i in lefts])
        merged = vocab.merged(a, b)
        skipped = drop.skips(np.full(len(lefts), key), np.array(lefts), a * len(vocab.pieces) + b)
        for i, x, y, m, skip in zip(lefts, a.tolist(), b.tolist(), merged.tolist(), skipped.tolist()):
            if m >= 0 and not skip:
                heapq.heappush(agenda, (-float(vocab.scores[m]), i, x, y, m))

    push(list(range(n)))
    while agenda:
        _, i, x, y, m = heapq.heappop(agenda)
        j = after[i] if symbol[i] == x else -1
        if j < 0 or symbol[j] != y:
            continue
        symbol[i], symbol[j] = m, -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        push([before[i], i])
    return np.array([s for s in symbol if s >= 0], np.int32)


def encode(texts: list[str | None], keys: np.ndarray, vocab: Vocabulary, drop: Dropout) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text's start; ``keys`` name the texts for the dropout."""
    strings = [t or "" for t in texts]
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    points = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    # one space before each text that is not empty
    full = np.flatnonzero(size)
    start = np.concatenate(([0], np.cumsum(size)))
    points = np.insert(points, start[:-1][full], _SPACE)
    size = size + (size > 0)
    start = np.concatenate(([0], np.cumsum(size)))
    if not len(points):
        return np.empty(0, np.int32), start
    ids = vocab.char_ids[points]
    space = points == _SPACE
    ids[space] = vocab.space_id
    known = ids >= 0
    head = ~known
    head[1:] |= ~known[:-1] | (space[1:] & ~space[:-1])
    head[start[:-1][full]] = True
    unit = np.flatnonzero(head)
    length = np.diff(np.append(unit, len(points)))
    # a unit's hash, and each occurrence's name
    within = np.arange(len(points)) - np.repeat(unit, length)
    code = mix64(np.where(known, ids, -2 - points.astype(np.int64)).view(U64), 53) * _place[within & 0xFFF]
    code = mix64(np.add.reduceat(code, unit) + length.astype(U64) + (within[unit + length - 1] >> 12).astype(U64))
    doc = np.searchsorted(start, unit, "right") - 1
    name = mix64(keys[doc] ^ mix64(unit - start[doc], drop.seed + 54), 55)
    _, first, which, often = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
    by_unit, by_first = np.argsort(which, kind="stable"), np.cumsum(often) - often
    at, long = unit[first], length[first]

    def occurrences(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of ``units``, and the place of their unit among these; one of each if they are all alike."""
        if not drop.share:
            return first[units], np.arange(len(units))
        n = often[units]
        row = np.repeat(np.arange(len(units)), n)
        return by_unit[np.arange(len(row)) + (by_first[units] - (np.cumsum(n) - n))[row]], row

    blocks = []  # (occurrences, their rows, counts, padded ids)
    strange = np.flatnonzero(~known[at])
    for u in strange.tolist():
        raw = vocab.byte_ids[list(chr(points[at[u]]).encode())]
        alike = by_unit[by_first[u] : by_first[u] + often[u]]
        blocks.append((alike, np.zeros(len(alike), np.int64), np.array([len(raw)]), raw[None, :]))
    plain = known[at]
    low = 0
    for high in (2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 32, LONGEST):
        here = np.flatnonzero(plain & (long > low) & (long <= high))
        low = high
        total = np.cumsum(often[here]) if drop.share else np.arange(len(here))
        for part in np.split(here, np.flatnonzero(np.diff(total * high >> 19)) + 1):
            if len(part):
                column = np.arange(high)
                inside = column < long[part][:, None]
                matrix = np.where(inside, ids[np.minimum(at[part][:, None] + column, len(ids) - 1)], -1).astype(np.int16)
                own, row = occurrences(part)
                for n, rows, counts, made in _segments(matrix, long[part], row, name[own], vocab, drop):
                    blocks.append((own[n], rows, counts, made))
    for n in occurrences(np.flatnonzero(plain & (long > LONGEST)))[0].tolist():
        made = _long_segment(ids[unit[n] : unit[n] + length[n]], name[n], vocab, drop)
        blocks.append((np.array([n]), np.zeros(1, np.int64), np.array([len(made)]), made[None, :]))
    # pieces of all rows one after the other, then those of every occurrence
    row_of = np.empty(len(unit), np.int64)
    held, counts = 0, []
    for n, rows, size, _ in blocks:
        row_of[n] = held + rows
        held += len(size)
        counts.append(size)
    counts = np.concatenate(counts)
    flat = np.concatenate([made[np.arange(made.shape[1]) < size[:, None]] for _, _, size, made in blocks]).astype(np.int32)
    if not drop.share:
        row_of = row_of[first][which]
    n = counts[row_of]
    ends = np.cumsum(n)
    out = flat[np.arange(ends[-1]) + np.repeat((np.cumsum(counts) - counts)[row_of] - (ends - n), n)]
    total = np.concatenate(([0], ends))
    bounds = total[np.searchsorted(unit, start)]
    return out, bounds


def decode(ids: np.ndarray, at: np.ndarray, vocab: Vocabulary) -> list[bytes]:
    """UTF-8 bytes of each text from its ids."""
    size = np.diff(vocab.raw_at)[ids]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    out = vocab.raw[np.arange(total) + np.repeat(vocab.raw_at[ids] - (ends - size), size)].tobytes()
    bounds = np.concatenate(([0], ends))[at]
    return [out[low + (high > low) : high] for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def encode_texts(
    df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", share: float = 0.1, seed: int = 0
) -> DataFrame:
    """Per row (key, n_tokens, ids, decoded_sha256, lossless): its pieces, and whether they decode to its text.

    ``share`` is the probability with which a merge is skipped, 0 gives the
    model's own segmentation.  Which merges are skipped depends on ``seed``, the
    key, the place in the text and the pair, so reruns agree.
    ``decoded_sha256`` is that of the text decoded from ``ids``, as UTF-8.

    A null or empty text has no ids and decodes to an empty text.  The literal
    space mark and characters outside the vocabulary become their bytes' pieces.
    Null keys are one name; repeated rows are encoded alike; an empty table
    gives no rows.  Other columns are not read.
    """
    drop = Dropout(share, seed)
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))  # as large as the vocabulary
    given = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(key)).alias("name"))
    kind = given.schema["key"].dataType.simpleString()

    def work(piece):
        vocab = shared.value
        texts = piece.column("text")
        ids, at = encode(texts.to_pylist(), piece.column("name").to_numpy().view(U64), vocab, drop)
        decoded = decode(ids, at, vocab)
        buf, own = packed(texts)
        raw = buf.tobytes()
        same = [raw[a:b] == d for a, b, d in zip(own[:-1].tolist(), own[1:].tolist(), decoded)]
        return {
            "key": piece.column("key"),
            "n_tokens": np.diff(at),
            "ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)),
            "decoded_sha256": [hashlib.sha256(d).hexdigest() for d in decoded],
            "lossless": same,
        }

    schema = f"key {kind}, n_tokens bigint, ids array<int>, decoded_sha256 string, lossless boolean"
    return map_pieces(given, "text", schema, work, TOGETHER).withColumnRenamed("key", key)


def decode_ids(df: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row (key, text): the text of an array of ids; null and empty arrays are empty texts."""
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))
    given = df.select(F.col(key).alias("key"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))
    kind = given.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            column = batch.column("ids")
            flat = column.flatten().to_numpy(zero_copy_only=False)
            at = column.offsets.to_numpy()
            texts = decode(flat, at - at[0], shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=["key", "text"]
            )

    return given.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
