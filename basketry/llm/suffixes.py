"""Repeated passages: bytes covered by a string of ``LENGTH`` bytes that also starts earlier.

The start positions of all strings are sampled, the samples sorted by name, the
names compared with their neighbours, and the remaining positions merged in
where names leave the answer open.

* **Sample.** A cover by position (every start modulo 3, or a sparser
  difference cover) would send at least one row for each seventh byte through
  the sort; README gives computed sizes, none was run.  The cover here is taken from the
  text itself: of the grams of ``GRAM`` bytes in a string, the one of lowest
  hash, the leftmost on a tie.  Equal strings have it at equal places, and
  neighbouring strings share it, so one sample in about 35 bytes covers all.
* **Names.** A sample's name stands for the bytes of all strings that it covers,
  and is sorted with the gram first.  Equal neighbours are repeats in full, all
  but the first, and one comparison settles about 35 strings.
* **Remaining.** Where one gram has several names, strings may agree in part.
  Only these strings are named one by one and sorted in the same way.

Names are 64-bit hashes.  Samples and strings repeated within a task's piece are
settled there, so a name that a third of all documents holds sends a row for each
piece, and a gram a few rows.  What was settled leaves in the same pass as the
rest: a second pass may find other pieces.

The samples whose strings are to be named are a table, gathered per text and
joined to the texts, so the strings named are in proportion to them at any size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.text import BYTE_CODE, U64, map_pieces, mix64, packed
from basketry.plans.scratch import materialize

LENGTH = 100
GRAM = 32
BLOCK = 64
#: bits of a sampling key that hold the position in a piece
POSITION = U64((1 << 31) - 1)
#: names of one gram that a piece sends to be compared; the samples of further ones are opened at once
NAMES_SENT = 8


def block_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the GRAM and of the BLOCK bytes from each position, as far as they lie in ``buf``."""
    h, size, gram = BYTE_CODE[buf], 1, None
    while size < BLOCK:
        if len(h) <= size:
            return (gram if gram is not None else h[:0]), h[:0]
        wide = h[:-size] * U64(0x9FB21C651E98DF25)
        wide += h[size:]
        wide ^= wide >> U64(29)
        h, size = wide, 2 * size
        if size == GRAM:
            gram = mix64(h, 61)
    return gram, h


class Samples:
    """The sampled positions of packed texts and the strings they cover.

    Sample k covers the strings that start at ``low[k]`` to ``high[k]``.
    """

    def __init__(self, buf: np.ndarray, at: np.ndarray):
        self.block = None
        self.low = self.high = self.doc = np.empty(0, np.int64)
        self.gram = self.name = np.empty(0, U64)
        n = len(buf)
        if n < LENGTH:
            return
        gram, self.block = block_hashes(buf)
        key = (gram & ~POSITION) | np.arange(len(gram), dtype=U64)
        span, size = LENGTH - GRAM + 1, 1  # grams in a string
        while 2 * size <= span:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        lowest = np.minimum(key[: n - LENGTH + 1], key[span - size : span - size + n - LENGTH + 1])
        last = np.repeat(at[1:], np.diff(at))[: n - LENGTH + 1]
        starts = np.flatnonzero(np.arange(n - LENGTH + 1) + LENGTH <= last)
        if not len(starts):
            return
        place = (lowest[starts] & POSITION).astype(np.int64)
        fresh = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (np.diff(starts) != 1))))
        self.low = starts[fresh]
        self.high = starts[np.concatenate((fresh[1:], [len(starts)])) - 1]
        self.doc = np.searchsorted(at, self.low, "right") - 1
        self.gram = gram[place[fresh]]
        # all bytes of the covered strings, at most 168, lie in three blocks
        end = self.high + LENGTH - BLOCK
        parts = (self.low, (self.low + end) // 2, end)
        name = (self.high - self.low).astype(U64)
        for part in parts:
            name = mix64(name ^ self.block[part], 62)
        self.name = name


def _later(gram: np.ndarray, name: np.ndarray, doc: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Whether a sample's name stands at a smaller (doc, low) in the same arrays."""
    order = np.lexsort((low, doc, name, gram))
    g, n, d, l = gram[order], name[order], doc[order], low[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (n[1:] != n[:-1])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    out = np.empty(len(order), bool)
    out[order] = (d != d[first]) | (l != l[first])
    return out


#: a null document is later than all
NO_DOC = np.iinfo(np.int64).max


def _piece(piece: pa.RecordBatch):
    buf, at = packed(piece.column("text"))
    samples = Samples(buf, at)
    doc = piece.column("doc").fill_null(NO_DOC).to_numpy()[samples.doc]
    row = piece.column("row").to_numpy()[samples.doc]
    low = samples.low - at[samples.doc]
    return samples, doc, row, low


ROWS = "gram bigint, name bigint, doc bigint, row bigint, low int, more int"


def _rows(gram, name, doc, row, owner, low, high, on, off, opened=None) -> dict:
    """ROWS of the samples ``on`` as they are, and of ``off`` and ``opened`` with a null name.

    Samples of ``off`` that cover neighbouring strings of one ``owner`` are one row.
    ``more`` of those ``opened`` is -1 less what it was.
    """
    on, off = np.flatnonzero(on), np.flatnonzero(off)
    opened = np.flatnonzero(opened) if opened is not None else off[:0]
    fresh = np.ones(len(off), bool)
    fresh[1:] = (np.diff(off) != 1) | (owner[off[1:]] != owner[off[:-1]]) | (low[off[1:]] != high[off[:-1]] + 1)
    begin = off[fresh]
    end = off[np.append(np.flatnonzero(fresh)[1:], len(off)) - 1] if len(off) else off
    alone = np.concatenate((begin, opened))
    both = np.concatenate((on, alone))
    more = np.concatenate((high[on], high[end], high[opened])) - low[both]
    more[len(both) - len(opened) :] = -1 - more[len(both) - len(opened) :]
    return {
        "gram": np.concatenate((gram[on], _sample_code(row[alone], low[alone]))).view(np.int64),  # deals them evenly
        "name": pa.array(name[both].view(np.int64), mask=np.arange(len(both)) >= len(on)),
        "doc": doc[both],
        "row": row[both],
        "low": low[both].astype(np.int32),
        "more": more.astype(np.int32),
    }


def _beyond(gram: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Whether a sample's name is not one of the NAMES_SENT lowest of its gram in the same arrays."""
    order = np.lexsort((name, gram))
    g, n = gram[order], name[order]
    new_gram = np.ones(len(order), bool)
    new_gram[1:] = g[1:] != g[:-1]
    new_name = new_gram.copy()
    new_name[1:] |= n[1:] != n[:-1]
    number = np.cumsum(new_name)
    number -= number[np.maximum.accumulate(np.where(new_gram, np.arange(len(order)), 0))]
    out = np.empty(len(order), bool)
    out[order] = number >= NAMES_SENT
    return out


def sampled(given: DataFrame) -> DataFrame:
    """Samples of all texts, the first of each name in its piece; the others are settled.

    Settled samples side by side are one row: a null name, and all their starts.
    Of a gram with more than NAMES_SENT names in the piece only so many are
    sent, which show that it has several; the others are opened as they are:
    a null name, and a negative ``more``.  So a piece sends a bounded number of
    rows for each gram, however common that is.
    """

    def work(piece):
        s, doc, row, low = _piece(piece)
        later = _later(s.gram, s.name, doc, low)
        opened = ~later
        opened[opened] = _beyond(s.gram[opened], s.name[opened])
        return _rows(s.gram, s.name, doc, row, s.doc, low, low + s.high - s.low, ~later & ~opened, later, opened)

    return map_pieces(given, "text", ROWS, work)


def compared(rows: DataFrame) -> DataFrame:
    """(open, gram, name, doc, row, low, more): sorted by name and compared with the neighbours before.

    A row that repeats an earlier one of its name comes with ``open`` false.
    The first of a name comes with ``open`` true if its gram has other names;
    else it is left out.  Rows of a null name are not compared: they come with
    ``open`` false as they are, or with ``open`` true if ``more`` is negative.
    """
    dealt = rows.repartition("gram").sortWithinPartitions("gram", "name", "doc", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the open gram's firsts; ``told`` if they have been given out
        for batch in batches:
            settled = batch.column("name").is_null()
            if batch.column("name").null_count:
                done = batch.filter(settled)
                more = done.column("more").to_numpy()
                columns = [*done.columns[:-1], pa.array(np.where(more < 0, -1 - more, more).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(more < 0), *columns], names=["open", *done.schema.names])
                batch = batch.filter(pc.invert(settled))
            if not batch.num_rows:
                continue
            table = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            table["told"] = np.zeros(batch.num_rows, bool)
            if held is not None:
                table = {n: np.concatenate((held[n], c)) for n, c in table.items()}
            made, held = _compare(table, len(held["gram"]) if held is not None else 0, False)
            yield made
        if held is not None:
            yield _compare(held, len(held["gram"]), True)[0]

    return dealt.mapInArrow(run, f"open boolean, {ROWS}")


def _compare(t: dict[str, np.ndarray], n_held: int, end: bool) -> tuple[pa.RecordBatch, dict[str, np.ndarray]]:
    n = len(t["gram"])
    new_gram = np.ones(n, bool)
    new_gram[1:] = t["gram"][1:] != t["gram"][:-1]
    new_name = new_gram.copy()
    new_name[1:] |= t["name"][1:] != t["name"][:-1]
    first = np.maximum.accumulate(np.where(new_name, np.arange(n), 0))
    repeat = (t["doc"] != t["doc"][first]) | (t["low"] != t["low"][first])
    repeat[:n_held] = False
    group = np.cumsum(new_gram) - 1
    names = np.bincount(group[new_name], minlength=group[-1] + 1 if n else 0)
    several = names[group] > 1
    last = group == group[-1] if not end else np.zeros(n, bool)  # may go on in the next batch
    give = several & ~repeat & ~t["told"]
    t["told"] = t["told"] | give
    out = repeat | give
    columns = ("gram", "name", "doc", "row", "low", "more")
    made = pa.RecordBatch.from_arrays(
        [pa.array(give[out]), *[pa.array(t[c][out]) for c in columns]], names=["open", *columns]
    )
    # of the last gram: all firsts while it has one name, then those of its last name and one more
    keep = last & ~repeat
    if keep.any() and names[group[-1]] > 1:
        final = keep & (np.arange(n) >= first[-1])
        other = np.flatnonzero(keep & ~final)[:1]
        keep = final
        keep[other] = True
    return made, {c: v[keep] for c, v in t.items()}


def _sample_code(row: np.ndarray, low: np.ndarray) -> np.ndarray:
    return mix64(row.view(U64) ^ mix64(low.astype(np.int64), 65), 66)


def _spread(piece: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans in a list column: row of each, its ``low`` and its ``more``."""
    spans = piece.column(column)
    many = pc.fill_null(pc.list_value_length(spans), 0).to_numpy()
    flat = spans.flatten()
    low, more = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("low", "more"))
    return np.repeat(np.arange(len(many)), many), low, more


def opened_strings(texts: DataFrame) -> DataFrame:
    """The strings that start in ``spans`` of (doc, text, row, spans), each as a sample of its own.

    Only the bytes of the spans are read.  A string that repeats one of its
    piece is settled there.
    """

    def work(piece):
        buf, at = packed(piece.column("text"))
        doc, row = piece.column("doc").fill_null(NO_DOC).to_numpy(), piece.column("row").to_numpy()
        owner, low, more = _spread(piece, "spans")
        order = np.lexsort((low, owner))
        owner, low, more = owner[order], low[order], more[order]
        # spans whose bytes meet are read as one run
        fresh = np.ones(len(low), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (low[1:] > (low + more)[:-1] + LENGTH)
        run = np.flatnonzero(fresh)
        end = np.append(run[1:], len(low)) - 1
        size = low[end] + more[end] + LENGTH - low[run]
        head = np.cumsum(size) - size
        total = int(size.sum())
        _, block = block_hashes(buf[np.arange(total) + np.repeat(at[owner[run]] + low[run] - head, size)])
        number = np.cumsum(fresh) - 1
        begin = head[number] + low - low[run[number]]
        order = np.lexsort((low, doc[owner]))  # mostly earlier strings first
        owner, low, begin, n = owner[order], low[order], begin[order], more[order] + 1
        which = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        start = begin[which] + step
        name = mix64(mix64(block[start], 63) ^ block[start + LENGTH - BLOCK], 64)
        which, place = owner[which], low[which] + step
        order = np.argsort(name, kind="stable")
        fresh = np.ones(len(order), bool)
        fresh[1:] = name[order[1:]] != name[order[:-1]]
        first = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
        d, d_first = doc[which[order]], doc[which[first]]
        later = np.empty(len(order), bool)
        later[order] = (d > d_first) | (d == d_first) & (place[order] > place[first])
        return _rows(name, name, doc[which], row[which], which, place, place, ~later, later)

    return map_pieces(texts, "text", ROWS, work)


def repeated_starts(texts: DataFrame) -> DataFrame:
    """Per ``row`` of (doc, text, row, ...) its repeated starts: (row, starts).

    ``starts`` are structs of a first start, ``low``, and of how many further
    starts follow it, ``more``.  ``texts`` is dealt by ``row`` with all its
    columns, so that a caller who joins the result to it needs no second exchange.
    """
    found = materialize(compared(sampled(texts.select("doc", "text", "row"))), "repeated-samples")
    span = F.struct("low", "more")
    spans = found.where("open").groupBy("row").agg(F.collect_set(span).alias("spans"))
    strings = compared(opened_strings(texts.join(spans, "row")))
    columns = ["row", "low", "more"]
    starts = found.where("NOT open").select(*columns).union(strings.select(*columns))
    return starts.groupBy("row").agg(F.collect_set(span).alias("starts"))


def _cut(raw: bytes, low: np.ndarray, more: np.ndarray) -> tuple[bytes, int]:
    """Bytes outside all strings that start at ``low`` and the ``more`` places after, and the number of removed runs."""
    if not len(low):
        return raw, 0
    n = len(raw) + 1
    change = np.bincount(low, minlength=n) - np.bincount(low + more + LENGTH, minlength=n)
    gone = np.cumsum(change[:-1]) > 0
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), spans


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row (key, n_bytes, n_removed, n_spans, kept_sha256, kept_text, row): its text without repeated passages.

    Texts are UTF-8 bytes.  Every byte covered by a string of ``LENGTH`` bytes
    that also starts earlier is removed: in a row of a smaller key, or of the
    same key at a smaller place.  Strings do not cross texts, are judged on
    the texts as given, and may overlap.  ``kept_text`` leaves out the parts of
    characters that were cut; columns of ``keep`` are carried in the struct ``row``.

    Null and short texts have nothing removed.  Keys are integers; null keys are
    one, later than all others.  Rows of one key do not precede each other at
    equal places, so repeated rows give equal results.  An empty table gives no
    rows.  Other columns are not read.
    """
    texts = df.select(
        F.col(key).cast("bigint").alias("doc"),
        F.col(text).alias("text"),
        F.xxhash64(F.col(key), F.col(text)).alias("row"),
        F.col(key).alias("key"),
        (F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("boolean")).alias("kept"),
    )
    if re.search("Exchange|RDD", df._jdf.queryExecution().executedPlan().toString()):
        texts = materialize(texts, "texts")  # a task run again may get its rows in another order, and cut other pieces
        texts = texts.where("row IS NOT NULL")  # as the inner join asks, so that both joins read one exchange
    both = texts.join(repeated_starts(texts), "row", "left")
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    schema = (
        f"key {kinds['key']}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
        f"kept_text string, row {kinds['kept']}"
    )

    def work(piece):
        texts = [(t or "").encode() for t in piece.column("text").to_pylist()]
        owner, low, more = _spread(piece, "starts")
        at = np.searchsorted(owner, np.arange(len(texts) + 1))
        cut = [_cut(raw, low[a:b], more[a:b]) for raw, a, b in zip(texts, at[:-1], at[1:])]
        return {
            "key": piece.column("key"),
            "n_bytes": [len(raw) for raw in texts],
            "n_removed": [len(raw) - len(left) for raw, (left, _) in zip(texts, cut)],
            "n_spans": [n for _, n in cut],
            "kept_sha256": [hashlib.sha256(left).hexdigest() for left, _ in cut],
            "kept_text": [left.decode("utf-8", "ignore") for left, _ in cut],
            "row": piece.column("kept"),
        }

    return map_pieces(both, "text", schema, work).withColumnRenamed("key", key)
