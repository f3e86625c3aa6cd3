"""Document fingerprints by a randomised embedding of edit distance into Hamming distance.

A walker reads a text from its first character; at each step it writes the
character it stands on and then moves on by one or stays, as a random bit for
(step, character) says.  All texts share these bits.  After an edit two walkers
fall into step again soon, so a small edit distance becomes a small Hamming
distance between what is written.  A fingerprint keeps the written characters,
as 4-bit codes, at fixed random steps: ``SAMPLES`` in each of the step ranges
[0, 64), [64, 128), [128, 256) ... up to the end of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from basketry.llm.components import groups_of_lists, shared_lists
from basketry.llm.text import U64, map_pieces, mix64
from basketry.plans.scratch import materialize

SAMPLES = 32
FIRST_RANGE = 64
#: texts of one walk together; a longer text walks alone
BATCH_CHARS = 8 << 20
CODES = np.frombuffer(b"0123456789abcdef", np.uint8)
END = ord("_")
#: the bits of (step, character class) are one table's exclusive-or another's; the lengths are different primes
_moves_a = (mix64(np.arange(4093 * 256), 31) >> U64(63)).astype(np.uint8).reshape(-1, 256)
_moves_b = (mix64(np.arange(4099 * 256), 32) >> U64(63)).astype(np.uint8).reshape(-1, 256)
_moves_a[:, 0] = _moves_b[:, 0] = 0  # a walker stays at the end of its text
#: walkers that have ended are dropped every so many steps
SWEEP = 512


def sample_steps(level: int) -> np.ndarray:
    """Sorted steps kept in range number ``level``."""
    low, high = (0, FIRST_RANGE) if level == 0 else (FIRST_RANGE << (level - 1), FIRST_RANGE << level)
    order = np.argsort(mix64(np.arange(SAMPLES * 4), 40 + level))  # of equal parts of the range
    return np.sort(low + (high - low) * order[:SAMPLES] // (SAMPLES * 4))


def classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes 1 to 255 of all texts, a 0 after each, and where each text starts."""
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.concatenate(([0], np.cumsum(size + 1)))
    code = points * np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(16)
    out = (code % np.uint32(255) + np.uint32(1)).astype(np.uint8)
    out[start[1:] - 1] = 0
    return out, start


def embed(texts: list[str]) -> list[str]:
    """Fingerprint of each text; an empty text has an empty one."""
    made: list[str | None] = [None] * len(texts)
    order = sorted(range(len(texts)), key=lambda d: -len(texts[d]))
    low = 0
    while low < len(order):
        high, chars = low, 0
        while high < len(order) and (high == low or chars + len(texts[order[high]]) <= BATCH_CHARS):
            chars += len(texts[order[high]])
            high += 1
        for d, print_ in zip(order[low:high], _walk([texts[d] for d in order[low:high]])):
            made[d] = print_
        low = high
    return made


def _walk(texts: list[str]) -> list[str]:
    buf, start = classes(texts)
    at = start[:-1].astype(np.int32 if len(buf) < 1 << 31 else np.int64)
    live = np.flatnonzero(buf[at])
    at = at[live]
    kept = [[] for _ in texts]  # written codes, by range
    level, step = 0, 0
    while len(live):
        steps = sample_steps(level)
        rows = np.zeros((SAMPLES, len(live)), np.uint8)
        walker = np.arange(len(live))  # column of ``rows``
        last = FIRST_RANGE << level
        due, row = steps[0], 0
        while step < last and len(at):
            here = buf[at]
            while step == due:
                rows[row, walker] = here
                row += 1
                due = steps[row] if row < SAMPLES else -1
            at += (_moves_a[step % 4093] ^ _moves_b[step % 4099])[here]
            step += 1
            if step % SWEEP == 0 or step == last:
                on = buf[at] > 0
                at, walker = at[on], walker[on]
        step = last
        written = np.where(rows > 0, CODES[(rows * np.uint8(151)) >> 4], END).astype(np.uint8).T
        for k, d in enumerate(live):
            kept[d].append(written[k].tobytes())
        live = live[walker]
        level += 1
    return [b"".join(x).decode() for x in kept]


def likeness(a: str, b: str) -> float:
    """Share of equal characters at equal steps, 0 to 1, estimated from two fingerprints.

    Ranges weigh as their lengths.  Steps after the end of both texts do not
    count; two empty fingerprints are equal.
    """
    if a == b:
        return 1.0
    levels = max(len(a), len(b)) // SAMPLES
    x = np.frombuffer(a.encode().ljust(levels * SAMPLES, b"_"), np.uint8).reshape(levels, SAMPLES)
    y = np.frombuffer(b.encode().ljust(levels * SAMPLES, b"_"), np.uint8).reshape(levels, SAMPLES)
    weight = np.ones(levels) if levels < 2 else np.concatenate(([1.0], 2.0 ** np.arange(levels - 1)))
    counts = ((x != END) | (y != END)).sum(axis=1) @ weight
    equal = ((x == y) & (x != END)).sum(axis=1) @ weight
    return float(equal / counts) if counts else 1.0


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row (key, n_chars, fingerprint); a null text is an empty one, repeated rows stay."""
    given = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = given.schema["key"].dataType.simpleString()

    def work(piece):
        texts = [t or "" for t in piece.column("text").to_pylist()]
        return {"key": piece.column("key"), "n_chars": [len(t) for t in texts], "fingerprint": embed(texts)}

    made = map_pieces(given, "text", f"key {kind}, n_chars bigint, fingerprint string", work)
    return made.withColumnRenamed("key", key)


def near_groups(prints: DataFrame, key: str = "doc_id", bands: int = 24, width: int = 8, least: float = 0.75, seed: int = 7) -> DataFrame:
    """Per row (key, group): the smallest key reachable over pairs of a likeness of ``least`` or more.

    ``prints`` has (key, n_chars, fingerprint).  A band is ``width`` written
    characters at steps drawn from the last ranges of the text, which weigh
    most; members of one band are compared as ``groups_of_lists`` says, and
    their likeness decides.  At a likeness of 0.85 a pair shares a band with
    probability 0.999.  Equal fingerprints are one node.  Texts of unequal
    length, by over a third, are not compared.  Rows with an empty fingerprint
    are groups of their own; null keys count as larger than all others.
    """
    rows = prints.select(F.col(key).alias("key"), "n_chars", "fingerprint", F.xxhash64("fingerprint").alias("code"))
    full = rows.where(F.length("fingerprint") > 0)
    nodes = full.groupBy("code").agg(F.first("fingerprint").alias("fingerprint"), F.max("n_chars").alias("n"))

    @F.pandas_udf("array<bigint>")
    def band_codes(column: pd.Series) -> pd.Series:
        return column.map(lambda p: _bands(p, bands, width, seed))

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) for x, y in zip(a, b)], dtype=float)

    nodes = materialize(nodes, "prints")
    lists = shared_lists(nodes.select(F.explode(band_codes("fingerprint")).alias("value"), "code", "n"))
    side = lambda name: nodes.select(F.col("code").alias(name), F.col("fingerprint").alias(f"p_{name}"))

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return both.where(alike("p_a", "p_b") >= least).select("a", "b")

    groups = groups_of_lists(lists, confirm, 75)
    named = rows.join(groups, rows["code"] == groups["node"], "left")
    named = named.select("key", F.when(F.length("fingerprint") > 0, F.coalesce("component", "code")).alias("label"))
    first = named.where("label IS NOT NULL").groupBy("label").agg(F.min("key").alias("first"))
    out = named.join(first, "label", "left")
    return out.select(F.col("key").alias(key), F.when(F.col("label").isNull(), F.col("key")).otherwise(F.col("first")).alias("group"))


def _bands(print_: str, bands: int, width: int, seed: int) -> list[int]:
    """Codes of bands over the last three ranges, and over the last three before the last.

    Texts whose lengths differ little may end in neighbouring ranges.
    """
    levels, out = len(print_) // SAMPLES, []
    raw = np.frombuffer(print_.encode(), np.uint8)
    for top in {levels, max(levels - 1, 1)}:
        low = max(top - 3, 0) * SAMPLES
        size = top * SAMPLES - low
        pick = mix64(np.arange(bands * width), seed) % U64(size)
        chars = raw[low : low + size][pick.astype(np.int64)].reshape(bands, width)
        code = np.zeros(bands, U64)
        for w in range(width):
            code = mix64(code ^ chars[:, w], top)
        out += mix64(code ^ np.arange(bands).astype(U64), 9).view(np.int64).tolist()
    return out


def with_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its fingerprint, that of its edited text, and likenesses to that and to the next row's.

    (key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next).  The next row is the one with the next smaller key, after the
    last the first.  The edited text has the last third of a text's characters,
    rounded down, replaced by as many first ones of the next row's text.

    Rows go to tasks by ranges of the key, in descending order; a range also
    gets the first row of the range after it, so every text moves once and no
    task sees more than its range.  A null text is an empty one; null keys come
    last; rows of one key stand in the order of their texts; a single row is
    its own next; an empty table gives no rows.  Other columns are not read.
    """
    spark = df.sparkSession
    given = df.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    kind = given.schema["key"].dataType.simpleString()
    narrow = given.select("key")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = narrow.agg(F.percentile_approx("key", [k / (tasks + 1) for k in range(1, tasks + 1)], 20 * tasks)).first()[0]
    part = _range_of(F.col("key"), sorted(set(cuts or [])))
    # one small row for each range
    firsts = narrow.groupBy(part.alias("part")).agg(F.max("key").alias("first")).orderBy("part").collect()
    schema = f"key {kind}, " + ", ".join(f"{n} {t}" for n, t in _EDIT_COLUMNS)
    if not firsts:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    first = F.array(*[F.lit(r["first"]) for r in firsts])
    number = F.array(*[F.lit(r["part"]) for r in firsts])
    own = given.withColumns({"part": part, "tail": F.lit(0)})
    place = F.array_position(number, F.col("part")).cast("int")
    earlier = F.element_at(number, F.when(place == 1, len(firsts)).otherwise(place - 1))
    tails = own.where(F.col("key").eqNullSafe(F.element_at(first, place))).withColumns({"part": earlier, "tail": F.lit(1)})
    order = [F.col("part"), F.col("tail"), F.desc_nulls_last("key"), F.col("text")]
    dealt = own.unionByName(tails).repartitionByRange(len(firsts), "part").sortWithinPartitions(*order)
    out = to_arrow_schema(StructType.fromDDL(schema))
    made = dealt.select("key", "text", "part", "tail").mapInArrow(lambda batches: _edited(batches, out), schema)
    return made.withColumnRenamed("key", key)


_EDIT_COLUMNS = [
    ("n_chars", "bigint"),
    ("edited_sha256", "string"),
    ("fingerprint", "string"),
    ("edited_fingerprint", "string"),
    ("near_edited", "double"),
    ("near_next", "double"),
]


def _range_of(key: Column, cuts: list) -> Column:
    """Number of the key's range, counted from the largest keys down; null keys are in the last."""
    if not cuts:
        return F.lit(0)
    above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > key))
    return F.when(key.isNull(), len(cuts)).otherwise(above).cast("int")


class _Row:
    __slots__ = ("key", "text", "part", "print")

    def __init__(self, key, text, part):
        self.key, self.text, self.part, self.print = key, text, part, None


def _edited(batches: Iterator[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in order of (part, tail): each needs the one after it, the last of a part the part's tail."""
    held: list[_Row] = []
    chars, closed = 0, None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in (0, 2, 3)]
        for k, (key, part, tail) in enumerate(zip(*columns)):
            if tail and part == closed:
                continue  # another row of the tail's key
            row = _Row(key, batch.column(1)[k].as_py(), part)
            held.append(row)
            chars += len(row.text)
            if tail:
                closed = part
                yield _judged(held, out)
                held, chars = [], 0
            elif chars > BATCH_CHARS:
                if len(held) > 1:
                    yield _judged(held, out)
                held, chars = held[-1:], 0


def _judged(rows: list[_Row], out: pa.Schema) -> pa.RecordBatch:
    """Results for all rows but the last, which is only looked at."""
    texts = []
    for row, after in zip(rows, rows[1:]):
        n = len(row.text)
        texts.append(row.text[: n - n // 3] + after.text[: n // 3])
    fresh = [r for r in rows if r.print is None]
    prints = embed([r.text for r in fresh] + texts)
    for row, print_ in zip(fresh, prints):
        row.print = print_
    edited = prints[len(fresh) :]
    own = rows[:-1]
    made = [
        [r.key for r in own],
        [len(r.text) for r in own],
        [hashlib.sha256(t.encode()).hexdigest() for t in texts],
        [r.print for r in own],
        edited,
        [likeness(r.print, e) for r, e in zip(own, edited)],
        [likeness(r.print, after.print) for r, after in zip(own, rows[1:])],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, out)], schema=out)
