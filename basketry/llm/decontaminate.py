"""Words of documents that stand inside passages of a benchmark, and texts without them.

All steps are DataFrame functions.  Every item gives its windows of ``n`` words;
the distinct windows are a table that is broadcast, by hash, to the task that
reads a document.  There each run of words is looked up, a hit is verified word
by word, and only hits and one row per document leave the task.  If the windows
outgrow the size that may be broadcast, they are looked up block by block over a
stored copy of the documents; windows of documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.plans.scratch import materialize, materialize_with

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: what ends a word: ASCII but letters and digits
BORDERS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
#: the same as a regular expression's character class
BORDER = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: a word with what stands before it since the last one
PIECE = f"[{BORDER}]*[^{BORDER}]+"

#: bytes of windows that a task may hold: a block is broadcast only below it
BLOCK_BYTES = 64 << 20


def _words(text: str) -> Column:
    """Words of a text, A-Z lower-cased: one look at each character, as a regular expression takes five times as long."""
    spaced = F.translate(F.coalesce(text, F.lit("")), UPPER + BORDERS, LOWER + " " * len(BORDERS))
    return F.array_remove(F.split(spaced, " "), "")


def _places(sizes: Sequence[int]) -> Column:
    """Starts of the runs of each of ``sizes`` words: place from 1 times the number of sizes, plus the size's index."""
    many = len(sizes)

    def starts(index: int, size: int) -> Column:
        last = (F.size("words") - size + 1) * many + index
        return F.when(F.size("words") >= size, F.sequence(F.lit(many + index), last, F.lit(many)))

    none = F.array().cast("array<int>")
    return F.concat(none, *[F.coalesce(starts(index, size), none) for index, size in enumerate(sizes)])


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (hash, size, window, owners), and (owners, items): which items hold them.

    ``owners`` numbers the sets of items; most windows of an item share one.
    """
    words = benchmark.select(F.col(item_id).cast("string").alias("item"), _words(text).alias("words")).where(
        F.size("words") > 0
    )
    sized = words.withColumn("size", F.least(F.size("words"), F.lit(n)))
    at = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at")
    rows = sized.select("item", "words", "size", at).select(
        "item", F.slice("words", F.col("at"), F.col("size")).alias("window")
    )
    held = materialize(rows.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items")), "windows")
    owners = held.select("items").distinct().withColumn("owners", F.monotonically_increasing_id())
    owners = materialize(owners, "owners")
    windows = held.join(owners, "items").select(
        F.xxhash64("window").alias("hash"), F.size("window").alias("size"), "window", "owners"
    )
    return windows, owners


def _look_up(docs: DataFrame, windows: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Hits (row, n_words, at, size, owners, …) and one row without a hit, or more, for each document."""
    many = max(1, len(sizes))
    size = F.get(F.array(*[F.lit(s) for s in sizes]), F.pmod("_place", F.lit(many))) if sizes else F.lit(0)
    seen = docs.select("*", F.explode_outer(_places(sizes)).alias("_place"))
    seen = seen.withColumn("at", F.floor(F.col("_place") / many).cast("int")).withColumn("size", size)
    # outside of a higher-order function this is compiled code
    seen = seen.withColumn("hash", F.xxhash64(F.slice("words", F.col("at"), F.col("size"))))
    known = F.broadcast(windows.select("hash", "window", "owners"))
    # not part of the join: as an equality it would become a key, made for every run
    hit = F.col("window").isNotNull() & (F.slice("words", F.col("at"), F.col("size")) == F.col("window"))
    found = seen.join(known, "hash", "left").withColumn("hit", F.coalesce(hit, F.lit(False)))
    kept = found.where(F.col("hit") | F.col("at").isNull() | (F.col("at") == 1))
    return kept.select(
        "row", "n_words", "kept",
        F.when(F.col("hit"), F.struct("at", "size")).alias("place"),
        F.when(F.col("hit"), F.col("owners")).alias("owners"),
    )


def find_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 10,
    keep: Sequence[str] = (),
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per row of ``df``: (row, n_words, n_hit, spans, items).

    Texts are lower-cased (A-Z) and cut into words of letters, digits and
    characters beyond ASCII.  A window is a run of ``n`` words of an item; an
    item of fewer words, but not none, is one window.  ``spans`` are the maximal
    runs (first, last) of words, counted from 1, inside any occurrence of a
    window, ``n_hit`` the words in them, ``items`` the ids, as strings in order,
    of the items with an occurring window.  ``row`` holds the columns ``keep``.

    A null or empty text has no words and no hit; a null item text no window.
    An item without an id hits, but is not in ``items``; texts under one id are
    one item.  Repeated rows are rows of their own.  An empty benchmark leaves
    all rows without a hit.  Other columns are not read, so their names may
    clash.  One text is handled in one task, whole.
    """
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("string")
    docs = df.select(kept.alias("kept"), F.col(text).alias("_text"))
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    windows, owners = benchmark_windows(benchmark, item_id, item_text, n)
    held = F.sum(F.size("window") * 16 + F.length(F.array_join("window", " ")) + 64).alias("bytes")
    windows, seen = materialize_with(windows, "grams", held, F.collect_set("size").alias("sizes"))
    sizes = sorted(seen["sizes"] or [])
    blocks = 1 + (seen["bytes"] or 0) // block_bytes
    if blocks > 1:
        docs = materialize(docs, "documents")  # so that a row has one number in all passes
    docs = docs.withColumn("words", _words("_text")).withColumn("n_words", F.size("words").cast("bigint"))
    docs = docs.drop("_text")
    passes = [_look_up(docs, windows.where(F.pmod("hash", F.lit(blocks)) == block), sizes) for block in range(blocks)]
    rows = reduce(DataFrame.unionByName, passes).groupBy("row").agg(
        F.first("n_words").alias("n_words"),
        F.first("kept").alias("kept"),
        F.collect_set("place").alias("places"),
        F.collect_set("owners").alias("owners"),
    )
    covered = F.flatten(F.transform("places", lambda p: F.sequence(p["at"], p["at"] + p["size"] - 1)))
    rows = rows.withColumn("hits", F.sort_array(F.array_distinct(covered))).withColumn(
        "spans",
        F.arrays_zip(
            F.filter("hits", lambda x, i: (i == 0) | (F.get("hits", i - 1) < x - 1)).alias("first"),
            F.filter("hits", lambda x, i: F.coalesce(F.get("hits", i + 1) > x + 1, F.lit(True))).alias("last"),
        ),
    )
    owned = rows.select(
        "row", "n_words", "kept", F.size("hits").cast("bigint").alias("n_hit"), "spans", F.explode_outer("owners").alias("_owners")
    )
    # rows without a hit are dealt evenly, should the join need an exchange
    owned = owned.withColumn("_owners", F.coalesce("_owners", -1 - F.pmod("row", F.lit(1 << 20))))
    named = owned.join(owners.withColumnRenamed("owners", "_owners"), "_owners", "left")
    return (
        named.groupBy("row")
        .agg(
            *[F.first(c).alias(c) for c in ("kept", "n_words", "n_hit", "spans")],
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        .select(F.col("kept").alias("row"), "n_words", "n_hit", "spans", "items")
    )


def without_spans(df: DataFrame, text: Column, spans: str, out: str) -> DataFrame:
    """``df`` with ``out``: ``text`` without the words in ``spans`` and what stands before each of them."""
    cut = df.withColumn("_pieces", F.when(F.size(spans) > 0, F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))))
    lows = F.concat(F.array(F.lit(1)), F.transform(spans, lambda s: s["last"] + 1))
    highs = F.concat(F.transform(spans, lambda s: s["first"] - 1), F.array(F.size("_pieces")))
    gaps = F.arrays_zip(lows.alias("low"), highs.alias("high"))
    left = F.flatten(F.transform(gaps, lambda g: F.slice("_pieces", g["low"], g["high"] - g["low"] + 1)))
    rest = F.regexp_extract(text, f"([{BORDER}]*)\\z", 1)
    whole = F.when(F.size(spans) > 0, F.concat(F.array_join(left, ""), rest)).otherwise(text)
    return cut.withColumn(out, whole).drop("_pieces")


def remove_leaks(df: DataFrame, benchmark: DataFrame, how: str = "spans", text: str = "text", **options) -> DataFrame:
    """Rows of ``df`` without what they share with the benchmark, columns unchanged.

    ``how="spans"`` cuts the words that ``find_leaks`` marks out of the texts,
    ``how="documents"`` drops the rows that have any.  Null texts stay.
    """
    if how not in ("spans", "documents"):
        raise ValueError("how must be 'spans' or 'documents'")
    found = find_leaks(df, benchmark, text, keep=df.columns, **options)
    if how == "documents":
        return found.where("n_hit = 0").select("row.*")
    cut = without_spans(found, F.col("row")[text], "spans", "_text")
    return cut.select(*[F.col("_text").alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns])
