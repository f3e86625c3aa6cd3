"""Near-duplicate documents by bottom-k sketches of their word shingles.

One hash function orders all shingles; the k lowest of a document are its
sketch.  Two documents of Jaccard similarity t share each value of their
union's sketch with probability t, so they share at least ``needed(k, t)`` of
their retained values but for a chance of about 1e-8.  Sets that share that
many must share one among the rarest k - needed + 1 of either, whatever the
common order; so inverted lists hold these only, and a passage that stands in
very many documents fills no list.  Overlaps in the lists give candidates, the
sketch of the union filters them, whole shingle sets decide.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.components import for_parts, groups_of_lists, in_parts, shared_lists
from basketry.llm.text import LOWER, U64, Words, map_pieces, mix64, packed, word_ngrams
from basketry.plans.scratch import materialize, passing_tables


def needed(k: int, threshold: float) -> int:
    """Retained values that a pair at ``threshold`` shares, nearly surely, out of k."""
    return max(1, int(k * threshold - 5.8 * math.sqrt(k * threshold * (1 - threshold))))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (63 bits) of each text, A-Z lower-cased.

    A text of fewer words than ``size`` has its whole sequence as one shingle,
    one without words an empty set.
    """
    buf, at = packed(texts)
    words = Words(LOWER[buf], at)
    grams, first = word_ngrams(words, size)
    bounds = np.searchsorted(words.doc[first], np.arange(len(at)))
    grams = (grams >> U64(1)).view(np.int64)
    sets = []
    for d in range(len(at) - 1):
        low, high = words.first[d], words.first[d + 1]
        if high - low >= size:
            sets.append(np.unique(grams[bounds[d] : bounds[d + 1]]))
        elif high > low:
            code = np.zeros(1, U64)
            for h in words.hash[low:high]:
                code = mix64(code ^ h, int(high - low))
            sets.append((code >> U64(1)).view(np.int64))
        else:
            sets.append(np.empty(0, np.int64))
    return sets


def set_code(values: np.ndarray) -> int:
    """64-bit code of a set of shingles; equal sets have equal codes."""
    total = mix64(values.view(U64), 5).sum(dtype=U64)
    return int(mix64(np.array([total ^ U64(len(values))]), 6).view(np.int64)[0])


def row_code(key: str, text: str) -> Column:
    """Code of a row by its key and text."""
    return F.xxhash64(F.col(key), F.col(text))


def _lists(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))


def sketches(df: DataFrame, key: str, text: str, k: int, size: int) -> DataFrame:
    """(key, row, n, code, sketch) per row; ``code`` stands for the whole set and is null for an empty one."""

    def work(piece):
        sets = shingle_sets(piece.column("text"), size)
        return {
            "key": piece.column("key"),
            "row": piece.column("row"),
            "n": [len(s) for s in sets],
            "code": [set_code(s) if len(s) else None for s in sets],
            "sketch": _lists([s[:k] for s in sets]),
        }

    given = df.select(F.col(key).alias("key"), F.col(text).alias("text"), row_code(key, text).alias("row"))
    kind = given.schema["key"].dataType.simpleString()
    return map_pieces(given, "text", f"key {kind}, row bigint, n bigint, code bigint, sketch array<bigint>", work)


def whole_sets(df: DataFrame, text: str, size: int) -> DataFrame:
    """(code, shingles) per row, one for each code."""

    def work(piece):
        sets = [s for s in shingle_sets(piece.column("text"), size) if len(s)]
        return {"code": [set_code(s) for s in sets], "shingles": _lists(sets)}

    rows = map_pieces(df.select(F.col(text).alias("text")), "text", "code bigint, shingles array<bigint>", work)
    return rows.groupBy("code").agg(F.first("shingles").alias("shingles"))


def rare_lists(classes: DataFrame, k: int, threshold: float) -> DataFrame:
    """Inverted lists (value, code, n) of each sketch's rarest values, those in one sketch only left out.

    ``classes`` has (code, n, sketch) and is read several times.  A set whose possible partners all have
    complete sketches must share ``threshold`` of its own values.
    """
    values = classes.select("code", "n", F.size("sketch").alias("held"), F.explode("sketch").alias("value"))
    own = in_parts(values).groupBy("code", "n", "held").agg(F.collect_list(F.struct("length", "value")).alias("v"))
    least = F.when(F.col("n") <= int(k * threshold), F.ceil(F.col("n") * threshold)).otherwise(F.lit(needed(k, threshold)))
    alone = F.col("held") - F.size("v")
    take = F.greatest(F.col("held") - least + 1 - alone, F.lit(0)).cast("int")
    prefix = F.slice(F.sort_array("v"), F.lit(1), take)
    return own.select("code", "n", F.explode(prefix).alias("x")).select(F.col("x.value").alias("value"), "code", "n")


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose sketches allow ``percent``, and whose whole sets reach it.

    Sketches of sets of at most ``k`` shingles are the sets, so what they share
    is exact; else the sketch of the union is a sample of it.
    """
    side = lambda name: classes.select(F.col("code").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.array_intersect("s_a", "s_b")
    sketch = F.slice(F.sort_array(F.array_union("s_a", "s_b")), 1, k)  # of the union
    whole = F.size(shared) * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))
    least = needed(k, percent / 100)
    sampled = (F.size(shared) >= least) & (F.size(F.array_intersect(sketch, shared)) >= least)
    near = near.where(F.when(F.greatest("n_a", "n_b") <= k, whole).otherwise(sampled)).select("a", "b", "n_a", "n_b")
    full = lambda name: sets.select(F.col("code").alias(name), F.col("shingles").alias(f"w_{name}"))
    done = near.join(full("a"), "a").join(full("b"), "b")
    return done.where(F.size(F.array_intersect("w_a", "w_b")) * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, k: int = 64, size: int = 5) -> DataFrame:
    """Per row (key, n_shingles, component_id, kept, group, row): its group of near copies.

    Rows are linked if 100 * shared shingles >= ``percent`` * all shingles of
    the two; ``component_id`` is the smallest key reachable over links, the row
    itself included, and ``kept`` whether that is the row's own.  ``group`` is a
    code of the group, ``row`` the row's ``row_code``.  Rows of one
    shingle set are one node; see ``groups_of_lists`` for which pairs are
    compared.  No link that would join two groups is left out.

    Null and empty texts, and texts without words, have no shingles and are
    groups of their own.  Null keys count as larger than all others; a group of
    null keys only has a null ``component_id`` and is kept.  Repeated rows are
    in one group; rows of the smallest key are all kept.  An empty table gives
    no rows.  Other columns are not read.
    """
    with passing_tables(df.sparkSession):  # sketches, lists and sets, several times as large as the rows
        found = materialize(sketches(df, key, text, k, size), "sketches")
        rows = materialize(found.select("key", "row", "n", "code"), "rows", lasting=True)
        groups = materialize(_groups(df, found, key, text, percent, k, size), "groups", lasting=True)
    out = _named(rows, groups)
    return out.select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.col("_id").alias("component_id"),
        F.col("key").eqNullSafe(F.col("_id")).alias("kept"),
        F.col("label").alias("group"),
        "row",
    )


def _groups(df: DataFrame, rows: DataFrame, key: str, text: str, percent: int, k: int, size: int) -> DataFrame:
    """(node, component) of the codes that are linked with others; ``rows`` are the sketches of ``df``."""
    classes = rows.where("code IS NOT NULL").groupBy("code").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialize(classes, "classes")
    lists = shared_lists(rare_lists(classes, k, percent / 100))
    met = lists.select("code").distinct()
    classes = materialize(classes.join(met, "code", "left_semi"), "met-classes")
    reps = rows.groupBy("code").agg(F.min("key").alias("rep")).join(met, "code", "left_semi").select("rep").distinct()
    texts = df.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    texts = texts.join(reps, texts["_key"].eqNullSafe(reps["rep"]), "left_semi")
    sets = materialize(whole_sets(texts, "text", size).join(met, "code", "left_semi"), "whole-sets")
    return groups_of_lists(lists, lambda pairs: confirmed(pairs, classes, sets, k, percent), percent, sets)


def _named(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with the ``label`` of their group and ``_id``, its smallest key; rows without a code are groups of their own.

    One code, and one label, may hold very many rows: both are dealt over parts.
    """
    dealt = in_parts(rows, "code", "row", least=1)
    owns = dealt.groupBy("code").agg(F.min("key").alias("own"), F.first("parts").alias("copied"))
    owns = owns.join(groups, owns["code"] == groups["node"], "left")
    owns = owns.select("code", "own", "copied", F.coalesce("component", "code").alias("label"))
    labelled = in_parts(materialize(owns, "labels"), "label", "code", least=1)
    lowest = for_parts(labelled.groupBy("label").agg(F.min("own").alias("_id"), F.first("parts").alias("parts"))).drop("parts")
    found = labelled.join(lowest, ["label", "part"]).select("code", "label", "_id", F.col("copied").alias("parts"))
    coded = dealt.join(for_parts(found).drop("parts"), ["code", "part"]).select("key", "row", "n", "label", "_id")
    alone = rows.where("code IS NULL").select("key", "row", "n", F.col("row").alias("label"), F.col("key").alias("_id"))
    return coded.unionByName(alone)


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of ``df``, one of each group: that of the smallest key; of several such, one by a hash of its text."""
    found = near_duplicates(df, key, text, **options)
    order = F.struct(F.col(key).isNull(), F.col(key), F.col("row"))
    first = found.groupBy("group").agg(F.min_by("row", order).alias("_row")).select("_row").distinct()
    return df.withColumn("_row", row_code(key, text)).join(first, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")
