"""The index of items to baskets as blocks of bits, and supports by their intersection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.itemsets import canonical
from basketry.operators.baskets import distinct_items
from basketry.plans.scratch import materialize, materialize_with

BYTES = 4096  # of a block, as ``bitmap_construct_agg`` makes them


def vertical_bitmap(baskets: DataFrame, tid: str | Sequence[str] = "tid") -> DataFrame:
    """Item to transactions, a bit each: (item, block, bits, n).

    A block stands for 32,768 whole-number ids (``assign_tids`` makes such ids),
    so no row or group grows with an item's frequency.  ``bits`` has 4 KB and
    mostly zeros for a rare item, which Parquet's compression takes out again.
    Rows, not bits, are exchanged: of a rare item each task would have a block of
    its own.  A row of a few bytes becomes up to 4 KB, so the tasks that make the
    bits are as many as the session's shuffle partitions, however few bytes they
    read.  Null items and ids are left out, repeats count once.
    """
    rows = distinct_items(baskets, tid).withColumn("block", F.bitmap_bucket_number("tid"))
    parts = int(baskets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = rows.repartition(parts, "item", "block").groupBy("item", "block")
    bits = blocks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("tid")).alias("bits"))
    return bits.select("item", "block", "bits", F.bitmap_count("bits").alias("n"))


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (block, item, ids): a list of places where that is shorter than the bits."""
    for batch in batches:
        ids = []
        for bits, n in zip(batch.column("bits"), batch.column("n").to_pylist()):
            bits = np.frombuffer(bits.as_buffer(), np.uint8)
            few = 2 * n < BYTES
            ids.append((np.flatnonzero(np.unpackbits(bits, bitorder="little")).astype(np.uint16) if few else bits).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("block"), batch.column("item"), pa.array(ids, pa.binary())], ["block", "item", "ids"]
        )


def _common(parts: list[bytes]) -> int:
    """How many ids all of ``parts`` hold, lists of places or bits."""
    bits = [np.frombuffer(p, np.uint64) for p in parts if len(p) == BYTES]
    lists = [np.frombuffer(p, np.uint16) for p in sorted(parts, key=len) if len(p) < BYTES]
    if not lists:
        return int(np.bitwise_count(reduce(np.bitwise_and, bits)).sum())
    left = reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), lists)
    for one in bits:
        left = left[(one.view(np.uint8)[left >> 3] >> (left & 7).astype(np.uint8)) & 1 == 1]
    return len(left)


def _held_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of ids that hold all items of a set (set, n), from rows sorted by block, items first and then sets."""
    block, items = None, {}
    for batch in batches:
        sets, counts = [], []
        kind = batch.schema.field("set").type
        columns = (batch.column(name).to_pylist() for name in ("block", "item", "ids", "set"))
        for number, item, ids, asked in zip(*columns):
            if number != block:
                block, items = number, {}
            if asked is None:
                items[item] = ids
                continue
            parts = [items.get(x) for x in asked]
            if None not in parts:
                sets.append(asked)
                counts.append(_common(parts))
        yield pa.RecordBatch.from_arrays([pa.array(sets, kind), pa.array(counts, pa.int64())], ["set", "n"])


def itemset_support_bitmap(index: DataFrame, itemsets: DataFrame) -> DataFrame:
    """Support of each given itemset (array column ``items``) from a ``vertical_bitmap``, 0 if absent.

    An itemset can only occur in the blocks of its rarest item; these are listed
    without their bits.  The blocks of all items that are asked for are dealt by
    block, each once however many itemsets need it and with few ids as a list,
    and the sets of a block follow its items.  So no bits are copied for a set,
    and a task holds the ids of one block, that is of 32,768 baskets, at a time.

    Order, repeats and nulls in a given itemset do not matter; the result has it
    as it was given, once.  The empty set is in every basket.
    """
    given = itemsets.select("items").distinct().withColumn("set", canonical("items"))
    given, seen = materialize_with(given, "sets", F.count_if(F.size("set") == 0).alias("empty"))
    sets = given.select("set").where(F.size("set") > 0).distinct()
    wanted = sets.select("set", F.explode("set").alias("item"))
    supports = index.groupBy("item").agg(F.sum("n").alias("support"))
    anchors = (
        wanted.join(supports, "item")
        .groupBy("set")
        .agg(F.min(F.struct("support", "item"))["item"].alias("item"), F.count("*").alias("known"))
        .where(F.col("known") == F.size("set"))
        .select("set", "item")
    )
    places = anchors.join(index.select("item", "block"), "item").select("block", "set")
    held = index.join(wanted.select("item").distinct(), "item", "left_semi").select("block", "item", "bits", "n")
    kind = sets.schema["set"].dataType.elementType.simpleString()
    held = held.mapInArrow(_short, f"block bigint, item {kind}, ids binary")
    both = held.unionByName(places, allowMissingColumns=True).select("block", "item", "ids", "set")
    both = both.repartition("block").sortWithinPartitions("block", F.col("set").isNotNull())
    counts = both.mapInArrow(_held_together, f"set array<{kind}>, n bigint")
    counts = counts.groupBy("set").agg(F.sum("n").alias("support"))
    if seen["empty"]:
        every = index.groupBy("block").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
        every = every.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("support"))
        empty = given.where(F.size("set") == 0).select("set").distinct()
        counts = counts.unionByName(empty.crossJoin(every))  # one row by one row
    return given.join(counts, "set", "left").select(
        "items", F.coalesce("support", F.lit(0)).cast("bigint").alias("support")
    )


def store_bitmap(baskets: DataFrame, tid: str | Sequence[str] = "tid") -> DataFrame:
    """A ``vertical_bitmap`` written once, as a look-up reads it three times."""
    return materialize(vertical_bitmap(baskets, tid), "bitmap")
