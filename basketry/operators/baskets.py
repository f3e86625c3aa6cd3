"""From item records to baskets.

Two shapes are used.  *Item rows* hold one (tid, item) per row; they are what
the miner reads, because a huge transaction then stays spread over many tasks.
*Baskets* hold one row per transaction with a sorted item array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.itemsets import canonical
from basketry.plans.scratch import materialize, materialize_with, small_shares

INTEGERS = ("tinyint", "smallint", "int", "bigint")
GATHER = 100_000  # rows of one key that may be brought together as they are
BUCKETS = 1 << 14  # hashes that keys are counted by first


def tid_column(by: str | Sequence[str]) -> Column:
    """Transaction key: the column itself, or a struct of several columns."""
    keys = [by] if isinstance(by, str) else list(by)
    return F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)


def basket_items(df: DataFrame, tid: str | Sequence[str] = "tid", item: str = "item") -> DataFrame:
    """Item rows (tid, item) of item records or of baskets, nulls dropped.

    Rows repeat where the input repeats; counting operators remove repeats
    where they must.
    """
    if item not in df.columns and "items" in df.columns:
        df = df.select("*", F.explode(canonical("items")).alias(item))
    rows = df.select(tid_column(tid).alias("tid"), F.col(item).alias("item"))
    return rows.where("tid IS NOT NULL AND item IS NOT NULL")


def distinct_items(baskets: DataFrame, tid: str | Sequence[str] = "tid") -> DataFrame:
    """Item rows without repeats; item arrays, one per basket, need no exchange."""
    rows = basket_items(baskets, tid)
    return rows.distinct() if "item" in baskets.columns else rows


def hot_keys(rows: DataFrame, keys: Sequence[str], limit: int = GATHER) -> DataFrame | None:
    """Keys with more than ``limit`` rows as one struct column ``key``, None if there are none.

    Rows are counted by a hash of the key first, which moves at most ``BUCKETS``
    numbers a task: a key of a bucket within the limit is within it, too.  Only
    rows of the other buckets, most often none, are counted by key.  Any limit
    gives the same baskets in the end.
    """
    bucketed = rows.select(*keys).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    full = bucketed.groupBy("_bucket").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    full, seen = materialize_with(full.select("_bucket"), "full", F.count("*").alias("n"))
    if not seen["n"]:
        return None
    counted = bucketed.join(full, "_bucket", "left_semi").groupBy(F.struct(*keys).alias("key"))
    counts = counted.agg(F.count("*").alias("n")).where(F.col("n") > limit)
    hot, seen = materialize_with(counts.select("key"), "hot", F.count("*").alias("n"))
    return hot if seen["n"] else None


def split_hot(rows: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary keys, and rows of hot keys without repeats."""
    keyed = rows.withColumn("key", F.struct(*keys))
    return keyed.join(hot, "key", "left_anti").drop("key"), keyed.join(hot, "key", "left_semi").drop("key").distinct()


def gather(rows: DataFrame, keys: Sequence[str], item: str = "item") -> DataFrame:
    """Sorted distinct items per key.

    Rows are exchanged by key as they are: gathering in each task before the
    exchange would sort them twice and hardly shrink them.  Hot keys must not
    come here, or only after their repeats are gone.
    """
    return rows.repartition(*keys).groupBy(*keys).agg(F.array_sort(F.collect_set(item)).alias("items"))


def to_baskets(
    items: DataFrame, by: str | Sequence[str] = ("site", "user", "group"), item: str = "item", limit: int = GATHER
) -> DataFrame:
    """One row per transaction: the key columns and the sorted item array.

    The source is read once, its keys and items are stored.  Transactions with
    more than ``limit`` rows are found first; their repeats are removed by
    (key, item), which spreads each of them over many tasks, so that only
    distinct items are brought together.  Rows without an item, or with a null
    single key, are dropped; in a key of several columns a null is a value.
    """
    keys = [by] if isinstance(by, str) else list(by)
    rows = items.select(*keys, F.col(item).alias("_item")).where("_item IS NOT NULL")
    if len(keys) == 1:
        rows = rows.where(F.col(keys[0]).isNotNull())
    with small_shares(items.sparkSession):  # keys are counted in each task before the exchange
        rows = materialize(rows, "item-rows")
        hot = hot_keys(rows, keys, limit)
    if hot is None:
        return gather(rows, keys, "_item")
    ordinary, few = split_hot(rows, keys, hot)
    return gather(ordinary, keys, "_item").unionByName(gather(few, keys, "_item"))


def assign_tids(baskets: DataFrame, order_by: str | Sequence[str]) -> DataFrame:
    """Add ``tid``: 0, 1, 2, ... in the order of the given unique key.

    The table is range-partitioned and written once with the partition number
    and the row number within it; the start of each partition is the sum of the
    sizes before it.  Only one row per partition is ever brought together.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    ranged = baskets.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = materialize(
        ranged.select(
            "*",
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"),
        ),
        "tids",
    )
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition, so the single-task window does not grow with the data
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return numbered.join(starts, "_part").select(
        (F.col("_start") + F.col("_row")).alias("tid"), *[F.col(c) for c in baskets.columns]
    )


def sort_items(baskets: DataFrame, ascending: bool = False) -> DataFrame:
    """Baskets with the items of each row in descending (or ascending) order."""
    return baskets.withColumn("items", F.sort_array("items", asc=ascending))


def explode_baskets(baskets: DataFrame) -> DataFrame:
    """One row per (item, transaction) instead of one per transaction."""
    keys = [c for c in baskets.columns if c != "items"]
    return baskets.select(*keys, F.explode("items").alias("item"))


def basket_profile(baskets: DataFrame, tid: str | Sequence[str] = "tid") -> DataFrame:
    """One row: baskets, distinct items, item rows, smallest and largest item.

    Both distinct counts come from grouped tables, so a frequent item or a huge
    transaction never lands in one task.  For integer items the width of the
    item range is added.
    """
    rows = distinct_items(baskets, tid)
    of_items = rows.groupBy("item").agg(F.count("*").alias("pairs")).agg(
        F.count("*").alias("n_items"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"),
        F.min("item").alias("min_item"),
        F.max("item").alias("max_item"),
    )
    of_baskets = rows.groupBy("tid").agg(F.lit(1).alias("one")).agg(F.count("*").alias("n_baskets"))
    both = of_baskets.unionByName(of_items, allowMissingColumns=True)  # one row each, merged into one
    profile = both.agg(*[F.max(name).alias(name) for name in both.columns])
    if dict(rows.dtypes)["item"] in INTEGERS:
        profile = profile.withColumn("item_range", F.col("max_item") - F.col("min_item") + 1)
    return profile
