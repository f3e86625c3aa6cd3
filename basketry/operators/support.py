"""Supports: how many baskets hold an item or an itemset."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.itemsets import canonical
from basketry.operators.baskets import distinct_items, tid_column
from basketry.plans import scratch
from basketry.plans.scratch import materialize, small_shares
from basketry.plans.store import WIDTH, prepare


def item_support(baskets: DataFrame, tid: str | Sequence[str] = "tid") -> DataFrame:
    """Number of baskets holding each item.

    Both steps are counted before the exchange, so neither a frequent item nor
    a huge basket makes one task large.
    """
    return distinct_items(baskets, tid).groupBy("item").agg(F.count("*").alias("support"))


def item_occurrences(items: DataFrame, item: str = "item") -> DataFrame:
    """Number of rows per item, repeats within a basket counted."""
    return (
        items.where(F.col(item).isNotNull())
        .groupBy(F.col(item).alias("item"))
        .agg(F.count("*").alias("occurrences"))
    )


def vertical_index(baskets: DataFrame, tid: str = "tid", block: int = 1 << 15) -> DataFrame:
    """Item to transaction ids, in blocks: (item, block, tids, n).

    Block ``b`` of an item lists its ids in ``[b * block, (b + 1) * block)``, so
    no row or group is longer than ``block`` however frequent the item is.
    ``n`` counts the ids of the block; an item's support is the sum of its blocks' ``n``.
    """
    rows = distinct_items(baskets, tid).withColumn("block", F.expr(f"tid div {block}"))
    # exchanged as rows: gathering before the exchange would only sort them twice
    blocks = rows.repartition("item", "block").groupBy("item", "block")
    return blocks.agg(F.array_sort(F.collect_list("tid")).alias("tids"), F.count("*").alias("n"))


def itemset_support(
    baskets: DataFrame,
    itemsets: DataFrame,
    tid: str | Sequence[str] = "tid",
    supports: DataFrame | None = None,
    width: int = WIDTH,
) -> DataFrame:
    """Support of each given itemset (array column ``items``), 0 if absent.

    Each itemset is looked up by its rarest item only; the baskets found are
    then checked for the other items.  So a frequent item costs nothing unless
    all items of a set are frequent.  Baskets of at most ``width`` items are
    gathered once and checked where they are found; of wider ones the item rows
    are joined again on (basket, item).  With a ``width`` of 0 none is gathered,
    as suits baskets known to be wide.  ``supports`` may give known item
    supports (item, support).  The result depends on neither.

    Order, repeats and nulls in a given itemset do not matter; the result has it
    as it was given, once.  The empty set is in every basket.
    """
    spark = itemsets.sparkSession
    given = itemsets.select("items").distinct().withColumn("set", canonical("items"))
    sets = given.select(F.col("set").alias("items")).where(F.size("items") > 0).distinct()
    sets = materialize(sets.select(F.monotonically_increasing_id().alias("no"), "items", F.size("items").alias("n")), "sets")
    if width:
        rows = baskets.select(tid_column(tid).alias("tid"), "item" if "item" in baskets.columns else "items")
        store = prepare(rows.where("tid IS NOT NULL"), "tid", width)
        narrow, wide = store.narrow, store.wide
        supports = store.supports if supports is None else supports
        every = spark.range(0, 1, 1, 1).select(F.lit(store.total).cast("bigint").alias("support"))
    else:
        with small_shares(spark):
            narrow, wide = None, materialize(distinct_items(baskets, tid), "item-rows")
        supports = wide.groupBy("item").agg(F.count("*").alias("support")) if supports is None else supports
        every = wide.select("tid").distinct().agg(F.count("*").alias("support"))
    held, n_found = [], 0
    with small_shares(spark):
        anchors = materialize(_anchors(sets, supports), "anchors")
        if narrow is not None:
            held.append(held_by_narrow(narrow, anchors))
        if wide is not None:
            found = wide.groupBy("item").count().join(anchors.groupBy("item").agg(F.count("*").alias("sets")), "item")
            n_found = found.agg(F.sum(F.col("count") * F.col("sets"))).first()[0] or 0
            held.append(_held_by_wide(dealt(wide, n_found), anchors))
    with small_shares(spark, n_found):
        counts = reduce(DataFrame.unionByName, held).groupBy("no").agg(F.count("*").alias("support"))
        counts = materialize(counts.join(sets, "no").select("items", "support"), "counts")
    empty = given.where(F.size("set") == 0).select(F.col("set").alias("items")).distinct()
    counts = counts.unionByName(empty.crossJoin(every))  # one row by one row
    return given.join(counts.withColumnRenamed("items", "set"), "set", "left").select(
        "items", F.coalesce("support", F.lit(0).cast("bigint")).alias("support")
    )


def _anchors(sets: DataFrame, supports: DataFrame) -> DataFrame:
    """The sets (no, n) whose items all occur, by their rarest ``item``, with the ``others``."""
    return (
        sets.select("no", "n", F.explode("items").alias("item"))
        .join(supports.select("item", "support"), "item")
        .groupBy("no", "n")
        .agg(F.min(F.struct("support", "item")).alias("rarest"), F.count("*").alias("known"))
        .where("known = n")
        .select("no", F.col("rarest.item").alias("item"))
        .join(sets, "no")
        .select("no", "n", "item", F.array_remove("items", F.col("item")).alias("others"))
    )


def held_by_narrow(narrow: DataFrame, anchors: DataFrame) -> DataFrame:
    """``no`` of an anchored set, once for each gathered basket that holds it.

    A basket found goes nowhere: the other items are looked for in its own list,
    the first of them before any list of others is compared.
    """
    found = narrow.select("items", F.explode("items").alias("item")).join(anchors, "item")
    others = F.col("others").cast(narrow.schema["items"].dataType)
    found = found.where((F.col("n") == 1) | F.array_contains("items", F.get(others, F.lit(0))))
    return found.where((F.col("n") <= 2) | (F.size(F.array_except(others, "items")) == 0)).select("no")


def dealt(rows: DataFrame, n_found: int) -> DataFrame:
    """Item rows over so many tasks that each, on average, finds a share of ``n_found``."""
    n_tasks = -(-n_found // scratch.SHARE_ROWS)
    return rows.repartition(n_tasks, "tid", "item") if n_tasks > 1 else rows


def _held_by_wide(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """The same of baskets as item rows; sets go by number, of a pair the join itself says that a basket holds it."""
    found = anchors.join(rows, "item")
    single = found.where("n = 1").select("no")
    parts = found.where("n > 1").select("no", "n", "tid", F.explode("others").alias("item")).join(rows, ["tid", "item"])
    pairs = parts.where("n = 2").select("no")
    longer = parts.where("n > 2").groupBy("no", "n", "tid").agg(F.count("*").alias("hits")).where("hits = n - 1").select("no")
    return single.unionByName(pairs).unionByName(longer)
