"""Baskets made ready for counting itemsets.

Counting pairs inside a basket costs the square of its width, so one basket that
holds a large share of all rows must not be treated like the others.  Baskets
are kept in two tables: *narrow* ones as item arrays, and the few *wide* ones as
item rows.  Itemsets are enumerated in narrow baskets only.  This is exact as
long as fewer baskets are wide than the support asked for: an itemset with
support >= t then lies in at least one narrow basket, and its count in the wide
ones is found by looking it up (``operators.support.itemset_support``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.itemsets import canonical
from basketry.operators.baskets import GATHER, basket_items, gather, hot_keys, split_hot, tid_column
from basketry.plans.scratch import materialize, materialize_with, small_shares

WIDTH = 64  # items a basket may hold before it is treated as wide


@dataclass
class BasketStore:
    """Narrow baskets (tid, items), wide ones as (tid, item), item supports."""

    narrow: DataFrame
    wide: DataFrame | None
    n_wide: int
    total: int
    supports: DataFrame
    n_items: int
    width: int

    def item_rows(self) -> DataFrame:
        """All baskets as item rows."""
        rows = self.narrow.select("tid", F.explode("items").alias("item"))
        return rows if self.wide is None else rows.unionByName(self.wide)


def prepare(baskets: DataFrame, tid: str | Sequence[str] = "tid", width: int = WIDTH, limit: int = GATHER) -> BasketStore:
    """Split ``baskets`` (item rows or item arrays) and count each item once.

    Transactions of more than ``limit`` rows are never gathered.  The others are
    in small shares, so what a task sorts does not grow with the input.
    """
    spark = baskets.sparkSession
    scattered, n_rows = None, 0
    if "items" in baskets.columns:
        gathered = baskets.select(tid_column(tid).alias("tid"), canonical("items").alias("items"))
        gathered = gathered.where(F.size("items") > 0)
    else:
        with small_shares(spark):  # the rows may come from joins that sort all they get
            rows, seen = materialize_with(basket_items(baskets, tid), "item-rows", F.count("*").alias("n"))
            hot, n_rows = hot_keys(rows, ["tid"], limit), seen["n"]
        with small_shares(spark, n_rows):
            if hot is not None:
                rows, few = split_hot(rows, ["tid"], hot)
                scattered = materialize(few, "scattered")
            gathered = gather(rows, ["tid"])
    with small_shares(spark, n_rows):
        table, seen = materialize_with(
            gathered, "baskets", F.count("*").alias("n"), F.count_if(F.size("items") > width).alias("wide")
        )
        total, n_wide = seen["n"], seen["wide"]
        narrow, wide = table, scattered
        if n_wide:
            narrow = table.where(F.size("items") <= width)
            unfolded = table.where(F.size("items") > width).select("tid", F.explode("items").alias("item"))
            wide = materialize(unfolded if scattered is None else unfolded.unionByName(scattered), "wide")
        if scattered is not None:
            n_hot = scattered.select("tid").distinct().count()
            total, n_wide = total + n_hot, n_wide + n_hot
        store = BasketStore(narrow, wide, n_wide, total, narrow, 0, width)
        counts = store.item_rows().groupBy("item").agg(F.count("*").alias("support"))
        store.supports, seen = materialize_with(counts, "supports", F.count("*").alias("n"))
    store.n_items = seen["n"]
    return store


def _regroup(rows: DataFrame, least: int) -> DataFrame:
    """Item rows without repeats, gathered to arrays of at least ``least`` items."""
    return gather(rows, ["tid"]).where(F.size("items") >= least)


def _only(narrow: DataFrame, values: list) -> DataFrame:
    """Baskets cut to the given items, where two or more are left."""
    cut = narrow.select("tid", F.filter("items", lambda x: x.isin(values)).alias("items"))
    return cut.where(F.size("items") > 1)


def restrict_to_head(store: BasketStore, head: DataFrame, size: int) -> DataFrame:
    """Baskets cut to the items of ``head``, a table of at most ``size`` (a few hundred) rows.

    No basket is wider than the head, so wide ones can be gathered here.
    """
    if store.wide is None and store.n_items <= size:
        return store.narrow
    values = [row["item"] for row in head.select("item").collect()]
    narrow = _only(store.narrow, values)
    if store.wide is None:
        return narrow
    return narrow.unionByName(_regroup(store.wide.where(F.col("item").isin(values)), 2))


def prune(store: BasketStore, tau: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Baskets without the items below support ``tau``: narrow, wide, #wide.

    At most half of ``tau`` baskets are wide in the result: where more are, the
    width limit is doubled until the rest can be listed as narrow.  So an itemset
    to be counted lies in at least tau / 2 narrow baskets, which keeps the
    candidates few.
    """
    frequent = store.supports.where(F.col("support") >= tau)
    size = frequent.agg(F.count("*").alias("n")).first()
    if size["n"] == store.n_items:  # nothing to leave out
        narrow = store.narrow
    else:
        rows = store.narrow.select("tid", F.explode("items").alias("item"))
        narrow = materialize(_regroup(rows.join(frequent.select("item"), "item", "left_semi"), 2), "pruned")
    if store.wide is None:
        return narrow, None, 0

    wide = materialize(store.wide.join(frequent.select("item"), "item", "left_semi"), "wide")
    widths = wide.groupBy("tid").agg(F.count("*").alias("n"))
    limits = [store.width << step for step in range(40)]
    wider = widths.agg(*[F.count_if(F.col("n") > limit) for limit in limits]).first()
    limit, n_wide = next((lim, n) for lim, n in zip(limits, wider) if 2 * n <= tau)
    if n_wide:
        hot = materialize(widths.where(F.col("n") > limit).select("tid"), "hot")
        back, wide = wide.join(hot, "tid", "left_anti"), wide.join(hot, "tid", "left_semi")
    else:
        back, wide = wide, None
    return narrow.unionByName(materialize(_regroup(back, 2), "back")), wide, n_wide
