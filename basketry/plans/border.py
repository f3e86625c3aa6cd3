"""Supports kept up to date as baskets are added.

Kept is the support of every itemset that occurs and whose subsets, one item
smaller, all reach a threshold: the frequent itemsets and the border right below
them.  Baskets are only added, so supports only grow, and a new batch needs

* the counts of such itemsets in the batch itself, added to what is kept; one
  that is not kept has never occurred before, so its count is that of the batch;
* for an itemset that crosses the threshold, its supersets by one item: these
  were below the border and must be counted in all baskets.  Exactly the baskets
  that hold the crossing itemset are looked up, by its rarest item, in an index
  of item to baskets.

Without a crossing nothing but the batch and the kept supports are read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.itemsets import canonical
from basketry.operators.baskets import gather
from basketry.plans import files
from basketry.plans.generations import Generations
from basketry.plans.mining import (
    HEADS, _check, _check_search, _count, _extend, _first, _keep, _search, _Seed, _seed, top_k_nr_rules, top_k_rules,
)
from basketry.plans.scratch import materialize, materialize_with
from basketry.plans.store import WIDTH, BasketStore, prepare

#: crossing items whose index rows are found by a list in the filter; more are found by the join alone
LISTED = 1000
#: the threshold kept, as a share of the support of the k-th rule: room for rules that lose their confidence
ROOM = 0.75


def _smaller() -> Column:
    """The subsets of ``items`` by one item less."""
    return F.transform(F.sequence(F.lit(0), F.size("items") - 1), lambda at: F.array_remove("items", F.get("items", at)))


def _with_frequent_subsets(sets: DataFrame, smaller: DataFrame, *more: Column) -> DataFrame:
    """Itemsets of ``sets`` all of whose subsets by one item are in ``smaller``, with aggregates over those."""
    parts = sets.select("items", F.explode(_smaller()).alias("inner"))
    found = parts.join(smaller.withColumnRenamed("items", "inner"), "inner").groupBy("items")
    whole = found.agg(F.count("*").alias("_n"), *more).where(F.col("_n") == F.size("items")).drop("_n")
    return sets.join(whole, "items")


@dataclass
class Supports:
    """Kept supports: ``levels[n - 1]`` has (items, support, crossed) for itemsets of n items."""

    threshold: int
    total: int
    levels: list[DataFrame]

    def store(self) -> tuple[BasketStore, dict]:
        """The supports as the miner's search takes them: no baskets, every level known."""
        items = self.levels[0].select(F.col("items")[0].alias("item"), "support")
        known = {n: level.select("items", "support") for n, level in enumerate(self.levels[1:], 2)}
        known[len(self.levels) + 1] = self.levels[-1].select("items", "support").limit(0)
        return BasketStore(None, None, 0, self.total, items, 0, WIDTH), {
            n: (self.threshold - 1, level) for n, level in known.items()
        }


def index_rows(baskets: DataFrame) -> DataFrame:
    """(item, tid, items): each basket under each of its items, sorted by item."""
    rows = baskets.select(F.explode("items").alias("item"), "tid", "items")
    return sort_index(rows)


def sort_index(rows: DataFrame) -> DataFrame:
    """Index rows in the order that lets a reader skip what it does not look for; a frequent item spans many files."""
    return rows.repartitionByRange("item", "tid").sortWithinPartitions("item")


def _holding(index: DataFrame, crossed: DataFrame, items: DataFrame) -> DataFrame:
    """(tid, items, inner): the indexed baskets that hold an itemset ``inner`` of ``crossed``."""
    anchors = (
        crossed.select(F.col("items").alias("inner"), F.explode("items").alias("item"))
        .join(items.select(F.col("items")[0].alias("item"), "support"), "item")
        .groupBy("inner")
        .agg(F.min(F.struct("support", "item"))["item"].alias("item"))
    )
    anchors, seen = materialize_with(anchors, "anchors", F.count("*").alias("n"))
    if seen["n"] <= LISTED:
        index = index.where(F.col("item").isin([r["item"] for r in anchors.select("item").distinct().collect()]))
    held = F.size(F.array_intersect("inner", "items")) == F.size("inner")
    return index.join(anchors, "item").where(held).select("tid", "items", "inner")


def advance(
    before: Supports | None, baskets: DataFrame, threshold: int, max_len: int | None, index: DataFrame | None = None
) -> tuple[Supports, int]:
    """Supports after ``baskets`` (tid, items) are added, and the number of earlier baskets looked up.

    Without ``before``, ``baskets`` are all there are.  Else the threshold is
    that of ``before`` and ``index`` holds all baskets, the new ones included.
    """
    added = baskets.select(F.explode("items").alias("item")).groupBy(F.array("item").alias("items"))
    level, seen = _grown(before, 1, added.agg(F.count("*").alias("support")), None, threshold)
    levels, looked_up = [level], 0
    rows = baskets.select("tid", F.explode("items").alias("item"))
    frequent = level.where(F.col("support") >= threshold)
    pruned = rows.join(frequent.select(F.col("items")[0].alias("item")), "item", "left_semi")
    state = _first(materialize(gather(pruned, ["tid"]).where(F.size("items") > 1), "pruned"))
    n = 1
    while seen["frequent"] > n and (max_len is None or n < max_len):
        n += 1
        longer = _extend(state)
        counted = materialize(_count(longer), "counted")
        whole = _with_frequent_subsets(counted, frequent.select("items", "crossed"), F.max("crossed").alias("new"))
        late = None
        if seen["crossed"]:
            found = _holding(index, frequent.where("crossed"), levels[0])
            found, rows_seen = materialize_with(found, "looked-up", F.count("*").alias("n"))
            looked_up += rows_seen["n"]
            more = F.explode(F.array_except("items", "inner")).alias("item")
            again = found.select("tid", "inner", more).select(
                "tid", F.array_sort(F.concat("inner", F.array("item"))).alias("items")
            )  # a basket meets a set once for each crossing subset
            late = _with_frequent_subsets(_count(again.distinct()), frequent.select("items"))
        level, seen = _grown(before, n, whole.where("NOT new").select("items", "support"), late, threshold)
        if not seen["n"]:
            break
        levels.append(level)
        frequent = level.where(F.col("support") >= threshold)
        state = _keep(longer, frequent)
        if n > 2:
            state = materialize(state, "state")
    total = baskets.count() + (before.total if before else 0)
    return Supports(threshold, total, levels), looked_up


def _grown(
    before: Supports | None, n: int, added: DataFrame, late: DataFrame | None, threshold: int
) -> tuple[DataFrame, dict]:
    """Level ``n`` after counts are added, stored, and how many sets it has, of them frequent and crossing."""
    if before is None:
        level = added.select("items", "support", F.lit(False).alias("crossed"))
    else:
        if n <= len(before.levels):
            old = before.levels[n - 1].select("items", F.col("support").alias("_old"))
            level = old.join(added, "items", "full")
        else:
            level = added.withColumn("_old", F.lit(None).cast("bigint"))
        old, new = F.coalesce("_old", F.lit(0)), F.coalesce("_old", F.lit(0)) + F.coalesce("support", F.lit(0))
        level = level.select("items", new.alias("support"), ((new >= threshold) & (old < threshold)).alias("crossed"))
    if late is not None:
        crossed = (F.col("support") >= threshold).alias("crossed")
        level = level.unionByName(late.select("items", "support", crossed))
    return materialize_with(
        level,
        "level",
        F.count("*").alias("n"),
        F.count_if(F.col("support") >= threshold).alias("frequent"),
        F.count_if("crossed").alias("crossed"),
    )


def trim(kept: Supports, threshold: int) -> Supports:
    """What has to be kept at a higher threshold."""
    levels = [kept.levels[0]]
    for level in kept.levels[1:]:
        smaller = levels[-1].where(F.col("support") >= threshold).select("items")
        level, seen = materialize_with(_with_frequent_subsets(level, smaller), "trimmed", F.count("*").alias("n"))
        if not seen["n"]:
            break
        levels.append(level)
    return Supports(threshold, kept.total, levels)


class IncrementalMiner:
    """The k best rules over all baskets so far, brought up to date batch by batch.

    Below ``root``: ``baskets/`` (tid, items) and ``index/`` (item, tid, items),
    merged in generations, and the kept supports of the last two batches.  A
    batch that is run again starts from the supports before it and replaces what
    it wrote.

    The threshold rises with the support of the k-th rule and is at most
    ``ROOM`` of it.  Rules can lose their confidence as supports grow; if fewer
    than k are left above the threshold, it is halved and all baskets are
    counted again.  Itemsets of a batch are listed within its baskets, so a
    basket of more than ``width`` items ends keeping supports: from then on all
    baskets are mined after each batch, by the miner that looks wide ones up.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        k: int,
        minconf: float,
        non_redundant: bool = False,
        max_len: int | None = None,
        min_count: int = 1,
        width: int = WIDTH,
    ):
        _check(k, minconf)
        _check_search(min_count, None, width, max_len)
        self.spark, self.root = spark, root.rstrip("/")
        self.k, self.minconf, self.non_redundant = k, minconf, non_redundant
        self.max_len, self.min_count, self.width = max_len, min_count, width
        self.baskets = Generations(spark, f"{self.root}/baskets")
        self.index = Generations(spark, f"{self.root}/index")

    # ------------------------------------------------------------- kept state

    def _notes(self) -> dict[int, dict]:
        folder = f"{self.root}/supports"
        found = [name for name in files.names(self.spark, folder) if name.endswith(".json") and name[0] != "."]
        return {int(name[:-5]): json.loads(files.read_text(self.spark, f"{folder}/{name}")) for name in found}

    def note(self, batch: int) -> dict:
        """What is known of a batch: threshold, total, rows looked up in earlier batches."""
        return self._notes()[batch]

    def _load(self, batch: int) -> tuple[Supports | None, dict | None]:
        """The supports before ``batch`` and the note on them."""
        notes = {n: note for n, note in self._notes().items() if n < batch}
        if not notes:
            return None, None
        last = max(notes)
        note = notes[last]
        folders = [f"{self.root}/supports/{last}/size={n}" for n in range(1, note["longest"] + 1)]
        levels = [self.spark.read.parquet(folder) for folder in folders]
        return (Supports(note["threshold"], note["total"], levels) if levels else None), note

    def _save(self, batch: int, kept: Supports | None, **note) -> None:
        folder = f"{self.root}/supports"
        levels = kept.levels if kept else []
        for n, level in enumerate(levels, 1):
            level.write.mode("overwrite").parquet(f"{folder}/{batch}/size={n}")
        note |= {"longest": len(levels), "threshold": kept.threshold if kept else 0, "total": kept.total if kept else 0}
        files.publish(self.spark, f"{folder}/{batch}.json", json.dumps(note))
        for old in sorted(n for n in self._notes() if n < batch)[:-1]:  # a repeat needs the one before
            files.delete(self.spark, f"{folder}/{old}.json")
            files.delete(self.spark, f"{folder}/{old}")

    # ------------------------------------------------------------------ rules

    def _rules(self, kept: Supports) -> tuple[DataFrame | None, int]:
        store, known = kept.store()
        return _search(
            store, self.k, self.minconf, kept.threshold, self.max_len, False, self.non_redundant,
            _Seed(kept.threshold, known), None,
        )

    def _rebuilt(self, baskets: DataFrame, threshold: int | None) -> tuple[Supports, DataFrame | None]:
        """Supports counted over all baskets at a threshold that leaves k rules, and these."""
        if threshold is None:
            seed = _seed(prepare(baskets), self.k, self.minconf, self.max_len, False, HEADS)
            threshold = int(ROOM * seed.start)
        while True:
            threshold = max(self.min_count, threshold)
            kept, _ = advance(None, baskets, threshold, self.max_len)
            rules, found = self._rules(kept)
            if found >= self.k or threshold <= self.min_count:
                return kept, rules
            threshold //= 2

    def add(self, batch: int, baskets: DataFrame) -> DataFrame | None:
        """The best rules after the batch's baskets (tid, items) are added; None if there is none to add."""
        clean = baskets.select("tid", canonical("items").alias("items")).where(F.size("items") > 0)
        n, widest = F.count("*").alias("n"), F.max(F.size("items")).alias("widest")
        if not self.baskets.covers(batch):
            clean.write.mode("overwrite").parquet(self.baskets.part(batch))
            new = self.spark.read.schema(clean.schema).parquet(self.baskets.part(batch))
        else:
            new = materialize(clean, "repeated")
        seen = new.agg(n, widest).first()
        if not seen["n"]:
            return None
        before, note = self._load(batch)
        if (note and note["wide"]) or seen["widest"] > self.width:
            self.baskets.merge(_as_they_are)
            self._save(batch, None, wide=True, looked_up=0)
            return self._mined()
        self.index.add(batch, index_rows(new), sort_index)
        self.baskets.merge(_as_they_are)
        looked_up = 0
        if before is None:
            kept, rules = self._rebuilt(self.baskets.read(), None)
        else:
            kept, looked_up = advance(before, new, before.threshold, self.max_len, self.index.read())
            rules, found = self._rules(kept)
            if found < self.k and kept.threshold > self.min_count:
                looked_up += kept.total
                kept, rules = self._rebuilt(self.baskets.read(), kept.threshold // 2)
        if rules is None:  # no itemset of two items
            rules = self._mined()
        rules = materialize(rules, "rules")
        last = rules.agg(F.count("*").alias("n"), F.min("support").alias("support")).first()
        if last["n"] >= self.k and int(ROOM * last["support"]) > kept.threshold:
            kept = trim(kept, int(ROOM * last["support"]))
        self._save(batch, kept, wide=False, looked_up=looked_up)
        return rules

    def _mined(self) -> DataFrame:
        mine = top_k_nr_rules if self.non_redundant else top_k_rules
        return mine(self.baskets.read(), self.k, self.minconf, max_len=self.max_len, min_count=self.min_count)


def _as_they_are(rows: DataFrame) -> DataFrame:
    return rows

