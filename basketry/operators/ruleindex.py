"""Rules stored for look-up by their items: posting lists as a bucketed, sorted table.

The postings are hashed by item once, when they are written; a look-up then
exchanges the few rows it asks with, never the rules.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.recommend import USER
from basketry.plans.scratch import materialize

#: postings of one item and side in one bucket; a longer list is dealt over several
LONGEST = 100_000
SIDES = ("antecedent", "consequent")
_KEYS = {"postings": ("item", "part"), "rules": ("rid",)}


@dataclass
class RuleIndex:
    """``postings`` (side, item, part, place, n, items, rid), ``rules`` (rid, …) and ``long`` (side, item, parts)."""

    postings: DataFrame
    rules: DataFrame
    long: DataFrame

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rules.columns if c != "rid"]


def _read(spark: SparkSession, root: str, name: str) -> RuleIndex:
    long = spark.read.parquet(f"{root.rstrip('/')}/long")
    return RuleIndex(spark.table(f"{name}_postings"), spark.table(f"{name}_rules"), long)


def _store(rows: DataFrame, root: str, name: str, table: str, buckets: int) -> None:
    keys = _KEYS[table]
    # one file a bucket: rows are dealt as the buckets are
    dealt = rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    dealt.option("path", f"{root.rstrip('/')}/{table}").mode("overwrite").saveAsTable(f"{name}_{table}")
    rows.sparkSession.sql(f"ANALYZE TABLE {name}_{table} COMPUTE STATISTICS")


def write_rule_index(rules: DataFrame, root: str, name: str, buckets: int = 64, longest: int = LONGEST) -> RuleIndex:
    """Write ``rules`` below ``root`` as tables ``name_postings`` and ``name_rules``, bucketed and with statistics.

    Each rule is listed under every item of either side.  ``place`` is the
    item's rank in its side by the length of its list, the shortest first: of a
    side of n items of which m must be held, the first n - m + 1 are enough to
    find it.  A list of more than ``longest`` rows is dealt over several parts.
    """
    numbered = rules.withColumn("rid", F.monotonically_increasing_id())
    numbered = materialize(numbered.select("rid", *rules.columns), "numbered")
    rows = None
    for side in SIDES:
        one = numbered.select(F.lit(side).alias("side"), F.col(side).alias("items"), "rid").where(F.size(side) > 0)
        rows = one if rows is None else rows.unionByName(one)
    items = rows.select("side", "rid", F.explode("items").alias("item"))
    lengths = materialize(items.groupBy("side", "item").agg(F.count("*").alias("length")), "lengths")
    placed = (
        rows.select("side", "items", "rid", F.explode("items").alias("item"))
        .join(lengths, ["side", "item"])
        .groupBy("side", "rid", "items")
        .agg(F.sort_array(F.collect_list(F.struct("length", "item"))).alias("ranked"))
        .select("side", "rid", "items", F.posexplode("ranked").alias("place", "ranked"))
    )
    parts = F.ceil(F.col("ranked.length") / longest).cast("int")
    postings = placed.select(
        "side", F.col("ranked.item").alias("item"), F.pmod(F.xxhash64("rid"), parts).cast("int").alias("part"),
        (F.col("place") + 1).alias("place"), F.size("items").alias("n"), "items", "rid",
    )
    _store(postings, root, name, "postings", buckets)
    _store(numbered, root, name, "rules", buckets)
    long = lengths.where(F.col("length") > longest).select("side", "item", F.ceil(F.col("length") / longest).cast("int").alias("parts"))
    long.write.mode("overwrite").parquet(f"{root.rstrip('/')}/long")
    return _read(rules.sparkSession, root, name)


def open_rule_index(spark: SparkSession, root: str, name: str, buckets: int = 64) -> RuleIndex:
    """The index below ``root`` in a session whose catalogue doesn't know it yet; ``buckets`` as it was written with."""
    for table, keys in _KEYS.items():
        path = f"{root.rstrip('/')}/{table}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        by = ", ".join(keys)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name}_{table} ({columns}) USING parquet "
            f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return _read(spark, root, name)


def _need(min_weight: float) -> Column:
    """The fewest of n items whose share reaches ``min_weight``."""
    enough = F.filter(F.sequence(F.lit(1), F.col("n")), lambda m: m / F.col("n") >= F.lit(float(min_weight)))
    return F.element_at(enough, 1)


def match_index(
    held: DataFrame, index: RuleIndex, min_weight: float = 1.0, by: Sequence[str] = USER, side: str = "antecedent"
) -> DataFrame:
    """As ``match_rules``: rules matching each key's items, (by..., rule columns, weight), from a stored index."""
    if side not in SIDES:
        raise ValueError("side must be 'antecedent' or 'consequent'")
    if not 0 <= min_weight <= 1:
        raise ValueError("min_weight must lie between 0 and 1")
    keys = list(by)
    rows = materialize(held.select(*keys, "item").where("item IS NOT NULL").distinct(), "held")
    long = index.long.where(F.col("side") == side).select("item", "parts")  # few: each stands for many postings
    asked = rows.join(F.broadcast(long), "item", "left")
    asked = asked.select(*keys, "item", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    first = index.postings.where(F.col("side") == side).withColumn("need", _need(min_weight))
    first = first.where(F.col("place") <= F.col("n") - F.col("need") + 1)
    found = asked.join(first, ["item", "part"]).select(*keys, "rid", "n", "need", "items").distinct()
    hits = (
        found.select(*keys, "rid", "n", "need", F.explode("items").alias("item"))
        .join(rows, [*keys, "item"])
        .groupBy(*keys, "rid", "n", "need")
        .agg(F.count("*").alias("hits"))
        .where("hits >= need")
        .select(*keys, "rid", (F.col("hits") / F.col("n")).alias("weight"))
    )
    return hits.join(index.rules, "rid").select(*keys, *index.columns, "weight")
