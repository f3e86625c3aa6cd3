"""Compositions for the usual applications of rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators.recommend import match_rules


def attributes_to_items(df: DataFrame, cols: dict[str, str] | Sequence[str], tid: str | Column) -> DataFrame:
    """Each row of a table as a basket of ``name=value`` items: (tid, items).

    ``cols`` lists columns or maps item names to columns; nulls give no item.
    """
    names = cols if isinstance(cols, dict) else {c: c for c in cols}
    parts = [F.concat(F.lit(f"{name}="), F.col(col).cast("string")) for name, col in names.items()]
    key = F.col(tid) if isinstance(tid, str) else tid
    return df.select(key.alias("tid"), F.array_sort(F.array_compact(F.array(*parts))).alias("items"))


@dataclass(frozen=True)
class Attributes:
    """A table that tells something of each key: ``names`` maps item names to columns.

    Columns of ``bins`` are numbers and become quantile bins, so many as given;
    the others are taken as they are.  A key may have one row or many: each row
    adds to its bag of items.
    """

    rows: DataFrame
    key: str
    names: Mapping[str, str]
    bins: Mapping[str, int] = field(default_factory=dict)


def quantile_cuts(rows: DataFrame, columns: Mapping[str, int], accuracy: int = 100_000) -> dict[str, list[float]]:
    """Per column the inner borders of its quantile bins, from one pass and a bounded summary a task.

    A border is a value of the column; its share of smaller values is off by at
    most 1 / ``accuracy``.
    """
    if not columns:
        return {}
    if any(n < 2 for n in columns.values()):
        raise ValueError("a column needs at least two bins")
    shares = {c: [k / n for k in range(1, n)] for c, n in columns.items()}
    cuts = [F.percentile_approx(F.col(c).cast("double"), shares[c], accuracy).alias(c) for c in columns]
    found = rows.agg(*cuts).first()
    return {c: sorted(set(found[c] or [])) for c in columns}


def bag_of_attributes(tables: Sequence[Attributes]) -> DataFrame:
    """Item rows (tid, item) of all that several tables tell of a key.

    Values become ``name=value``, numbers with bins ``name~k`` where k borders lie
    below the value.  The tables are put one below the other by key: a key's rows
    of one table never meet those of another, so nothing multiplies.  Null keys
    and values give no item; repeats within a key count once.
    """
    rows = None
    for table in tables:
        cuts = quantile_cuts(table.rows, {table.names[name]: n for name, n in table.bins.items()})
        items = []
        for name, column in table.names.items():
            value = F.col(column)
            if name in table.bins:
                below = [F.when(value.cast("double") > F.lit(cut), 1).otherwise(0) for cut in cuts[column]]
                value = F.when(value.isNotNull(), sum(below, F.lit(0)))
            items.append(F.concat(F.lit(f"{name}~" if name in table.bins else f"{name}="), value.cast("string")))
        one = table.rows.select(F.col(table.key).alias("tid"), F.explode(F.array_compact(F.array(*items))).alias("item"))
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise ValueError("no tables given")
    return rows.where("tid IS NOT NULL").distinct()


def expand_queries(terms: DataFrame, rules: DataFrame, by: Sequence[str], min_weight: float = 1.0) -> DataFrame:
    """Queries with terms added from matching rules: (by..., term, added).

    ``terms`` has one row per (by..., item).  A row of the result is a term of
    the query, or an added one that the query does not have.
    """
    keys = list(by)
    own = terms.select(*keys, "item").where("item IS NOT NULL").distinct()
    extra = match_rules(own, rules, min_weight, keys).select(*keys, F.explode("consequent").alias("item")).distinct()
    both = own.withColumn("added", F.lit(0)).unionByName(extra.withColumn("added", F.lit(1)))
    return both.groupBy(*keys, F.col("item").alias("term")).agg((F.min("added") == 1).alias("added"))


def discount_conflicts(items: DataFrame, pairs: DataFrame, min_discount: float) -> DataFrame:
    """Pairs often sold together of which both are discounted.

    ``items`` has (item, discount) per sale, ``pairs`` is a pair support table
    (a, b, support); a pair is kept if both mean discounts reach the bound.
    Discounts are summed as decimals: a mean on the bound must not depend on the
    order in which tasks add.
    """
    summed = items.groupBy("item").agg(
        F.sum(F.col("discount").cast("decimal(18,6)")).alias("sum"), F.count("discount").alias("n")
    )
    bound = F.lit(Decimal(str(min_discount))) * F.col("n")
    means = summed.where(F.col("sum") >= bound).select(
        "item", (F.col("sum").cast("double") / F.col("n")).alias("discount")
    )
    left = means.select(F.col("item").alias("a"), F.col("discount").alias("discount_a"))
    right = means.select(F.col("item").alias("b"), F.col("discount").alias("discount_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "support", "discount_a", "discount_b")


def best_partner(rules: DataFrame, n: int = 1) -> DataFrame:
    """The n best other items for each single item, by confidence."""
    single = rules.where("size(antecedent) = 1 AND size(consequent) = 1").select(
        F.col("antecedent")[0].alias("item"), F.col("consequent")[0].alias("partner"), "support", "confidence"
    )
    order = Window.partitionBy("item").orderBy(F.desc("confidence"), F.desc("support"), F.asc("partner"))
    return single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def bundles(itemsets: DataFrame, n: int = 1) -> DataFrame:
    """The n best-supported itemsets of two or more items around each item."""
    members = itemsets.where("size(items) > 1").select(F.explode("items").alias("item"), "items", "support")
    order = Window.partitionBy("item").orderBy(F.desc("support"), F.asc(F.size("items")), F.asc("items"))
    return members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
