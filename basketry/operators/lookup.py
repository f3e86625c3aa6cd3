"""Looking rules up and reshaping them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions.itemsets import overlap


def item_list(rules: DataFrame, items: Sequence | str, side: str) -> Column:
    """The caller's items as an array of the rules' item type.

    ``items`` is a list or a text such as ``"1,2,3"``.
    """
    if isinstance(items, str):
        items = [part.strip() for part in items.split(",") if part.strip()]
    if not items:
        raise ValueError("no items given")
    return F.array(*[F.lit(i) for i in items]).cast(rules.schema[side].dataType)


def _by_side(rules: DataFrame, items: Sequence | str, side: str, min_weight: float) -> DataFrame:
    given = item_list(rules, items, side)
    weighted = rules.withColumn("weight", overlap(given, F.col(side)))
    return weighted.where((F.col("weight") > 0) & (F.col("weight") >= F.lit(float(min_weight))))


def rules_by_antecedent(rules: DataFrame, items: Sequence | str, min_weight: float = 1.0) -> DataFrame:
    """Rules whose antecedent matches the items: what goes well with them.

    ``weight`` is the share of the antecedent that the items cover; 1.0 means
    all of it.  For many item sets at once use ``match_rules``.
    """
    return _by_side(rules, items, "antecedent", min_weight)


def rules_by_consequent(rules: DataFrame, items: Sequence | str, min_weight: float = 1.0) -> DataFrame:
    """Rules whose consequent matches the items: what to promote to sell them."""
    return _by_side(rules, items, "consequent", min_weight)


def classifier_rules(rules: DataFrame) -> DataFrame:
    """One row per consequent item, weighted by 1 / number of such items."""
    return rules.select(
        "antecedent",
        F.explode("consequent").alias("consequent"),
        "support",
        "confidence",
        (F.lit(1.0) / F.size("consequent")).alias("weight"),
    )


def with_relative_support(rules: DataFrame) -> DataFrame:
    """Add the share of all baskets that hold the rule."""
    return rules.withColumn("relative_support", F.col("support") / F.col("total"))


def rules_to_json(rules: DataFrame) -> DataFrame:
    """One JSON text per rule, column ``json``."""
    return rules.select(F.to_json(F.struct(*rules.columns)).alias("json"))


def rules_from_json(texts: DataFrame, item_type: str = "string") -> DataFrame:
    """Rules from the texts ``rules_to_json`` writes."""
    schema = T.StructType.fromDDL(
        f"antecedent ARRAY<{item_type}>, consequent ARRAY<{item_type}>, support BIGINT, "
        "antecedent_support BIGINT, total BIGINT, confidence DOUBLE"
    )
    return texts.select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("rule")).select("rule.*")
