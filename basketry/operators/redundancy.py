"""Removal of redundant rules from any rule table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.plans.scratch import materialize

KEYS = ["support", "antecedent_support"]


def drop_redundant(rules: DataFrame) -> DataFrame:
    """Rules that no other rule of the table makes redundant.

    X -> Y is redundant if another rule X' -> Y' has the same support and the
    same antecedent support (hence confidence), X' within X and Y within Y'.

    Such a rule shares with X -> Y every item of Y and has all of X' in X.  So a
    covering rule is entered under each item of its consequent together with
    the rarest item of its antecedent, and X -> Y is looked up under the rarest
    item of Y together with each item of X: |Y'| and |X| rows a rule, however
    long it is.  What meets is compared in full.
    """
    table = materialize(rules.select(*KEYS, "antecedent", "consequent").distinct(), "rules")
    sides = table.select("antecedent", "consequent")
    rarity = (
        sides.select(F.explode(F.concat("antecedent", "consequent")).alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    )
    rarity = materialize(rarity, "rarity")

    def rarest(side: str) -> DataFrame:
        items = sides.select(side).distinct().select(side, F.explode(side).alias("item")).join(rarity, "item")
        return items.groupBy(side).agg(F.min_by("item", F.struct("n", "item")).alias(f"rare_{side}"))

    covers = table.join(rarest("antecedent"), "antecedent").select(
        *KEYS,
        F.col("rare_antecedent").alias("a"),
        F.explode("consequent").alias("c"),
        F.col("antecedent").alias("less"),
        F.col("consequent").alias("more"),
    )
    looks = table.join(rarest("consequent"), "consequent").select(
        *KEYS, F.explode("antecedent").alias("a"), F.col("rare_consequent").alias("c"), "antecedent", "consequent"
    )
    inside = (F.size(F.array_except("less", "antecedent")) == 0) & (F.size(F.array_except("consequent", "more")) == 0)
    other = (F.size("less") < F.size("antecedent")) | (F.size("more") > F.size("consequent"))
    redundant = looks.join(covers, [*KEYS, "a", "c"]).where(other & inside).select("antecedent", "consequent")
    return rules.join(redundant, ["antecedent", "consequent"], "left_anti").select(*rules.columns)
