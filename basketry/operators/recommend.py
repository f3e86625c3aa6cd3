"""Rules applied to users: matching, nesting, recommending."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.plans.scratch import materialize, small_shares

USER = ("site", "user")


def last_transaction(items: DataFrame, by: Sequence[str] = USER) -> DataFrame:
    """Item rows of the latest group of each user: (by..., group, item).

    Latest is the largest (timestamp, group).  Rows are stored as they come; the
    newest time of each user is found on that table, then the largest group that
    has a row at that time.  Groups are never listed: all that a task holds is one
    row per user, a time or a group, which the item rows are streamed against.
    """
    keys = list(by)
    with small_shares(items.sparkSession):  # the records may come from joins that sort all they get
        rows = materialize(items.where("item IS NOT NULL").select(*keys, "group", "item", "timestamp"), "held-items")
    newest = rows.groupBy(*keys).agg(F.max("timestamp").alias("timestamp"))
    # by hash, as a merge would sort all rows for the few that stay
    at_newest = rows.select(*keys, "group", "timestamp").join(newest.hint("shuffle_hash"), [*keys, "timestamp"])
    last = at_newest.groupBy(*keys).agg(F.max("group").alias("group"))
    held = rows.select(*keys, "group", "item").join(last.hint("shuffle_hash"), [*keys, "group"], "left_semi")
    return held.distinct()


def match_rules(
    held: DataFrame, rules: DataFrame, min_weight: float = 1.0, by: Sequence[str] = USER, side: str = "antecedent"
) -> DataFrame:
    """Rules matching each key's items: (by..., rule columns, weight).

    ``held`` has item rows (by..., item).  The weight is the share of the rule's
    ``side``, antecedent or consequent, that is held; rows below ``min_weight``
    are left out, as is a rule of which nothing is held.

    With m of n items needed, at least one of any n - m + 1 must be held.  Sides
    are therefore looked up by their n - m + 1 rarest items only, and checked in
    full by a join on (key, item).  Empty sides match nothing.
    """
    if side not in ("antecedent", "consequent"):
        raise ValueError("side must be 'antecedent' or 'consequent'")
    if not 0 <= min_weight <= 1:
        raise ValueError("min_weight must lie between 0 and 1")
    keys = list(by)
    with small_shares(held.sparkSession):
        rows = materialize(held.select(*keys, "item").where("item IS NOT NULL").distinct(), "held")
    sides = rules.select(side).where(F.size(side) > 0).distinct().withColumn("n", F.size(side))
    enough = F.filter(F.sequence(F.lit(1), F.col("n")), lambda m: m / F.col("n") >= F.lit(float(min_weight)))
    sides = sides.withColumn("need", F.element_at(enough, 1))
    freq = rows.groupBy("item").agg(F.count("*").alias("freq"))
    ranked = (
        sides.select(side, "n", "need", F.explode(side).alias("item"))
        .join(freq, "item", "left")
        .groupBy(side, "n", "need")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "item"))).alias("parts"))
    )
    anchors = ranked.select(
        side, "n", "need", F.explode(F.slice("parts", F.lit(1), F.col("n") - F.col("need") + 1)).alias("part")
    ).select(side, "n", "need", "part.item")
    anchors = materialize(anchors, "anchors")
    found = rows.join(anchors, "item")
    whole = found.where("n = 1").select(*keys, side, F.lit(1.0).alias("weight"))
    parts = (
        found.where("n > 1")
        .select(*keys, side, "n", "need")
        .distinct()
        .select(*keys, side, "n", "need", F.explode(side).alias("item"))
        .join(rows, [*keys, "item"])
        .groupBy(*keys, side, "n", "need")
        .agg(F.count("*").alias("hits"))
        .where("hits >= need")
        .select(*keys, side, (F.col("hits") / F.col("n")).alias("weight"))
    )
    return whole.unionByName(parts).join(rules, side).select(*keys, *rules.columns, "weight")


def user_rules(last: DataFrame, rules: DataFrame, min_weight: float = 1.0, by: Sequence[str] = USER) -> DataFrame:
    """Rules that apply to each user's last transaction, with their weight."""
    matched = match_rules(last, rules, min_weight, by)
    return matched.select(*by, "antecedent", "consequent", "support", "confidence", "weight")


def nest_user_rules(matched: DataFrame, by: Sequence[str] = USER) -> DataFrame:
    """One row per user with the list of that user's rules, best first.

    A row is as long as the rules matching one user, at most the rule table.
    """
    rank = F.struct(
        (-F.col("weight")).alias("w"), (-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"),
        "antecedent", "consequent", "support", "confidence", "weight",
    )
    grouped = matched.repartition(*by).groupBy(*by)
    return grouped.agg(F.array_sort(F.collect_list(rank)).alias("ranked")).select(
        *by,
        F.transform(
            "ranked",
            lambda r: F.struct(r["antecedent"].alias("antecedent"), r["consequent"].alias("consequent"),
                               r["support"].alias("support"), r["confidence"].alias("confidence"),
                               r["weight"].alias("weight")),
        ).alias("items"),
    )


def user_rules_to_json(nested: DataFrame) -> DataFrame:
    """One JSON text per user from ``nest_user_rules``, column ``json``."""
    return nested.select(F.to_json(F.struct(*nested.columns)).alias("json"))


def user_rules_from_json(texts: DataFrame, item_type: str = "string", user_type: str = "string") -> DataFrame:
    """Nested user rules from the texts ``user_rules_to_json`` writes."""
    rule = (
        f"STRUCT<antecedent: ARRAY<{item_type}>, consequent: ARRAY<{item_type}>, support: BIGINT, "
        "confidence: DOUBLE, weight: DOUBLE>"
    )
    schema = f"site STRING, user {user_type}, items ARRAY<{rule}>"
    return texts.select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("one")).select("one.*")


def recommend(matched: DataFrame, held: DataFrame, n: int, by: Sequence[str] = USER) -> DataFrame:
    """The n best items per user that the user does not hold yet.

    An item counts with its best rule (weight, confidence, support); the rank
    within a user is cut per task before the exchange.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    keys = list(by)
    offers = matched.select(*keys, F.explode("consequent").alias("item"), "weight", "confidence", "support")
    new = offers.join(held.select(*keys, "item").distinct(), [*keys, "item"], "left_anti")
    best = new.groupBy(*keys, "item").agg(F.max(F.struct("weight", "confidence", "support")).alias("best"))
    order = Window.partitionBy(*keys).orderBy(
        F.desc("weight"), F.desc("confidence"), F.desc("support"), F.asc("item")
    )
    return (
        best.select(*keys, "item", "best.*")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
    )
