"""Rules from itemsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.plans.scratch import materialize_with

#: item cells that one step of growing consequents may hold before antecedents are looked up in itemsets instead
MAX_CELLS = 500_000_000


def generate_rules(
    itemsets: DataFrame,
    total: int,
    minconf: float,
    antecedents: DataFrame | None = None,
    longest: int | None = None,
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """All rules X -> Y with X u Y in ``itemsets`` and enough confidence.

    ``itemsets`` has (items, support).  ``antecedents`` is the table the
    supports of X come from, by default ``itemsets`` itself; X not found there
    gives no rule.  It is unique on ``items``, so a frequent X makes one side of
    the join skewed and the other not, which adaptive execution splits.
    ``longest`` may give the size of the largest itemset.

    Consequents grow item by item, in the order of the itemset.  As Y grows X
    shrinks and the confidence can only fall, so a consequent of too little
    confidence is not grown; one whose X is not in the table is.  If the X of a
    long itemset are mostly not there, that lists very many consequents of no
    rule: a step that would hold more than ``max_cells`` items in all is not
    taken, and the longer consequents come from ``_contained``.  The limit
    changes the work, not the result.
    """
    known = (itemsets if antecedents is None else antecedents).select(
        F.col("items").alias("antecedent"), F.col("support").alias("antecedent_support")
    )
    sets = itemsets.select("items", "support").where(F.size("items") > 1)
    if longest is None:
        longest = sets.agg(F.max(F.size("items"))).first()[0] or 0
    first = sets.select("items", "support", F.posexplode("items").alias("at", "y"))
    grown = first.select(
        "items", "support", "at", F.array("y").alias("consequent"), F.expr("filter(items, (x, i) -> i <> at)").alias("antecedent")
    )
    out = None
    columns = ["antecedent", "consequent", "support", "antecedent_support", "confidence"]
    for size in range(1, longest):
        rated = grown.join(known, "antecedent", "inner" if size == longest - 1 else "left")
        rated = rated.withColumn("confidence", F.col("support") / F.col("antecedent_support"))
        if size < longest - 1:
            rated = rated.where(F.col("confidence").isNull() | (F.col("confidence") >= F.lit(float(minconf))))
            more = F.when(F.size("antecedent") > 1, F.size("items") - F.col("at") - 1).otherwise(0)
            cells = F.coalesce(F.sum(more.cast("bigint") * F.size("items")), F.lit(0)).alias("cells")
            rated, seen = materialize_with(rated, "consequents", cells)
        rules = rated.where(F.col("confidence") >= F.lit(float(minconf))).select(*columns)
        out = rules if out is None else out.unionByName(rules)
        if size < longest - 1:
            if not seen["cells"]:
                break
            if seen["cells"] > max_cells:
                out = out.unionByName(_contained(sets, known, size, minconf).select(*columns))
                break
            grown = (
                rated.where(F.size("antecedent") > 1)
                .select("items", "support", "consequent", "antecedent", F.col("at").alias("last"), F.posexplode("items").alias("at", "y"))
                .where(F.col("at") > F.col("last"))
                .select(
                    "items", "support", "at",
                    F.concat("consequent", F.array("y")).alias("consequent"),
                    F.array_remove("antecedent", F.col("y")).alias("antecedent"),
                )
            )
    if out is None:
        out = grown.join(known, "antecedent").withColumn("confidence", F.lit(None).cast("double")).where("false")
    return out.select(
        "antecedent",
        "consequent",
        "support",
        "antecedent_support",
        F.lit(total).cast("bigint").alias("total"),
        "confidence",
    )


def _contained(sets: DataFrame, known: DataFrame, longer: int, minconf: float) -> DataFrame:
    """Confident rules whose consequent has more than ``longer`` items.

    Every known antecedent is met with the itemsets that hold the one of its
    items that is in the fewest, and must be part of them.  So the rows grow with
    antecedents times such itemsets, whatever the length of an itemset.
    """
    held = sets.select("items", "support", F.explode("items").alias("item"))
    often = held.groupBy("item").agg(F.count("*").alias("sets"))
    sides = known.select("antecedent", "antecedent_support", F.explode("antecedent").alias("item")).join(often, "item")
    rarest = sides.groupBy("antecedent", "antecedent_support").agg(F.min_by("item", F.struct("sets", "item")).alias("item"))
    met = held.join(rarest, "item").withColumn("confidence", F.col("support") / F.col("antecedent_support"))
    met = met.where(F.col("confidence") >= F.lit(float(minconf))).where(F.size("items") - F.size("antecedent") > longer)
    whole = F.size(F.array_intersect("antecedent", "items")) == F.size("antecedent")
    return met.where(whole).withColumn("consequent", F.array_except("items", "antecedent"))
