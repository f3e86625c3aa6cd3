"""Column expressions over itemsets: sorted arrays without repeats or nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(items: str | Column) -> Column:
    """Sorted, distinct, null-free form of an item array."""
    return F.array_sort(F.array_distinct(F.array_compact(items)))


def itemset_text(items: str | Column, sep: str = ",") -> Column:
    """Itemset as one string, for display and for text sinks."""
    return F.array_join(F.col(items) if isinstance(items, str) else items, sep)


def overlap(given: Column, side: Column) -> Column:
    """Share of ``side`` that ``given`` contains, between 0 and 1."""
    return F.size(F.array_intersect(side, given)) / F.size(side)


def rule_order() -> list[Column]:
    """Ranking of rules: support, confidence, length, then the item lists."""
    return [
        F.desc("support"),
        F.desc("confidence"),
        F.asc(F.size("antecedent") + F.size("consequent")),
        F.asc("antecedent"),
        F.asc("consequent"),
    ]
