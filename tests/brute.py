"""Plain-Python answers for small fixtures, independent of the Spark code."""

from __future__ import annotations

from itertools import combinations

TOY = [{1, 2, 3, 5, 6, 7}, {1, 2, 3, 4, 5, 6}, {1, 2, 5, 6}, {2, 6, 7}]


def itemsets(baskets, max_len=None):
    counts = {}
    for basket in baskets:
        items = sorted(basket)
        for size in range(1, min(len(items), max_len or len(items)) + 1):
            for combo in combinations(items, size):
                counts[combo] = counts.get(combo, 0) + 1
    return counts


def rules(baskets, minconf, max_len=None, min_count=1):
    """(antecedent, consequent, support, antecedent support), best first."""
    counts = itemsets(baskets, max_len)
    found = []
    for union, support in counts.items():
        if support < min_count:
            continue
        for size in range(1, len(union)):
            for ante in combinations(union, size):
                if support / counts[ante] >= minconf:
                    cons = tuple(i for i in union if i not in ante)
                    found.append((ante, cons, support, counts[ante]))
    return sorted(found, key=lambda r: (-r[2], -r[2] / r[3], len(r[0]) + len(r[1]), r[0], r[1]))


def non_redundant(table):
    groups = {}
    for rule in table:
        groups.setdefault(rule[2:], []).append(rule)
    kept = []
    for rule in table:
        ante, cons = set(rule[0]), set(rule[1])
        if not any(
            other is not rule and set(other[0]) <= ante and cons <= set(other[1]) for other in groups[rule[2:]]
        ):
            kept.append(rule)
    return kept


def rows(df):
    """A rule DataFrame in the shape of ``rules``, in its own order."""
    return [
        (tuple(r.antecedent), tuple(r.consequent), r.support, r.antecedent_support) for r in df.collect()
    ]


def ranked(found):
    return sorted(found, key=lambda r: (-r[2], -r[2] / r[3], len(r[0]) + len(r[1]), r[0], r[1]))
