from __future__ import annotations

import random
from itertools import combinations

import pytest

from basketry.operators.redundancy import drop_redundant
from basketry.operators.rules import generate_rules
from basketry.operators.support import held_by_narrow, itemset_support
from basketry.plans.mining import frequent_itemsets, mine, pair_support, top_k_nr_rules, top_k_rules
from tests import brute


def item_rows(spark, baskets):
    rows = [(tid, item) for tid, basket in enumerate(baskets) for item in basket]
    return spark.createDataFrame(rows, "tid bigint, item bigint")


def random_baskets(seed, n=60, items=9, hot=0):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(items)]
    out = [set(rng.choices(range(items), weights, k=rng.randint(1, 5))) for _ in range(n)]
    return out + [set(range(items + 3)) for _ in range(hot)]


def test_toy_all_rules(spark):
    sets = frequent_itemsets(item_rows(spark, brute.TOY), 1)
    found = brute.rows(generate_rules(sets, 4, 0.8))
    expected = brute.rules(brute.TOY, 0.8)
    assert len(found) == 459
    assert brute.ranked(found) == expected
    by_support = [sum(r[2] == s for r in found) for s in (4, 3, 2, 1)]
    assert by_support == [2, 33, 70, 354]


def test_toy_non_redundant(spark):
    golden = [
        ((2,), (6,), 4), ((6,), (2,), 4), ((1,), (2, 5, 6), 3), ((5,), (1, 2, 6), 3), ((7,), (2, 6), 2),
        ((3,), (1, 2, 5, 6), 2), ((1, 7), (2, 3, 5, 6), 1), ((3, 7), (1, 2, 5, 6), 1),
        ((4,), (1, 2, 3, 5, 6), 1), ((5, 7), (1, 2, 3, 6), 1),
    ]
    found = brute.ranked(brute.rows(top_k_nr_rules(item_rows(spark, brute.TOY), 50, 0.8)))
    assert {r[:3] for r in found} == set(golden)
    sets = frequent_itemsets(item_rows(spark, brute.TOY), 1)
    dropped = brute.rows(drop_redundant(generate_rules(sets, 4, 0.8)))
    assert {r[:3] for r in dropped} == set(golden)


@pytest.mark.parametrize("start", [None, 1, 60])
def test_top_k_does_not_depend_on_start(spark, start):
    baskets = random_baskets(1)
    found = brute.rows(top_k_rules(item_rows(spark, baskets), 15, 0.4, start=start))
    assert brute.ranked(found) == brute.rules(baskets, 0.4)[:15]


@pytest.mark.parametrize(
    "seed,hot,width,k,minconf", [(2, 0, 64, 40, 0.6), (3, 1, 4, 5, 0.2), (4, 3, 3, 40, 0.6), (5, 2, 2, 10, 0.4)]
)
def test_top_k_with_wide_baskets(spark, seed, hot, width, k, minconf):
    baskets = random_baskets(seed, hot=hot)
    found = brute.rows(top_k_rules(item_rows(spark, baskets), k, minconf, max_len=4, width=width))
    assert brute.ranked(found) == brute.rules(baskets, minconf, 4)[:k]


@pytest.mark.parametrize("seed,width,k", [(6, 64, 30), (7, 3, 5)])
def test_top_k_nr(spark, seed, width, k):
    baskets = random_baskets(seed, n=40, hot=1)
    expected = brute.non_redundant(brute.rules(baskets, 0.5, 4))
    found = brute.rows(top_k_nr_rules(item_rows(spark, baskets), k, 0.5, max_len=4, width=width))
    assert brute.ranked(found) == expected[:k]


def test_many_items_use_the_head_only_as_a_start(spark):
    rng = random.Random(8)
    baskets = [set(rng.choices(range(400), k=5)) for _ in range(300)]
    baskets += [{1000 + i, 2000 + i} for i in range(3) for _ in range(4)]
    found = brute.rows(top_k_rules(item_rows(spark, baskets), 8, 0.3))
    assert brute.ranked(found) == brute.rules(baskets, 0.3)[:8]


def test_ties_all(spark):
    baskets = random_baskets(9)
    table = brute.rules(baskets, 0.3)
    cut = table[9][2]
    found = brute.rows(top_k_rules(item_rows(spark, baskets), 10, 0.3, ties="all"))
    assert brute.ranked(found) == [r for r in table if r[2] >= cut]


def test_bounded_buffer(spark):
    baskets = random_baskets(10)
    table, room = brute.rules(baskets, 0.3), 25
    while len(brute.non_redundant(table[:room])) < 20:
        room *= 2
    found = brute.rows(top_k_nr_rules(item_rows(spark, baskets), 20, 0.3, delta=5, exact=False))
    assert found == brute.non_redundant(table[:room])[:20]


def test_drop_redundant_on_a_partial_table(spark):
    baskets = random_baskets(11, n=25)
    table = [r for i, r in enumerate(brute.rules(baskets, 0.2)) if i % 3]
    df = spark.createDataFrame(
        [(list(a), list(c), s, x) for a, c, s, x in table],
        "antecedent array<bigint>, consequent array<bigint>, support bigint, antecedent_support bigint",
    )
    assert brute.ranked(brute.rows(drop_redundant(df))) == brute.non_redundant(table)


@pytest.mark.parametrize("width", [64, 3])
def test_frequent_itemsets(spark, width):
    baskets = random_baskets(12, hot=2)
    for count, max_len in ((4, None), (1, 3)):
        sets = frequent_itemsets(item_rows(spark, baskets), count, max_len, width=width)
        found = {tuple(r["items"]): r.support for r in sets.collect()}
        assert found == {s: c for s, c in brute.itemsets(baskets, max_len).items() if c >= count}


def test_pair_support_and_array_input(spark):
    baskets = random_baskets(13, hot=1)
    expected = {s: c for s, c in brute.itemsets(baskets, 2).items() if len(s) == 2 and c >= 3}
    arrays = spark.createDataFrame(
        [(f"t{t}", [*b, *b, None]) for t, b in enumerate(baskets)], "tid string, items array<bigint>"
    )
    for df in (item_rows(spark, baskets), arrays):
        for width in (64, 4):
            found = {(r.a, r.b): r.support for r in pair_support(df, 3, width=width).collect()}
            assert found == expected


def test_itemset_support(spark):
    baskets = random_baskets(14)
    wanted = [(0,), (0, 1), (0, 1, 2), (3, 5), (7, 8), (0, 99), (99,), (1, 0, 1), (2, 2), ()]
    df = spark.createDataFrame([(list(w),) for w in wanted], "items array<bigint>")
    found = {tuple(r["items"]): r.support for r in itemset_support(item_rows(spark, baskets), df).collect()}
    assert found == {w: sum(set(w) <= b for b in baskets) for w in wanted}


@pytest.mark.parametrize("width", [0, 1, 3, 64])
def test_itemset_support_of_narrow_and_wide_baskets(spark, width):
    baskets = random_baskets(15, n=40, hot=2)
    wanted = [w for n in range(5) for w in combinations(range(10), n)]
    df = spark.createDataFrame([(list(w),) for w in wanted], "items array<bigint>")
    rows = item_rows(spark, baskets).selectExpr("tid", "cast(item AS int) AS item")
    arrays = spark.createDataFrame([(t, [*b, *b, None]) for t, b in enumerate(baskets)], "tid bigint, items array<bigint>")
    for given in (rows.unionByName(rows), arrays):
        found = {tuple(r["items"]): r.support for r in itemset_support(given, df, width=width).collect()}
        assert found == {w: sum(set(w) <= b for b in baskets) for w in wanted}


def test_a_narrow_basket_found_goes_nowhere(spark):
    """Before, each basket found by a set was exchanged once more for each other item of the set."""
    narrow = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "c"])], "tid bigint, items array<string>")
    sets = [(0, 1, "a", []), (1, 2, "a", ["b"]), (2, 3, "b", ["a", "c"]), (3, 3, "a", ["b", "x"])]
    held = held_by_narrow(narrow, spark.createDataFrame(sets, "no bigint, n int, item string, others array<string>"))
    assert sorted(r.no for r in held.collect()) == [0, 0, 1, 2]
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan


def test_edges(spark):
    empty = item_rows(spark, [])
    assert top_k_rules(empty.limit(0), 5, 0.5).count() == 0
    assert top_k_nr_rules(empty.limit(0), 5, 0.5).count() == 0
    assert frequent_itemsets(empty.limit(0), 1).count() == 0
    assert top_k_rules(item_rows(spark, [{1}, {2}, {1}]), 5, 0.0).count() == 0
    one = brute.rows(top_k_rules(item_rows(spark, [{1, 2}]), 5, 0.5))
    assert brute.ranked(one) == [((1,), (2,), 1, 1), ((2,), (1,), 1, 1)]
    repeated = spark.createDataFrame(
        [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, None), (None, "a")], "tid bigint, item string"
    )
    assert brute.ranked(brute.rows(top_k_rules(repeated, 5, 0.0))) == [
        (("b",), ("a",), 1, 1), (("a",), ("b",), 1, 2),
    ]


def test_parameters(spark):
    df = item_rows(spark, brute.TOY)
    assert mine(df, "TOPK", k=2, minconf=0.8).count() == 2
    assert mine(df, "TOPKNR", k=2, minconf=0.8, delta=1).count() == 2
    for bad in (
        lambda: mine(df, "APRIORI", k=2, minconf=0.8),
        lambda: mine(df, "TOPK", k=2),
        lambda: mine(df, "TOPKNR", k=2, minconf=0.8),
        lambda: mine(df, "TOPK", k=0, minconf=0.8),
        lambda: mine(df, "TOPK", k=2, minconf=1.2),
        lambda: mine(df, "TOPKNR", k=2, minconf=0.5, delta=-1),
        lambda: top_k_rules(df, 2, 0.5, ties="some"),
        lambda: frequent_itemsets(df, 0),
    ):
        with pytest.raises(ValueError):
            bad()


def test_input_shape_does_not_matter(spark):
    baskets = random_baskets(15)
    df = item_rows(spark, baskets)
    plain = brute.ranked(brute.rows(top_k_rules(df, 12, 0.3)))
    shuffled = df.unionByName(df).repartition(7).orderBy("item")
    assert brute.ranked(brute.rows(top_k_rules(shuffled, 12, 0.3))) == plain


def test_long_itemsets_give_all_rules(spark):
    items = list(range(76))
    # nearly no X is known, so consequents of all lengths would be grown
    rows = [(items, 10)] + [([i for i in items if i != j], 10) for j in items]
    sets = spark.createDataFrame(rows, "items array<bigint>, support bigint")
    known = sets.unionByName(spark.createDataFrame([([0], 1000)], "items array<bigint>, support bigint"))
    want = {(tuple(i for i in items if i != j), (j,), 10, 10) for j in items}
    short = {((0,), tuple(i for i in s if i), 10, 1000) for s, _ in rows if 0 in s}
    for minconf, more in ((0.5, set()), (0.005, short)):
        rules = generate_rules(sets, 20, minconf, known, max_cells=100_000).collect()
        got = [(tuple(r.antecedent), tuple(r.consequent), r.support, r.antecedent_support) for r in rules]
        assert len(got) == len(set(got)) and set(got) == want | more
        assert all(r.confidence == r.support / r.antecedent_support and r.total == 20 for r in rules)
    every = [(list(s), 10 if len(s) >= 4 else 100) for n in range(1, 6) for s in combinations(range(5), n)]
    df = spark.createDataFrame(every, "items array<bigint>, support bigint")
    got, looked_up = (
        sorted((tuple(r.antecedent), tuple(r.consequent)) for r in generate_rules(df, 100, 0.5, **more).collect())
        for more in ({}, {"max_cells": 1})
    )
    assert got == looked_up and len(got) == len(set(got))
    counts = {tuple(s): c for s, c in every}
    want = {
        (a, tuple(i for i in s if i not in a))
        for s in counts for n in range(1, len(s)) for a in combinations(s, n) if counts[s] / counts[a] >= 0.5
    }
    assert set(got) == want


def test_one_long_consequent(spark):
    long = list(range(1, 25))
    rules = [([0], long, 5, 5), ([0], long[:3], 5, 5), ([0, 30], long[2:9], 5, 5), ([0, 30], [31], 5, 5), ([30], [1], 5, 5)]
    df = spark.createDataFrame(rules, "antecedent array<bigint>, consequent array<bigint>, support bigint, antecedent_support bigint")
    left = sorted((r.antecedent, r.consequent) for r in drop_redundant(df).collect())
    assert left == sorted([([0], long), ([0, 30], [31]), ([30], [1])])


def test_start_values_do_not_matter(spark):
    df = item_rows(spark, random_baskets(21, hot=1))
    answers = [
        brute.rows(top_k_rules(df, 25, 0.4, heads=heads, width=width, start=start))
        for heads, width, start in (({2: 200, 3: 50}, 64, None), ({2: 2}, 4, None), ({}, 3, 9), ({2: 5, 3: 4}, 2, 1))
    ]
    assert all(a == answers[0] for a in answers)


def test_search_parameters(spark):
    df = item_rows(spark, brute.TOY)
    for bad in ({"min_count": 0}, {"start": 0}, {"width": 0}, {"max_len": 1}):
        with pytest.raises(ValueError):
            top_k_rules(df, 2, 0.5, **bad)
