from __future__ import annotations

import pytest

from basketry.catalog.queries import QUERIES
from basketry.operators import lookup, recommend, usecases
from tests import brute

SCHEMA = (
    "antecedent array<bigint>, consequent array<bigint>, support bigint, antecedent_support bigint, "
    "total bigint, confidence double"
)
RULES = [
    ([1], [2], 8, 10, 20, 0.8),
    ([1, 2], [3, 4], 6, 8, 20, 0.75),
    ([2, 5, 6], [1], 5, 5, 20, 1.0),
    ([7], [8], 2, 4, 20, 0.5),
]


@pytest.fixture()
def rules(spark):
    return spark.createDataFrame(RULES, SCHEMA)


def test_by_side(rules):
    found = {tuple(r.antecedent): r.weight for r in lookup.rules_by_antecedent(rules, [1, 2], 0.3).collect()}
    assert found == {(1,): 1.0, (1, 2): 1.0, (2, 5, 6): pytest.approx(1 / 3)}
    assert {tuple(r.antecedent) for r in lookup.rules_by_antecedent(rules, "1, 2").collect()} == {(1,), (1, 2)}
    found = {tuple(r.consequent): r.weight for r in lookup.rules_by_consequent(rules, "3,8", 0.5).collect()}
    assert found == {(3, 4): 0.5, (8,): 1.0}
    for nothing in ([], "", " , "):
        with pytest.raises(ValueError):
            lookup.rules_by_antecedent(rules, nothing)


def test_classifier_rules(rules):
    found = {(tuple(r.antecedent), r.consequent, r.weight) for r in lookup.classifier_rules(rules).collect()}
    assert found == {((1,), 2, 1.0), ((1, 2), 3, 0.5), ((1, 2), 4, 0.5), ((2, 5, 6), 1, 1.0), ((7,), 8, 1.0)}


def test_json(rules):
    back = lookup.rules_from_json(lookup.rules_to_json(rules), "bigint")
    assert back.schema.simpleString() == rules.schema.simpleString()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rules.collect()))


def test_relative_support(rules):
    assert {r.relative_support for r in lookup.with_relative_support(rules).collect()} == {0.4, 0.3, 0.25, 0.1}


def brute_match(held, min_weight):
    out = set()
    for user, items in held.items():
        for ante, cons, *_ in RULES:
            weight = len(items & set(ante)) / len(ante)
            if weight > 0 and weight >= min_weight:
                out.add((user, tuple(ante), tuple(cons), round(weight, 9)))
    return out


@pytest.mark.parametrize("min_weight", [0.0, 0.34, 0.5, 2 / 3, 1.0])
def test_match_rules(spark, rules, min_weight):
    held = {"a": {1}, "b": {1, 2, 5}, "c": {2, 5, 6, 9}, "d": {6}, "e": {9}, "f": set(range(1, 9))}
    rows = spark.createDataFrame([(u, i) for u, items in held.items() for i in items] * 2, "user string, item bigint")
    found = {
        (r.user, tuple(r.antecedent), tuple(r.consequent), round(r.weight, 9))
        for r in recommend.match_rules(rows, rules, min_weight, ["user"]).collect()
    }
    assert found == brute_match(held, min_weight)


def test_last_transaction_and_recommend(spark, rules):
    records = spark.createDataFrame(
        [("s", "u", "g1", 9, 5), ("s", "u", "g2", 1, 7), ("s", "u", "g2", 2, 7), ("s", "u", "g2", 2, 7),
         ("s", "v", "g8", 7, 1), ("s", "v", "g9", 1, 1), ("s", "w", "g1", None, 1)],
        "site string, user string, group string, item bigint, timestamp bigint",
    )
    last = recommend.last_transaction(records)
    assert {(r.user, r.group, r.item) for r in last.collect()} == {("u", "g2", 1), ("u", "g2", 2), ("v", "g9", 1)}
    matched = recommend.user_rules(last, rules)
    best = recommend.recommend(matched, last, 2)
    assert {(r.user, r["rank"], r.item) for r in best.collect()} == {("u", 1, 3), ("u", 2, 4), ("v", 1, 2)}
    nested = {r.user: [tuple(i.antecedent) for i in r["items"]] for r in recommend.nest_user_rules(matched).collect()}
    assert nested == {"u": [(1,), (1, 2)], "v": [(1,)]}
    with pytest.raises(ValueError):
        recommend.recommend(matched, last, 0)


def test_use_cases(spark, rules):
    table = spark.createDataFrame([(1, "x", 3), (2, None, 4)], "id bigint, a string, b int")
    items = {r.tid: list(r["items"]) for r in usecases.attributes_to_items(table, {"a": "a", "bb": "b"}, "id").collect()}
    assert items == {1: ["a=x", "bb=3"], 2: ["bb=4"]}
    terms = spark.createDataFrame([("q", 1), ("q", 2), ("r", 9)], "q string, item bigint")
    found = {(r.q, r.term): r.added for r in usecases.expand_queries(terms, rules, ["q"]).collect()}
    assert found == {("q", 1): False, ("q", 2): False, ("q", 3): True, ("q", 4): True, ("r", 9): False}
    sales = spark.createDataFrame([(1, 0.2), (1, 0.0), (2, 0.1), (3, 0.01)], "item bigint, discount double")
    pairs = spark.createDataFrame([(1, 2, 5), (1, 3, 5)], "a bigint, b bigint, support bigint")
    assert [(r.a, r.b) for r in usecases.discount_conflicts(sales, pairs, 0.1).collect()] == [(1, 2)]
    assert {(r["item"], r.partner) for r in usecases.best_partner(rules).collect()} == {(1, 2), (7, 8)}
    sets = spark.createDataFrame([([1], 9), ([1, 2], 4), ([1, 3], 4), ([2, 3], 5)], "items array<bigint>, support bigint")
    assert {(r["item"], tuple(r["items"])) for r in usecases.bundles(sets).collect()} == {
        (1, (1, 2)), (2, (2, 3)), (3, (2, 3)),
    }


def test_match_rules_by_consequent_and_its_parameters(spark):
    rules = spark.createDataFrame(
        [([1], [2, 3], 4, 0.5), ([2], [4], 3, 0.5), ([5], [2], 3, 0.9), ([5], [], 1, 0.1)],
        "antecedent array<int>, consequent array<int>, support int, confidence double",
    )
    held = spark.createDataFrame([("s", "u", 2), ("s", "u", 9), ("s", "v", 4), ("s", "v", 4)], "site string, user string, item int")
    got = recommend.match_rules(held, rules, 0.5, side="consequent").collect()
    assert sorted((r.user, r.antecedent, r.weight) for r in got) == [("u", [1], 0.5), ("u", [5], 1.0), ("v", [2], 1.0)]
    for bad in ({"min_weight": 1.5}, {"min_weight": -1}, {"side": "both"}):
        with pytest.raises(ValueError):
            recommend.match_rules(held, rules, **bad)


def test_queries_are_expanded_by_rules_of_several_words(spark, tmp_path):
    said = ["red wine glass", "red wine glass", "red wine", "red shoes", "red hat", "red car", "wine bar", "wine shop",
            "wine list", "Wine  cellar", "glass door", "red", "blue"]
    rows = [(c, 0, "user", t) for c, t in enumerate(said)] + [(0, 1, "assistant", "wine blue")]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    baskets = [set(t.lower().split()) for t in said]

    def expanded(rules):
        return {(c, i) for c, b in enumerate(baskets) for a, x, *_ in rules if set(a) <= b for i in x if i not in b}

    want = expanded(brute.rules(baskets, 0.3)[:200])
    got = QUERIES["expand_queries_all"](spark, str(tmp_path)).collect()
    assert {(r.conv_id, r.term) for r in got if r.added} == want
    assert {(r.conv_id, r.term) for r in got if not r.added} == {(c, i) for c, b in enumerate(baskets) for i in b}
    pairs = QUERIES["expand_queries"](spark, str(tmp_path)).where("added").collect()
    assert want - {(r.conv_id, r.term) for r in pairs}  # words that take a rule of several


def test_clusters_of_baskets_of_several_items(spark):
    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").distinct().count()
    got = QUERIES["cluster_brand_baskets"](spark, sf).collect()
    assert len(got) == len({r.tid for r in got}) == lines and len({r.cluster for r in got}) == 3
    values = [r.value.split("|") for r in QUERIES["cluster_part_lines"](spark, sf).collect()]
    assert len(values) == lines and max(len(line.split(" ")) for _, line in values) > 1
