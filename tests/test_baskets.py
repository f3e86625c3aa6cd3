from __future__ import annotations

import random

from pyspark.sql import functions as F

from basketry.operators import baskets as bk
from basketry.operators import support
from basketry.plans import store

RECORDS = [
    ("s", "u1", "g1", "b"), ("s", "u1", "g1", "a"), ("s", "u1", "g1", "a"), ("s", "u1", "g2", None),
    ("s", "u2", "g1", "c"), (None, "u2", "g1", "d"), (None, "u2", "g1", "a"),
]


def records(spark):
    return spark.createDataFrame(RECORDS, "site string, user string, group string, item string")


def test_to_baskets(spark):
    found = {(r.site, r.user, r.group): list(r["items"]) for r in bk.to_baskets(records(spark)).collect()}
    assert found == {
        ("s", "u1", "g1"): ["a", "b"], ("s", "u2", "g1"): ["c"], (None, "u2", "g1"): ["a", "d"],
    }


def test_to_baskets_with_hot_keys(spark):
    plain = sorted(map(str, bk.to_baskets(records(spark)).collect()))
    for limit in (0, 1):  # with 0 every key is hot
        assert sorted(map(str, bk.to_baskets(records(spark), limit=limit).collect())) == plain


def test_a_null_single_key_is_no_basket(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "a"), (None, "b")], "tid bigint, item string")
    assert [tuple(r) for r in bk.to_baskets(rows, "tid").collect()] == [(1, ["a"])]
    assert bk.basket_profile(rows).first().n_baskets == 1


def test_hot_keys_are_exact(spark):
    rows = spark.range(3000).select(F.expr("CASE WHEN id < 1000 THEN -1 ELSE id DIV 4 END").alias("tid"))
    hot = bk.hot_keys(rows, ["tid"], 100)
    assert [r["key"]["tid"] for r in hot.collect()] == [-1]
    assert bk.hot_keys(rows, ["tid"], 1000) is None


def test_assign_tids(spark):
    keys = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(k, [k]) for k in keys], "key bigint, items array<bigint>").repartition(5)
    found = sorted((r.tid, r.key) for r in bk.assign_tids(df, "key").collect())
    assert found == list(enumerate(sorted(keys)))


def test_sort_and_explode(spark):
    df = spark.createDataFrame([(1, [1, 3, 2])], "tid bigint, items array<int>")
    assert list(bk.sort_items(df).first()["items"]) == [3, 2, 1]
    assert list(bk.sort_items(df, ascending=True).first()["items"]) == [1, 2, 3]
    assert {(r.tid, r.item) for r in bk.explode_baskets(df).collect()} == {(1, 1), (1, 2), (1, 3)}


def test_profile(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 9), (2, 5), (3, None)], "tid bigint, item int")
    row = bk.basket_profile(df).first()
    assert row.asDict() == {
        "n_baskets": 2, "n_items": 2, "n_pairs": 3, "min_item": 5, "max_item": 9, "item_range": 5,
    }
    empty = bk.basket_profile(df.where("tid > 9")).first()
    assert (empty.n_baskets, empty.n_items, empty.n_pairs, empty.min_item) == (0, 0, 0, None)
    assert "item_range" not in bk.basket_profile(records(spark).withColumn("tid", F.col("user"))).columns


def test_supports_and_index(spark):
    df = spark.createDataFrame([(t, i) for t in range(100) for i in {t % 2, t % 5, 7}] + [(3, 7)], "tid bigint, item int")
    counts = {r.item: r.support for r in support.item_support(df).collect()}
    assert counts[7] == 100 and counts[0] == sum(t % 2 == 0 or t % 5 == 0 for t in range(100))
    assert {r.item: r.occurrences for r in support.item_occurrences(df).collect()}[7] == 101
    blocks = support.vertical_index(df, block=16).where("item = 7").collect()
    assert len(blocks) == 7 and sum(r.n for r in blocks) == 100
    assert sorted(t for r in blocks for t in r.tids) == list(range(100))
    assert all(16 * r.block <= t < 16 * (r.block + 1) for r in blocks for t in r.tids)


def test_prepare_never_gathers_hot_transactions(spark):
    rows = [(-1, i % 30) for i in range(600)] + [(t, t % 7) for t in range(50)] + [(t, 20) for t in range(50)]
    df = spark.createDataFrame(rows, "tid bigint, item bigint")
    split = store.prepare(df, width=8, limit=100)
    assert (split.total, split.n_wide, split.n_items) == (51, 1, 30)
    assert split.narrow.count() == 50 and split.wide.count() == 30
    assert {r.item: r.support for r in split.supports.collect()}[20] == 51
    narrow, wide, n_wide = store.prune(split, 8)
    assert n_wide == 0 and wide is None  # few items are that frequent, so the basket is narrow now
    assert narrow.where("size(items) > 2").count() == 1
