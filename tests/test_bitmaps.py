from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from basketry import runs
from basketry.operators.bitmaps import itemset_support_bitmap, store_bitmap, vertical_bitmap
from basketry.operators.support import itemset_support, vertical_index

ROWS = [(1, "a"), (1, "b"), (1, "b"), (2, "a"), (32768, "a"), (32768, "b"), (32769, "b"), (40000, "a"), (40000, "b"), (40000, "c"),
        (0, "a"), (0, "c"), (None, "a"), (5, None), (100000, "d")]


def test_bits_stand_for_the_ids(spark):
    rows = spark.createDataFrame(ROWS, "tid bigint, item string")
    found = {}
    for r in vertical_bitmap(rows).collect():
        assert r.n == sum(bin(b).count("1") for b in r.bits) and len(r.bits) == 4096
        places = [k for k in range(32768) if r.bits[k // 8] >> (k % 8) & 1]
        ids = [(r.block - 1) * 32768 + k + 1 if r.block > 0 else -k for k in places]
        found.setdefault(r["item"], set()).update(ids)
    want = {}
    for r in vertical_index(rows).collect():
        want.setdefault(r["item"], set()).update(r.tids)
    assert found == want
    assert vertical_bitmap(rows.limit(0)).count() == 0


def test_few_bytes_of_rows_do_not_make_few_tasks(spark):
    """Before, tasks were merged by the bytes of the rows, a hundredth of those of the blocks they make."""
    rows = spark.createDataFrame([(t, t % 3) for t in range(30)], "tid bigint, item int")
    index = vertical_bitmap(rows)
    assert index.groupBy().sum("n").first()[0] == 30
    plan = index._jdf.queryExecution().executedPlan().toString()
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    assert f"{parts}), REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan


def test_supports_equal_those_by_lists(spark):
    rows = spark.createDataFrame(ROWS, "tid bigint, item string")
    sets = [["a"], ["b", "a"], ["a", "b"], ["a", "b", "c"], ["c", "d"], ["x"], ["a", "x"], [], ["b", None, "b"], ["d"]]
    given = spark.createDataFrame([(s,) for s in sets], "items array<string>")
    got = itemset_support_bitmap(store_bitmap(rows), given).collect()
    want = itemset_support(rows, given).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == len(sets)


def test_bits_are_dealt_once_however_many_itemsets_ask(spark):
    dense = spark.range(1, 40000).selectExpr("id AS tid", "explode(filter(array('a', 'b', 'c'), (x, i) -> id % (i + 1) = 0)) AS item")
    rows = dense.unionByName(spark.createDataFrame([(6, "r"), (7, "r"), (35000, "r"), (6, "s"), (35000, "s")], dense.schema))
    names = ["a", "b", "c", "r", "s"]
    sets = [[x for i, x in enumerate(names) if m >> i & 1] for m in range(1, 32)]
    given = spark.createDataFrame([(s,) for s in sets], "items array<string>")
    found = itemset_support_bitmap(store_bitmap(rows), given)
    held = {r.tid: set(r["items"]) for r in rows.groupBy("tid").agg(F.collect_set("item").alias("items")).collect()}
    want = {tuple(s): sum(set(s) <= h for h in held.values()) for s in sets}
    assert {tuple(r["items"]): r.support for r in found.collect()} == want
    # before, a copy of 4 KB was combined and exchanged for every set, block and item
    assert "bitmap_and_agg" not in found._jdf.queryExecution().toString()


def test_of_a_pair_the_join_is_enough(spark):
    rows = spark.createDataFrame(ROWS, "tid bigint, item string")
    given = spark.createDataFrame([(["a", "b"],), (["c", "a"],), (["a", "b", "c"],), (["a"],), (["a", "x"],)], "items array<string>")
    found = itemset_support(rows, given)
    got = {tuple(r["items"]): r.support for r in found.collect()}
    assert got == {("a", "b"): 3, ("c", "a"): 2, ("a", "b", "c"): 1, ("a",): 5, ("a", "x"): 0}
    # before, every basket found was grouped with the set as an array, pairs too
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate [" in line and "tid#" in line and "items#" in line]
    assert not grouped


def test_of_two_starters_one_runs(spark, tmp_path):
    baskets = spark.createDataFrame([(1, [1, 2]), (2, [1, 2])], "tid bigint, items array<bigint>")
    root, log = str(tmp_path / "rules"), str(tmp_path / "log")

    def start(_):
        try:
            return runs.train(baskets, "TOPK", root, log, "one", k=1, minconf=0.5).count()
        except ValueError as error:
            return str(error)

    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(start, range(4)))
    assert sorted(map(str, found)) == ["1"] + ["run 'one' has been started before"] * 3
    assert runs.run_status(spark, log, "one") == "finished"


def test_a_reader_never_sees_half_a_run(spark, tmp_path):
    root = str(tmp_path / "rules")
    rules = spark.createDataFrame([(i,) for i in range(6)], "support bigint").repartition(3)
    runs.store_rules(rules, root, "s", "u/1")
    reader = runs.get_rules(spark, root, "s", "u/1")  # has the files' names, has not read them
    runs.store_rules(rules.where("support < 2"), root, "s", "u/1")
    assert reader.count() == 6 and runs.get_rules(spark, root, "s", "u/1").count() == 2

    bad = rules.selectExpr("IF(support = 5, raise_error('lost'), support) AS support")
    with pytest.raises(Exception, match="lost"):
        runs.store_rules(bad, root, "s", "u/1")  # dies half-way: the pointer still names the last whole run
    assert runs.get_rules(spark, root, "s", "u/1").count() == 2
    runs.store_rules(rules.limit(1), root, "s", "u/1")
    assert runs.get_rules(spark, root, "s", "u/1").count() == 1
